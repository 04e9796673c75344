"""From raw documents to pieces: quality rules, line dedup, near-dedup, mixing, encoding."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import lines, mixing, neardup, pieces, quality
from rankloom.llm.common import checkpoint_dir, cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The mixture takes each document once at most, and this share of all tokens.
BUDGET_SHARE = 0.8


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and all certified cutoffs of their language."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality.judge(docs.select(*COLUMNS), labels).filter("kept").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that their keep bitmaps drop; every document stays."""
    done = lines.keep_bitmaps(docs.select(*COLUMNS))
    done = done.withColumn("text", lines.kept_text(F.col("text"), F.col("keep_runs")))
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return neardup.keep_first(docs.select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, at most once each."""
    docs = docs.select(*COLUMNS)
    taken = mixing.mix(docs, weights=mixing.WEIGHTS, budget_share=BUDGET_SHARE, max_epochs=1).filter("epochs > 0")
    taken = cut(taken.select(F.col("doc_id").alias("_k"), "_h").distinct())
    text = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(taken.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(taken["_k"]) & (text == taken["_h"]), "left_semi")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's piece ids, with the proof that they decode to its text."""
    return pieces.encode(docs.select("doc_id", "text", "lang", "source"))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_stage),
    ("mixing to target weights", mixing_stage),
    ("SentencePiece encoding", encoding_stage),
]

#: SQL cannot express the signatures, the binomial tests and the lattice.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            files.delete(path(f"{folder}/{k - 1}"), True)
    return docs
