"""Exact line dedup that returns keep bitmaps (operator 5, native)."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE_CHARS, cut, text_or_empty

MIN_CHARS = 20
MIN_DOCS = 3


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased, all else unchanged.

    A line of ASCII alone takes lower(), which is faster and there the same.
    """
    bare = F.btrim(line, F.lit(SPACE_CHARS))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, th, line, h1, h2): the lines with keys long enough, by a 128-bit hash of the
    key; ``th`` hashes the whole text, as rows of one key may have different ones."""
    said = text_or_empty(docs, text)
    rows = docs.select(F.col(key).alias("doc"), F.xxhash64(said).alias("th"), F.posexplode(F.split(said, "\n", -1)).alias("line", "said"))
    rows = rows.filter(F.length("said") >= MIN_CHARS).select("doc", "th", "line", line_key(F.col("said")).alias("said"))
    rows = rows.filter(F.length("said") >= MIN_CHARS)
    return rows.select("doc", "th", "line", F.xxhash64("said").alias("h1"), F.xxhash64(F.lit("second"), "said").alias("h2"))


def repeated_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, last): keys found in ``min_docs`` documents, with the largest of them.

    Lines are range-partitioned by (hash, document), so that a hash with a third of all
    lines spans many ranges, and sorted by document and position within it. Streaming
    past them keeps the first occurrence of a key in each document (one pass, no further
    exchange); each range then sends one row for each key: its documents and the last.
    """
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = lines.select("h1", "h2", "doc", "line").repartitionByRange(parts, "h1", "h2", "doc").sortWithinPartitions("h1", "h2", "doc", "line")
    once = ranged.groupBy("h1", "h2", "doc").agg(F.min("line").alias("line"))
    found = once.groupBy("h1", "h2").agg(F.count("doc").alias("n"), F.max("doc").alias("last"))
    return found.filter(F.col("n") >= min_docs).select("h1", "h2", "last")


def dropped_runs(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """(doc, th, _drops): each text's runs of dropped lines, as (first line, lines), in order.

    A run is what has one difference of line and rank: a window over one document's
    dropped lines, so nothing is looked up line by line in a document's list.
    """
    hits = lines.join(repeated, ["h1", "h2"]).filter(F.col("doc") < F.col("last")).select("doc", "th", "line").distinct()
    order = Window.partitionBy("doc", "th").orderBy("line")
    runs = hits.withColumn("_run", F.col("line") - F.row_number().over(order)).groupBy("doc", "th", "_run")
    runs = runs.agg(F.min("line").alias("at"), F.count(F.lit(1)).cast("int").alias("n"))
    return runs.groupBy("doc", "th").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("_drops"))


def keep_runs(n: Column, drops: Column) -> Column:
    """A compressed keep bitmap: lengths of runs of kept, dropped, kept, ... lines.

    ``drops``: an array column of the dropped runs (at, n) among ``n`` lines, in order.
    """
    last = F.element_at(drops, -1)
    before = F.transform(drops, lambda d, i: F.array(d["at"] - F.when(i == 0, 0).otherwise(F.get(drops, i - 1)["at"] + F.get(drops, i - 1)["n"]), d["n"]))
    return F.when(F.coalesce(F.size(drops), F.lit(0)) <= 0, F.array(n)).otherwise(F.concat(F.flatten(before), F.array(n - last["at"] - last["n"])))


def keep_bitmaps(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """Adds ``n_lines``, ``n_dropped`` and ``keep_runs`` to ``docs``; texts stay as they are.

    A text is split at \\n (null or empty: one empty line). A line whose key (see
    :func:`line_key`) has ``MIN_CHARS`` code points and is found in ``min_docs``
    documents is dropped, except in the largest ``key`` that holds it, which keeps all
    its copies. Rows that share a key value count as one document; rows with a null key
    are never dropped and count for none. ``keep_runs`` are the bitmap's run lengths, kept first.
    Other columns pass through, whatever their names, but give way to the three. No rows:
    no rows.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "keep_runs")]
    docs = docs.select(*names)
    # Hashes without texts, read three times below: sampled for the ranges, dealt, joined.
    lines = cut(lines_of(docs.filter(F.col(key).isNotNull()), key, text))
    drops = cut(dropped_runs(lines, cut(repeated_lines(lines, min_docs))))
    said = text_or_empty(docs, text)
    rows = docs.select(F.struct(*[F.col(c) for c in names]).alias("row"), F.col(key).alias("k"), F.xxhash64(said).alias("h"), F.size(F.split(said, "\n", -1)).alias("n"))
    joined = rows.hint("merge").join(drops, (rows["k"] == drops["doc"]) & (rows["h"] == drops["th"]), "left")
    dropped = F.aggregate(F.coalesce("_drops", F.array().cast("array<struct<at:int,n:int>>")), F.lit(0), lambda s, d: s + d["n"])
    done = joined.select("row", F.col("n").cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"), keep_runs(F.col("n"), F.col("_drops")).alias("keep_runs"))
    return done.select("row.*", "n_lines", "n_dropped", "keep_runs")


def kept_text(text: Column, runs: Column) -> Column:
    """The kept lines of ``text``, joined by \\n, read off the bitmap: the bitmap is
    written out and zipped with the lines, in one pass."""
    flags = F.flatten(F.transform(runs, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    kept = F.zip_with(F.split(F.coalesce(text, F.lit("")), "\n", -1), flags, lambda line, keep: F.when(keep, line))
    return F.when(F.size(runs) == 1, F.coalesce(text, F.lit(""))).otherwise(F.array_join(kept, "\n"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = keep_bitmaps(docs)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(kept_text(F.col("text"), F.col("keep_runs")), 256).alias("kept_sha256"), F.concat_ws(",", F.col("keep_runs").cast("array<string>")).alias("keep_runs"))


#: DuckDB: the same by window functions over the lines' whole keys.
SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM t),
e AS (SELECT doc_id, unnest(ls) AS said, generate_subscripts(ls, 1) AS i FROM s),
k AS (SELECT doc_id, i, said,
  translate(trim(said, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id < r.last AS gone FROM k LEFT JOIN r ON k.key = r.key),
g AS (SELECT doc_id, gone, i, i - row_number() OVER (PARTITION BY doc_id, gone ORDER BY i) AS island FROM j),
u AS (SELECT doc_id, gone, min(i) AS first, count(*) AS n FROM g GROUP BY doc_id, gone, island),
b AS (SELECT doc_id, CASE WHEN arg_min(gone, first) THEN '0,' ELSE '' END || string_agg(n::VARCHAR, ',' ORDER BY first)
  || CASE WHEN arg_max(gone, first) THEN ',0' ELSE '' END AS keep_runs FROM u GROUP BY doc_id),
o AS (SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(said, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
  FROM j GROUP BY doc_id)
SELECT doc_id, n_lines, n_dropped, kept_sha256, keep_runs FROM o JOIN b USING (doc_id)
"""
