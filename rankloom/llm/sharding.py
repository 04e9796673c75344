"""Sharding by proportional stratified interleaving (operator 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, digest, digest_unit, ranked, text_or_empty

SEED = 20_240_817


def shard(docs: DataFrame, n_shards: int = 8, *, stratum: str = "source", key: str = "doc_id", seed: int = SEED, rows: int = 2048) -> DataFrame:
    """Deals all rows into ``n_shards`` shards that each match the mixture of strata.

    Rows are shuffled by a seeded hash within their stratum; a row of rank r among n has
    the fractional rank (r + u) / n, where u in [0, 1) is a seeded hash of the stratum (so
    that many small strata spread over all shards, instead of all at 1/2); rows are
    ordered by it and cut into ``n_shards`` runs whose row counts differ by one at most. Returns key, stratum, ``size`` (UTF-8
    bytes plus 1), ``text_crc32``, ``shard``, and ``slot`` (the place in the shard, from
    0, without gaps).

    Law: ``rows``. A null stratum is a stratum of its own; a null text has size 1 and
    the checksum of no bytes; repeated rows each get a slot of their own (which of two
    equal rows gets which is all one); other columns are ignored; no rows give no rows.
    """
    text = text_or_empty(docs)
    base = docs.select(F.col(key).alias("_key"), F.col(stratum).alias("_stratum"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    base = cut(base.withColumn("_u", digest(F.lit(seed), F.col("_key"), F.col("text_crc32"), F.col("size"))).withColumn("_at", digest_unit(F.col("_u"))))
    placed = ranked(base, ["_stratum"], "_at", ["_u", "_key", "text_crc32", "size"], rows)
    placed = placed.withColumn("_tie", digest(F.lit(seed + 1), F.col("_stratum"))).withColumn("_f", (F.col("_rank") + digest_unit(F.col("_tie"))) / F.col("_size"))
    placed = cut(placed.select("_key", "_stratum", "size", "text_crc32", "_u", "_f", "_tie", F.lit(0).alias("_all")))
    placed = ranked(placed, ["_all"], "_f", ["_tie", "_u", "_key", "text_crc32", "size"], rows, "_pos", "_total")
    n = F.lit(n_shards)
    placed = placed.withColumn("shard", F.expr(f"(_pos * {n_shards}) div _total"))
    first = F.expr(f"(shard * _total + {n_shards - 1}) div {n_shards}")
    return placed.select(F.col("_key").alias(key), F.col("_stratum").alias(stratum), "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("_pos") - first).cast("long").alias("slot"), n.alias("n_shards"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard(docs).select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: DuckDB: the same order by window functions; the checksum folds each text's bytes over
#: the table of its polynomial (a fixed value: 0xEDB88320).
SQL = f"""
WITH RECURSIVE steps AS (SELECT i::UBIGINT AS i, i::UBIGINT AS c, 0 AS n FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM steps WHERE n < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE n = 8),
d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
b AS (SELECT doc_id, source, strlen(text) + 1 AS size, xor(list_reduce(list_prepend(4294967295::UBIGINT,
    list_transform(range(strlen(text)), lambda k: ('0x' || substr(hex(encode(text)), 2 * k + 1, 2))::UBIGINT)),
    lambda a, x: xor(a >> 8, t[(xor(a, x) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS text_crc32 FROM d, crc),
u AS (SELECT *, md5(concat_ws('|', '{SEED}', coalesce(doc_id::VARCHAR, 'null'), text_crc32::VARCHAR, size::VARCHAR)) AS u, md5('{SEED + 1}|' || coalesce(source, 'null')) AS tie FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY u, doc_id, text_crc32, size) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM u),
f AS (SELECT *, (r + ('0x' || substr(tie, 1, 13))::BIGINT::DOUBLE / 4503599627370496::DOUBLE) / n AS f FROM r),
p AS (SELECT *, row_number() OVER (ORDER BY f, tie, u, doc_id, text_crc32, size) - 1 AS pos, count(*) OVER () AS total FROM f),
s AS (SELECT *, pos * 8 // total AS shard FROM p)
SELECT doc_id, source, size, text_crc32, 'rows' AS law, shard::INT AS shard, pos - (shard * total + 7) // 8 AS slot, NULL::INT AS grown_shard FROM s
"""
