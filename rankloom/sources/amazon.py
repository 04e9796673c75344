"""Amazon ratings: a headerless CSV of reviewer, item, rating, timestamp."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.splits import k_core


def ratings(spark: SparkSession, path: str) -> DataFrame:
    """A malformed row is an error."""
    return spark.read.csv(path, schema="user_id STRING, item_id STRING, rating DOUBLE, timestamp LONG", mode="FAILFAST")


def five_core(log: DataFrame, k: int = 5) -> DataFrame:
    """One pass of the k-core on the raw rows, then users left with fewer than k rows go;
    items are not filtered again."""
    kept = k_core(log, k)
    users = kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") >= k).select("user_id")
    return kept.join(users, "user_id", "left_semi")


def codes(log: DataFrame, column: str) -> DataFrame:
    """(column, code): ids ranked from 0 in their order, by ranges, so no task ranks all."""
    from pyspark.sql.window import Window

    from ..session import cut

    parts = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = cut(log.select(column).distinct().repartitionByRange(parts, column).withColumn("_p", F.spark_partition_id()))
    sizes = ids.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(column)) - 1
    return ids.join(F.broadcast(starts), "_p").select(column, (F.col("_b") + place).alias("code"))
