"""Ranks and normalisations within groups, built from Spark's windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _sound(value: str) -> Column:
    return F.when(~F.isnan(F.col(value).cast("double")), F.col(value))


def average_rank(df: DataFrame, group: Sequence[str], value: str, out: str, *, descending: bool = True) -> DataFrame:
    """1-based rank in which ties share their mean; null and NaN are unranked (null) and
    push nobody down."""
    df = df.withColumn("_v", _sound(value))
    missing = F.col("_v").isNull()
    order = F.desc("_v") if descending else F.asc("_v")
    ranks = F.rank().over(Window.partitionBy(*group, missing).orderBy(order))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*group, "_v"))
    return df.withColumn(out, F.when(~missing, ranks + (ties - 1) / F.lit(2.0))).drop("_v")


def percentile_rank(df: DataFrame, group: Sequence[str], value: str, out: str) -> DataFrame:
    """Average rank from 0 for the least to 1 for the greatest; a lone value has 0.5."""
    df = average_rank(df, group, value, "_rank", descending=False)
    n = F.count("_rank").over(Window.partitionBy(*group))
    return df.withColumn(out, F.when(n == 1, F.when(F.col("_rank").isNotNull(), 0.5)).otherwise(F.try_divide(F.col("_rank") - 1, n - 1))).drop("_rank")


def zscore(df: DataFrame, group: Sequence[str], value: str, out: str) -> DataFrame:
    """(value - mean) / population deviation; 0 where all values are equal."""
    w = Window.partitionBy(*group)
    df = df.withColumn("_v", _sound(value))
    spread = F.stddev_pop("_v").over(w)
    return df.withColumn(out, F.when(F.col("_v").isNotNull(), F.when(spread > 0, (F.col("_v") - F.avg("_v").over(w)) / spread).otherwise(0.0))).drop("_v")


def normalize(df: DataFrame, group: Sequence[str], value: str, out: str, how: str | None) -> DataFrame:
    if how in (None, "none"):
        return df.withColumn(out, F.col(value))
    return {"rank": percentile_rank, "zscore": zscore}[how](df, group, value, out)


def reciprocal_rank(ranks: Sequence[Column], k: float = 60, weights: Sequence[float] | None = None) -> Column:
    """Sum of weight / (k + rank) over the ranks that are not null."""
    weights = weights or [1.0] * len(ranks)
    total = F.lit(0.0)
    for r, w in zip(ranks, weights, strict=True):
        total = total + F.coalesce(F.lit(float(w)) / (F.lit(float(k)) + r), F.lit(0.0))
    return total
