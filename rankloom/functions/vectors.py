"""Expressions over array<double> vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def equalize_norms(items: DataFrame, vector: str = "v", out: str = "v") -> DataFrame:
    """Appends sqrt(max |v|^2 - |v|^2), so all vectors are as long as the longest and inner
    product order is cosine order; queries append 0 (:func:`pad_query`)."""
    longest = items.agg(F.max(F.aggregate(F.col(vector), F.lit(0.0), lambda s, x: s + x * x)).alias("_max"))
    square = F.aggregate(F.col(vector), F.lit(0.0), lambda s, x: s + x * x)
    slack = F.sqrt(F.greatest(F.col("_max") - square, F.lit(0.0)))
    return items.join(F.broadcast(longest)).withColumn(out, F.array_append(F.col(vector), slack)).drop("_max")


def pad_query(vector: Column) -> Column:
    return F.array_append(vector, F.lit(0.0))
