"""Conditions on queries: each adds a boolean column, never a null."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Condition:
    """``fit(log)`` learns what is needed; ``mark(queries, out)`` adds the verdict."""

    def fit(self, log: DataFrame) -> Condition:
        return self

    def mark(self, queries: DataFrame, out: str = "holds") -> DataFrame:
        raise NotImplementedError

    def __invert__(self) -> Condition:
        return Not(self)

    def __and__(self, other: Condition) -> Condition:
        return AllOf(self, other)

    def __or__(self, other: Condition) -> Condition:
        return AnyOf(self, other)


class KnownUser(Condition):
    """The user has interactions."""

    def fit(self, log: DataFrame) -> Condition:
        self.users = log.select("user_id").distinct().withColumn("_k", F.lit(True))
        return self

    def mark(self, queries: DataFrame, out: str = "holds") -> DataFrame:
        return queries.join(self.users, "user_id", "left").withColumn(out, F.col("_k").isNotNull()).drop("_k")


class MinInteractions(Condition):
    """The user has at least ``n`` rows of interactions."""

    def __init__(self, n: int = 5):
        self.n = n

    def fit(self, log: DataFrame) -> Condition:
        self.counts = log.groupBy("user_id").agg(F.count(F.lit(1)).alias("_c"))
        return self

    def mark(self, queries: DataFrame, out: str = "holds") -> DataFrame:
        return queries.join(self.counts, "user_id", "left").withColumn(out, F.coalesce("_c", F.lit(0)) >= self.n).drop("_c")


class QueryIn(Condition):
    """The user is among ``ids``: a list, or a table with user_id for long ones."""

    def __init__(self, ids: Iterable | DataFrame):
        self.ids = ids

    def mark(self, queries: DataFrame, out: str = "holds") -> DataFrame:
        if isinstance(self.ids, DataFrame):
            ids = self.ids.select("user_id").distinct().withColumn("_k", F.lit(True))
            return queries.join(ids, "user_id", "left").withColumn(out, F.col("_k").isNotNull()).drop("_k")
        return queries.withColumn(out, F.coalesce(F.col("user_id").isin(list(self.ids)), F.lit(False)))


class When(Condition):
    """A condition on the query's own columns, e.g. its context."""

    def __init__(self, column: Column | Callable[[DataFrame], Column]):
        self.column = column

    def mark(self, queries: DataFrame, out: str = "holds") -> DataFrame:
        column = self.column(queries) if callable(self.column) else self.column
        return queries.withColumn(out, F.coalesce(column.cast("boolean"), F.lit(False)))


class Not(Condition):
    def __init__(self, inner: Condition):
        self.inner = inner

    def fit(self, log: DataFrame) -> Condition:
        self.inner.fit(log)
        return self

    def mark(self, queries: DataFrame, out: str = "holds") -> DataFrame:
        return self.inner.mark(queries, out).withColumn(out, ~F.col(out))


class _Many(Condition):
    def __init__(self, *parts: Condition):
        if not parts:
            raise ValueError("at least one condition is needed")
        self.parts = parts

    def fit(self, log: DataFrame) -> Condition:
        for p in self.parts:
            p.fit(log)
        return self

    def join(self, columns: list[Column]) -> Column:
        raise NotImplementedError

    def mark(self, queries: DataFrame, out: str = "holds") -> DataFrame:
        names = [f"_{out}{i}" for i in range(len(self.parts))]
        for p, name in zip(self.parts, names, strict=True):
            queries = p.mark(queries, name)
        return queries.withColumn(out, self.join([F.col(n) for n in names])).drop(*names)


class AllOf(_Many):
    def join(self, columns: list[Column]) -> Column:
        out = columns[0]
        for c in columns[1:]:
            out = out & c
        return out


class AnyOf(_Many):
    def join(self, columns: list[Column]) -> Column:
        out = columns[0]
        for c in columns[1:]:
            out = out | c
        return out
