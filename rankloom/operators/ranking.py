"""Filters and top-k of the ranking path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import InsufficientData


def as_queries(users: DataFrame) -> DataFrame:
    """Queries (qid, user_id, ...): where no qid is given, each user is a query."""
    return users if "qid" in users.columns else users.withColumn("qid", F.col("user_id"))


def restrict(scored: DataFrame, candidates: DataFrame | None) -> DataFrame:
    """Only ``candidates`` (item_id); None: all."""
    return scored if candidates is None else scored.join(candidates.select("item_id").distinct(), "item_id", "left_semi")


def exclude(scored: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """Without ``pairs`` (user_id, item_id), for every query of that user."""
    return scored if pairs is None else scored.join(pairs.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def not_taken(scored: DataFrame, taken: DataFrame) -> DataFrame:
    """Without the (qid, item_id) of ``taken``."""
    return scored.join(taken.select("qid", "item_id"), ["qid", "item_id"], "left_anti")


def top_k(scored: DataFrame, k: int | Column, score: str = "score") -> DataFrame:
    """The k best of each query, by score, then item: adds ``rank`` from 1. Spark plans a
    rank limit before the exchange, so no query's whole list is moved."""
    order = Window.partitionBy("qid").orderBy(F.desc(score), F.asc("item_id"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def rank_rows(df: DataFrame, *order: Column | str, out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy("qid").orderBy(*order)))


#: The first places of a list go to all tasks as one array, up to this length.
PREFIX = 100_000


def first_places(need: DataFrame, items: DataFrame, order: Sequence[Column | str], k: int) -> DataFrame:
    """(qid, user_id, item_id, score): for each query of ``need`` (qid, user_id, _t) the first
    ``_t`` + k of ``items`` (item_id, score) in ``order``.

    Only as many places are ranked as the longest of these lists has. Up to PREFIX of them
    each query takes its slice of one array; beyond that queries and places meet by rank.
    """
    most = int(need.agg(F.max("_t")).first()[0] or 0) + k
    first = items.select("item_id", "score").orderBy(*order).limit(most)
    first = first.withColumn("_n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    if most > PREFIX:
        need = need.withColumn("_n", F.explode(F.sequence(F.lit(1), (F.col("_t") + k).cast("int"))))
        return need.join(first, "_n").select("qid", "user_id", "item_id", "score")
    whole = first.agg(F.array_sort(F.collect_list(F.struct("_n", "item_id", "score"))).alias("_list"))
    met = need.join(F.broadcast(whole)).withColumn("_e", F.explode(F.slice("_list", F.lit(1), (F.col("_t") + k).cast("int"))))
    return met.select("qid", "user_id", "_e.item_id", "_e.score")


def zero_fill(queries: DataFrame, reached: DataFrame, items: DataFrame, k: int, blocked: DataFrame | None = None) -> DataFrame:
    """``reached`` (qid, user_id, item_id, score) with items that score exactly 0 because
    nothing reached them: the first k of each query in item order that are neither
    reached nor ``blocked`` (user_id, item_id).

    Among the first k + n items, n of them reached or blocked, k are left; so each query
    takes a prefix of the item list (:func:`first_places`). ``reached`` is read twice.
    """
    taken = reached.select("qid", "item_id")
    if blocked is not None:
        taken = taken.unionByName(queries.select("qid", "user_id").join(blocked.select("user_id", "item_id"), "user_id").select("qid", "item_id")).distinct()
    counts = taken.groupBy("qid").agg(F.count(F.lit(1)).alias("_t"))
    need = queries.select("qid", "user_id").distinct().join(counts, "qid", "left").fillna(0, ["_t"])
    zeros = first_places(need, items.select("item_id").distinct().withColumn("score", F.lit(0.0)), ["item_id"], k)
    zeros = not_taken(zeros, taken)
    return reached.select("qid", "user_id", "item_id", "score").unionByName(top_k(zeros, k).drop("rank"))


def count_eligible(queries: DataFrame, items: DataFrame, *, seen: DataFrame | None = None, excluded: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """(qid, user_id, eligible): candidates less those that a filter takes from the query."""
    pool = restrict(items.select("item_id").distinct(), candidates)
    blocked = None
    for pairs in (seen, excluded):
        if pairs is not None:
            own = pairs.select("user_id", "item_id")
            blocked = own if blocked is None else blocked.unionByName(own)
    total = pool.agg(F.count(F.lit(1)).alias("_total"))
    if blocked is None:
        return queries.select("qid", "user_id").join(F.broadcast(total)).withColumnRenamed("_total", "eligible")
    lost = blocked.distinct().join(pool, "item_id", "left_semi").groupBy("user_id").agg(F.count(F.lit(1)).alias("_lost"))
    return queries.select("qid", "user_id").join(lost, "user_id", "left").join(F.broadcast(total)).select("qid", "user_id", (F.col("_total") - F.coalesce("_lost", F.lit(0))).alias("eligible"))


def require_full(ranked: DataFrame, queries: DataFrame, k: int) -> None:
    """Raises if a query has fewer than k results, naming the first."""
    counts = ranked.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    short = queries.select("qid", "user_id").distinct().join(counts, "qid", "left").filter(F.coalesce("n", F.lit(0)) < k).orderBy("qid").head(1)
    if short:
        raise InsufficientData(f"{k} items were asked for, but query {short[0]['qid']} of user {short[0]['user_id']} has {short[0]['n'] or 0}")


def require_known(ids: DataFrame, known: DataFrame, column: str) -> None:
    """Raises if an id of ``ids`` is not in ``known``, with up to five of them."""
    lost = [r[0] for r in ids.select(column).distinct().join(known.select(column), column, "left_anti").orderBy(column).head(5)]
    if lost:
        raise ValueError(f"unknown {column}: {lost}")


def check_unique(table: DataFrame, column: str) -> None:
    if again := table.groupBy(column).count().filter("count > 1").head(1):
        raise ValueError(f"{column} {again[0][0]} occurs {again[0]['count']} times in a table that must hold it once")
