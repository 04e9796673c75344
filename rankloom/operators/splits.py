"""Splits of a log into train and test rows, by windows over an explicit row order."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _users(order: Sequence[str], *, descending: bool = False) -> Window:
    return Window.partitionBy("user_id").orderBy(*[F.desc(c) if descending else F.asc(c) for c in order])


def positions(log: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``position`` (from 0) and ``n`` of each row among its user's."""
    return log.withColumn("position", F.row_number().over(_users(order)) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("user_id")))


def latest_split(log: DataFrame, order: Sequence[str], test_size: float = 0.2, max_users: int | None = None) -> DataFrame:
    """Adds ``test``: the last floor(test_size * n) rows of each user, or of the
    ``max_users`` users whose last row is the latest."""
    out = positions(log, order)
    test = F.col("position") >= F.col("n") - F.floor(F.lit(float(test_size)) * F.col("n"))
    if max_users is not None:
        last = log.groupBy("user_id").agg(F.max(F.struct(*order)).alias("_last")).orderBy(F.desc("_last")).limit(max_users).select("user_id", F.lit(True).alias("_chosen"))
        out = out.join(F.broadcast(last), "user_id", "left")
        test = test & F.col("_chosen").isNotNull()
    return out.withColumn("test", test).drop("position", "n", "_chosen")


def cold_start_split(log: DataFrame, order: Sequence[str], cold_users: float = 0.1, test_size: float = 0.2, draw: Column | None = None, seed: int = 0) -> DataFrame:
    """Adds ``test``: all rows of floor(cold_users * users) users, the first by ``draw`` (a
    hash of user_id and the seed), and the last floor(test_size * n) rows of the rest."""
    draw = draw if draw is not None else F.xxhash64(F.lit(seed), "user_id")
    users = log.select("user_id").distinct()
    cold = int(users.count() * cold_users)
    chosen = users.withColumn("_d", draw).orderBy("_d", "user_id").limit(cold).select("user_id", F.lit(True).alias("_cold"))
    out = positions(log, order).join(chosen, "user_id", "left")
    warm = F.col("position") >= F.col("n") - F.floor(F.lit(float(test_size)) * F.col("n"))
    return out.withColumn("test", F.col("_cold").isNotNull() | warm).drop("position", "n", "_cold")


def warm_k_fold(log: DataFrame, order: Sequence[str], n_splits: int = 5, shuffle: Column | None = None) -> DataFrame:
    """Adds ``fold``: null for rows that stay in training always (the first of each user
    and of each item), else the row's place among the others, in ``order`` or by
    ``shuffle``, modulo ``n_splits``.

    The place is a global row number; the rows are ranked by ranges of the order, so no
    task holds them all.
    """
    first_user = F.row_number().over(_users(order)) == 1
    first_item = F.row_number().over(Window.partitionBy("item_id").orderBy(*order)) == 1
    marked = log.withColumn("_pin", first_user | first_item)
    keys = [shuffle.alias("_s")] if shuffle is not None else []
    by = ["_s", *order] if shuffle is not None else list(order)
    free = marked.filter(~F.col("_pin")).select("*", *keys)
    parts = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = free.repartitionByRange(parts, *by).withColumn("_part", F.spark_partition_id())
    from ..session import cut

    ranged = cut(ranged)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*by)) - 1 + F.col("_before")
    folds = ranged.join(F.broadcast(starts), "_part").withColumn("fold", (place % n_splits).cast("int")).drop("_part", "_before", "_s")
    return folds.unionByName(marked.filter("_pin").withColumn("fold", F.lit(None).cast("int"))).drop("_pin")


def folds(marked: DataFrame, n_splits: int) -> Iterator[tuple[DataFrame, DataFrame]]:
    """(train, test) of each fold of :func:`warm_k_fold`."""
    for f in range(n_splits):
        test = F.coalesce(F.col("fold") == f, F.lit(False))
        yield marked.filter(~test).drop("fold"), marked.filter(test).drop("fold")


def leave_one_out(log: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``test``: the last row of each user."""
    return log.withColumn("test", F.row_number().over(_users(order, descending=True)) == 1)


def tail_rows(log: DataFrame, order: Sequence[str], n: int, *, held_out: bool = False) -> DataFrame:
    """The last n rows of each user, one more if the last is to be held out."""
    return log.withColumn("_n", F.row_number().over(_users(order, descending=True))).filter(F.col("_n") <= n + int(held_out)).drop("_n")


def k_core(log: DataFrame, k: int = 5) -> DataFrame:
    """Rows whose user and whose item both have k rows in ``log`` as given (one pass)."""
    users = log.groupBy("user_id").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") >= k).select("user_id")
    items = log.groupBy("item_id").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") >= k).select("item_id")
    return log.join(users, "user_id", "left_semi").join(items, "item_id", "left_semi")


def sequences(log: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """(user_id, items): each user's last n items, oldest first."""
    rows = tail_rows(log, order, n)
    return rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.col("item_id").alias("i")))).alias("_s")).select("user_id", F.col("_s.i").alias("items"))


def first_rows(log: DataFrame, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(user_id, columns): each user's earliest row."""
    return log.groupBy("user_id").agg(F.min(F.struct(*order, *[c for c in columns if c not in order])).alias("_r")).select("user_id", *[f"_r.{c}" for c in columns])
