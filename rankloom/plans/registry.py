"""Registration of queries, and what they have in common."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import purchases

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The purchases and their matrix, in SQL.
LOG = """
log AS (SELECT o_custkey AS user_id, l_partkey AS item_id, l_quantity AS value, o_orderdate AS time,
  l_orderkey, l_linenumber, l_suppkey, l_extendedprice, o_orderpriority
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
r AS (SELECT user_id, item_id, sum(value) AS r FROM log GROUP BY ALL),
users AS (SELECT DISTINCT user_id FROM log),
items AS (SELECT DISTINCT item_id FROM log)"""
#: Total order of a user's rows, in SQL.
BY = "time, l_orderkey, l_linenumber, item_id, l_suppkey, value, l_extendedprice"


def wide(df: DataFrame) -> DataFrame:
    """Integers as longs, as SQL engines count in longs."""
    return df.select(*[F.col(f"`{f.name}`").cast("long").alias(f.name) if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)) else F.col(f"`{f.name}`") for f in df.schema])


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a function (spark, sf_dir) under its name; ``sql`` follows the common WITH
    unless it begins with one of its own."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: wide(f(spark, sf_dir))
        if sql is not None:
            text = sql.strip()
            SQL[key] = text if text.startswith("WITH") else f"WITH {LOG.strip()}{text}" if text.startswith(",") else f"WITH {LOG.strip()}\n{text}"
        return f

    return add


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return purchases(spark, sf_dir)


def all_users(df: DataFrame) -> DataFrame:
    return df.select("user_id").distinct()


def top(k: int, scored: str = "scored", part: str = "user_id", score: str = "score", item: str = "item_id") -> str:
    """SQL of the k best of each query."""
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {score} DESC, {item}) AS rank FROM {scored}) WHERE rank <= {k}"
