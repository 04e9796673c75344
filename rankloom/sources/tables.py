"""Parquet tables as interaction logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Total order of a user's purchases.
ORDER = ("time", "l_orderkey", "l_linenumber", "item_id", "l_suppkey", "value", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as (user_id, item_id, value, time) with the order columns and priority."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("time"), "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("item_id"), "l_suppkey", F.col("l_quantity").alias("value"), "l_extendedprice")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as (user_id, item_id, value, time, event_id, event_type): the item is the
    property k."""
    events = table(spark, sf_dir, "events")
    return event_log(events)


def event_log(events: DataFrame) -> DataFrame:
    item = F.from_json("props", "k LONG")["k"]
    return events.select("user_id", item.alias("item_id"), F.lit(1.0).alias("value"), F.col("ts").alias("time"), "event_id", "event_type").filter("item_id IS NOT NULL")
