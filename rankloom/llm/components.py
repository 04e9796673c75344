"""Connected components of an edge table, by contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .hashing import tidy


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b: long); equal roots: one component.

    Each round sends every vertex to the smallest in its neighbourhood, follows these
    steps to their ends by doubling, and joins the edges' ends to where they went, until no
    edge is left between different vertices. Only vertices that are the least of their
    neighbours remain, at most half, so rounds and doublings are logarithms. Then the
    rounds' maps are composed. Maps are checkpointed, so the joins' exchanges can be split
    where a hub is hot.
    """
    now = cut(edges.select("a", "b").filter("a <> b").distinct())
    maps: list[DataFrame] = []
    while now.count():
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("to")))
        while True:
            after = step.select(F.col("v").alias("_v"), F.col("to").alias("_to"))
            further = cut(step.join(after, F.col("to") == F.col("_v")).select("v", "to", "_to"))
            step = further.select("v", F.col("_to").alias("to"))
            if not further.filter("_to <> to").head(1):
                break
        maps.append(step)
        tidy(edges.sparkSession)
        ends = lambda c, step=step: step.select(F.col("v").alias(c), F.col("to").alias(f"_{c}"))
        moved = now.join(ends("a"), "a").select("b", "_a").join(ends("b"), "b")
        now = cut(moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).filter("a <> b").distinct())
    if not maps:
        return edges.sparkSession.createDataFrame([], "v long, root long")
    roots = maps[-1].select("v", F.col("to").alias("root"))
    for step in reversed(maps[:-1]):
        above = roots.select(F.col("v").alias("_v"), "root")
        roots = cut(step.join(above, F.col("to") == F.col("_v"), "left").select("v", F.coalesce("root", "to").alias("root")))
    return roots
