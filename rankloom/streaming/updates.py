"""Interaction streams that keep model tables up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.base import Recommender
from ..operators.incremental import merged, partial_fit
from ..schema import matrix


class MatrixState:
    """R as versioned Parquet below ``path``: version n holds all batches up to n.

    A batch writes a new version beside the old one, which stays until the next commit, so
    a batch that is repeated after a failure starts from the same input and overwrites the
    same folder: each batch counts once.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _files(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, path = self._files(self.path)
        if not fs.exists(path):
            return []
        found = []
        for status in fs.listStatus(path):
            name = status.getPath().getName()
            done, at = self._files(f"{self.path}/{name}/_SUCCESS")
            if name.isdigit() and done.exists(at):
                found.append(int(name))
        return sorted(found)

    def read(self, before: int | None = None) -> DataFrame | None:
        known = [v for v in self.versions() if before is None or v < before]
        return self.spark.read.parquet(f"{self.path}/{known[-1]}") if known else None

    def add(self, log: DataFrame, batch: int) -> DataFrame:
        old, delta = self.read(batch), matrix(log)
        (delta if old is None else merged(old, delta)).write.mode("overwrite").parquet(f"{self.path}/{batch}")
        for v in self.versions()[:-2]:
            fs, path = self._files(f"{self.path}/{v}")
            fs.delete(path, True)
        return self.spark.read.parquet(f"{self.path}/{batch}")


def keep_matrix(stream: DataFrame, path: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None):
    """Starts a query that adds each micro-batch of (user_id, item_id, value) to R below
    ``path``, exactly once, and hands the new R to ``then``."""
    spark = stream.sparkSession
    state = MatrixState(spark, path)

    def batch(df: DataFrame, n: int) -> None:
        r = state.add(df.select("user_id", "item_id", "value"), n)
        if then is not None:
            then(r, n)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("append").start()


def keep_model(stream: DataFrame, model: Recommender, checkpoint: str):
    """Starts a query that applies :func:`partial_fit` to ``model`` for each micro-batch. The
    model lives in the driver: after a restart fit it on the history first."""

    def batch(df: DataFrame, n: int) -> None:
        from ..session import cut

        if df.head(1):
            partial_fit(model, cut(df.select("user_id", "item_id", "value")))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("append").start()


def windowed_popularity(stream: DataFrame, *, size: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, end, item_id, pop): rows of each item in event-time windows; rows later than
    ``late`` are dropped. Works on streams and tables alike."""
    window = F.window("time", size, slide) if slide else F.window("time", size)
    counts = stream.withWatermark("time", late).groupBy(window.alias("w"), "item_id").agg(F.count(F.lit(1)).alias("pop"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "item_id", "pop")
