"""Session settings and checkpoints."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold at any size; partition counts are the cluster's to choose.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(master: str = "local[8]", **settings: str) -> SparkSession:
    return SparkSession.builder.master(master).config(map=SETTINGS | settings).getOrCreate()


#: Tables larger than this, in bytes of Parquet, have the driver collect its garbage, so
#: that shuffle files of finished plans go.
LARGE = 32 << 20


def cut(df: DataFrame, **options: object) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder, which outlives executors.

    It is kept as Parquet, which takes a small part of a checkpoint's disk, until the
    session's process ends or :func:`forget` is called. ``options`` are the writer's.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("on a cluster, spark.checkpoint.dir must name a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="rankloom-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    path = context._jvm.org.apache.hadoop.fs.Path(f"{context.getCheckpointDir()}/cut-{uuid.uuid4().hex}")
    df.write.options(**options).parquet(str(path.toString()))
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    files.deleteOnExit(path)
    if files.getContentSummary(path).getLength() > LARGE:
        for _ in range(2):  # what has just ended is still held by listeners for a moment
            time.sleep(0.7)
            gc.collect()
            context._jvm.System.gc()
    made = spark.read.schema(df.schema).parquet(str(path.toString()))
    made._rankloom_path = path
    return made


def forget(df: DataFrame) -> None:
    """Deletes what :func:`cut` kept of a table that nothing will read again."""
    path = df._rankloom_path
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
