"""Helpers shared by the corpus operators: checkpoints, bounded joins, ranks, words."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ASCII white space, the only separator of words.
SPACE = "\\x20\\x09-\\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: A table of at most this many rows may be broadcast; it is counted first.
BROADCAST_ROWS = 100_000

#: Texts that go to Python at once.
BATCH_ROWS = 1000


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is set (tests), a temporary one."""
    found = spark.sparkContext.getCheckpointDir()
    if found:
        return found
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if not set_to:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("on a cluster, spark.checkpoint.dir must name a folder that all machines share")
        set_to = tempfile.mkdtemp(prefix="rankloom-checkpoint-")
        atexit.register(shutil.rmtree, set_to, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(set_to)
    return spark.sparkContext.getCheckpointDir()


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches of BATCH_ROWS at most, from now on in this session:
    a batch is held several times over, in the JVM and in the worker, and texts are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the shared checkpoint folder.

    The files survive lost executors, and go when the result is garbage and
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set. A checkpoint keeps its
    plan's size estimate, which joins multiply: after some rounds of joins it is a number
    of a million digits in the driver. So the rows are given a plan without estimates;
    adaptive execution goes by the sizes it measures.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    done = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done.queryExecution().toRdd(), done.schema(), False), spark)


def attach(big: DataFrame, small: DataFrame, keys: list[str], salt: int = 32) -> DataFrame:
    """``big`` left-joined to ``small`` on null-safe ``keys``, unique in ``small``.

    ``small`` is counted (it should be checkpointed): up to ``BROADCAST_ROWS`` rows it is
    broadcast; beyond that both sides are salted, so that one key with a third of the
    rows of ``big`` spreads over ``salt`` tasks.
    """
    right = small.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & big[k].eqNullSafe(right[f"_r_{k}"])
    drop = [f"_r_{k}" for k in keys]
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(right), on, "left").drop(*drop)
    rest = [c for c in big.columns if c not in keys] or big.columns
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*rest), F.lit(salt)))
    right = right.withColumn("_r_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).cast("long"))
    on = left["_salt"] == right["_r_salt"]
    for k in keys:
        on = on & left[k].eqNullSafe(right[f"_r_{k}"])
    return left.join(right, on, "left").drop("_salt", "_r_salt", *drop)


def unit(hashed: Column) -> Column:
    """A 64-bit hash as a double in [0, 1)."""
    return F.shiftrightunsigned(hashed, 11).cast("double") / F.lit(float(1 << 53))


def digest(*columns: Column) -> Column:
    """MD5 of the columns' texts, which other engines compute alike; null is "null"."""
    return F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns]))


def digest_unit(hexed: Column) -> Column:
    """The first 52 bits of a digest as a double in [0, 1)."""
    return F.conv(F.substring(hexed, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def ranked(df: DataFrame, group: list[str], spread: str, order: list[str], rows: int = 2048, out: str = "_rank", size: str = "_size") -> DataFrame:
    """0-based ranks within ``group``, without a task that holds a whole group.

    ``spread`` is a double in [0, 1), near uniform within its group and first in the
    order (``order`` breaks its ties). Each group is cut into ranges of about ``rows``
    rows by ``spread``, or the root of its size if that is more, as one task adds up a
    group's ranges; ranks are the rows in earlier ranges plus a row number within
    the range. ``df`` is read several times and should be checkpointed. Adds ``out``
    and ``size`` (the group's rows).
    """
    sizes = cut(df.groupBy(*group).agg(F.count(F.lit(1)).alias(size)))
    df = attach(df, sizes, group)
    df = df.withColumn("_range", F.floor(F.col(spread) * F.ceil(F.col(size) / F.greatest(F.lit(float(rows)), F.sqrt(size)))).cast("long"))
    counts = df.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(counts.select(*group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    df = attach(df, starts, [*group, "_range"])
    inside = Window.partitionBy(*group, "_range").orderBy(spread, *order)
    return df.withColumn(out, F.col("_before") + F.row_number().over(inside) - 1).drop("_before", "_range")


def text_or_empty(docs: DataFrame, text: str = "text") -> Column:
    return F.coalesce(docs[text].cast("string"), F.lit(""))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8: bytes.split() divides at just these bytes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []
