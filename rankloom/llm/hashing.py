"""Vectorised 64-bit hashes of words and word windows, and the set of repeated ones."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_word = xxhash.xxh3_64_intdigest
_U = np.uint64
_M1, _M2, _M3 = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93), _U(0xBF58476D1CE4E5B9)

#: About so many hashes meet in one task of :func:`mark_repeated`.
PER_BUCKET = 2_000_000


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_word, words), np.uint64, len(words))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the ordered pairs (a, b)."""
    with np.errstate(over="ignore"):
        x = a * _M1 + b
        x ^= x >> _U(32)
        x *= _M2
        x ^= x >> _U(29)
        x *= _M3
        x ^= x >> _U(32)
    return x


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` words: doubled while that fits, then two overlap."""
    if len(hashes) < width:
        return np.empty(0, np.uint64)
    have = 1
    while 2 * have <= width:
        hashes = mix(hashes[:-have], hashes[have:])
        have *= 2
    if have < width:
        hashes = mix(hashes[: -(width - have)], hashes[width - have :])
    return hashes


def tidy(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files and checkpoints that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def source_id(n: int) -> int:
    """A number for the n-th row a task makes; rows are checkpointed before it is used."""
    return (TaskContext.get().partitionId() << 32) + n


def repeated_of(state: DataFrame, total: int) -> DataFrame:
    """(src, again): for each row of ``state`` (src, hashes: binary uint64), those of its
    hashes that occur twice or more in all rows together, as a sorted list of binaries.

    Each row sends every hash once (pre-aggregated, with a mark if it holds it twice) to
    one of about ``total / PER_BUCKET`` buckets by its top bits. Hashes are uniform, and
    one that a third of all documents hold costs a bucket one entry a row of ``state``.
    """
    buckets = max(int(state.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PER_BUCKET))

    def send(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for src, blob in zip(batch["src"], batch["hashes"], strict=True):
                values, counts = np.unique(np.frombuffer(blob, np.uint64), return_counts=True)
                if not len(values):
                    continue
                bucket = ((values >> _U(32)) * _U(buckets)) >> _U(32)
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                starts = np.concatenate([[0], cuts])
                many = counts > 1
                yield pd.DataFrame({"bucket": bucket[starts].astype(np.int32), "src": src, "hashes": [x.tobytes() for x in np.split(values, cuts)], "many": [x.tobytes() for x in np.split(many, cuts)]})

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(b, np.uint64) for b in rows["hashes"]]
        values, where, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        many = np.concatenate([np.frombuffer(b, np.bool_) for b in rows["many"]])
        again = counts > 1
        again[where[many]] = True
        hit = np.split(again[where], np.cumsum([len(p) for p in parts])[:-1])
        out = [(s, p[h].tobytes()) for s, p, h in zip(rows["src"], parts, hit, strict=True) if h.any()]
        return pd.DataFrame(out, columns=["src", "again"])

    sent = state.select("src", "hashes").mapInPandas(send, "bucket int, src long, hashes binary, many binary")
    if buckets > int(state.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        sent = sent.repartition(buckets, "bucket")
    met = sent.groupBy("bucket").applyInPandas(meet, "src long, again binary")
    return met.groupBy("src").agg(F.collect_list("again").alias("again"))


def members(hashes: np.ndarray, again: list[bytes] | None) -> np.ndarray:
    """Which of ``hashes`` are in ``again``."""
    if again is None or not len(again):
        return np.zeros(len(hashes), np.bool_)
    found = np.sort(np.concatenate([np.frombuffer(b, np.uint64) for b in again]))
    at = np.minimum(np.searchsorted(found, hashes), len(found) - 1)
    return found[at] == hashes
