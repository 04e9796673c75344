"""Substring dedup by level-wise doubling (operator 3)."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches, words_of
from .hashing import members, mix, repeated_of, source_id, tidy, window_hashes, word_hashes

WIDTH = 35
#: Words of the first level's windows; each level doubles them up to WIDTH.
ANCHOR = 8
#: Hashes in a row of a level's table, about; a document and eight bytes of its text count as one.
PER_ROW = 100_000
#: A second, independent hash of words.
_SECOND = np.uint64(0xA0761D6478BD642F)

_EMPTY = hashlib.sha256(b"").hexdigest()


def anchors_of(hashes: np.ndarray, width: int, anchor: int) -> np.ndarray:
    """For each window of ``width`` words, the place of its smallest anchor hash (the first).

    Equal windows have their anchor at the same offset, so two of them share its hash.
    """
    grams = window_hashes(hashes, anchor)
    span = width - anchor + 1
    if len(grams) < span:
        return np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, span)
    return np.argmin(views, axis=1) + np.arange(len(views))


def cover(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a window of ``width`` words from one of ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:-1]) > 0


def levels(width: int, anchor: int) -> list[int]:
    """Window lengths up to ``width``: doubled from ``anchor``, the last one clipped."""
    out = [anchor]
    while out[-1] < width:
        out.append(min(width, 2 * out[-1]))
    return out


def windows_at(hashes: np.ndarray, lengths: list[int], upto: int) -> np.ndarray:
    """For each window of the last length, where the window of length ``upto`` starts that
    stands for it: it holds the one of the length before and lies within the last, so equal
    windows have equal ones at equal offsets."""
    places = anchors_of(hashes, lengths[-1], lengths[0])
    last = np.arange(len(places)) + lengths[-1]
    for length in lengths[1 : lengths.index(upto) + 1]:
        places = np.minimum(places, last - length)
    return places


def _scan(width: int, anchor: int):
    """Many documents a row: their keys, digests and the first level's windows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        out: list[tuple] = []
        size = 0
        for batch in batches:
            # Arrow's values keep keys whole numbers beside nulls, which pandas would not.
            for key, text in zip(batch.column("key"), batch.column("text"), strict=True):
                key, words = key.as_py(), words_of(text.as_py())
                said = hashlib.sha256(b" ".join(words)).digest()
                hashes = word_hashes(words)
                places = np.unique(anchors_of(hashes, width, anchor)) if len(words) >= width else np.empty(0, np.int64)
                grams = window_hashes(hashes, anchor)[places] if len(places) else np.empty(0, np.uint64)
                out.append((key, said, len(words), len(places), grams.tobytes(), places.astype(np.int32).tobytes()))
                size += len(places) + 1
                if size >= PER_ROW:
                    yield packed(source_id(n), out)
                    n, out, size = n + 1, [], 0
        if out:
            yield packed(source_id(n), out)

    def packed(src: int, out: list[tuple]) -> pa.RecordBatch:
        keys, said, words, counts, grams, places = zip(*out, strict=True)
        row = {"src": src, "keys": keys, "said": b"".join(said), "words": np.array(words, np.int32).tobytes(), "counts": np.array(counts, np.int32).tobytes(), "hashes": b"".join(grams), "places": b"".join(places)}
        kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5]
        return pa.RecordBatch.from_pylist([row], pa.schema(list(zip(row, kinds, strict=True))))

    return scan


_ROW = "src long, keys array<long>, said binary, words binary, counts binary, hashes binary, places binary"


def _split(blob: bytes, kind: type, counts: bytes) -> list[np.ndarray]:
    return np.split(np.frombuffer(blob, kind), np.cumsum(np.frombuffer(counts, np.int32))[:-1])


def _said(row: dict, i: int) -> bytes:
    return row["said"][32 * i : 32 * i + 32]


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            words = np.frombuffer(row["words"], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(row["keys"], pa.int64()), pa.array([_said(row, i) for i in range(len(words))], pa.binary()), pa.array(words)], ["key", "said", "n_words"])


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, said, places) of documents with windows of the first level that occur elsewhere."""
    for batch in batches:
        for row in batch.to_pylist():
            hit = members(np.frombuffer(row["hashes"], np.uint64), row["again"])
            hits = np.split(hit, np.cumsum(np.frombuffer(row["counts"], np.int32))[:-1])
            out = [(row["keys"][i], _said(row, i), p[h].tobytes()) for i, (p, h) in enumerate(zip(_split(row["places"], np.int32, row["counts"]), hits, strict=True)) if h.any()]
            if out:
                keys, said, places = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(said, pa.binary()), pa.array(places, pa.binary())], ["key", "said", "places"])


def _same(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Only texts of the class that was asked for (a key may have other texts too), as
    their words, compressed."""
    for batch in rows:
        words = [b" ".join(words_of(t)) for t in batch["text"]]
        batch["text"] = [zlib.compress(w, 1) for w in words]
        yield batch[[bytes(s) == hashlib.sha256(w).digest() for s, w in zip(batch["said"], words, strict=True)]]


_LEVEL = "src long, said binary, counts binary, starts binary, hashes binary, n long, texts array<binary>"


class _Packer:
    """Rows of a level, of about PER_ROW hashes each."""

    def __init__(self):
        self.n, self.out, self.size = 0, [], 0

    def add(self, said: bytes, starts: np.ndarray, hashes: np.ndarray, text: bytes | None) -> Iterator[pd.DataFrame]:
        self.out.append((bytes(said), starts.astype(np.int32), hashes, text))
        self.size += len(starts) + 1 + len(text or b"") // 8
        if self.size >= PER_ROW:
            yield from self.rest()

    def rest(self) -> Iterator[pd.DataFrame]:
        if self.out:
            said, starts, hashes, texts = zip(*self.out, strict=True)
            counts = np.array([len(s) for s in starts], np.int32)
            yield pd.DataFrame({"src": [source_id(self.n)], "said": [b"".join(said)], "counts": [counts.tobytes()], "starts": [np.concatenate(starts).tobytes()], "hashes": [np.concatenate(hashes).astype(np.uint64).tobytes()], "n": [int(counts.sum())], "texts": [list(texts)]})
            self.n, self.out, self.size = self.n + 1, [], 0


def _kept(row: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(document, starts, hashes) of a level's windows that occur twice or more."""
    hashes = np.frombuffer(row["hashes"], np.uint64)
    hit = members(hashes, row["again"])
    ends = np.cumsum(np.frombuffer(row["counts"], np.int32))[:-1]
    for i, (s, h, k) in enumerate(zip(np.split(np.frombuffer(row["starts"], np.int32), ends), np.split(hashes, ends), np.split(hit, ends), strict=True)):
        if k.any():
            yield i, s[k], h[k]


def _next(text: bytes, alive: np.ndarray, lengths: list[int], now: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The starts and hashes of the next level's windows of a text: those that stand for
    a window of the last length whose part at level ``now`` is ``alive``."""
    hashes = word_hashes(zlib.decompress(text).split())
    if second:
        starts = alive
    else:
        live = np.zeros(len(hashes), np.bool_)
        live[alive] = True
        starts = np.unique(windows_at(hashes, lengths, lengths[now + 1])[live[windows_at(hashes, lengths, lengths[now])]])
    if second:
        hashes = mix(hashes, np.full(len(hashes), _SECOND))
    return starts, window_hashes(hashes, lengths[-1] if second else lengths[now + 1])[starts]


def _first_level(lengths: list[int]):
    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = _Packer()
        for batch in rows:
            for said, text, blob in zip(batch["said"], batch["text"], batch["places"], strict=True):
                starts, hashes = _next(text, np.frombuffer(blob, np.int32), lengths, 0)
                yield from pack.add(said, starts, hashes, text)
        yield from pack.rest()

    return run


def _further_level(lengths: list[int], now: int):
    """From the survivors of level ``now`` to the next; after the last to its windows under
    a second hash, so that none is taken for repeated by a collision."""

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = _Packer()
        for batch in rows:
            for row in batch.to_dict("records"):
                for i, alive, _ in _kept(row):
                    starts, hashes = _next(row["texts"][i], alive, lengths, now, now == len(lengths) - 1)
                    yield from pack.add(_said(row, i), starts, hashes, row["texts"][i])
        yield from pack.rest()

    return run


def _last_level(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pack = _Packer()
    for batch in rows:
        for row in batch.to_dict("records"):
            for i, starts, hashes in _kept(row):
                yield from pack.add(_said(row, i), starts, hashes, None if row["texts"] is None else row["texts"][i])
    yield from pack.rest()


def _doubled(width: int):
    """Windows of twice ``width`` words: both halves are windows that survived."""

    def doubled(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = _Packer()
        for batch in rows:
            for row in batch.to_dict("records"):
                for i, (s, h) in enumerate(zip(_split(row["starts"], np.int32, row["counts"]), _split(row["hashes"], np.uint64, row["counts"]), strict=True)):
                    at = np.searchsorted(s, s + width)
                    ok = at < len(s)
                    ok[ok] = s[at[ok]] == s[ok] + width
                    if ok.any():
                        yield from pack.add(_said(row, i), s[ok], mix(h[ok], h[at[ok]]), None)
        yield from pack.rest()

    return doubled


def _names(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in rows:
        for row in batch.to_dict("records"):
            yield pd.DataFrame({"said": [_said(row, i) for i in range(len(row["said"]) // 32)]})


def _removed(width: int):
    """What is left of each document of the last level."""

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in rows:
            out = []
            for row in batch.to_dict("records"):
                for i, starts in enumerate(_split(row["starts"], np.int32, row["counts"])):
                    words = zlib.decompress(row["texts"][i]).split()
                    gone = cover(starts, width, len(words))
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                    kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                    out.append((_said(row, i), int(gone.sum()), hashlib.sha256(kept).hexdigest(), edges.reshape(-1, 2).tolist()))
            yield pd.DataFrame(out, columns=["said", "n_removed", "kept_sha256", "removed"])

    return run


def _survive(state: DataFrame, run) -> DataFrame | None:
    """``run`` over ``state`` and its repeated hashes; None if nothing is left."""
    total = state.agg(F.sum("n")).first()[0] or 0
    if not total:
        return None
    left = cut(state.join(repeated_of(state, total), "src").mapInPandas(run, _LEVEL))
    tidy(state.sparkSession)
    return left if left.head(1) else None


def dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    """Removes the words of windows that occur twice; returns what is kept, by document.

    (key, n_words, n_removed, kept_sha256, longest, removed): ``removed`` is an array of
    (start, end) word spans; ``longest`` is the longest of the lengths ``width`` * 2^j at
    which a window of the document occurs elsewhere (0: none).

    1. Texts with the same words are one class; it stands for its copies. In a class of
       two or more, every word of a text of ``width`` words or more goes.
    2. Level-wise doubling decides the windows of ``width`` words. Each is represented by
       its window of ``anchor`` words that hashes least, then by one of twice that length
       around it, and so on up to itself (:func:`windows_at`); equal windows have equal
       representatives. At each level, those found once rule out all they stand for, and
       the survivors are extended. Survivors of the last level must also be repeated under
       a second hash; words in them are removed. Windows are judged on the input.
    3. The doubling goes on: pairs of survivors that touch make the windows of twice the
       length, until no candidates survive. That gives ``longest``.

    Null and empty texts have no words and lose none. Rows with equal key and text are
    copies of each other like any others; null keys are kept. A window is taken for
    repeated only if five hashes of 64 bits of it and its parts are. Other columns are
    ignored. No rows: no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if width < 2:
        raise ValueError("windows of two words at least")
    lengths = levels(width, min(anchor, (width + 1) // 2))
    anchor = lengths[0]
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    scanned = cut(rows.mapInArrow(_scan(width, anchor), _ROW))
    named = cut(scanned.select("keys", "said", "words").mapInArrow(_documents, "key long, said binary, n_words int"))
    classes = cut(named.groupBy("said").agg(F.count(F.lit(1)).alias("copies"), F.min("key").alias("first")))
    total = scanned.agg(F.sum(F.octet_length("hashes")) / 8).first()[0] or 0
    again = repeated_of(scanned, int(total))
    alive = scanned.join(again, "src").mapInArrow(_survivors, "key long, said binary, places binary")
    # One text a class; copies with equal keys agree in all that follows.
    first = classes.select(F.col("said").alias("_said"), F.col("first").alias("_first"))
    alive = alive.join(first, (alive["said"] == first["_said"]) & alive["key"].eqNullSafe(first["_first"])).dropDuplicates(["said"]).select("key", "said", "places")
    alive = cut(alive)
    del scanned, again, first
    tidy(spark)
    joined = rows.withColumnRenamed("key", "_key").join(alive.hint("shuffle_hash"), F.col("_key").eqNullSafe(F.col("key")))
    texts = joined.select("said", "text", "places").mapInPandas(_same, "said binary, text binary, places binary").dropDuplicates(["said"])
    state = cut(texts.mapInPandas(_first_level(lengths), _LEVEL))
    del alive, joined, texts
    tidy(spark)
    for now in range(1, len(lengths)):
        state = state if state is None else _survive(state, _further_level(lengths, now))
    state = state if state is None else _survive(state, _last_level)
    part = spark.createDataFrame([], "said binary, n_removed long, kept_sha256 string, removed array<array<int>>")
    longest = spark.createDataFrame([], "said binary, longest long")
    if state is not None:
        part = cut(state.mapInPandas(_removed(width), part.schema))
        state = cut(state.withColumn("texts", F.lit(None).cast("array<binary>")))
        tidy(spark)
    size = width
    while state is not None:
        longest = longest.unionByName(cut(state.mapInPandas(_names, "said binary").withColumn("longest", F.lit(size).cast("long"))))
        state, size = cut(state.mapInPandas(_doubled(size), _LEVEL)), 2 * size
        state = _survive(state, _last_level)
    longest = longest.groupBy("said").agg(F.max("longest").alias("longest"))
    part = cut(part.join(longest, "said", "left").select(F.col("said").alias("_said"), "n_removed", "kept_sha256", "longest", "removed"))
    of_class = cut(classes.join(part, classes["said"] == part["_said"], "left").drop("_said").filter((F.col("copies") > 1) | F.col("n_removed").isNotNull()).withColumnRenamed("said", "_c"))
    done = named.join(of_class, named["said"] == of_class["_c"], "left")
    whole = (F.col("copies") > 1) & (F.col("n_words") >= width)
    n = F.col("n_words").cast("long")
    top = F.lit(width) * F.pow(F.lit(2.0), F.floor(F.log2(F.col("n_words") / F.lit(width))))
    return done.select(
        F.col("key").alias(key), n.alias("n_words"),
        F.when(whole, n).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(_EMPTY)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("said")))).alias("kept_sha256"),
        F.when(whole, top.cast("long")).otherwise(F.coalesce("longest", F.lit(0))).cast("long").alias("longest"),
        F.when(whole, F.array(F.array(F.lit(0), F.col("n_words")))).otherwise(F.coalesce("removed", F.array().cast("array<array<int>>"))).alias("removed"),
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256", "longest")


def _sql() -> str:
    """DuckDB: window hashes by the same doubling, as digests of two neighbours' digests."""
    hashes, have = ["h1 AS (SELECT doc_id, i, word, md5(word) AS h FROM p)"], 1
    while have < WIDTH:
        step = min(have, WIDTH - have)
        hashes.append(f"h{have + step} AS (SELECT doc_id, i, word, md5(h || lead(h, {step}) OVER (PARTITION BY doc_id ORDER BY i)) AS h FROM h{have})")
        have += step
    longest, width = [], WIDTH
    for _ in range(12):
        longest.append(f"SELECT doc_id, {width} AS longest FROM h{width} WHERE h IN (SELECT h FROM h{width} WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1)")
        hashes.append(f"h{2 * width} AS (SELECT doc_id, i, md5(h || lead(h, {width}) OVER (PARTITION BY doc_id ORDER BY i)) AS h FROM h{width})")
        width *= 2
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
{", ".join(hashes[:-1])},
again AS (SELECT h FROM h{WIDTH} WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1),
hit AS (SELECT a.*, again.h IS NOT NULL AS hit FROM h{WIDTH} a LEFT JOIN again ON a.h = again.h),
gone AS (SELECT doc_id, i, word, max(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {WIDTH - 1} PRECEDING AND CURRENT ROW) AS gone FROM hit),
kept AS (SELECT doc_id, (count(*) FILTER (gone))::BIGINT AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM gone GROUP BY doc_id),
long AS (SELECT doc_id, max(longest)::BIGINT AS longest FROM ({" UNION ALL ".join(longest)}) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256, coalesce(longest, 0) AS longest
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN long USING (doc_id)
"""


SQL = _sql()
