"""Near-duplicate documents by ProbMinHash, banding and verification (operator 1)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, small_batches, words_of
from .components import components
from .hashing import mix, tidy, window_hashes, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
#: Registers: BANDS bands of ROWS each. Two texts of similarity 0.8 share no band with
#: chance (1 - 0.8**6)**42 < 3e-6.
BANDS, ROWS = 42, 6
REGISTERS = BANDS * ROWS
#: A bucket's member at least so similar to its centre joins the centre's cluster.
PASS = 0.2
#: Two members of which one does not may be linked only if both are less similar than this.
APART = 0.6
#: Of a bucket's members that stay apart, up to so many are compared in pairs; more get a
#: new centre ROUNDS - 1 times, and what is left then is compared in blocks of signatures.
PAIRS = 64
ROUNDS = 3
#: Signatures compared with each other in one task, at most.
SIGNATURES = 2048
#: Documents compared with each other in one task, at most.
BLOCK = 256

_U = np.uint64


def shingles(text: str | None, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's distinct shingles, sorted, and how often each occurs.

    A text of fewer than ``width`` words is one shingle of all of them.
    """
    return shingles_of(words_of(text), width)


def shingles_of(words: list[bytes], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    hashes = word_hashes(words)
    if 0 < len(hashes) < width:
        hashes = window_hashes(hashes, len(hashes))
    else:
        hashes = window_hashes(hashes, width)
    return np.unique(hashes, return_counts=True)


def sketches(values: list[np.ndarray], weights: list[np.ndarray], registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash signatures: row d, register r holds the shingle of text d that arrives
    there first. Texts x and y agree in a register with chance equal to their probability
    Jaccard similarity.

    Each shingle of weight w sends arrivals at times that grow by exponential steps of
    rate w, each to a random register; both depend on the shingle's hash alone. A shingle
    stops when its next arrival would be later than all of its text's registers.
    """
    n = len(values)
    doc = np.repeat(np.arange(n), [len(v) for v in values])
    value = np.concatenate(values) if n else np.empty(0, np.uint64)
    rate = np.concatenate(weights).astype(np.float64) if n else np.empty(0)
    first = np.full(n * registers, np.inf)
    who = np.zeros(n * registers, np.uint64)
    # A text of one shingle has it in every register.
    lone = np.array([len(v) == 1 for v in values], np.bool_)
    who.reshape(n, registers)[lone] = np.array([v[0] for v in values if len(v) == 1], np.uint64)[:, None]
    live = ~lone[doc]
    doc, value, rate = doc[live], value[live], rate[live]
    time = np.zeros(len(doc))
    latest = np.full(n, np.inf)
    turn = 0
    while len(doc):
        draw = mix(value, np.full(len(value), turn + 1, np.uint64))
        time = time - np.log(((draw >> _U(12)).astype(np.float64) + 0.5) / float(1 << 52)) / rate
        early = np.flatnonzero(time < latest[doc])
        doc, value, rate, time = doc[early], value[early], rate[early], time[early]
        spot = mix(value, np.full(len(value), (turn + 1) << 32, np.uint64))
        at = doc * registers + ((spot >> _U(32)) * _U(registers) >> _U(32)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        who[at[won]] = value[won]
        some = np.unique(doc)
        latest[some] = first.reshape(n, registers)[some].max(axis=1)
        turn += 1
    return who.reshape(n, registers)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature; bands do not share keys."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(signatures), BANDS))
    for r in range(ROWS):
        keys = mix(keys, parts[:, :, r])
    return keys


def class_id(said: bytes) -> int:
    return int.from_bytes(said[:8], "little", signed=True)


_SKETCH = "key long, h long, cid long, n_words int, sig binary, bands array<long>"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A text's class, words, signature and bands. Keys pass in Arrow: pandas would turn them
    into doubles beside a null."""
    for batch in batches:
        for a in range(0, batch.num_rows, 512):
            part = batch.slice(a, 512)
            words = [words_of(t) for t in part.column("text").to_pylist()]
            cids = [class_id(hashlib.sha256(b" ".join(w)).digest()) for w in words]
            full = [i for i, w in enumerate(words) if w]
            sig: list[bytes | None] = [None] * len(words)
            bands: list[np.ndarray | None] = [None] * len(words)
            if full:
                found = [shingles_of(words[i]) for i in full]
                made = sketches([v for v, _ in found], [c for _, c in found])
                low = (made & _U(0xFFFF)).astype(np.uint16)
                for i, s, b in zip(full, low, band_keys(made).astype(np.int64), strict=True):
                    sig[i], bands[i] = s.tobytes(), b
            columns = [part.column("key"), part.column("h"), pa.array(cids, pa.int64()), pa.array(list(map(len, words)), pa.int32()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "h", "cid", "n_words", "sig", "bands"])


def _agreement(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Share of registers in which signatures agree, by their low 16 bits."""
    if not len(a):
        return np.empty(0)
    x, y = (np.frombuffer(b"".join(s), np.uint16).reshape(len(s), REGISTERS) for s in (a, b))
    return (x == y).mean(axis=1)


def needed(sigs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``sigs`` that ``ids`` (cid) name: few ids, counted first, are sent to the
    signatures, so that these are not shuffled for them."""
    ids = ids.distinct()
    return sigs.join(F.broadcast(ids), "cid", "left_semi") if ids.count() <= BROADCAST_ROWS else sigs


def estimated(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with their estimated similarity ``est``."""

    @F.pandas_udf("double")
    def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(_agreement(a, b))

    pairs = cut(pairs.distinct())
    sigs = needed(sigs, pairs.select(F.explode(F.array("a", "b")).alias("cid")))
    of = lambda c: sigs.select(F.col("cid").alias(c), F.col("sig").alias(f"_{c}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", agreement("_a", "_b").alias("est"))


def close_in_blocks(members: DataFrame, sigs: DataFrame) -> DataFrame:
    """(a, b): edges that join all members (bucket, cid, n) of a bucket connected by
    estimates of APART or more.

    A bucket is cut into blocks of up to SIGNATURES / 2, and every two blocks meet in a
    task of their own, so no task holds a large bucket.
    """
    sized = members.withColumn("_blocks", F.ceil(2 * F.col("n") / SIGNATURES).cast("int")).withColumn("_block", F.pmod(F.xxhash64("cid"), "_blocks").cast("int"))
    sized = sized.join(needed(sigs.select("cid", "sig"), members.select("cid")), "cid").withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    met = sized.select("bucket", F.least("_block", "_other").alias("i"), F.greatest("_block", "_other").alias("j"), "cid", "sig")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("cid")
        ids, sig = rows["cid"].to_numpy(), np.frombuffer(b"".join(rows["sig"]), np.uint16).reshape(len(rows), REGISTERS)
        # Each member is tied to the first of its group: links enough for components.
        group, out = np.arange(len(ids)), []
        for k in range(len(ids) - 1):
            for other in (np.flatnonzero((sig[k + 1 :] == sig[k]).mean(axis=1) >= APART) + k + 1).tolist():
                if group[other] != group[k]:
                    out.append((ids[k], ids[other]))
                    group[group == group[other]] = group[k]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return met.groupBy("bucket", "i", "j").applyInPandas(compare, "a long, b long")


def candidate_edges(sigs: DataFrame) -> DataFrame:
    """(a, b): edges whose components hold both ends of every pair that shares a band and
    may be similar enough; no bucket is spread into all its pairs.

    In each bucket all members are compared to its centre. Those that are similar to it
    by PASS join it. Others stay apart, and so do their possible partners: 1 - similarity
    is a metric, so a partner of a text that does not pass is itself under APART (0.2 +
    0.2, and the estimates' spread). What stays apart is compared in pairs where it is
    few. Where it is many it gets a new centre, and what is left after ROUNDS centres is
    compared in blocks (:func:`close_in_blocks`), so every pair that shares a band is met.
    """
    spark = sigs.sparkSession
    members = sigs.select("cid", F.explode("bands").alias("bucket"))
    edges = None

    def found(more: DataFrame) -> None:
        nonlocal edges
        edges = more if edges is None else edges.unionByName(more)

    for turn in range(ROUNDS):
        centres = members.groupBy("bucket").agg(F.min("cid").alias("centre"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket", "centre")
        near = cut(members.join(cut(centres), "bucket").filter("cid <> centre").select("bucket", F.col("cid").alias("a"), F.col("centre").alias("b")))
        known = cut(estimated(near.select("a", "b"), sigs))
        tidy(spark)
        found(known.filter(F.col("est") >= PASS).select("a", "b"))
        if not known.filter(F.col("est") < PASS).head(1):
            break
        apart = near.join(known.filter(F.col("est") < APART), ["a", "b"])
        sizes = apart.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("est").alias("least"))
        sizes = cut(sizes.filter((F.col("least") < PASS) & (F.col("n") > 1)).select("bucket", "n"))
        left = cut(apart.select("bucket", F.col("a").alias("cid")).join(sizes, "bucket"))
        few = left.filter(F.col("n") <= PAIRS)
        pairs = few.select("bucket", F.col("cid").alias("a")).join(few.select(F.col("bucket").alias("_k"), F.col("cid").alias("b")), (F.col("bucket") == F.col("_k")) & (F.col("a") < F.col("b")))
        # Cut, so that the union of all turns stays a small plan for the driver.
        found(cut(estimated(pairs.select("a", "b"), sigs).filter(F.col("est") >= APART).select("a", "b")))
        tidy(spark)
        many = left.filter(F.col("n") > PAIRS)
        if not many.head(1):
            break
        if turn == ROUNDS - 1:
            found(cut(close_in_blocks(many, sigs)))
        else:
            members = cut(many.select("cid", "bucket"))
    return edges


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over common shingles i of 1 / sum over all j of max(x_j / x_i, y_j / y_i).

    ``a`` and ``b``: sorted distinct shingles and their weights. Few weights occur, so
    the inner sum is taken once for each pair of weights.
    """
    every = np.union1d(a[0], b[0])
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a[0])] = a[1]
    y[np.searchsorted(every, b[0])] = b[1]
    common = (x > 0) & (y > 0)
    pairs, counts = np.unique(np.stack([x[common], y[common]]), axis=1, return_counts=True)
    return float(sum(c / np.maximum(x / p, y / q).sum() for (p, q), c in zip(pairs.T, counts, strict=True)))


def links(texts: list[str], side: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links that join all texts connected by pairs of similarity ``least`` or more.

    Only pairs of different ``side`` count if both sides occur. The similarity is the
    probability Jaccard of shingles weighted by how often they occur, which is the plain
    Jaccard similarity where no text repeats a shingle.
    """
    found = [shingles(t) for t in texts]
    n = len(texts)
    sizes = np.array([len(v) for v, _ in found])
    total = np.array([c.sum() for _, c in found], np.float64)
    values, where, counts = np.unique(np.concatenate([v for v, _ in found]), return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(n), sizes)
    share = np.concatenate([c for _, c in found]) / total[doc]
    shared = counts[where] > 1
    place = np.cumsum(counts > 1) - 1
    doc, column, share = doc[shared], place[where[shared]], share[shared]
    common, mass = np.zeros((n, n), np.float32), np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    doc, column, share = doc[order], column[order], share[order]
    width = 4096
    bounds = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + width + 1, width))
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        has = np.zeros((n, width), np.float32)
        part = np.zeros((n, width), np.float32)
        has[doc[a:b], column[a:b] - k * width] = 1
        part[doc[a:b], column[a:b] - k * width] = share[a:b]
        common += has @ has.T
        mass += part @ has.T
    even = sizes == total
    plain = common / (sizes[:, None] + sizes[None, :] - common)
    # Of two texts without repeats it is plain Jaccard; else at most the share of either that is common.
    most = np.where(even[:, None] & even[None, :], plain, np.minimum(mass, mass.T))
    maybe = (most >= least - 1e-3) & np.triu(np.ones((n, n), np.bool_), 1)
    if side.min() != side.max():
        maybe &= side[:, None] != side[None, :]
    a, b = np.nonzero(maybe)
    order = np.argsort(-most[a, b], kind="stable")
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True):
        p, q = root(i), root(j)
        if p == q:
            continue
        both = float(common[i, j])
        alike = both / (sizes[i] + sizes[j] - both) if even[i] and even[j] else probability_jaccard(found[i], found[j])
        if alike >= least:
            parent[p] = q
            out.append((i, j))
    return out


def verified_links(clusters: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """(a, b): links found by comparing all texts of each cluster (cid, key, root).

    A cluster is cut into blocks of up to about BLOCK texts and every two blocks meet in
    a task of their own, so no task holds a whole large cluster.
    """
    sizes = clusters.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / (BLOCK // 2)).cast("int").alias("_blocks"))
    members = clusters.join(cut(sizes), "root").withColumn("_block", F.pmod(F.xxhash64("cid"), "_blocks").cast("int"))
    texts = docs.withColumnRenamed("key", "_key").join(members.hint("shuffle_hash"), F.col("_key").eqNullSafe(F.col("key")))

    def same(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[[class_id(hashlib.sha256(b" ".join(words_of(t))).digest()) == c for t, c in zip(batch["text"], batch["cid"], strict=True)]]

    texts = texts.select("root", "cid", "text", "_block", "_blocks").mapInPandas(same, "root long, cid long, text string, _block int, _blocks int")
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    met = texts.withColumn("_other", other).select("root", F.least("_block", "_other").alias("i"), F.greatest("_block", "_other").alias("j"), "cid", "text", "_block")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("cid")
        ids = rows["cid"].to_numpy()
        if len(ids) < 2:
            return pd.DataFrame({"a": ids[:0], "b": ids[:0]})
        at = np.array(links(rows["text"].tolist(), rows["_block"].to_numpy(), least), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": ids[at[:, 0]], "b": ids[at[:, 1]]})

    return met.groupBy("root", "i", "j").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(key, class_id, class_size, n_words, text_hash, class_hash) for every row:
    near-duplicates share a class; ``text_hash`` (xxhash64) tells rows of one key apart,
    ``class_hash`` classes that have no key (and holds for texts with words only).

    Documents are linked if their shingles of five words are similar by ``least`` (see
    :func:`links`); a class is a connected component of links and is named by its
    smallest key. Texts with the same words are one to begin with. ProbMinHash signatures
    are cut into bands; buckets give clusters of candidates (:func:`candidate_edges`),
    and all texts of a cluster are compared exactly (:func:`verified_links`), so only
    pairs that share no band can be missed.

    Null, empty and white texts have no words, are never linked and are classes of their
    own (``class_id`` is their key). Rows that repeat a key and a text are copies of each
    other; a class is named by the smallest key that is not null, or null if it has none.
    Other columns are ignored. No rows: no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    sketched = cut(rows.select("key", F.xxhash64("text").alias("h"), "text").mapInArrow(_sketch, _SKETCH))
    spoken = sketched.filter("n_words > 0")
    classes = cut(spoken.groupBy("cid").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("copies")))
    firsts = classes.select(F.col("cid").alias("_cid"), "first")
    sigs = spoken.join(firsts, (F.col("cid") == F.col("_cid")) & F.col("key").eqNullSafe(F.col("first")))
    sigs = cut(sigs.select("cid", "sig", "bands").dropDuplicates(["cid"]))
    clusters = components(candidate_edges(sigs))
    members = cut(clusters.withColumnRenamed("v", "cid").join(classes, "cid").select("cid", F.col("first").alias("key"), "root"))
    tidy(spark)
    found = cut(verified_links(members, rows, least))
    tidy(spark)
    joined = components(found).withColumnRenamed("v", "_v")
    named = classes.join(joined, F.col("cid") == F.col("_v"), "left").select("cid", "first", "copies", F.coalesce("root", "cid").alias("root"))
    named = cut(named)
    whole = named.groupBy("root").agg(F.min("first").alias("class_id"), F.sum("copies").alias("class_size"))
    of_class = cut(named.select("cid", "root").join(whole, "root").select(F.col("cid").alias("_cid"), "class_id", "class_size", F.col("root").alias("class_hash")))
    done = sketched.select("key", "h", "cid", "n_words").join(of_class, F.col("cid") == F.col("_cid"), "left")
    none = F.col("n_words") == 0
    return done.select(F.col("key").alias(key), F.when(none, F.col("key")).otherwise(F.col("class_id")).alias("class_id"), F.when(none, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"), F.col("n_words").cast("long").alias("n_words"), F.col("h").alias("text_hash"), "class_hash")


def keep_first(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the one with the smallest key (of its
    texts, the one that hashes least). Texts without words all stay, whatever their key.
    Of rows that repeat both key and text, one stays."""
    found = near_duplicates(docs, key=key, text=text, least=least)
    wordless = F.col("n_words") == 0
    group = F.when(wordless, F.struct(F.col(key).alias("k"), F.col("text_hash").alias("h"))).otherwise(F.struct(F.lit(None).cast("long").alias("k"), F.col("class_hash").alias("h")))
    own = found.filter(wordless | F.col("class_id").eqNullSafe(F.col(key)))
    own = cut(own.select(key, "text_hash", wordless.alias("_none"), group.alias("_group")))
    tidy(docs.sparkSession)
    one = own.groupBy("_none", "_group").agg(F.min(F.struct(F.col(key).alias("k"), F.col("text_hash").alias("h"))).alias("m"))
    rows = own.groupBy(F.col(key).alias("_k"), F.col("text_hash").alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
    stay = one.select("m.k", "m.h").join(rows, F.col("k").eqNullSafe(F.col("_k")) & F.col("h").eqNullSafe(F.col("_h"))).select("_k", "_h", "_n")
    stay = cut(stay)

    def of(rows: DataFrame) -> DataFrame:
        return docs.join(rows.hint("shuffle_hash"), docs[key].cast("long").eqNullSafe(rows["_k"]) & F.xxhash64(docs[text].cast("string")).eqNullSafe(rows["_h"]), "left_semi")

    if not stay.filter("_n > 1").head(1):
        return of(stay)
    # Rows that the table repeats whole: these alone are deduplicated as rows.
    return of(stay.filter("_n = 1")).unionByName(of(stay.filter("_n > 1")).dropDuplicates([key, text]))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs)
    return found.select("doc_id", "class_id", "class_size", (F.col("doc_id") == F.col("class_id")).alias("kept"))


#: DuckDB: probability Jaccard of all pairs that have most of their weight in common, by
#: the pairs of weights that occur, then the closure of the links.
SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(greatest(len(ws) - {SHINGLE - 1}, 1)), lambda k: md5(array_to_string(ws[k + 1:k + {SHINGLE}], ' ')))) AS h FROM d WHERE len(ws) > 0),
s AS (SELECT doc_id, h, count(*)::DOUBLE AS x FROM g GROUP BY ALL),
n AS (SELECT doc_id, sum(x) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, a.x, b.x AS y, count(*) AS m FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
t AS (SELECT a, b, sum(m * x) AS sx, sum(m * y) AS sy, any_value(na.n) AS nx, any_value(nb.n) AS ny FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b GROUP BY a, b
  HAVING least(sx / nx, sy / ny) >= {SIMILARITY} - 0.001),
j AS (SELECT p.a, p.b, p.m / (sum(q.m * greatest(q.x / p.x, q.y / p.y)) + any_value((nx - sx) / p.x + (ny - sy) / p.y)) AS part
  FROM t JOIN c p ON p.a = t.a AND p.b = t.b JOIN c q ON q.a = t.a AND q.b = t.b GROUP BY p.a, p.b, p.x, p.y, p.m),
l AS (SELECT a, b FROM j GROUP BY a, b HAVING sum(part) >= {SIMILARITY}),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
k AS (SELECT a AS doc_id, min(b) AS class_id, count(*) AS class_size FROM r GROUP BY a)
SELECT doc_id, class_id, class_size::BIGINT AS class_size, doc_id = class_id AS kept FROM k
"""
