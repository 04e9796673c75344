"""Approximate nearest neighbours over learned partitions (operator 9)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import attach, cut

#: Rows that the partition and its classifier are fitted on, at most.
SAMPLE = 8192
#: Neighbours of each node of the sample's graph.
DEGREE = 10
#: Rows of the sample in a part, about. Many small parts leave more of the table out at
#: the same recall than few large ones do.
PART_ROWS = 8
#: A query is sent to so many parts that this recall is reached on the sample.
TARGET_RECALL = 0.95
#: Parts are dealt to tasks in so many cells, so that a query travels once a cell.
CELLS = 16
#: Vectors and queries that meet in one task, at most about.
BLOCK_ROWS, BLOCK_QUERIES = 20_000, 2_000


@dataclass
class Router:
    """A classifier of one hidden layer: unit vector -> logits of parts."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    @property
    def parts(self) -> int:
        return self.w2.shape[1]

    def logits(self, unit: np.ndarray) -> np.ndarray:
        return np.maximum(unit @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def neighbours(unit: np.ndarray, k: int, block: int = 1024) -> np.ndarray:
    """The k nearest other rows of each row."""
    out = np.empty((len(unit), k), np.int64)
    for a in range(0, len(unit), block):
        near = unit[a : a + block] @ unit.T
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -np.inf
        out[a : a + block] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def _bisect(edges: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Sides of a balanced cut: a smooth vector over the graph, cut at its median, then
    swaps of the pairs that gain most."""
    a, b = edges
    degree = np.bincount(a, minlength=n) + 1.0
    x = rng.standard_normal(n)
    for _ in range(60):
        x = (x + np.bincount(a, weights=x[b], minlength=n)) / degree
        x -= x.mean()
        x /= np.abs(x).max() + 1e-12
    side = np.zeros(n, np.bool_)
    side[np.argsort(x, kind="stable")[n // 2 :]] = True
    for _ in range(20):
        other = np.bincount(a, weights=(side[a] != side[b]), minlength=n)
        gain = 2 * other - (degree - 1)
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left])], right[np.argsort(-gain[right])]
        m = min(len(left), len(right))
        good = int(((gain[left[:m]] + gain[right[:m]]) > 0).sum()) // 2
        if not good:
            break
        before = (side[a] != side[b]).sum()
        swapped = side.copy()
        swapped[left[:good]], swapped[right[:good]] = True, False
        if (swapped[a] != swapped[b]).sum() >= before:
            break
        side = swapped
    return side


def balanced_parts(near: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Each node's part; all parts have the same size but for rounding (parts: a power of 2)."""
    n, k = near.shape
    a, b = np.repeat(np.arange(n), k), near.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    part = np.zeros(n, np.int64)
    done = 1
    while done < parts:
        out = part * 2
        for p in range(done):
            nodes = np.flatnonzero(part == p)
            if len(nodes) < 2:
                continue
            place = np.full(n, -1)
            place[nodes] = np.arange(len(nodes))
            inside = (place[a] >= 0) & (place[b] >= 0)
            out[nodes] += _bisect(np.stack([place[a[inside]], place[b[inside]]]), len(nodes), rng)
        part, done = out, done * 2
    return part


def fit_router(vectors: np.ndarray, parts: int, k: int = 5, seed: int = 11) -> Router:
    """Cuts the sample's neighbour graph into balanced parts and learns which of them hold
    a vector's neighbours: the targets are the shares of its neighbours, itself included.

    An eighth of the sample is held out of the fit; the number of probes is the least that
    reaches TARGET_RECALL for it, so it is not judged on what the classifier has seen.
    """
    rng = np.random.default_rng(seed)
    every = _unit(rng.permutation(np.unique(vectors, axis=0))).astype(np.float32)
    unit = every[len(every) // 8 :]
    n, dim = unit.shape
    degree = min(DEGREE, n - 1)
    near = neighbours(unit, degree)
    part = balanced_parts(near, parts, rng)
    target = np.zeros((n, parts), np.float32)
    for column in (*near.T, np.arange(n), np.arange(n)):
        target[np.arange(n), part[column]] += 1 / (degree + 2)
    hidden = 128
    p = [rng.standard_normal((dim, hidden)).astype(np.float32) * (2 / dim) ** 0.5, np.zeros(hidden, np.float32), rng.standard_normal((hidden, parts)).astype(np.float32) * (2 / hidden) ** 0.5, np.zeros(parts, np.float32)]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    size, step = min(512, n), 0
    for epoch in range(25):
        order = rng.permutation(n)
        for s in range(0, n, size):
            rows = order[s : s + size]
            x = unit[rows]
            h = np.maximum(x @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            d = (z / z.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            dh = (d @ p[2].T) * (h > 0)
            step += 1
            rate = 0.01 * 0.5 ** (epoch / 8)
            for i, g in enumerate((x.T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    router = Router(*[x.astype(np.float64) for x in p], probes=parts)
    held = np.arange(max(len(every) // 8, min(len(every), 8)))
    top = neighbours(every, min(k, len(every) - 1))[held]
    z = router.logits(every.astype(np.float64))
    home = z.argmax(axis=1)
    rank = np.argsort(np.argsort(-z[held], axis=1), axis=1)
    need = rank[held[:, None], home[top]]
    shares = [(need < probes).mean() for probes in range(1, parts + 1)]
    router.probes = int(np.argmax(np.array(shares) >= TARGET_RECALL)) + 1
    return router


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v array<double>): rows that take part. Others are null in key or vector,
    hold null or non-finite components, or are zero (an empty one is)."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    return rows.filter(F.forall("v", ok) & F.exists("v", lambda x: x != 0))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def nearest(q: np.ndarray, own: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, id, score) of each query's k nearest, ties to the smaller id.

    A matrix product finds who may be among them; their scores are then computed pair by
    pair, so that equal vectors get equal scores in any block.
    """
    order = np.argsort(ids, kind="stable")
    v, ids = v[order], ids[order]
    first = np.concatenate([[True], ids[1:] != ids[:-1]])
    v, ids = v[first], ids[first]
    vn, qn = np.sqrt((v * v).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
    vu = (v / vn[:, None]).T
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(q), 256):
        near = (q[a : a + 256] / qn[a : a + 256, None]) @ vu
        for i in range(len(near)):
            row = near[i]
            row[ids == own[a + i]] = -np.inf
            least = np.partition(row, -k)[-k] if len(row) > k else -np.inf
            at = np.flatnonzero((row >= least - 1e-9) & (row > -np.inf))
            score = (v[at] * q[a + i]).sum(axis=1) / (vn[at] * qn[a + i])
            best = np.lexsort((ids[at], -score))[:k]
            out.append((np.full(len(best), a + i), ids[at[best]], score[best]))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def search(vectors: DataFrame, queries: DataFrame, router: Router | None, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each query within the parts it is
    sent to.

    ``router`` None: all vectors of the query's length are one part. Parts are gathered in
    cells; vectors and queries of a cell meet in blocks of about BLOCK_ROWS by
    BLOCK_QUERIES, so no part and no group of copies fills a task. A query travels once to
    each cell, with the list of its parts there.
    """
    wide = max(1, router.parts // CELLS) if router else 1

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                part = router.logits(_unit(_matrix(batch["v"]))).argmax(axis=1).astype(np.int32)
                yield batch.assign(cell=part // wide, part=part)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                z = router.logits(_unit(_matrix(batch["v"])))
                top = np.sort(np.argsort(-z, axis=1, kind="stable")[:, : router.probes], axis=1).astype(np.int32)
                rows = [(i, v, c, row[row // wide == c].tolist()) for i, v, row in zip(batch["vec_id"], batch["v"], top, strict=True) for c in np.unique(row // wide).tolist()]
                yield pd.DataFrame(rows, columns=["vec_id", "v", "cell", "parts"])

    if router is None:
        whole = F.size("v")
        placed, sent = vectors.select("vec_id", "v", whole.alias("cell"), whole.alias("part")), queries.select("vec_id", "v", whole.alias("cell"), F.array(whole).alias("parts"))
    else:
        placed = vectors.mapInPandas(place, "vec_id long, v array<double>, cell int, part int")
        sent = queries.mapInPandas(send, "vec_id long, v array<double>, cell int, parts array<int>")
    placed, sent = cut(placed), cut(sent)
    count = lambda df, size, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    # One row for each cell: at most CELLS, or one for each length of vectors.
    blocks = cut(count(placed, BLOCK_ROWS, "nv").join(count(sent, BLOCK_QUERIES, "nq"), "cell"))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = attach(sent, blocks, ["cell"]).filter("nv > 0").withColumn("qb", F.pmod(F.xxhash64("vec_id"), "nq").cast("int")).withColumn("vb", each("nv"))
    right = attach(placed, blocks, ["cell"]).filter("nq > 0").withColumn("vb", F.pmod(F.xxhash64("vec_id"), "nv").cast("int")).withColumn("qb", each("nq"))
    keys = ["cell", "qb", "vb"]

    def meet(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})]
        q = q.drop_duplicates("vec_id")
        if len(q) and len(v):
            asked, own, each = _matrix(q["v"]), q["vec_id"].to_numpy(), _matrix(v["v"])
            by, ids = v["part"].to_numpy(), v["vec_id"].to_numpy()
            lists = q["parts"].tolist()
            who, to = np.repeat(np.arange(len(q)), [len(x) for x in lists]), np.concatenate(lists)
            for part in np.intersect1d(by, to):
                rows, some = np.flatnonzero(by == part), who[to == part]
                at, found, score = nearest(asked[some], own[some], each[rows], ids[rows], k)
                out.append(pd.DataFrame({"query_id": own[some][at], "vec_id": found, "score": score}))
        return pd.concat(out)

    # Aliased, as both sides may come from one table.
    left = left.select(*[F.col(c).alias(c) for c in (*keys, "vec_id", "v", "parts")])
    right = right.select(*[F.col(c).alias(c) for c in (*keys, "vec_id", "v", "part")])
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def parts_for(rows: int) -> int:
    """Parts for a sample of so many rows: a power of two."""
    return max(2, 1 << round(math.log2(max(1.0, rows / PART_ROWS))))


def ann(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5, sample: int = SAMPLE) -> DataFrame:
    """The ``k`` nearest other rows, by cosine, of each row whose ``key`` is divisible by
    ``every``: (query_id, rank, vec_id, score), nearest first, ties to the smaller id.

    At most ``sample`` rows (the first by a hash) are collected; their neighbour graph is
    cut into balanced parts and a small classifier learns which parts hold a vector's
    neighbours. It puts every vector into its most probable part and sends each query to
    the most probable ones, as many as reach TARGET_RECALL on the sample; all vectors
    there are compared exactly. That holds at every size; only queries whose parts hold
    fewer than ``k`` others are searched whole.

    Only vectors of one length have a cosine: the most common length is partitioned,
    those of other lengths are searched whole among their like. Rows that take no part:
    see :func:`usable`. Rows with one key: the first by a sort of its block is taken, so
    repeated rows count once. Other columns are ignored. No rows: no rows.
    """
    rows = cut(usable(vectors.select(key, vector), key, vector))
    queries = rows.filter(F.col("vec_id") % every == 0)
    most = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").first()
    main = F.size("v") == (most["n"] if most else 0)
    some = rows.filter(main).orderBy(F.xxhash64(F.lit("sample"), "vec_id"), "vec_id").limit(sample).select("v").toPandas()
    distinct = np.unique(_matrix(some["v"]), axis=0) if len(some) else np.empty((0, 1))
    if len(distinct) < 4:
        return search(rows, queries, None, k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    router = fit_router(distinct, parts_for(len(distinct)), k)
    found = cut(search(rows.filter(main), queries.filter(main), router, k))
    full = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= k).select(F.col("query_id").alias("vec_id"))
    short = cut(queries.join(full, "vec_id", "left_anti"))
    if short.head(1):
        found = found.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").unionByName(search(rows, short, None, k))
    return found.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
