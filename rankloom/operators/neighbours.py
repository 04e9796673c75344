"""Item-item models as edge tables: cosine, BM25 and random walks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut
from . import blocks
from .base import SimilarityRecommender


def strongest(edges: DataFrame, by: str, other: str, n: int | None) -> DataFrame:
    """The n heaviest edges of each ``by``, ties to the smaller ``other``."""
    if n is None:
        return edges
    order = Window.partitionBy(by).orderBy(F.desc("w"), F.asc(other))
    return edges.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n).drop("_n")


def gram(r: DataFrame, weight: str = "r", *, diagonal: bool = True) -> DataFrame:
    """(i, j, dot): sums over users of products of their weights, for all item pairs that
    share a user. Only pairs i <= j are joined and summed; the rest is their mirror."""
    a = r.select("user_id", F.col("item_id").alias("i"), F.col(weight).alias("_x"))
    b = r.select("user_id", F.col("item_id").alias("j"), F.col(weight).alias("_y"))
    pairs = a.join(b, (a["user_id"] == b["user_id"]) & ((a["i"] <= b["j"]) if diagonal else (a["i"] < b["j"])))
    half = pairs.groupBy("i", "j").agg(F.sum(F.col("_x") * F.col("_y")).alias("dot"))
    both = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return half.select(F.explode(both).alias("p"), "dot").select("p.i", "p.j", "dot")


def cosine_edges(r: DataFrame, shrink: float, n: int | None = None, targets: DataFrame | None = None) -> DataFrame:
    """(i, j, w): cosines, of each target j the n largest; ``targets`` (item_id): only theirs."""
    if blocks.whole_ids(r, "user_id", "item_id"):
        rows = r.withColumn("f", F.sum(F.col("r") * F.col("r")).over(Window.partitionBy("item_id")))
        if targets is None:
            rows = rows.withColumn("x", F.col("r"))
        else:
            rows = rows.join(targets.select("item_id").distinct().withColumn("_t", F.lit(True)), "item_id", "left").withColumn("x", F.when(F.col("_t"), F.col("r")).otherwise(0.0))
        cosine = lambda dot, f, g: dot / (np.sqrt(f) * np.sqrt(g) + float(shrink))
        return blocks.products(rows.select("user_id", "item_id", "x", F.col("r").alias("y"), "f", F.col("f").alias("g")), cosine, n, own="j", other="i").select("i", "j", "w")
    norms = r.groupBy("item_id").agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("_norm"))
    pairs = gram(r, diagonal=False).filter("dot <> 0")
    pairs = pairs.join(norms.select(F.col("item_id").alias("i"), F.col("_norm").alias("_ni")), "i").join(norms.select(F.col("item_id").alias("j"), F.col("_norm").alias("_nj")), "j")
    edges = pairs.select("i", "j", (F.col("dot") / (F.col("_ni") * F.col("_nj") + F.lit(float(shrink)))).alias("w"))
    if targets is not None:
        edges = edges.join(targets.select(F.col("item_id").alias("j")).distinct(), "j", "left_semi").select("i", "j", "w")
    return strongest(edges, "j", "i", n)


class ItemKNN(SimilarityRecommender):
    """w(i, j) = <R_i, R_j> / (|R_i| |R_j| + shrink); each target j keeps its
    ``n_neighbors`` heaviest neighbours."""

    def __init__(self, n_neighbors: int | None = 50, shrink: float = 0.0, units: float | None = None):
        super().__init__(n_neighbors=n_neighbors, shrink=shrink, units=units)

    def fit_matrix(self, r: DataFrame) -> None:
        self.tables["s"] = cut(cosine_edges(r, self.shrink, self.n_neighbors))


def bm25_weights(r: DataFrame, k1: float, b: float) -> DataFrame:
    """(user_id, item_id, x): BM25 with items as documents, as long as their values' sum, and
    users as terms. ``r`` is read three times and should be computed already."""
    items = r.groupBy("item_id").agg(F.sum("r").alias("_sum"))
    users = r.groupBy("user_id").agg(F.count(F.lit(1)).cast("double").alias("_n"))
    n, mean = items.agg(F.count(F.lit(1)).cast("double"), F.avg("_sum")).first()
    items = items.select("item_id", (F.lit(1.0 - b) + F.lit(float(b)) * F.col("_sum") / F.lit(mean)).alias("_l"))
    users = users.select("user_id", (F.ln(F.lit(n)) - F.log1p("_n")).alias("_idf"))
    joined = r.join(items, "item_id").join(users, "user_id")
    return joined.select("user_id", "item_id", (F.col("r") * (k1 + 1) / (F.lit(float(k1)) * F.col("_l") + F.col("r")) * F.col("_idf")).alias("x"))


class BM25(SimilarityRecommender):
    """Edges are inner products of BM25 weights, an item's own included; each source i keeps
    its ``n_neighbors`` heaviest. Scores take the raw values."""

    def __init__(self, n_neighbors: int | None = 20, k1: float = 1.2, b: float = 0.75, units: float | None = None):
        super().__init__(n_neighbors=n_neighbors, k1=k1, b=b, units=units)

    def fit_matrix(self, r: DataFrame) -> None:
        if blocks.whole_ids(r, "user_id", "item_id"):
            units = self.units
            x = F.col("x") if units is None else F.floor(F.col("x") * F.lit(float(units)) + F.lit(0.5)).cast("double")
            scale = 1.0 if units is None else float(units) ** 2
            rows = bm25_weights(r, self.k1, self.b).select("user_id", "item_id", x.alias("x"), x.alias("y"), F.lit(0.0).alias("f"), F.lit(0.0).alias("g"))
            self.tables["s"] = cut(blocks.products(rows, lambda dot, f, g: dot / scale, self.n_neighbors, own="i", other="j", same=True))
            return
        x = cut(bm25_weights(r, self.k1, self.b))
        if self.units is None:
            edges = gram(x, "x").withColumnRenamed("dot", "w")
        else:
            whole = x.withColumn("x", F.floor(F.col("x") * self.units + F.lit(0.5)).cast("double"))
            edges = gram(whole, "x").withColumn("w", F.col("dot") / F.lit(float(self.units) ** 2)).drop("dot")
        self.tables["s"] = cut(strongest(edges.filter("w <> 0"), "i", "j", self.n_neighbors))


def walk_edges(r: DataFrame, alpha: float, beta: float, units: float | None = None, n: int | None = None) -> DataFrame:
    """w(i, j) = pop_i^-alpha pop_j^-beta * sum over users of i of (r_uj / sum |r_u|)^alpha; of
    each source i the n largest."""
    r = r.filter("r <> 0")
    if blocks.whole_ids(r, "user_id", "item_id"):
        pop = F.count(F.lit(1)).over(Window.partitionBy("item_id")).cast("double")
        # Rows carry the value and the count, a byte or two each once packed, and not shares
        # and powers: blocks have whole users, whose shares they make. Of different counts
        # there are few (n of them need n * (n + 1) / 2 rows), so all tasks get these.
        rows = r.withColumn("_pop", pop).select("user_id", "item_id", F.lit(1.0).alias("x"), F.abs("r").alias("y"), F.col("_pop").alias("f"), F.col("_pop").alias("g"))
        counts = r.groupBy("item_id").agg(F.count(F.lit(1)).cast("double").alias("_pop")).select("_pop").distinct()
        powers = counts.select("_pop", F.pow("_pop", F.lit(-float(alpha))), F.pow("_pop", F.lit(-float(beta)))).orderBy("_pop").collect()
        known, by_source, by_target = np.array([tuple(p) for p in powers], float).reshape(-1, 3).T

        def finish(dot: np.ndarray, f: np.ndarray, g: np.ndarray) -> np.ndarray:
            f, g = by_source[np.searchsorted(known, f)], by_target[np.searchsorted(known, g)]
            if units is None:
                return dot * f * g
            return np.floor(dot / float(units) * f * g * float(units) + 0.5) / float(units)

        def shares(r: np.ndarray, first: np.ndarray) -> np.ndarray:
            total = np.add.reduceat(r, first) if len(first) else r
            share = np.power(r / np.repeat(total, np.diff(np.append(first, len(r)))), float(alpha))
            return share if units is None else np.floor(share * float(units) + 0.5)

        return blocks.products(rows, finish, n, own="i", other="j", of_user=shares)
    share = F.abs("r") / F.sum(F.abs("r")).over(Window.partitionBy("user_id"))
    p = r.select("user_id", F.col("item_id").alias("j"), F.pow(share, F.lit(float(alpha))).alias("_p"))
    pop = r.groupBy("item_id").agg(F.count(F.lit(1)).cast("double").alias("_pop"))
    pairs = r.select("user_id", F.col("item_id").alias("i")).join(p, "user_id").filter("i <> j")
    whole = lambda c: c if units is None else F.floor(c * F.lit(float(units)) + F.lit(0.5)) / F.lit(float(units))
    total = F.sum("_p") if units is None else F.sum(F.floor(F.col("_p") * F.lit(float(units)) + F.lit(0.5))) / F.lit(float(units))
    sums = pairs.groupBy("i", "j").agg(total.alias("_w"))
    sums = sums.join(pop.select(F.col("item_id").alias("i"), F.pow("_pop", F.lit(-float(alpha))).alias("_a")), "i").join(pop.select(F.col("item_id").alias("j"), F.pow("_pop", F.lit(-float(beta))).alias("_b")), "j")
    return strongest(sums.select("i", "j", whole(F.col("_w") * F.col("_a") * F.col("_b")).alias("w")).filter("w <> 0"), "i", "j", n)


def pruned_walk(walk: DataFrame, n: int | None, normalize: bool, units: float | None = None) -> DataFrame:
    """The n heaviest of each source, scaled to sum 1, then the n heaviest of each target."""
    edges = strongest(walk, "i", "j", n)
    if normalize:
        # Whole numbers of units sum to the same in any order.
        size = F.abs("w") if units is None else F.floor(F.abs("w") * F.lit(float(units)) + F.lit(0.5)).cast("double")
        part = F.col("w") if units is None else F.signum("w") * size
        edges = edges.withColumn("w", part / F.sum(size).over(Window.partitionBy("i")))
    return strongest(edges, "j", "i", n)


class RP3Beta(SimilarityRecommender):
    """A walk user - item - user - item, popularity damped by ``alpha`` and ``beta``. The
    table ``walk`` keeps the edges before pruning, for incremental updates."""

    def __init__(self, n_neighbors: int | None = 100, alpha: float = 1.0, beta: float = 0.6, normalize_similarity: bool = True, units: float | None = None):
        super().__init__(n_neighbors=n_neighbors, alpha=alpha, beta=beta, normalize_similarity=normalize_similarity, units=units)

    def fit_matrix(self, r: DataFrame) -> None:
        # Read once here, so it stays a plan; a batch update keeps its rows.
        self.tables["walk"] = walk_edges(r, self.alpha, self.beta, self.units)
        best = walk_edges(r, self.alpha, self.beta, self.units, self.n_neighbors)
        self.tables["s"] = cut(pruned_walk(best, self.n_neighbors, self.normalize_similarity, self.units))
