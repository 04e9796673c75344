"""Vector indexes: quantized scan with exact rerank, and locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, equalize_norms, pad_query
from . import ranking
from .factors import factor_top_k


class ExactIndex:
    """Inner products with every item."""

    def fit(self, items: DataFrame) -> ExactIndex:
        self.items = items.select("item_id", "v")
        return self

    def query(self, queries: DataFrame, k: int, *, candidates: DataFrame | None = None, excluded: DataFrame | None = None) -> DataFrame:
        pool = ranking.restrict(self.items, candidates).withColumn("bias", F.lit(0.0))
        return factor_top_k(queries.withColumn("offset", F.lit(0.0)), pool, k, excluded)


def clipping_bounds(items: DataFrame, quantile: float = 0.0) -> DataFrame:
    """(dim, lo, hi): least and greatest of each component, or its quantiles."""
    parts = items.select(F.posexplode("v").alias("dim", "x"))
    if quantile:
        return parts.groupBy("dim").agg(F.percentile("x", F.lit(quantile)).alias("lo"), F.percentile("x", F.lit(1 - quantile)).alias("hi"))
    return parts.groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))


def encode(v: Column, lo: Column, scale: Column, levels: int) -> Column:
    """Codes 0..levels: the clipped components' steps from the lower bound, rounded half to
    even; a component without spread has code 0."""
    parts = F.arrays_zip(v.alias("v"), lo.alias("lo"), scale.alias("s"))
    step = lambda p: F.when(p["s"] > 0, F.rint(F.least(F.greatest((p["v"] - p["lo"]) / F.when(p["s"] > 0, p["s"]), F.lit(0.0)), F.lit(float(levels))))).otherwise(0.0)
    return F.transform(parts, lambda p: step(p).cast("int"))


def decode(codes: Column, lo: Column, scale: Column) -> Column:
    return F.transform(F.arrays_zip(codes.alias("c"), lo.alias("lo"), scale.alias("s")), lambda p: p["lo"] + p["c"] * p["s"])


def pack(codes: Column, bits: int) -> Column:
    """Codes of ``bits`` each, packed into longs of 64 / bits codes (low bits first)."""
    per = 64 // bits
    groups = F.sequence(F.lit(0), F.floor((F.size(codes) - 1) / per).cast("int"))
    word = lambda g: F.aggregate(F.slice(codes, g * per + 1, F.lit(per)), F.struct(F.lit(0).cast("long").alias("w"), F.lit(0).alias("i")), lambda s, c: F.struct(s["w"].bitwiseOR(F.call_function("shiftleft", c.cast("long"), s["i"] * bits)).alias("w"), (s["i"] + 1).alias("i")), lambda s: s["w"])
    return F.transform(groups, word)


def unpack(words: Column, bits: int, n: Column) -> Column:
    per, mask = 64 // bits, (1 << bits) - 1
    at = F.sequence(F.lit(0), n - 1)
    return F.transform(at, lambda i: F.call_function("shiftrightunsigned", F.get(words, F.floor(i / per).cast("int")), F.pmod(i, F.lit(per)) * bits).bitwiseAND(F.lit(mask).cast("long")).cast("int"))


class QuantizedFlat:
    """Components as codes of ``bits`` bits; a scan of decoded products keeps oversample * k
    items, whose exact products give the k best."""

    def __init__(self, bits: int = 8, quantile: float = 0.0, oversample: int = 4):
        self.bits, self.quantile, self.oversample = bits, quantile, oversample

    def fit(self, items: DataFrame) -> QuantizedFlat:
        levels = (1 << self.bits) - 1
        bounds = clipping_bounds(items, self.quantile)
        rows = F.array_sort(F.collect_list(F.struct("dim", "lo", ((F.col("hi") - F.col("lo")) / levels).alias("s"))))
        # One row of 2 * dimension numbers.
        self.bounds = bounds.agg(rows.alias("b")).select(F.col("b.lo").alias("lo"), F.col("b.s").alias("scale"))
        coded = items.select("item_id", "v").join(F.broadcast(self.bounds))
        self.codes = coded.select("item_id", "v", encode(F.col("v"), F.col("lo"), F.col("scale"), levels).alias("codes"))
        self.items = items
        return self

    def query(self, queries: DataFrame, k: int, *, candidates: DataFrame | None = None, excluded: DataFrame | None = None) -> DataFrame:
        pool = ranking.restrict(self.codes, candidates)
        decoded = pool.join(F.broadcast(self.bounds)).select("item_id", decode(F.col("codes"), F.col("lo"), F.col("scale")).alias("v"), F.lit(0.0).alias("bias"))
        near = factor_top_k(queries.withColumn("offset", F.lit(0.0)), decoded, k * self.oversample, excluded)
        exact = near.select("qid", "user_id", "item_id").join(self.items.select("item_id", F.col("v").alias("_v")), "item_id").join(queries.select("qid", F.col("v").alias("_q")), "qid")
        scored = exact.select("qid", "user_id", "item_id", dot(F.col("_q"), F.col("_v")).alias("score"))
        return ranking.top_k(scored, k).select("qid", "user_id", "rank", "item_id", "score")


class RandomProjection:
    """Buckets of random projections of norm-equalised vectors (pyspark.ml), where a graph
    walk has no counterpart: approximate, items found in no common bucket are missed."""

    def __init__(self, tables: int = 8, length: float = 0.5, seed: int = 0):
        self.tables, self.length, self.seed = tables, length, seed

    def fit(self, items: DataFrame) -> RandomProjection:
        from pyspark.ml.feature import BucketedRandomProjectionLSH
        from pyspark.ml.functions import array_to_vector

        self.items = items
        equal = equalize_norms(items).withColumn("_x", array_to_vector("v"))
        self.model = BucketedRandomProjectionLSH(inputCol="_x", outputCol="_h", bucketLength=self.length, numHashTables=self.tables, seed=self.seed).fit(equal)
        self.hashed = self.model.transform(equal).select("item_id", F.posexplode("_h").alias("_t", "_b"))
        return self

    def query(self, queries: DataFrame, k: int, *, candidates: DataFrame | None = None, excluded: DataFrame | None = None) -> DataFrame:
        from pyspark.ml.functions import array_to_vector, vector_to_array

        asked = queries.withColumn("_x", array_to_vector(pad_query(F.col("v"))))
        asked = self.model.transform(asked).select("qid", "user_id", F.posexplode("_h").alias("_t", "_b"))
        key = lambda df: df.withColumn("_b", F.floor(vector_to_array("_b")[0]).cast("long"))
        met = key(asked).join(key(ranking.restrict(self.hashed, candidates)), ["_t", "_b"]).select("qid", "user_id", "item_id").distinct()
        met = ranking.exclude(met, excluded).join(self.items.select("item_id", F.col("v").alias("_v")), "item_id").join(queries.select("qid", F.col("v").alias("_q")), "qid")
        return ranking.top_k(met.select("qid", "user_id", "item_id", dot(F.col("_q"), F.col("_v")).alias("score")), k).select("qid", "user_id", "rank", "item_id", "score")


_REGISTRY: dict[str, Callable] = {"exact": ExactIndex, "quantized": QuantizedFlat, "lsh": RandomProjection}


def register_index(name: str, make: Callable) -> None:
    _REGISTRY[name] = make


def available_indexes() -> list[str]:
    return sorted(_REGISTRY)


def make_index(name: str, **params):
    if name not in _REGISTRY:
        raise ValueError(f"no index {name!r}; there are {available_indexes()}")
    return _REGISTRY[name](**params)


def worthwhile(n_candidates: int, k: int, least: int = 4096, search: int = 64) -> bool:
    """Whether an index beats a scan: enough candidates, and many more than are asked for."""
    return n_candidates >= max(least, 10 * max(k, search))


def navigability(items: DataFrame) -> DataFrame:
    """(ratio): the squared length of the mean vector over the dimension. At 1 or more a
    common direction outweighs the rest, and greedy graph walks get stuck on hubs."""
    parts = items.select("item_id", F.posexplode("v").alias("dim", "x"))
    means = parts.groupBy("dim").agg(F.avg("x").alias("m"))
    dims = means.agg(F.sum(F.col("m") * F.col("m")).alias("_square"), F.count(F.lit(1)).alias("_n"))
    return dims.select((F.col("_square") / F.col("_n")).alias("ratio"))


def index_recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(recall, churn): share of exact results found, share of first places that differ."""
    hit = exact.join(found.select("qid", "item_id").withColumn("_f", F.lit(1.0)), ["qid", "item_id"], "left")
    hit = hit.join(found.filter("rank = 1").select("qid", F.col("item_id").alias("_first")), "qid", "left")
    changed = F.avg(F.when(F.col("rank") == 1, F.when(F.col("_first").eqNullSafe(F.col("item_id")), 0.0).otherwise(1.0)))
    return hit.agg(F.avg(F.coalesce("_f", F.lit(0.0))).alias("recall"), changed.alias("churn"))
