"""Ranking and beyond-accuracy metrics: one join of lists and truth, many aggregates."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import Recommender
from .popular import item_popularity

RANKING = ["precision", "recall", "ndcg", "map", "mrr", "hit_rate"]
_ALIASES = {"ap": "map", "average_precision": "map", "rr": "mrr", "reciprocal_rank": "mrr", "hr": "hit_rate", "hitrate": "hit_rate"}


def parse(name: str) -> tuple[str, int | None]:
    """"ndcg@10" as ("ndcg", 10); "mrr" as ("mrr", None)."""
    found = re.fullmatch(r"\s*([a-z_]+?)\s*(?:@\s*(\d+))?\s*", name.lower())
    if not found:
        raise ValueError(f"not a metric: {name!r}")
    metric = _ALIASES.get(found[1], found[1])
    if metric not in RANKING:
        raise ValueError(f"unknown metric {found[1]!r}; known: {RANKING}")
    return metric, int(found[2]) if found[2] else None


def relevant(held_out: DataFrame) -> DataFrame:
    """(qid, item_id): pairs with a positive value; users without one are not evaluated."""
    rows = held_out.filter(F.col("value") > 0) if "value" in held_out.columns else held_out
    return rows.select(F.col("qid") if "qid" in rows.columns else F.col("user_id").alias("qid"), "item_id").distinct()


def per_query(ranked: DataFrame, truth: DataFrame, cutoffs: Sequence[int]) -> DataFrame:
    """A row for each query of ``truth`` with all ranking metrics at all cutoffs, named
    metric@k. Queries without a list count as all misses."""
    top = max(cutoffs)
    hits = ranked.filter(F.col("rank") <= top).join(truth.withColumn("_hit", F.lit(1.0)), ["qid", "item_id"], "left")
    hits = hits.select("qid", "rank", F.coalesce("_hit", F.lit(0.0)).alias("hit"))
    so_far = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("_prec", F.sum("hit").over(so_far) / F.col("rank"))
    sums = []
    for k in cutoffs:
        at = F.col("rank") <= k
        sums += [
            F.sum(F.when(at, F.col("hit"))).alias(f"_hits{k}"),
            F.sum(F.when(at, F.col("hit") / F.log2(F.col("rank") + F.lit(1.0)))).alias(f"_dcg{k}"),
            F.sum(F.when(at, F.col("hit") * F.col("_prec"))).alias(f"_ap{k}"),
            F.min(F.when(at & (F.col("hit") > 0), F.col("rank"))).alias(f"_first{k}"),
        ]
    found = hits.groupBy("qid").agg(*sums)
    out = truth.groupBy("qid").agg(F.count(F.lit(1)).alias("_rel")).join(found, "qid", "left")
    ideal = [0.0]
    for r in range(1, top + 1):
        ideal.append(ideal[-1] + 1 / math.log2(r + 1))
    table = F.array(*[F.lit(x) for x in ideal])
    columns = []
    zero = F.lit(0.0)
    for k in cutoffs:
        least = F.least(F.col("_rel"), F.lit(k)).cast("int")
        n = F.coalesce(f"_hits{k}", zero)
        columns += [
            (n / k).alias(f"precision@{k}"),
            (n / F.col("_rel")).alias(f"recall@{k}"),
            (F.coalesce(f"_dcg{k}", zero) / F.get(table, least)).alias(f"ndcg@{k}"),
            (F.coalesce(f"_ap{k}", zero) / least).alias(f"map@{k}"),
            F.coalesce(1.0 / F.col(f"_first{k}"), zero).alias(f"mrr@{k}"),
            F.when(n > 0, 1.0).otherwise(0.0).alias(f"hit_rate@{k}"),
        ]
    return out.select("qid", *columns)


def average(values: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """One row: the mean over queries of every metric, or weighted by (qid, weight)."""
    names = [c for c in values.columns if c != "qid"]
    if weights is None:
        return values.agg(*[F.avg(f"`{c}`").alias(c) for c in names])
    joined = values.join(weights, "qid")
    return joined.agg(*[(F.sum(F.col(f"`{c}`") * F.col("weight")) / F.sum("weight")).alias(c) for c in names])


def evaluate(model: Recommender, held_out: DataFrame, metrics: Sequence[str] = ("ndcg@10",), k: int = 10, **options) -> dict[str, float]:
    """Metric means over users with relevant held-out items that the model serves; one
    ranking at the largest cutoff."""
    wanted = [(m, c or k) for m, c in map(parse, metrics)]
    truth = relevant(held_out)
    queries = model.served(truth.select(F.col("qid").alias("user_id")).distinct().withColumn("qid", F.col("user_id")))
    truth = truth.join(queries.select("qid"), "qid", "left_semi")
    cutoffs = sorted({c for _, c in wanted})
    ranked = model.recommend(queries, max(cutoffs), **options)
    row = average(per_query(ranked, truth, cutoffs)).first()
    return {f"{m}@{c}": row[f"{m}@{c}"] for m, c in wanted}


def scorer(metric: str = "ndcg@10", **options):
    """A function (model, held-out log) -> number, for tuning."""
    name, k = parse(metric)

    def score(model: Recommender, held_out: DataFrame) -> float:
        return evaluate(model, held_out, [f"{name}@{k or 10}"], **options)[f"{name}@{k or 10}"]

    return score


def catalog_coverage(ranked: DataFrame, catalog: DataFrame, k: int) -> DataFrame:
    """(coverage): distinct items in the first k of any list, of all in ``catalog``. Items
    outside it are an error of the caller and make the result null."""
    shown = ranked.filter(F.col("rank") <= k).select("item_id").distinct().withColumn("_s", F.lit(1)).join(catalog.select("item_id").distinct().withColumn("_c", F.lit(1)), "item_id", "full")
    outside = F.count(F.when(F.col("_c").isNull(), 1))
    return shown.agg(F.when(outside == 0, F.try_divide(F.count("_s").cast("double"), F.count("_c"))).alias("coverage"))


def user_coverage(ranked: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(coverage): share of queries whose list has k items."""
    full = ranked.filter((F.col("rank") <= k) & F.col("item_id").isNotNull()).groupBy("qid").agg(F.count(F.lit(1)).alias("_n"))
    marked = queries.select("qid").distinct().join(full, "qid", "left")
    return marked.agg(F.avg(F.when(F.coalesce("_n", F.lit(0)) >= k, 1.0).otherwise(0.0)).alias("coverage"))


def mean_popularity(ranked: DataFrame, popularity: DataFrame, k: int) -> DataFrame:
    """(qid, mean_popularity) of the first k; items without one count 0."""
    rows = ranked.filter(F.col("rank") <= k).join(popularity.select("item_id", "pop"), "item_id", "left")
    return rows.groupBy("qid").agg(F.avg(F.coalesce("pop", F.lit(0.0))).alias("mean_popularity"))


def novelty(ranked: DataFrame, popularity: DataFrame, k: int, smoothing: float = 1.0) -> DataFrame:
    """(qid, novelty): mean of -log2((pop + s) / (sum of pop + s n)) over the first k."""
    whole = popularity.agg(F.sum("pop").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    rows = ranked.filter(F.col("rank") <= k).join(popularity.select("item_id", "pop"), "item_id", "left").join(F.broadcast(whole))
    s = F.lit(float(smoothing))
    surprise = -F.log2((F.coalesce("pop", F.lit(0.0)) + s) / (F.col("_sum") + s * F.col("_n")))
    return rows.groupBy("qid").agg(F.avg(surprise).alias("novelty"))


def candidate_recall(retrieved: DataFrame, truth: DataFrame) -> DataFrame:
    """(recall): share of all relevant pairs that retrieval reached, the ranker's ceiling."""
    hit = truth.join(retrieved.select("qid", "item_id").distinct().withColumn("_r", F.lit(1.0)), ["qid", "item_id"], "left")
    return hit.agg(F.avg(F.coalesce("_r", F.lit(0.0))).alias("recall"))


__all__ = ["RANKING", "average", "candidate_recall", "catalog_coverage", "evaluate", "item_popularity", "mean_popularity", "novelty", "parse", "per_query", "relevant", "scorer", "user_coverage"]
