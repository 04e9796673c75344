"""Why an item was recommended, or was not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import cosine
from ..session import cut
from . import blocks, ranking
from .base import Recommender, SimilarityRecommender


def _shown(terms: DataFrame, n: int) -> DataFrame:
    """The n terms of each pair that weigh most, and the rest of the score."""
    order = Window.partitionBy("user_id", "item_id").orderBy(F.desc(F.abs("term")), F.asc("reason"))
    whole = F.sum("term").over(Window.partitionBy("user_id", "item_id"))
    terms = terms.withColumn("place", F.row_number().over(order)).withColumn("_whole", whole).filter(F.col("place") <= n)
    part = F.sum("term").over(Window.partitionBy("user_id", "item_id"))
    return terms.withColumn("rest", F.col("_whole") - part).drop("_whole")


def history_attribution(model: SimilarityRecommender, pairs: DataFrame, n: int = 3) -> DataFrame:
    """(user_id, item_id, place, reason, term, rest): the history items whose r * w make up
    most of a pair's score."""
    keys = pairs.select("user_id", "item_id").distinct()
    if blocks.whole_ids(model.r, "user_id", "item_id") and blocks.whole_ids(pairs, "user_id", "item_id"):
        # Read twice, so computed once; the shuffle files of its making go.
        keys = cut(keys)
        mine = model.r.join(keys.select("user_id").distinct(), "user_id", "left_semi")
        return _shown(blocks.meetings(mine, model.tables["s"].select("i", "j", "w"), "terms", pairs=keys), n)
    history = keys.join(model.r.select("user_id", F.col("item_id").alias("reason"), "r"), "user_id")
    edges = model.tables["s"].select(F.col("i").alias("reason"), F.col("j").alias("item_id"), "w")
    terms = history.join(edges, ["reason", "item_id"]).select("user_id", "item_id", "reason", (F.col("r") * F.col("w")).alias("term"))
    return _shown(terms, n)


def similar_history(model: Recommender, pairs: DataFrame, n: int = 3) -> DataFrame:
    """The same for factor models by r * cosine of item factors: an approximation, as their
    scores are no sums over the history. The item itself is left out."""
    keys = pairs.select("user_id", "item_id").distinct()
    v = model.tables["items"].select("item_id", "v")
    history = keys.join(model.r.select("user_id", F.col("item_id").alias("reason"), "r"), "user_id").filter("reason <> item_id")
    terms = history.join(v.withColumnRenamed("v", "_a"), "item_id").join(v.select(F.col("item_id").alias("reason"), F.col("v").alias("_b")), "reason")
    return _shown(terms.select("user_id", "item_id", "reason", (F.col("r") * cosine(F.col("_a"), F.col("_b"))).alias("term")), n)


def popularity_attribution(scored: DataFrame) -> DataFrame:
    """Popularity has no reasons in the user's history: all of the score is rest."""
    return scored.select("user_id", "item_id", F.col("score").alias("rest"))


def explain(model: Recommender, pairs: DataFrame, k: int = 10, *, candidates: DataFrame | None = None, exclude_seen: bool = True, exclude: DataFrame | None = None, retrieved: DataFrame | None = None, postprocessed: bool = False) -> DataFrame:
    """Adds ``status``, ``by``, ``rank`` and ``score`` to (user_id, item_id).

    Status, in this order: unknown_item; excluded (``by``: candidates, exclude or seen);
    served; dropped_by_postprocess or ranked_out for retrieved items (``retrieved``:
    qid, item_id); not_retrieved, or ranked_out where there is no retrieval stage.
    """
    asked = pairs.select("user_id", "item_id").distinct()
    mark = lambda df, keys, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    both = ["user_id", "item_id"]
    served = model.recommend(asked.select("user_id").distinct(), k, candidates=candidates, exclude_seen=exclude_seen, exclude=exclude)
    out = asked.join(mark(model.items(), ["item_id"], "_known"), "item_id", "left")
    out = out.join(served.select("user_id", "item_id", "rank"), both, "left")
    out = out.join(mark(model.r, both, "_seen"), both, "left")
    out = out.join(mark(exclude, both, "_out"), both, "left") if exclude is not None else out.withColumn("_out", F.lit(None).cast("boolean"))
    out = out.join(mark(candidates, ["item_id"], "_in"), "item_id", "left") if candidates is not None else out.withColumn("_in", F.lit(True))
    if retrieved is not None:
        out = out.join(mark(retrieved.withColumnRenamed("qid", "user_id") if "user_id" not in retrieved.columns else retrieved, both, "_got"), both, "left")
    else:
        out = out.withColumn("_got", F.lit(True))
    by = F.when(F.col("_in").isNull(), "candidates").when(F.col("_out").isNotNull(), "exclude").when(F.col("_seen").isNotNull() & F.lit(exclude_seen), "seen")
    lost = F.when(F.col("_got").isNull(), "not_retrieved").otherwise("dropped_by_postprocess" if postprocessed else "ranked_out")
    status = F.when(F.col("_known").isNull(), "unknown_item").when(by.isNotNull(), "excluded").when(F.col("rank").isNotNull(), "served").otherwise(lost)
    said = model.predict(asked).select("user_id", "item_id", "score")
    out = out.withColumn("status", status).withColumn("by", F.when(F.col("status") == "excluded", by)).join(said, both, "left")
    return out.select("user_id", "item_id", "status", "by", "rank", "score")


class Trace:
    """Collects the tables of a call's stages as one: ``add(path, kind, table)`` within the
    call, ``events()`` afterwards. ``sample``: only queries whose hash is below it."""

    def __init__(self, sample: float = 1.0):
        self.sample, self.stages = sample, []

    def add(self, path: str, kind: str, table: DataFrame) -> DataFrame:
        from .ranking import as_queries

        rows = as_queries(table)
        if self.sample < 1:
            rows = rows.filter(F.shiftrightunsigned(F.xxhash64("qid"), 11) / float(1 << 53) < self.sample)
        extra = [c for c in rows.columns if c not in ("qid", "user_id", "item_id", "rank", "score")]
        payload = F.map_from_arrays(F.array(*[F.lit(c) for c in extra]), F.array(*[F.col(c).cast("string") for c in extra])) if extra else F.create_map().cast("map<string,string>")
        has = lambda c, kind: F.col(c).cast(kind) if c in rows.columns else F.lit(None).cast(kind)
        self.stages.append(rows.select(F.lit(path).alias("path"), F.lit(kind).alias("kind"), F.col("qid").cast("string").alias("qid"), has("item_id", "string").alias("item_id"), has("rank", "long").alias("rank"), has("score", "double").alias("score"), payload.alias("payload")))
        return table

    def events(self) -> DataFrame:
        if not self.stages:
            raise ValueError("nothing was traced")
        out = self.stages[0]
        for s in self.stages[1:]:
            out = out.unionByName(s)
        return out


__all__ = ["Trace", "explain", "history_attribution", "popularity_attribution", "ranking", "similar_history"]
