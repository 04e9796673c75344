"""Popularity, optionally per exposure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import ranking
from .base import Recommender


def item_popularity(log: DataFrame, *, weighting: str = "count", normalize: bool = False) -> DataFrame:
    """(item_id, pop): rows (``count``) or values (``sum``) of each item, or their shares."""
    pop = F.count(F.lit(1)).cast("double") if weighting == "count" else F.sum("value")
    out = log.groupBy("item_id").agg(pop.alias("pop"))
    if normalize:
        total = out.agg(F.sum("pop").alias("_all"))
        out = out.join(F.broadcast(total)).select("item_id", F.coalesce(F.try_divide("pop", "_all"), F.lit(0.0)).alias("pop"))
    return out


class MostPopular(Recommender):
    """Items by distinct users (``count``) or summed values (``sum``), the same for all
    users. With ``exposure`` (item_id, shown) by pop / (shown + smoothing); items that the
    table lacks were shown 0 times. Serves unknown users."""

    serves_unknown_users = True

    def __init__(self, weighting: str = "count", smoothing: float = 10.0, exposure: DataFrame | None = None):
        super().__init__(weighting=weighting, smoothing=smoothing)
        self.exposure = exposure

    def clone(self, **changes):
        return MostPopular(**{**self.params, "exposure": self.exposure, **changes})

    def fit_matrix(self, r: DataFrame) -> None:
        pop = F.count("user_id").cast("double") if self.weighting == "count" else F.sum("r")
        table = r.groupBy("item_id").agg(pop.alias("pop"))
        if self.exposure is not None:
            ranking.check_unique(self.exposure, "item_id")
            shown = F.coalesce("shown", F.lit(0.0)) + F.lit(float(self.smoothing))
            table = table.join(self.exposure.select("item_id", F.col("shown").cast("double")), "item_id", "left")
            if table.filter(shown <= 0).head(1):
                raise ValueError("exposure plus smoothing must be positive")
            table = table.select("item_id", (F.col("pop") / shown).alias("pop"))
        self.tables["pop"] = cut(table)

    def score(self, queries: DataFrame, k: int, blocked: DataFrame | None) -> DataFrame:
        # A query with n blocked items finds its k best among the first k + n.
        pool = self.tables["pop"].withColumnRenamed("pop", "score")
        if self.__dict__.get("_restricted") is not None:
            pool = pool.join(self.pool(), "item_id", "left_semi")
        need = queries.select("qid", "user_id")
        if blocked is None:
            need = need.withColumn("_t", F.lit(0))
        else:
            need = need.join(blocked.groupBy("user_id").agg(F.count(F.lit(1)).alias("_t")), "user_id", "left").fillna(0, ["_t"])
        return ranking.first_places(need, pool, [F.desc("score"), F.asc("item_id")], k)

    def predict(self, pairs: DataFrame) -> DataFrame:
        known = self.users().withColumn("_u", F.lit(True))
        out = pairs.join(self.tables["pop"].withColumnRenamed("pop", "_pop"), "item_id", "left").join(known, "user_id", "left")
        return out.withColumn("score", F.when(F.col("_u"), F.col("_pop"))).drop("_pop", "_u")
