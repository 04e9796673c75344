"""What all recommenders share: recommend, predict, eligibility, saving."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import matrix
from ..session import cut
from . import blocks, ranking


class Recommender:
    """A model whose state is a set of tables (``tables``) and parameters (``params``).

    ``fit(log)`` takes interactions (user_id, item_id, value). ``recommend`` answers
    (qid, user_id, rank, item_id, score); ``predict`` scores given pairs.
    """

    serves_unknown_users = False
    #: Whether ``score`` leaves out blocked pairs and items that are no candidates itself.
    filters = False

    def __init__(self, **params: Any):
        self.params = params
        self.tables: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> Any:
        params = self.__dict__.get("params", {})
        if name in params:
            return params[name]
        raise AttributeError(name)

    def clone(self, **changes: Any) -> Recommender:
        return type(self)(**{**self.params, **changes})

    # To be defined by models.
    def fit_matrix(self, r: DataFrame) -> None:
        raise NotImplementedError

    def score(self, queries: DataFrame, k: int, blocked: DataFrame | None) -> DataFrame:
        """(qid, user_id, item_id, score) holding each query's best k beyond ``blocked``."""
        raise NotImplementedError

    def predict(self, pairs: DataFrame) -> DataFrame:
        raise NotImplementedError

    # Shared.
    def fit(self, log: DataFrame) -> Recommender:
        return self.fit_on(cut(matrix(log.repartition("user_id"))))

    def fit_on(self, r: DataFrame) -> Recommender:
        """Fits on a matrix that is computed already, which several models can share."""
        self.tables = {"r": r}
        self.fit_matrix(r)
        return self

    @property
    def r(self) -> DataFrame:
        return self.tables["r"]

    def items(self) -> DataFrame:
        return self.r.select("item_id").distinct()

    def users(self) -> DataFrame:
        return self.r.select("user_id").distinct()

    def served(self, queries: DataFrame) -> DataFrame:
        """The queries the model can answer."""
        return queries if self.serves_unknown_users else queries.join(self.users(), "user_id", "left_semi")

    def recommend(self, queries: DataFrame, k: int = 10, *, candidates: DataFrame | None = None, exclude_seen: bool = True, exclude: DataFrame | None = None, strict: bool = False) -> DataFrame:
        """The k best items of each query, best first, ties to the smaller item.

        ``candidates`` (item_id) limits the items, ``exclude`` (user_id, item_id) takes
        pairs away. ``strict`` raises for unknown users and candidates and for queries with
        fewer than k items; otherwise unknown users are left out and lists may be shorter.
        """
        queries = ranking.as_queries(queries)
        if strict and not self.serves_unknown_users:
            ranking.require_known(queries, self.users(), "user_id")
        if strict and candidates is not None:
            ranking.require_known(candidates, self.items(), "item_id")
        blocked = self.r.select("user_id", "item_id") if exclude_seen else None
        if exclude is not None:
            pairs = exclude.select("user_id", "item_id")
            blocked = (pairs if blocked is None else blocked.unionByName(pairs)).distinct()
        if blocked is not None:
            blocked = blocked.join(queries.select("user_id").distinct(), "user_id", "left_semi")
        self._restricted, self._without = candidates, (exclude_seen, exclude)
        scored = self.score(self.served(queries), k, blocked)
        if not self.filters:
            scored = ranking.exclude(ranking.restrict(scored, candidates), blocked)
        best = ranking.top_k(scored, k).select("qid", "user_id", "rank", "item_id", "score")
        if strict:
            ranking.require_full(best, queries, k)
        return best

    def pool(self) -> DataFrame:
        """The items that compete: the call's candidates, or all."""
        return ranking.restrict(self.items(), self.__dict__.get("_restricted"))

    def count_eligible(self, queries: DataFrame, *, candidates: DataFrame | None = None, exclude_seen: bool = True, exclude: DataFrame | None = None) -> DataFrame:
        return ranking.count_eligible(ranking.as_queries(queries), self.items(), seen=self.r if exclude_seen else None, excluded=exclude, candidates=candidates)

    def save(self, path: str) -> None:
        """Parameters as JSON text, every table as Parquet, below ``path``."""
        spark = self.r.sparkSession
        for name, table in self.tables.items():
            table.write.mode("overwrite").parquet(f"{path}/{name}")
        spark.createDataFrame([(json.dumps({"params": self.params, "tables": list(self.tables)}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Recommender:
        said = json.loads(spark.read.text(f"{path}/model").first()[0])
        model = cls(**said["params"])
        model.tables = {name: spark.read.parquet(f"{path}/{name}") for name in said["tables"]}
        return model


class SimilarityRecommender(Recommender):
    """Models of item-item edges (table ``s``: i, j, w): score(u, j) = sum of r(u, i) w(i, j).

    ``s`` is computed once by :meth:`fit` and read by all that follows.

    Items that no edge reaches score exactly 0 and compete as such. With the parameter
    ``units`` weights are rounded to multiples of 1 / units: with whole-numbered values
    their sums are then exact, so scores and ties do not depend on the order of summation.
    """

    filters = True

    def _sum(self, r: Column, w: Column) -> Column:
        units = self.params.get("units")
        return F.sum(r * w) if units is None else F.sum(r * F.floor(w * F.lit(float(units)) + F.lit(0.5))) / F.lit(float(units))

    def _in_blocks(self) -> bool:
        return blocks.whole_ids(self.r, "user_id", "item_id")

    def _edges(self) -> DataFrame:
        """The edges to the items that compete."""
        edges = self.tables["s"].select("i", "j", "w")
        if self.__dict__.get("_restricted") is None:
            return edges
        return edges.join(self._restricted.select(F.col("item_id").alias("j")).distinct(), "j", "left_semi")

    def reached(self, queries: DataFrame) -> DataFrame:
        history = queries.select("qid", "user_id").join(self.r, "user_id")
        edges = self._edges()
        joined = history.join(edges, history["item_id"] == edges["i"])
        return joined.groupBy("qid", "user_id", "j").agg(self._sum(F.col("r"), F.col("w")).alias("score")).withColumnRenamed("j", "item_id")

    def score(self, queries: DataFrame, k: int, blocked: DataFrame | None) -> DataFrame:
        """The best k that are reached; only for queries with fewer than k scores above 0 do
        untouched items compete, so only these look at the item list."""
        queries = queries.select("qid", "user_id").distinct()
        if self._in_blocks():
            seen, exclude = self._without
            mine = self.r.join(queries.select("user_id").distinct(), "user_id", "left_semi")
            best = blocks.meetings(mine, self._edges(), "best", k=k, units=self.params.get("units"), seen=seen, exclude=exclude)
            best = cut(queries.join(best, "user_id").select("qid", "user_id", "item_id", "score"))
        else:
            best = cut(ranking.top_k(ranking.exclude(self.reached(queries), blocked), k).drop("rank"))
        full = best.filter("score > 0").groupBy("qid").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= k).select("qid")
        short = cut(queries.join(full, "qid", "left_anti"))
        if not short.head(1):
            return best
        reached = cut(self.reached(short))
        filled = ranking.exclude(ranking.zero_fill(short, reached, self.pool(), k, blocked), blocked)
        return best.join(full, "qid", "left_semi").select("qid", "user_id", "item_id", "score").unionByName(filled)

    def predict(self, pairs: DataFrame) -> DataFrame:
        """Adds ``score`` to (user_id, item_id): null for unknown users and items."""
        keys = pairs.select("user_id", "item_id").distinct()
        if self._in_blocks() and blocks.whole_ids(pairs, "user_id", "item_id"):
            pairs = cut(pairs)
            mine = self.r.join(pairs.select("user_id").distinct(), "user_id", "left_semi")
            if len(pairs.columns) == 2:
                # The blocks answer every pair, so no sums are joined to the pairs again.
                bare = F.col("user_id").isNull() | F.col("item_id").isNull()
                asked = pairs.filter(~bare).join(self.items().withColumn("known", F.lit(True)), "item_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
                answered = blocks.meetings(mine, self.tables["s"], "all", units=self.params.get("units"), pairs=asked)
                kept = [F.col(f.name).cast(f.dataType).alias(f.name) for f in pairs.schema]
                return answered.select(*kept, "score").unionByName(pairs.filter(bare).withColumn("score", F.lit(None).cast("double")))
            sums = cut(blocks.meetings(mine, self.tables["s"], "pairs", units=self.params.get("units"), pairs=pairs).withColumnRenamed("score", "_s"))
        else:
            history = keys.join(self.r.select("user_id", F.col("item_id").alias("_i"), "r"), "user_id")
            edges = self.tables["s"].select(F.col("i").alias("_i"), F.col("j").alias("item_id"), "w")
            sums = history.join(edges, ["_i", "item_id"]).groupBy("user_id", "item_id").agg(self._sum(F.col("r"), F.col("w")).alias("_s"))
        users, items = self.users().withColumn("_u", F.lit(True)), self.items().withColumn("_k", F.lit(True))
        out = pairs.join(sums, ["user_id", "item_id"], "left").join(users, "user_id", "left").join(items, "item_id", "left")
        return out.withColumn("score", F.when(F.col("_u") & F.col("_k"), F.coalesce("_s", F.lit(0.0)))).drop("_s", "_u", "_k")
