"""Queries of filters, lists, fusion, features, rankers and pipelines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import windows
from ..functions.hashing import unit_hash
from ..operators import cascade, compose, conditions, explain, features, rankers, ranking
from ..operators.neighbours import ItemKNN
from ..operators.popular import MostPopular
from ..operators.splits import first_rows, latest_split
from ..schema import matrix
from ..session import cut
from ..sources.tables import ORDER, clicks, table
from .models import _KNN, _PAIRS, _SCORED, K, N, UNITS, _out, _pairs
from .registry import BY, all_users, log, query, top

#: Two models' lists in SQL: a (neighbours) and b (popularity), 20 items each.
_LISTS = _KNN.format(n=N) + _SCORED + f""", a AS ({top(20)}),
pop AS (SELECT item_id, count(*)::DOUBLE AS pop FROM r GROUP BY 1),
ps AS (SELECT u.user_id, p.item_id, p.pop AS score FROM users u CROSS JOIN pop p WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = u.user_id AND r.item_id = p.item_id)),
b AS ({top(20, "ps")})"""


def _lists(x: DataFrame, n: int = 20) -> list[DataFrame]:
    """The models share one matrix; lists are read several times, so each is computed once."""
    r = cut(matrix(x.repartition("user_id")))
    queries = ranking.as_queries(all_users(r))
    return [cut(m.fit_on(r).recommend(queries, n)) for m in (ItemKNN(N, units=UNITS), MostPopular())]


@query(_LISTS + """, merged AS (SELECT user_id, item_id, min(struct_pack(r := rank, s := src)) AS m FROM (SELECT *, 0 AS src FROM a UNION ALL SELECT *, 1 AS src FROM b) GROUP BY 1, 2)
SELECT user_id, item_id, source::BIGINT AS source, rank FROM (SELECT user_id, item_id, m.s AS source, row_number() OVER (PARTITION BY user_id ORDER BY m.r, m.s) AS rank FROM merged) WHERE rank <= 20""")
def union_retrieve(spark, d):
    return compose.union_lists(_lists(log(spark, d)), 20).select("user_id", "item_id", "source", "rank")


_FUSED = _LISTS + """, fused AS (SELECT user_id, item_id, round(sum(c), 12) AS score FROM (SELECT user_id, item_id, 1.0::DOUBLE / (60.0::DOUBLE + rank) AS c FROM a UNION ALL SELECT user_id, item_id, 1.0::DOUBLE / (60.0::DOUBLE + rank) AS c FROM b) GROUP BY 1, 2)"""


@query(_FUSED + f" SELECT user_id, rank, item_id, round(score, 9) AS score FROM ({top(K, 'fused')})")
def rrf_fusion(spark, d):
    fused = compose.fuse(_lists(log(spark, d))).withColumn("score", F.round("score", 12))
    return ranking.top_k(fused, K).select("user_id", "rank", "item_id", F.round("score", 9).alias("score"))


@query(_KNN.format(n=N) + _SCORED.replace("WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = u.user_id AND r.item_id = i.item_id)", "") + f""", a AS ({top(20)}),
pop AS (SELECT item_id, count(*)::DOUBLE AS pop FROM r GROUP BY 1),
b AS (SELECT item_id, row_number() OVER (ORDER BY pop DESC, item_id) AS rank FROM pop QUALIFY rank <= 20)""" + _PAIRS + """
SELECT p.user_id, p.item_id, CASE WHEN p.item_id IN (SELECT item_id FROM items) THEN
  round(coalesce(1 / (60.0::DOUBLE + a.rank), 0) + coalesce(1 / (60.0::DOUBLE + b.rank), 0), 9) END AS score
FROM pairs p LEFT JOIN a ON a.user_id = p.user_id AND a.item_id = p.item_id LEFT JOIN b ON b.item_id = p.item_id""")
def rrf_predict(spark, d):
    x = log(spark, d)
    model = compose.ReciprocalRankFusion([ItemKNN(N, units=UNITS), MostPopular()], n_retrieved=20).fit(x)
    return model.predict(_pairs(x)).select("user_id", "item_id", F.round("score", 9).alias("score"))


#: Queries: all users and a thousand unknown ones.
_ASKED = """, asked AS (SELECT user_id FROM users UNION SELECT -1 - range AS user_id FROM range(100))"""


def _asked(x: DataFrame) -> DataFrame:
    return all_users(x).unionByName(x.sparkSession.range(100).select((-1 - F.col("id")).alias("user_id")))


_LIST_ITEMS = [1, 5, 9, 13, 17, 21, 25, 29, 33, 37, 41, 45]
_LIST = ", list AS (SELECT unnest([" + ", ".join(map(str, _LIST_ITEMS)) + "])::BIGINT AS item_id, generate_subscripts([" + ", ".join(map(str, _LIST_ITEMS)) + "], 1) - 1 AS place)"


@query(_ASKED + _LIST + f""", pop AS (SELECT item_id, count(*)::DOUBLE AS pop FROM r GROUP BY 1),
yes AS (SELECT u.user_id, p.item_id, p.pop AS score FROM users u CROSS JOIN pop p WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = u.user_id AND r.item_id = p.item_id)),
no AS (SELECT a.user_id, l.item_id, (12 - l.place)::DOUBLE AS score FROM asked a CROSS JOIN list l WHERE a.user_id NOT IN (SELECT user_id FROM users)),
scored AS (SELECT * FROM yes UNION ALL SELECT * FROM no) SELECT user_id, rank, item_id, score FROM ({top(5)})""")
def switch_known_user(spark, d):
    x = log(spark, d)
    model = compose.Switch([MostPopular(), compose.ItemList(_LIST_ITEMS)], conditions.KnownUser()).fit(x)
    return _out(model.recommend(_asked(x), 5))


@query(_ASKED + """, c AS (SELECT user_id, count(*) AS c FROM log GROUP BY 1)
SELECT a.user_id, coalesce(c, 0) >= 40 AS holds FROM asked a LEFT JOIN c USING (user_id)""")
def switch_min_interactions(spark, d):
    x = log(spark, d)
    return conditions.MinInteractions(40).fit(x).mark(_asked(x)).select("user_id", "holds")


@query(_ASKED + " SELECT user_id, user_id IN (1, 2, 3, 50, -7) AS holds FROM asked")
def query_in(spark, d):
    return conditions.QueryIn([1, 2, 3, 50, -7]).mark(_asked(log(spark, d))).select("user_id", "holds")


@query(_ASKED + """, c AS (SELECT user_id, count(*) AS c FROM log GROUP BY 1)
SELECT a.user_id, (NOT (coalesce(c, 0) >= 40) AND c IS NOT NULL) OR a.user_id IN (1, 2, 3) AS holds FROM asked a LEFT JOIN c USING (user_id)""")
def condition_not_and_or(spark, d):
    x = log(spark, d)
    rule = (~conditions.MinInteractions(40) & conditions.KnownUser()) | conditions.QueryIn([1, 2, 3])
    return rule.fit(x).mark(_asked(x)).select("user_id", "holds")


_FROM_LIST = """, scored AS (SELECT a.user_id, l.item_id, (12 - (({start}) % 12 + 12) % 12)::DOUBLE AS score FROM asked a CROSS JOIN list l
  WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = a.user_id AND r.item_id = l.item_id))"""


@query(_ASKED + _LIST + _FROM_LIST.format(start="l.place") + f" SELECT user_id, rank, item_id, score FROM ({top(8)})")
def item_list(spark, d):
    x = log(spark, d)
    return _out(compose.ItemList(_LIST_ITEMS).fit(x).recommend(_asked(x), 8))


@query(_ASKED + _LIST + _FROM_LIST.format(start="l.place - floor((((a.user_id * 2654435761) % 1000 + 1000) % 1000)::DOUBLE / 1000 * 12)::BIGINT") + f" SELECT user_id, rank, item_id, score FROM ({top(8)})")
def item_list_rotate(spark, d):
    x = log(spark, d)
    draw = F.pmod(F.col("user_id") * F.lit(2654435761), F.lit(1000)).cast("double") / 1000
    return _out(compose.ItemList(_LIST_ITEMS, rotate=True, draw=draw).fit(x).recommend(_asked(x), 8))


_SHORT = f""", short AS (SELECT * FROM ({top(K)}) WHERE item_id % 3 = 0)"""
_FILL = """, first AS (SELECT user_id, item_id, min(struct_pack(g := g, r := rank)) AS m FROM lists GROUP BY 1, 2),
placed AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY m.g, m.r) AS rank FROM first)
SELECT user_id, rank, item_id, (count(*) OVER (PARTITION BY user_id) - rank + 1)::DOUBLE AS score FROM placed WHERE rank <= 10"""


@query(_LISTS + """, lists AS (SELECT 0 AS g, user_id, item_id, rank FROM a WHERE item_id % 3 = 0 UNION ALL SELECT 1, user_id, item_id, rank FROM b)""" + _FILL)
def backfill(spark, d):
    a, b = _lists(log(spark, d))
    return _out(compose.backfill_lists([a.filter("item_id % 3 = 0"), b], K))


@query(_LISTS + """, kept AS (SELECT * FROM a WHERE rank <= 5),
new AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY rank) AS rank FROM b WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.user_id = b.user_id AND k.item_id = b.item_id)),
lists AS (SELECT 0 AS g, user_id, item_id, rank FROM kept UNION ALL SELECT 1, user_id, item_id, rank FROM new WHERE rank <= 3
  UNION ALL SELECT 2, user_id, item_id, rank FROM a WHERE rank > 5 UNION ALL SELECT 3, user_id, item_id, rank FROM b)""" + _FILL)
def reserved_slots(spark, d):
    a, b = _lists(log(spark, d))
    return _out(compose.reserve_slots(a, b, K, 3, 8))


@query()
def stable_hash(spark, d):
    x = all_users(log(spark, d))
    return x.select("user_id", unit_hash(F.col("user_id"), x.schema["user_id"].dataType).alias("u"))


# Features.


@query(_PAIRS + " SELECT user_id, item_id, p_size::DOUBLE AS p_size, p_retailprice FROM pairs LEFT JOIN part ON p_partkey = item_id")
def join_static(spark, d):
    values = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return features.JoinStatic("item", values).fit(None).transform(_pairs(log(spark, d)))


@query(_PAIRS + " SELECT user_id, item_id, (user_id % 7)::DOUBLE * 2 AS twice FROM pairs")
def join_dynamic_distinct(spark, d):
    made = features.JoinDynamic(["user_id"], lambda keys: pd.DataFrame({"twice": (keys["user_id"] % 7).astype(float) * 2}), "twice double")
    return made.transform(_pairs(log(spark, d)))


@query("""WITH e AS (SELECT user_id, ts, event_id, value FROM events), p AS (SELECT o_orderkey, o_custkey AS user_id, o_orderdate AS time FROM orders)
SELECT o_orderkey, p.user_id, e.event_id::DOUBLE AS event_id, e.value FROM p ASOF LEFT JOIN e ON p.user_id = e.user_id AND p.time > e.ts""")
def asof_lookup(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("time"))
    events = table(spark, d, "events").select("user_id", F.col("ts").alias("time"), "event_id", "value")
    return features.as_of(orders, events, "user_id", ["event_id", "value"]).select("o_orderkey", "user_id", F.col("event_id").cast("double").alias("event_id"), "value")


@query(_PAIRS + """, u AS (SELECT user_id, count(*)::DOUBLE AS c FROM log GROUP BY 1), i AS (SELECT item_id, count(*)::DOUBLE AS c FROM log GROUP BY 1)
SELECT p.user_id, p.item_id, coalesce(u.c, 0) AS user_count, coalesce(i.c, 0) AS item_count FROM pairs p LEFT JOIN u USING (user_id) LEFT JOIN i ON i.item_id = p.item_id""")
def interaction_counts(spark, d):
    x = log(spark, d)
    out = features.InteractionCounts("user").fit(x).transform(_pairs(x))
    return features.InteractionCounts("item").fit(x).transform(out).select("user_id", "item_id", "user_count", "item_count")


@query(_PAIRS + """, pop AS (SELECT item_id, count(*)::DOUBLE AS pop FROM r GROUP BY 1)
SELECT p.user_id, p.item_id, pop AS model_score FROM pairs p LEFT JOIN pop USING (item_id)""")
def recommender_scores(spark, d):
    x = log(spark, d)
    return features.RecommenderScores(MostPopular()).fit(x).transform(_pairs(x)).select("user_id", "item_id", "model_score")


_SEGMENTS = """, seg AS (SELECT c_custkey AS user_id, c_mktsegment AS segment FROM customer),
base AS (SELECT item_id, count(*)::DOUBLE / (SELECT count(*) FROM users) AS g FROM r GROUP BY 1),
cnt AS (SELECT segment, item_id, count(*)::DOUBLE AS c FROM r JOIN seg USING (user_id) GROUP BY 1, 2),
mem AS (SELECT segment, count(*)::DOUBLE AS m FROM users JOIN seg USING (user_id) GROUP BY 1),
shares AS (SELECT p.user_id, p.item_id, s.segment, base.g, (coalesce(c, 0) + 10.0::DOUBLE * coalesce(g, 0)) / (coalesce(m, 0) + 10.0::DOUBLE) AS share
  FROM pairs p LEFT JOIN seg s USING (user_id) LEFT JOIN base ON base.item_id = p.item_id LEFT JOIN cnt ON cnt.segment = s.segment AND cnt.item_id = p.item_id LEFT JOIN mem ON mem.segment = s.segment)"""


@query(_PAIRS + _SEGMENTS + " SELECT user_id, item_id, round(CASE WHEN segment IS NOT NULL THEN share END, 9) AS segment_share, round(CASE WHEN segment IS NOT NULL THEN share / g END, 9) AS segment_lift FROM shares")
def segment_popularity(spark, d):
    x = log(spark, d)
    segments = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    out = features.SegmentPopularity(segments).fit(x).transform(_pairs(x))
    return out.select("user_id", "item_id", F.round("segment_share", 9).alias("segment_share"), F.round("segment_lift", 9).alias("segment_lift"))


@query(_PAIRS + """, f AS (SELECT p_partkey AS item_id, (p_size % 2)::DOUBLE AS a, (p_size % 3)::DOUBLE AS b FROM part),
prof AS (SELECT user_id, count(*)::DOUBLE AS n, sum(a) AS pa, sum(b) AS pb FROM log JOIN f USING (item_id) GROUP BY 1)
SELECT p.user_id, p.item_id, round((pa * a + pb * b) / nullif((a + b) * n, 0), 9) AS profile_share,
  round((pa * a + pb * b) / nullif(sqrt(pa * pa + pb * pb) * sqrt(a * a + b * b), 0), 9) AS profile_cosine
FROM pairs p LEFT JOIN f ON f.item_id = p.item_id LEFT JOIN prof ON prof.user_id = p.user_id""")
def profile_affinity(spark, d):
    x = log(spark, d)
    attributes = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), (F.col("p_size") % 2).cast("double").alias("a"), (F.col("p_size") % 3).cast("double").alias("b"))
    out = features.ProfileAffinity(attributes).fit(x).transform(_pairs(x))
    return out.select("user_id", "item_id", F.round("profile_share", 9).alias("profile_share"), F.round("profile_cosine", 9).alias("profile_cosine"))


@query(_PAIRS + """, i AS (SELECT item_id, count(*)::DOUBLE AS c FROM log GROUP BY 1)
SELECT p.user_id, p.item_id, coalesce(i.c, 0) AS counts__item_count, part.p_size::DOUBLE AS part__p_size FROM pairs p LEFT JOIN i USING (item_id) LEFT JOIN part ON p_partkey = p.item_id""")
def concat_features(spark, d):
    x = log(spark, d)
    values = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_size").cast("double").alias("p_size"))
    both = features.Concat(counts=features.InteractionCounts("item"), part=features.JoinStatic("item", values)).fit(x)
    return both.transform(_pairs(x)).select("user_id", "item_id", *both.names())


@query("SELECT p_partkey AS item_id, " + ", ".join(f"(p_brand = 'Brand#{i}')::INT::DOUBLE AS \"p_brand_Brand#{i}\"" for i in (1, 2, 3)) + " FROM part".replace("WITH", ""))
def one_hot_table(spark, d):
    return features.one_hot(table(spark, d, "part").withColumnRenamed("p_partkey", "item_id"), "item_id", "p_brand", [f"Brand#{i}" for i in (1, 2, 3)])


# Ranks and rankers: a user's purchases as groups, quantities as scores (with many ties).

_GROUPS = """, c AS (SELECT user_id AS qid, user_id, item_id, r, CASE WHEN item_id % 5 <> 0 THEN (item_id % 4)::DOUBLE END AS f FROM r)"""


def _groups(spark, d) -> DataFrame:
    r = matrix(log(spark, d))
    return r.select(F.col("user_id").alias("qid"), "user_id", "item_id", "r", F.when(F.col("item_id") % 5 != 0, (F.col("item_id") % 4).cast("double")).alias("f"))


_AVG = "CASE WHEN {v} IS NOT NULL THEN rank() OVER (PARTITION BY qid, {v} IS NULL ORDER BY {v} {way}) + (count(*) OVER (PARTITION BY qid, {v}) - 1) / 2.0::DOUBLE END"


@query(_GROUPS + f" SELECT qid, item_id, {_AVG.format(v='f', way='DESC')} AS place FROM c")
def avg_rank(spark, d):
    return windows.average_rank(_groups(spark, d), ["qid"], "f", "place").select("qid", "item_id", "place")


@query(_GROUPS + f", a AS (SELECT *, {_AVG.format(v='f', way='ASC')} AS p, count(f) OVER (PARTITION BY qid) AS n FROM c) SELECT qid, item_id, CASE WHEN n = 1 THEN CASE WHEN p IS NOT NULL THEN 0.5::DOUBLE END ELSE (p - 1) / nullif(n - 1, 0) END AS place FROM a")
def percentile_rank(spark, d):
    return windows.percentile_rank(_groups(spark, d), ["qid"], "f", "place").select("qid", "item_id", "place")


@query(_GROUPS + " SELECT qid, item_id, round(CASE WHEN stddev_pop(r) OVER w > 0 THEN (r - avg(r) OVER w) / stddev_pop(r) OVER w ELSE 0 END, 6) AS z FROM c WINDOW w AS (PARTITION BY qid)")
def zscore_norm(spark, d):
    return windows.zscore(_groups(spark, d), ["qid"], "r", "z").select("qid", "item_id", F.round("z", 6).alias("z"))


_RANKS = f"SELECT qid, user_id, item_id, {_AVG.format(v='r', way='DESC')} AS a, {_AVG.format(v='f', way='DESC')} AS b FROM c"


@query(_GROUPS + f", k AS ({_RANKS}) SELECT qid, item_id, round(coalesce(1 / (60.0::DOUBLE + a), 0) + coalesce(1 / (60.0::DOUBLE + b), 0), 12) AS score FROM k")
def rrf_ranker(spark, d):
    out = rankers.ReciprocalRank().fit(None, ["r", "f"]).predict(_groups(spark, d))
    return out.select("qid", "item_id", F.round("score", 12).alias("score"))


_PCT = "CASE WHEN n_{v} = 1 THEN CASE WHEN p_{v} IS NOT NULL THEN 0.5::DOUBLE END ELSE (p_{v} - 1) / nullif(n_{v} - 1, 0) END"


@query(_GROUPS + f""", a AS (SELECT *, {_AVG.format(v='r', way='ASC')} AS p_r, count(r) OVER (PARTITION BY qid) AS n_r, {_AVG.format(v='item_id', way='ASC')} AS p_i, count(item_id) OVER (PARTITION BY qid) AS n_i FROM c)
SELECT qid, item_id, round((({_PCT.format(v='r')}) * 3 + ({_PCT.format(v='i')}) * 1) / 4, 9) AS score FROM a""")
def blend_mean(spark, d):
    class Column(rankers.Ranker):
        def __init__(self, name):
            self.name = name

        def fit(self, candidates, features):
            return self

        def predict(self, candidates, out="score"):
            return candidates.withColumn(out, F.col(self.name).cast("double"))

    blend = rankers.Blend([Column("r"), Column("item_id")], blender="mean", weights=[3, 1])
    return blend.fit(_groups(spark, d), ["r"]).predict(_groups(spark, d)).select("qid", "item_id", F.round("score", 9).alias("score"))


@query(_KNN.format(n=N) + _PAIRS + """, terms AS (SELECT p.user_id, p.item_id, r.item_id AS reason, r.r * s.w AS term FROM pairs p JOIN r ON r.user_id = p.user_id JOIN s ON s.i = r.item_id AND s.j = p.item_id),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY abs(term) DESC, reason) AS place FROM terms)
SELECT user_id, item_id, place, reason, round(term, 9) AS term FROM o WHERE place <= 3""")
def history_attribution(spark, d):
    x = log(spark, d)
    said = explain.history_attribution(ItemKNN(N).fit(x), _pairs(x), 3)
    return said.select("user_id", "item_id", "place", "reason", F.round("term", 9).alias("term"))


@query(_PAIRS + f""", pop AS (SELECT item_id, count(*)::DOUBLE AS pop FROM r GROUP BY 1),
scored AS (SELECT u.user_id, p.item_id, p.pop AS score FROM users u CROSS JOIN pop p WHERE p.item_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = u.user_id AND r.item_id = p.item_id)),
best AS ({top(K)})
SELECT p.user_id, p.item_id, CASE WHEN p.item_id NOT IN (SELECT item_id FROM items) THEN 'unknown_item' WHEN p.item_id % 2 <> 0 OR r.r IS NOT NULL THEN 'excluded' WHEN b.rank IS NOT NULL THEN 'served' ELSE 'ranked_out' END AS status,
  CASE WHEN p.item_id NOT IN (SELECT item_id FROM items) THEN NULL WHEN p.item_id % 2 <> 0 THEN 'candidates' WHEN r.r IS NOT NULL THEN 'seen' END AS "by", b.rank::DOUBLE AS rank
FROM pairs p LEFT JOIN r ON r.user_id = p.user_id AND r.item_id = p.item_id LEFT JOIN best b ON b.user_id = p.user_id AND b.item_id = p.item_id""")
def explain_status(spark, d):
    x = log(spark, d)
    wanted = x.select("item_id").distinct().filter("item_id % 2 = 0")
    return explain.explain(MostPopular().fit(x), _pairs(x), K, candidates=wanted).select("user_id", "item_id", "status", "by", F.col("rank").cast("double").alias("rank"))


# Pieces of the cascade.


@query(f", f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {BY}) AS n FROM log) SELECT user_id, time, o_orderpriority FROM f WHERE n = 1")
def first_request_row(spark, d):
    return first_rows(log(spark, d), ORDER, ["time", "o_orderpriority"])


_SPLIT = f""", m AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {BY}) - 1 AS p, count(*) OVER (PARTITION BY user_id) AS n FROM log),
held AS (SELECT * FROM m WHERE p >= n - floor(0.2::DOUBLE * n)), train AS (SELECT * FROM m WHERE p < n - floor(0.2::DOUBLE * n)),
cand AS (SELECT DISTINCT user_id, item_id FROM held UNION SELECT DISTINCT user_id, item_id + 1 FROM held),
lab AS (SELECT c.user_id, c.item_id, CASE WHEN EXISTS (SELECT 1 FROM held h WHERE h.user_id = c.user_id AND h.item_id = c.item_id AND h.value > 25) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label FROM cand c)"""


def _labelled(spark, d) -> DataFrame:
    marked = latest_split(log(spark, d), ORDER, 0.2)
    held = marked.filter("test")
    near = held.select("user_id", "item_id").unionByName(held.select("user_id", (F.col("item_id") + 1).alias("item_id"))).distinct()
    return cascade.label(near.withColumn("qid", F.col("user_id")), held.withColumn("value", F.col("value") - 25))


@query(_SPLIT + " SELECT user_id, item_id, label FROM lab")
def ranker_labels(spark, d):
    return _labelled(spark, d).select("user_id", "item_id", "label")


@query(_SPLIT + " SELECT user_id, item_id, label FROM lab WHERE user_id IN (SELECT user_id FROM lab WHERE label > 0)")
def groups_with_positive(spark, d):
    return cascade.with_a_positive(_labelled(spark, d)).select("user_id", "item_id", "label")


def _cascade(spark, d):
    x = log(spark, d)
    values = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_size").cast("double").alias("size"), "p_retailprice")
    made = features.Concat(generator=features.GeneratorScores(), counts=features.InteractionCounts("item"), part=features.JoinStatic("item", values))
    return x, cascade.Cascade([ItemKNN(N, units=UNITS), MostPopular()], made, rankers.Pointwise(), order=ORDER, n_retrieved=50)


@query()
def cascade_logistic(spark, d):
    x, model = _cascade(spark, d)
    return _out(model.fit(x).recommend(all_users(x), K))


@query("""WITH e AS (SELECT user_id, json_extract_string(props, '$.k')::BIGINT AS item_id, ts FROM events)
SELECT time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP AS start, item_id, count(*) AS pop FROM e GROUP BY ALL""")
def windowed_popularity(spark, d):
    from ..streaming.updates import windowed_popularity as windowed

    return windowed(clicks(spark, d)).select("start", "item_id", "pop")
