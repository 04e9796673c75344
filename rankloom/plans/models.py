"""Queries of the models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import equalize_norms
from ..operators import factors, incremental, index, neighbours, ranking
from ..operators.linear import EASE, SLIM
from ..operators.neighbours import BM25, ItemKNN, RP3Beta
from ..operators.popular import MostPopular
from ..schema import matrix
from ..session import cut
from ..sources.tables import table
from .registry import BY, all_users, log, query, top

K = 10
N = 20
UNITS = 1e9


def _out(ranked: DataFrame) -> DataFrame:
    return ranked.select("user_id", "rank", "item_id", "score")


@query("SELECT user_id, item_id, r FROM r")
def interactions_matrix(spark, d):
    return matrix(log(spark, d))


def _popular(pop: str, more: str = "", where: str = "") -> str:
    return f""", pop AS ({pop}){more},
scored AS (SELECT u.user_id, p.item_id, p.pop AS score FROM users u CROSS JOIN pop p
  WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = u.user_id AND r.item_id = p.item_id){where})
SELECT user_id, rank, item_id, score FROM ({top(K)})"""


_COUNT = "SELECT item_id, count(*)::DOUBLE AS pop FROM r GROUP BY 1"


@query(_popular(_COUNT))
def popular_topk(spark, d):
    x = log(spark, d)
    return _out(MostPopular().fit(x).recommend(all_users(x), K))


@query(_popular("SELECT item_id, sum(r) AS pop FROM r GROUP BY 1"))
def popular_sum_topk(spark, d):
    x = log(spark, d)
    return _out(MostPopular("sum").fit(x).recommend(all_users(x), K))


@query(_popular("SELECT item_id, count(*)::DOUBLE / (coalesce(any_value(p_size), 0)::DOUBLE + 10.0) AS pop FROM r LEFT JOIN part ON p_partkey = item_id GROUP BY 1"))
def popular_rate_topk(spark, d):
    x = log(spark, d)
    shown = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_size").alias("shown"))
    return _out(MostPopular(exposure=shown).fit(x).recommend(all_users(x), K))


@query(_popular(_COUNT, where=" AND p.item_id % 7 = 0"))
def recommend_candidates(spark, d):
    x = log(spark, d)
    wanted = x.select("item_id").distinct().filter("item_id % 7 = 0")
    return _out(MostPopular().fit(x).recommend(all_users(x), K, candidates=wanted))


@query(_popular(_COUNT, more=", away AS (SELECT DISTINCT user_id, item_id + 1 AS item_id FROM r)", where=" AND NOT EXISTS (SELECT 1 FROM away a WHERE a.user_id = u.user_id AND a.item_id = p.item_id)"))
def recommend_exclude_pairs(spark, d):
    x = log(spark, d)
    away = x.select("user_id", (F.col("item_id") + 1).alias("item_id")).distinct()
    return _out(MostPopular().fit(x).recommend(all_users(x), K, exclude=away))


@query(""", lost AS (SELECT user_id, item_id FROM r UNION SELECT user_id, item_id + 1 FROM r),
c AS (SELECT item_id FROM items WHERE item_id % 3 <> 0),
n AS (SELECT user_id, count(*) AS n FROM lost WHERE item_id IN (SELECT item_id FROM c) GROUP BY 1)
SELECT u.user_id, (SELECT count(*) FROM c) - coalesce(n.n, 0) AS eligible FROM users u LEFT JOIN n USING (user_id)""")
def count_eligible(spark, d):
    x = log(spark, d)
    away = x.select("user_id", (F.col("item_id") + 1).alias("item_id"))
    pool = x.select("item_id").distinct().filter("item_id % 3 <> 0")
    return MostPopular().fit(x).count_eligible(all_users(x), candidates=pool, exclude=away).select("user_id", "eligible")


_GRAM = """, g AS (SELECT a.item_id AS i, b.item_id AS j, sum(a.r * b.r) AS dot FROM r a JOIN r b ON a.user_id = b.user_id GROUP BY 1, 2)"""
_KNN = _GRAM + """, norms AS (SELECT item_id, sqrt(sum(r * r)) AS n FROM r GROUP BY 1),
w AS (SELECT i, j, dot / (a.n * b.n + 0.0::DOUBLE) AS w FROM g JOIN norms a ON a.item_id = i JOIN norms b ON b.item_id = j WHERE i <> j AND dot <> 0),
s AS (SELECT i, j, w FROM (SELECT *, row_number() OVER (PARTITION BY j ORDER BY w DESC, i) AS n FROM w) WHERE n <= {n})"""
#: Scores of all items for all users, untouched ones at 0, seen ones left out.
_SCORED = """, reached AS (SELECT r.user_id, s.j AS item_id, sum(r.r * floor(s.w * 1e9::DOUBLE + 0.5::DOUBLE)) / 1e9::DOUBLE AS score FROM r JOIN s ON r.item_id = s.i GROUP BY 1, 2),
scored AS (SELECT u.user_id, i.item_id, coalesce(x.score, 0.0::DOUBLE) AS score FROM users u CROSS JOIN items i
  LEFT JOIN reached x ON x.user_id = u.user_id AND x.item_id = i.item_id
  WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = u.user_id AND r.item_id = i.item_id))"""
_BEST = f"SELECT user_id, rank, item_id, score FROM ({top(K)})"


@query(_GRAM + " SELECT i, j, dot FROM g")
def item_gram(spark, d):
    return neighbours.gram(matrix(log(spark, d)))


@query(_KNN.format(n=N) + " SELECT i, j, round(w, 9) AS w FROM s")
def itemknn_similarity(spark, d):
    return ItemKNN(N).fit(log(spark, d)).tables["s"].select("i", "j", F.round("w", 9).alias("w"))


@query(_KNN.format(n=N) + _SCORED + _BEST)
def itemknn_recommend(spark, d):
    x = log(spark, d)
    return _out(ItemKNN(N, units=UNITS).fit(x).recommend(all_users(x), K))


@query(_KNN.format(n=2) + _SCORED + _BEST)
def zero_fill_topk(spark, d):
    """Two neighbours only: many lists end with items that nothing reached."""
    x = log(spark, d)
    return _out(ItemKNN(2, units=UNITS).fit(x).recommend(all_users(x), K))


def _pairs(x: DataFrame) -> DataFrame:
    return x.select("user_id", (F.col("item_id") + 1).alias("item_id")).distinct()


_PAIRS = """, pairs AS (SELECT DISTINCT user_id, item_id + 1 AS item_id FROM log)"""
_PREDICT = _PAIRS + """, reached AS (SELECT r.user_id, s.j AS item_id, sum(r.r * floor(s.w * 1e9::DOUBLE + 0.5::DOUBLE)) / 1e9::DOUBLE AS score FROM r JOIN s ON r.item_id = s.i GROUP BY 1, 2)
SELECT p.user_id, p.item_id, CASE WHEN p.item_id IN (SELECT item_id FROM items) THEN coalesce(x.score, 0.0::DOUBLE) END AS score
FROM pairs p LEFT JOIN reached x ON x.user_id = p.user_id AND x.item_id = p.item_id"""


@query(_KNN.format(n=N) + _PREDICT)
def itemknn_predict(spark, d):
    x = log(spark, d)
    return ItemKNN(N, units=UNITS).fit(x).predict(_pairs(x)).select("user_id", "item_id", "score")


_BM25 = """, u AS (SELECT user_id, count(*) AS n FROM r GROUP BY 1), l AS (SELECT item_id, sum(r) AS s FROM r GROUP BY 1),
m AS (SELECT avg(s) AS mean, count(*)::DOUBLE AS items FROM l),
x AS (SELECT r.user_id, r.item_id, r.r * 2.2::DOUBLE / (1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.s / m.mean) + r.r) * (ln(m.items) - ln(1 + u.n::DOUBLE)) AS x FROM r JOIN u USING (user_id) JOIN l USING (item_id) CROSS JOIN m)"""
_BM25_S = _BM25 + """, q AS (SELECT user_id, item_id, floor(x * 1e4::DOUBLE + 0.5::DOUBLE) AS x FROM x),
w AS (SELECT a.item_id AS i, b.item_id AS j, sum(a.x * b.x) / 1e8::DOUBLE AS w FROM q a JOIN q b ON a.user_id = b.user_id GROUP BY 1, 2),
s AS (SELECT i, j, w FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY w DESC, j) AS n FROM w WHERE w <> 0) WHERE n <= 20)"""
_BM25_SCORED = _SCORED.replace("1e9::DOUBLE", "1e4::DOUBLE")


@query(_BM25 + " SELECT user_id, item_id, round(x, 6) AS x FROM x")
def bm25_weights(spark, d):
    return neighbours.bm25_weights(cut(matrix(log(spark, d))), 1.2, 0.75).select("user_id", "item_id", F.round("x", 6).alias("x"))


@query(_BM25_S + " SELECT i, j, w FROM s")
def bm25_similarity(spark, d):
    return BM25(N, units=1e4).fit(log(spark, d)).tables["s"].select("i", "j", "w")


@query(_BM25_S + _BM25_SCORED + _BEST)
def bm25_recommend(spark, d):
    x = log(spark, d)
    return _out(BM25(N, units=1e4).fit(x).recommend(all_users(x), K))


_WALK = """, total AS (SELECT user_id, sum(abs(r)) AS t FROM r WHERE r <> 0 GROUP BY 1),
p AS (SELECT user_id, item_id, r / t AS p FROM r JOIN total USING (user_id) WHERE r <> 0),
pop AS (SELECT item_id, count(*)::DOUBLE AS pop FROM r WHERE r <> 0 GROUP BY 1),
sums AS (SELECT a.item_id AS i, b.item_id AS j, sum(floor(b.p * 1e9::DOUBLE + 0.5::DOUBLE)) / 1e9::DOUBLE AS w FROM p a JOIN p b ON a.user_id = b.user_id WHERE a.item_id <> b.item_id GROUP BY 1, 2),
walk AS (SELECT i, j, floor(w * pow(a.pop, -1.0::DOUBLE) * pow(b.pop, -0.6::DOUBLE) * 1e9::DOUBLE + 0.5::DOUBLE) / 1e9::DOUBLE AS w FROM sums JOIN pop a ON a.item_id = i JOIN pop b ON b.item_id = j)"""
_RP3 = _WALK + """, one AS (SELECT i, j, floor(w * 1e9::DOUBLE + 0.5::DOUBLE) AS w FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY w DESC, j) AS n FROM walk WHERE w <> 0) WHERE n <= 20),
two AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM one),
s AS (SELECT i, j, w FROM (SELECT *, row_number() OVER (PARTITION BY j ORDER BY w DESC, i) AS n FROM two) WHERE n <= 20)"""


@query(_WALK + " SELECT i, j, w FROM walk WHERE w <> 0")
def rp3beta_walk(spark, d):
    return neighbours.walk_edges(cut(matrix(log(spark, d))), 1.0, 0.6, UNITS)


@query(_RP3 + " SELECT i, j, w FROM s")
def rp3beta_similarity(spark, d):
    return RP3Beta(N, units=UNITS).fit(log(spark, d)).tables["s"].select("i", "j", "w")


@query(_RP3 + _SCORED + _BEST)
def rp3beta_recommend(spark, d):
    x = log(spark, d)
    return _out(RP3Beta(N, units=UNITS).fit(x).recommend(all_users(x), K))


@query()
def ease_weights(spark, d):
    return EASE(500.0, max_items=20_000).fit(log(spark, d)).tables["s"].select("i", "j", F.round("w", 9).alias("w"))


@query()
def slim_weights(spark, d):
    return SLIM(0.01, 0.1, N, max_items=20_000).fit(log(spark, d)).tables["s"].select("i", "j", F.round("w", 6).alias("w"))


def _vectors(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    items = rows.select(F.col("vec_id").alias("item_id"), "v")
    asked = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("vec_id").alias("user_id"), "v")
    return items, asked


_VECTORS = """WITH v AS (SELECT vec_id AS item_id, embedding::DOUBLE[] AS v FROM embeddings),
q AS (SELECT item_id AS user_id, v AS q FROM v WHERE item_id % 50 = 0)"""


@query(_VECTORS + """, scored AS (SELECT user_id, item_id, list_dot_product(q, v) AS score FROM q CROSS JOIN v WHERE user_id <> item_id)
SELECT user_id, rank, item_id, round(score, 6) AS score FROM (""" + top(K) + ")")
def factor_topk(spark, d):
    items, asked = _vectors(spark, d)
    own = asked.select("user_id", F.col("user_id").alias("item_id"))
    found = factors.factor_top_k(asked.withColumn("offset", F.lit(0.0)), items.withColumn("bias", F.lit(0.0)), K, own)
    return found.select("user_id", "rank", "item_id", F.round("score", 6).alias("score"))


_BOUNDS = """, parts AS (SELECT item_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM v),
bounds AS (SELECT dim, min(x) AS lo, max(x) AS hi FROM parts GROUP BY 1)"""


@query(_VECTORS + _BOUNDS + " SELECT dim::BIGINT AS dim, lo, hi FROM bounds")
def clipping_bounds(spark, d):
    return index.clipping_bounds(_vectors(spark, d)[0])


_CODES = _BOUNDS + """, codes AS (SELECT item_id, dim, CASE WHEN hi > lo THEN round_even((x - lo) / ((hi - lo) / 255), 0) ELSE 0 END AS c, lo, (hi - lo) / 255 AS s FROM parts JOIN bounds USING (dim)),
decoded AS (SELECT item_id, list(lo + c * s ORDER BY dim) AS v FROM codes GROUP BY 1)"""


@query(_VECTORS + _CODES + " SELECT item_id, dim::BIGINT AS dim, c::BIGINT AS code FROM codes")
def quantized_codes(spark, d):
    made = index.QuantizedFlat().fit(_vectors(spark, d)[0])
    return made.codes.select("item_id", F.posexplode("codes").alias("dim", "code"))


@query(_VECTORS + _CODES + f""", near AS (SELECT user_id, item_id, list_dot_product(q, v) AS score FROM q CROSS JOIN decoded WHERE user_id <> item_id),
best AS ({top(4 * K, "near")}),
scored AS (SELECT b.user_id, b.item_id, list_dot_product(q.q, v.v) AS score FROM best b JOIN q USING (user_id) JOIN v USING (item_id))
SELECT user_id, rank, item_id, round(score, 6) AS score FROM ({top(K)})""")
def quantized_topk(spark, d):
    items, asked = _vectors(spark, d)
    own = asked.select("user_id", F.col("user_id").alias("item_id"))
    return index.QuantizedFlat().fit(items).query(asked, K, excluded=own).select("user_id", "rank", "item_id", F.round("score", 6).alias("score"))


@query(_VECTORS + """, n AS (SELECT item_id, list_dot_product(v, v) AS n FROM v)
SELECT item_id, round(sqrt(greatest((SELECT max(n) FROM n) - n, 0)), 6) AS slack FROM n""")
def norm_equalized(spark, d):
    items = _vectors(spark, d)[0]
    return equalize_norms(items).select("item_id", F.round(F.element_at("v", -1), 6).alias("slack"))


@query(_VECTORS + """, parts AS (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM v), m AS (SELECT dim, avg(x) AS m FROM parts GROUP BY 1)
SELECT round(sum(m * m) / count(*), 9) AS ratio FROM m""")
def navigability(spark, d):
    return index.navigability(_vectors(spark, d)[0]).select(F.round("ratio", 9).alias("ratio"))


@query()
def lsh_topk(spark, d):
    items, asked = _vectors(spark, d)
    return index.RandomProjection(seed=1).fit(items).query(asked, K).select("user_id", "rank", "item_id", "score")


@query()
def als_recommend(spark, d):
    x = log(spark, d)
    return _out(factors.ALS(4, 2).fit(x).recommend(all_users(x), K))


@query()
def bpr_recommend(spark, d):
    x = log(spark, d)
    return _out(factors.BPR(8, max_iter=2).fit(x).recommend(all_users(x), K))


@query(""", p AS (SELECT DISTINCT user_id, item_id FROM log), du AS (SELECT user_id, count(*) AS d FROM p GROUP BY 1), di AS (SELECT item_id, count(*) AS d FROM p GROUP BY 1),
w AS (SELECT user_id, item_id, 1 / sqrt(du.d * di.d) AS w FROM p JOIN du USING (user_id) JOIN di USING (item_id)),
dims AS (SELECT unnest([0, 1]) AS dim),
i0 AS (SELECT item_id, dim, ((item_id * 31 + dim * 17) % 101)::DOUBLE / 101 AS x FROM items CROSS JOIN dims),
u0 AS (SELECT user_id, dim, ((user_id * 37 + dim * 13) % 103)::DOUBLE / 103 AS x FROM users CROSS JOIN dims),
u1 AS (SELECT user_id, dim, sum(w * x) AS x FROM w JOIN i0 USING (item_id) GROUP BY ALL),
i1 AS (SELECT item_id, dim, sum(w * x) AS x FROM w JOIN u0 USING (user_id) GROUP BY ALL),
u2 AS (SELECT user_id, dim, sum(w * x) AS x FROM w JOIN i1 USING (item_id) GROUP BY ALL)
SELECT user_id, dim::BIGINT AS dim, round(sum(x) / 3, 6) AS x FROM (SELECT * FROM u0 UNION ALL SELECT * FROM u1 UNION ALL SELECT * FROM u2) GROUP BY ALL""")
def lightgcn_propagate(spark, d):
    r = matrix(log(spark, d))
    start = lambda name, a, b, m: r.select(name).distinct().withColumn("dim", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("x", ((F.col(name) * a + F.col("dim") * b) % m).cast("double") / m)
    users, _ = factors.light_gcn(r, start("user_id", 37, 13, 103), start("item_id", 31, 17, 101), 2)
    return users.select("user_id", "dim", F.round("x", 6).alias("x"))


#: A batch: the purchases after a date; what was there before it; what it touches.
_BATCH = """, old AS (SELECT user_id, item_id, sum(value) AS r FROM log WHERE time < TIMESTAMP '1998-06-01' GROUP BY ALL),
delta AS (SELECT * FROM log WHERE time >= TIMESTAMP '1998-06-01'), touched AS (SELECT DISTINCT item_id FROM delta)"""


def _batches(x: DataFrame) -> tuple[DataFrame, DataFrame]:
    late = F.col("time") >= F.lit("1998-06-01").cast(x.schema["time"].dataType)
    return x.filter(~late), x.filter(late)


@query(_BATCH + """, near AS (SELECT DISTINCT user_id FROM r WHERE item_id IN (SELECT item_id FROM touched))
SELECT DISTINCT item_id FROM r WHERE user_id IN (SELECT user_id FROM near) UNION SELECT item_id FROM touched""")
def partial_fit_affected_items(spark, d):
    x = log(spark, d)
    return incremental.affected_items(matrix(x), _batches(x)[1].select("item_id").distinct())


@query("SELECT item_id, count(*)::DOUBLE AS pop FROM r GROUP BY 1")
def partial_fit_popularity(spark, d):
    old, new = _batches(log(spark, d))
    return incremental.partial_fit(MostPopular().fit(old), new).tables["pop"].select("item_id", "pop")


@query(_KNN.format(n=N) + " SELECT i, j, round(w, 9) AS w FROM s")
def partial_fit_itemknn(spark, d):
    old, new = _batches(log(spark, d))
    return incremental.partial_fit(ItemKNN(N).fit(old), new).tables["s"].select("i", "j", F.round("w", 9).alias("w"))


__all__ = ["BY", "ranking"]
