"""Queries of splits and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, splits
from ..operators.popular import MostPopular, item_popularity
from ..schema import Schema, interactions
from ..sources.amazon import codes, five_core
from ..sources.tables import ORDER, clicks
from .composition import _SPLIT
from .models import K
from .registry import BY, log, query, top

_KEY = "user_id, item_id, l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_suppkey, l_extendedprice"
_KEYS = ["user_id", "item_id", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]
_POSITIONS = f", m AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {BY}) - 1 AS p, count(*) OVER (PARTITION BY user_id) AS n FROM log)"


@query(_POSITIONS + f" SELECT {_KEY}, p >= n - floor(0.2::DOUBLE * n) AS test FROM m")
def split_latest(spark, d):
    return splits.latest_split(log(spark, d), ORDER, 0.2).select(*_KEYS, "test")


@query(_POSITIONS + f""", last AS (SELECT user_id, max(row({BY})) AS last FROM log GROUP BY 1), chosen AS (SELECT user_id FROM last ORDER BY last DESC LIMIT 100)
SELECT {_KEY}, p >= n - floor(0.5::DOUBLE * n) AND user_id IN (SELECT user_id FROM chosen) AS test FROM m""")
def split_latest_recent_users(spark, d):
    return splits.latest_split(log(spark, d), ORDER, 0.5, max_users=100).select(*_KEYS, "test")


@query(_POSITIONS + f""", cold AS (SELECT user_id FROM users ORDER BY (user_id * 2654435761) % 100003, user_id LIMIT (SELECT floor(count(*) * 0.1::DOUBLE)::BIGINT FROM users))
SELECT {_KEY}, user_id IN (SELECT user_id FROM cold) OR p >= n - floor(0.2::DOUBLE * n) AS test FROM m""")
def split_cold_start(spark, d):
    draw = (F.col("user_id") * F.lit(2654435761)) % 100003
    return splits.cold_start_split(log(spark, d), ORDER, 0.1, 0.2, draw=draw).select(*_KEYS, "test")


@query(f""", m AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {BY}) = 1 OR row_number() OVER (PARTITION BY item_id ORDER BY {BY}) = 1 AS pin FROM log)
SELECT {_KEY}, CASE WHEN NOT pin THEN (row_number() OVER (PARTITION BY pin ORDER BY {BY}) - 1) % 5 ELSE -1 END AS fold FROM m""")
def split_warm_kfold(spark, d):
    return splits.warm_k_fold(log(spark, d), ORDER, 5).select(*_KEYS, F.coalesce("fold", F.lit(-1)).alias("fold"))


@query(f", m AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {', '.join(c + ' DESC' for c in BY.split(', '))}) AS n FROM log) SELECT {_KEY}, n = 1 AS test FROM m")
def leave_one_out(spark, d):
    return splits.leave_one_out(log(spark, d), ORDER).select(*_KEYS, "test")


@query(f", m AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {', '.join(c + ' DESC' for c in BY.split(', '))}) AS n FROM log) SELECT {_KEY} FROM m WHERE n <= 6")
def tail_rows(spark, d):
    return splits.tail_rows(log(spark, d), ORDER, 5, held_out=True).select(*_KEYS)


@query("""WITH e AS (SELECT user_id, json_extract_string(props, '$.k')::BIGINT AS item_id, event_id FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL),
u AS (SELECT user_id FROM e GROUP BY 1 HAVING count(*) >= 7), i AS (SELECT item_id FROM e GROUP BY 1 HAVING count(*) >= 7)
SELECT event_id, user_id, item_id FROM e WHERE user_id IN (SELECT user_id FROM u) AND item_id IN (SELECT item_id FROM i)""")
def k_core(spark, d):
    return splits.k_core(clicks(spark, d), 7).select("event_id", "user_id", "item_id")


@query("""WITH e AS (SELECT user_id, json_extract_string(props, '$.k')::BIGINT AS item_id, event_id FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL),
u AS (SELECT user_id FROM e GROUP BY 1 HAVING count(*) >= 7), i AS (SELECT item_id FROM e GROUP BY 1 HAVING count(*) >= 7),
k AS (SELECT * FROM e WHERE user_id IN (SELECT user_id FROM u) AND item_id IN (SELECT item_id FROM i))
SELECT event_id, user_id, item_id FROM k WHERE user_id IN (SELECT user_id FROM k GROUP BY 1 HAVING count(*) >= 7)""")
def five_core_users(spark, d):
    return five_core(clicks(spark, d), 7).select("event_id", "user_id", "item_id")


@query("SELECT item_id, dense_rank() OVER (ORDER BY item_id) - 1 AS code FROM items")
def id_codes(spark, d):
    return codes(log(spark, d), "item_id")


@query(f", m AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {', '.join(c + ' DESC' for c in BY.split(', '))}) AS n FROM log) SELECT user_id, string_agg(item_id::VARCHAR, ',' ORDER BY n DESC) AS items FROM m WHERE n <= 5 GROUP BY 1")
def sequences(spark, d):
    return splits.sequences(log(spark, d), ORDER, 5).select("user_id", F.concat_ws(",", F.col("items").cast("array<string>")).alias("items"))


@query("""WITH e AS (SELECT user_id, event_id, value FROM events) SELECT user_id, event_id AS item_id, value FROM e WHERE value > 0""")
def checked_interactions(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    return interactions(events.filter("value > 0"), Schema(item="event_id")).select("user_id", "item_id", "value")


# Metrics: popularity fitted on the training rows, ranked for all users, against what
# users bought last.

_TRUTH = _SPLIT + f""", truth AS (SELECT DISTINCT user_id AS qid, item_id FROM held WHERE value > 0),
tr AS (SELECT user_id, item_id, sum(value) AS r FROM train GROUP BY 1, 2), pop AS (SELECT item_id, count(*)::DOUBLE AS pop FROM tr GROUP BY 1),
scored AS (SELECT u.qid, u.qid AS user_id, p.item_id, p.pop AS score FROM (SELECT DISTINCT qid FROM truth) u CROSS JOIN pop p WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.user_id = u.qid AND tr.item_id = p.item_id)),
ranked AS ({top(K)}),
hits AS (SELECT k.qid, k.rank, CASE WHEN t.item_id IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS hit FROM ranked k LEFT JOIN truth t ON t.qid = k.qid AND t.item_id = k.item_id),
run AS (SELECT *, sum(hit) OVER (PARTITION BY qid ORDER BY rank) / rank AS prec FROM hits),
rel AS (SELECT qid, count(*) AS n FROM truth GROUP BY 1),
ideal AS (SELECT n, sum(1 / log2(i + 1)) AS idcg FROM (SELECT DISTINCT least(n, 10) AS n FROM rel) CROSS JOIN range(1, 11) t(i) WHERE i <= n GROUP BY 1),
agg AS (SELECT qid, sum(hit) AS h, sum(hit / log2(rank + 1)) AS dcg, sum(hit * prec) AS ap, min(CASE WHEN hit > 0 THEN rank END) AS first FROM run GROUP BY 1),
m AS (SELECT rel.qid, coalesce(h, 0) / 10 AS precision, coalesce(h, 0) / rel.n AS recall, coalesce(dcg, 0) / idcg AS ndcg, coalesce(ap, 0) / least(rel.n, 10) AS map,
  coalesce(1.0::DOUBLE / first, 0) AS mrr, CASE WHEN coalesce(h, 0) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit_rate FROM rel LEFT JOIN agg USING (qid) JOIN ideal ON ideal.n = least(rel.n, 10))"""
_TRUTH = _TRUTH.replace(", m AS (SELECT *, row_number()", ", pm AS (SELECT *, row_number()").replace("FROM m WHERE p", "FROM pm WHERE p")


def _ranked(spark, d):
    marked = splits.latest_split(log(spark, d), ORDER, 0.2)
    train, held = marked.filter("NOT test").drop("test"), marked.filter("test").drop("test")
    truth = metrics.relevant(held)
    queries = truth.select(F.col("qid").alias("user_id")).distinct()
    return train, truth, MostPopular().fit(train).recommend(queries, K)


def _metric(name: str):
    @query(_TRUTH + f" SELECT qid, round({name}, 9) AS {name} FROM m", name=f"metric_{name}")
    def run(spark, d):
        _, truth, ranked = _ranked(spark, d)
        return metrics.per_query(ranked, truth, [K]).select("qid", F.round(f"`{name}@{K}`", 9).alias(name))

    return run


for _name in metrics.RANKING:
    _metric(_name)


@query(_TRUTH + " SELECT round(avg(ndcg), 6) AS ndcg, round(avg(recall), 6) AS recall FROM m")
def evaluate_average(spark, d):
    _, truth, ranked = _ranked(spark, d)
    row = metrics.average(metrics.per_query(ranked, truth, [K]))
    return row.select(F.round(f"`ndcg@{K}`", 6).alias("ndcg"), F.round(f"`recall@{K}`", 6).alias("recall"))


@query(_TRUTH + " SELECT count(DISTINCT item_id)::DOUBLE / (SELECT count(*) FROM items) AS coverage FROM ranked")
def metric_catalog_coverage(spark, d):
    x = log(spark, d)
    return metrics.catalog_coverage(_ranked(spark, d)[2], x.select("item_id").distinct(), K)


@query(_TRUTH + ", c AS (SELECT qid, count(*) AS c FROM ranked GROUP BY 1) SELECT avg(CASE WHEN coalesce(c, 0) >= 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS coverage FROM (SELECT DISTINCT qid FROM truth) LEFT JOIN c USING (qid)")
def metric_user_coverage(spark, d):
    _, truth, ranked = _ranked(spark, d)
    return metrics.user_coverage(ranked, truth, K)


_ROWS = ", rp AS (SELECT item_id, count(*)::DOUBLE AS pop FROM train GROUP BY 1)"


@query(_TRUTH + _ROWS + " SELECT qid, round(avg(coalesce(rp.pop, 0)), 6) AS mean_popularity FROM ranked LEFT JOIN rp USING (item_id) GROUP BY 1")
def metric_mean_popularity(spark, d):
    train, _, ranked = _ranked(spark, d)
    out = metrics.mean_popularity(ranked, item_popularity(train), K)
    return out.select("qid", F.round("mean_popularity", 6).alias("mean_popularity"))


@query(_TRUTH + _ROWS + " SELECT qid, round(avg(-log2((coalesce(rp.pop, 0) + 1) / (SELECT sum(pop) + count(*) FROM rp))), 6) AS novelty FROM ranked LEFT JOIN rp USING (item_id) GROUP BY 1")
def metric_novelty(spark, d):
    train, _, ranked = _ranked(spark, d)
    return metrics.novelty(ranked, item_popularity(train), K).select("qid", F.round("novelty", 6).alias("novelty"))


@query("SELECT item_id, count(*)::DOUBLE / sum(count(*)) OVER () AS pop FROM log GROUP BY 1")
def item_popularity_share(spark, d):
    return item_popularity(log(spark, d), normalize=True)


@query(_TRUTH + " SELECT avg(CASE WHEN k.item_id IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS recall FROM truth t LEFT JOIN ranked k ON k.qid = t.qid AND k.item_id = t.item_id")
def candidate_recall(spark, d):
    _, truth, ranked = _ranked(spark, d)
    return metrics.candidate_recall(ranked, truth)
