"""Models, composition, metrics, tuning and streams on small tables with known results."""

import asyncio
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankloom.functions import windows
from rankloom.functions.hashing import split_mix, unit_hash
from rankloom.operators import compose, conditions, explain, features, incremental, index, metrics, ranking, rankers, splits, tune
from rankloom.operators.base import Recommender
from rankloom.operators.cascade import Cascade
from rankloom.operators.factors import ALS, BPR, factor_top_k
from rankloom.operators.linear import EASE, SLIM, elastic_net
from rankloom.operators.neighbours import BM25, ItemKNN, RP3Beta
from rankloom.operators.popular import MostPopular
from rankloom.schema import InsufficientData, Schema, interactions
from rankloom.sources import amazon, movielens
from rankloom.streaming.batching import AsyncRecommender, MicroBatcher
from rankloom.streaming.updates import MatrixState, keep_matrix


def log_of(spark, text, kind="string"):
    """"u1:a,b u2:a" as a log in that order."""
    rows, n = [], 0
    for part in text.split():
        user, _, items = part.partition(":")
        for item in items.split(","):
            rows.append((user, item, 1.0, n))
            n += 1
    return spark.createDataFrame(rows, f"user_id {kind}, item_id {kind}, value double, pos int")


def users(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "user_id string")


def lists(ranked):
    out = {}
    for r in sorted(ranked.collect(), key=lambda r: (r["qid"], r["rank"])):
        out.setdefault(r["qid"], []).append(r["item_id"])
    return out


def random_log(spark, seed=0, n_users=40, n_items=15, density=0.3):
    rng = np.random.default_rng(seed)
    rows = [(int(u), int(i), float(rng.integers(1, 6)), int(u * 100 + i)) for u in range(n_users) for i in range(n_items) if rng.random() < density or i == u % n_items]
    return spark.createDataFrame(rows, "user_id long, item_id long, value double, pos long")


@pytest.mark.parametrize("model", [ItemKNN(), BM25(), RP3Beta(), EASE(1.0), SLIM(0.01)])
def test_the_one_shared_item_is_recommended(spark, model):
    log = log_of(spark, "u1:a,b u2:a,b u3:a")
    assert lists(model.fit(log).recommend(users(spark, "u3"), 1)) == {"u3": ["b"]}


def test_popularity_orders_filters_and_serves_strangers(spark):
    model = MostPopular().fit(log_of(spark, "u1:a,b,c u2:b,c u3:c u3:c"))
    assert lists(model.recommend(users(spark, "u3", "new"), 2)) == {"u3": ["b", "a"], "new": ["c", "b"]}
    only = spark.createDataFrame([("a",), ("c",)], "item_id string")
    assert lists(model.recommend(users(spark, "new"), 2, candidates=only)) == {"new": ["c", "a"]}
    away = spark.createDataFrame([("new", "c")], "user_id string, item_id string")
    assert lists(model.recommend(users(spark, "new"), 1, exclude=away)) == {"new": ["b"]}
    with pytest.raises(InsufficientData, match="u1"):
        model.recommend(users(spark, "u1"), 1, strict=True)
    with pytest.raises(ValueError, match="unknown item_id"):
        model.recommend(users(spark, "u1"), 1, candidates=spark.createDataFrame([("zz",)], "item_id string"), strict=True)
    with pytest.raises(ValueError, match="unknown user_id"):
        ItemKNN().fit(log_of(spark, "u1:a,b")).recommend(users(spark, "new"), 1, strict=True)


def test_popularity_per_exposure(spark):
    shown = spark.createDataFrame([("a", 2.0), ("b", 40.0), ("c", 40.0)], "item_id string, shown double")
    log = log_of(spark, "u1:a,b u2:b u3:c")
    assert lists(MostPopular(smoothing=1.0, exposure=shown).fit(log).recommend(users(spark, "new"), 2)) == {"new": ["a", "b"]}


def dense(frame, n):
    out = np.zeros((n, n))
    for r in frame.collect():
        out[r["i"], r["j"]] = r["w"]
    return out


def test_similarities_equal_dense_algebra(spark):
    log = random_log(spark)
    x = np.zeros((40, 15))
    for r in log.collect():
        x[r["user_id"], r["item_id"]] += r["value"]
    g = x.T @ x
    cosine = g / (np.sqrt(np.diag(g))[:, None] * np.sqrt(np.diag(g))[None, :] + 3.0)
    np.fill_diagonal(cosine, 0)
    assert np.allclose(dense(ItemKNN(None, 3.0).fit(log).tables["s"], 15), cosine)
    length = 0.25 + 0.75 * x.sum(0) / x.sum(0).mean()
    w = x * 2.2 / (1.2 * length[None, :] + x) * (math.log(15) - np.log1p((x > 0).sum(1)))[:, None]
    assert np.allclose(dense(BM25(None).fit(log).tables["s"], 15), w.T @ w)
    p = x / x.sum(1, keepdims=True)
    pop = (x > 0).sum(0)
    walk = ((x > 0).T @ p) / pop[:, None] / pop[None, :] ** 0.6
    np.fill_diagonal(walk, 0)
    assert np.allclose(dense(RP3Beta(None, normalize_similarity=False).fit(log).tables["s"], 15), walk)
    inverse = np.linalg.inv(g + 20 * np.eye(15))
    b = -inverse / np.diag(inverse)[None, :]
    np.fill_diagonal(b, 0)
    assert np.allclose(dense(EASE(20.0).fit(log).tables["s"], 15), b)


def test_elastic_net_meets_its_optimality_conditions():
    rng = np.random.default_rng(0)
    x = rng.random((60, 12)) * (rng.random((60, 12)) < 0.5)
    g = x.T @ x
    w, done = elastic_net(g, 3, 0.5, 1.0, False, 1000, 1e-10)
    slope = g[:, 3] - g @ w - 1.0 * w
    assert done and w[3] == 0
    for k in range(12):
        if k != 3:
            assert slope[k] == pytest.approx(0.5 * np.sign(w[k]), abs=1e-4) if w[k] else abs(slope[k]) <= 0.5 + 1e-6


def test_untouched_items_compete_at_zero(spark):
    log = spark.createDataFrame([(1, 10, 1.0), (1, 11, 1.0), (2, 10, 1.0), (3, 12, -1.0), (3, 13, 1.0), (4, 12, 1.0)], "user_id long, item_id long, value double")
    model = ItemKNN().fit(log)
    got = {r["item_id"]: r["score"] for r in model.recommend(spark.createDataFrame([(4,)], "user_id long"), 3).collect()}
    assert got == {10: 0.0, 11: 0.0, 13: pytest.approx(-1 / math.sqrt(2))}
    said = model.predict(spark.createDataFrame([(2, 11), (2, 12), (2, 99), (9, 10)], "user_id long, item_id long"))
    assert {(r["user_id"], r["item_id"]): r["score"] for r in said.collect()} == {(2, 11): pytest.approx(1 / math.sqrt(2)), (2, 12): 0.0, (2, 99): None, (9, 10): None}
    assert {r["user_id"]: r["eligible"] for r in model.count_eligible(spark.createDataFrame([(1,), (4,)], "user_id long")).collect()} == {1: 2, 4: 3}


def test_factor_models_learn_and_rank(spark):
    log = random_log(spark, density=0.4)
    als = ALS(4, 3, reg_factors=1.0).fit(log)
    mean = log.agg(F.stddev_pop("value")).first()[0]
    assert als.rmse() < mean
    assert all(len(x) == 3 for x in lists(als.recommend(log.select("user_id").distinct(), 3)).values())
    bpr = BPR(4, max_iter=15, partitions=2, learning_rate=0.1).fit(log)
    every = log.select("user_id").distinct().join(log.select("item_id").distinct())
    scores = {(r["user_id"], r["item_id"]): r["score"] for r in bpr.predict(every).collect()}
    liked = {(r["user_id"], r["item_id"]) for r in log.collect()}
    better = np.mean([scores[u, i] > scores[u, j] for u, i in liked for j in range(15) if (u, j) not in liked])
    assert better > 0.65


def test_factor_top_k_in_blocks_equals_one_product(spark, monkeypatch):
    from rankloom.operators import factors

    rng = np.random.default_rng(2)
    p, q, bias = rng.normal(size=(20, 4)), rng.normal(size=(50, 4)), rng.normal(size=50)
    queries = spark.createDataFrame([(i, i, x.tolist(), 0.5) for i, x in enumerate(p)], "qid long, user_id long, v array<double>, offset double")
    items = spark.createDataFrame([(i, x.tolist(), float(b)) for i, (x, b) in enumerate(zip(q, bias, strict=True))], "item_id long, v array<double>, bias double")
    blocked = spark.createDataFrame([(i, i) for i in range(20)], "user_id long, item_id long")
    scores = p @ q.T + bias
    scores[np.arange(20), np.arange(20)] = -np.inf
    want = {i: np.argsort(-scores[i], kind="stable")[:5].tolist() for i in range(20)}
    assert lists(factor_top_k(queries, items, 5, blocked)) == want
    monkeypatch.setattr(factors, "BROADCAST_ITEMS", 10)
    assert lists(factor_top_k(queries, items, 5, blocked, blocks=3)) == want


def test_ranks_and_normalisations(spark):
    rows = [(1, "a", 3.0), (1, "b", 3.0), (1, "c", 1.0), (1, "d", None), (1, "e", float("nan")), (2, "a", 7.0)]
    frame = spark.createDataFrame(rows, "qid long, item_id string, v double")
    by = lambda df: {(r["qid"], r["item_id"]): r["out"] for r in df.collect()}
    assert by(windows.average_rank(frame, ["qid"], "v", "out")) == {(1, "a"): 1.5, (1, "b"): 1.5, (1, "c"): 3.0, (1, "d"): None, (1, "e"): None, (2, "a"): 1.0}
    assert by(windows.percentile_rank(frame, ["qid"], "v", "out")) == {(1, "a"): 0.75, (1, "b"): 0.75, (1, "c"): 0.0, (1, "d"): None, (1, "e"): None, (2, "a"): 0.5}
    z = by(windows.zscore(frame, ["qid"], "v", "out"))
    assert z[2, "a"] == 0.0 and z[1, "d"] is None and z[1, "a"] == pytest.approx((3 - 7 / 3) / np.std([3, 3, 1]))


def test_reciprocal_rank_ranker(spark):
    rows = spark.createDataFrame([(1, "a", 0.9, 0.1), (1, "b", 0.5, 0.8), (1, "c", 0.1, 0.2)], "qid long, item_id string, x double, y double")
    out = rankers.ReciprocalRank(k=1).fit(None, ["x", "y"]).predict(rows)
    assert {r["item_id"]: round(r["score"], 4) for r in out.collect()} == {"a": 0.75, "b": 0.8333, "c": 0.5833}


def test_lists_and_switch(spark):
    log = log_of(spark, "u1:a,b u2:b,c u3:c")
    filled = compose.Backfill([ItemKNN(), MostPopular(), compose.ItemList(["z", "y", "c", "b", "a"])]).fit(log)
    assert lists(filled.recommend(users(spark, "u1", "new"), 3)) == {"u1": ["c", "z", "y"], "new": ["b", "c", "a"]}
    plain = compose.ItemList(["new", "b", "a", "old"]).fit(log_of(spark, "u1:a u2:b"))
    assert lists(plain.recommend(users(spark, "u1", "u2", "who"), 2)) == {"u1": ["new", "b"], "u2": ["new", "a"], "who": ["new", "b"]}
    slots = compose.ReservedSlots([MostPopular(), compose.ItemList(["x", "y"])], n_slots=1, head=3).fit(log_of(spark, "u1:a,b,c u2:a,b u3:b"))
    assert lists(slots.recommend(users(spark, "new"), 4)) == {"new": ["b", "a", "x", "c"]}
    switch = compose.Switch([ItemKNN(), MostPopular()], conditions.KnownUser()).fit(log_of(spark, "u1:a,b u2:a,b u3:a u4:b u5:b"))
    assert lists(switch.recommend(users(spark, "u3", "new"), 1)) == {"u3": ["b"], "new": ["b"]}
    rotated = compose.ItemList(list("abcdefgh"), rotate=True).fit(log_of(spark, "u1:a"))
    got = lists(rotated.recommend(users(spark, *[f"q{i}" for i in range(30)]), 3))
    around = "abcdefghabc"
    assert all("".join(x) in around or "".join(x) in "ghabcdefgh" for x in got.values()) and len({x[0] for x in got.values()}) > 3


def test_fusion(spark):
    log = random_log(spark)
    a, b = ItemKNN(5), MostPopular()
    asked = log.select("user_id").distinct()
    model = compose.ReciprocalRankFusion([a, b], n_retrieved=6).fit(log)
    one, two = lists(a.recommend(asked, 6)), lists(b.recommend(asked, 6))
    got = lists(model.recommend(asked, 4))
    for q in got:
        score = {i: sum(1 / (60 + x[q].index(i) + 1) for x in (one, two) if i in x[q]) for i in {*one[q], *two[q]}}
        assert got[q] == sorted(score, key=lambda i: (-round(score[i], 12), i))[:4]


def test_unit_hash(spark):
    known = split_mix(np.array([0]))[0]
    assert int(known) == 16294208416658607535
    frame = spark.createDataFrame([(0, "a"), (None, None)], "n long, s string")
    got = frame.select(unit_hash(F.col("n"), frame.schema["n"].dataType).alias("n"), unit_hash(F.col("s"), frame.schema["s"].dataType).alias("s")).collect()
    assert got[0]["n"] == (int(known) >> 11) / 2**53 and got[0]["s"] == 0xE8B7BE43 / 2**32 and got[1]["n"] is None and got[1]["s"] is None


def test_metrics_on_known_lists(spark):
    truth = spark.createDataFrame([(0, "a"), (0, "c"), (0, "z"), (1, "x"), (2, "f")], "qid long, item_id string")
    ranked = spark.createDataFrame([(q, r + 1, x) for q, said in enumerate(["abcd", "abcd", "efgh"]) for r, x in enumerate(said)], "qid long, rank int, item_id string")
    got = {r["qid"]: r.asDict() for r in metrics.per_query(ranked, truth, [4]).collect()}
    want = {"precision@4": [0.5, 0, 0.25], "recall@4": [2 / 3, 0, 1], "map@4": [(1 + 2 / 3) / 3, 0, 0.5], "mrr@4": [1, 0, 0.5], "hit_rate@4": [1, 0, 1], "ndcg@4": [(1 + 0.5) / (1 + 1 / math.log2(3) + 0.5), 0, 1 / math.log2(3)]}
    for name, values in want.items():
        assert [got[q][name] for q in range(3)] == pytest.approx(values), name
    catalog = spark.createDataFrame([(x,) for x in "abcdefghij"], "item_id string")
    assert metrics.catalog_coverage(ranked, catalog, 2).first()[0] == 0.4
    assert metrics.catalog_coverage(ranked, catalog.filter("item_id <> 'a'"), 2).first()[0] is None
    assert metrics.user_coverage(ranked, spark.createDataFrame([(q,) for q in range(4)], "qid long"), 4).first()[0] == 0.75
    pop = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "item_id string, pop double")
    assert {r["qid"]: r[1] for r in metrics.mean_popularity(ranked, pop, 2).collect()} == {0: 1.5, 1: 1.5, 2: 0.0}
    assert {r["qid"]: round(r[1], 6) for r in metrics.novelty(ranked, pop, 1).collect()} == {0: round(-math.log2(3 / 5), 6), 1: round(-math.log2(3 / 5), 6), 2: round(-math.log2(1 / 5), 6)}
    assert metrics.parse("NDCG@10") == ("ndcg", 10) and metrics.parse("hr") == ("hit_rate", None)
    model = MostPopular().fit(log_of(spark, "u1:a u2:a,b"))
    held = spark.createDataFrame([("u1", "b", 1.0)], "user_id string, item_id string, value double")
    assert metrics.evaluate(model, held, ["ndcg@1", "hit_rate@1"]) == {"ndcg@1": 1.0, "hit_rate@1": 1.0}


def test_splits(spark):
    log = log_of(spark, "u1:a,b u2:a,b u1:c u2:c")
    fold = {r["pos"]: r["fold"] for r in splits.warm_k_fold(log, ["pos"], 2).collect()}
    assert fold == {0: None, 1: None, 2: None, 3: 0, 4: None, 5: 1}
    latest = splits.latest_split(log_of(spark, "u1:a,b u2:a,c u3:b,c"), ["pos"], 0.5)
    assert sorted(r["pos"] for r in latest.filter("test").collect()) == [1, 3, 5]
    cold = splits.cold_start_split(log_of(spark, "u1:a,b u2:a,c u3:b,c"), ["pos"], 0.34, 0.5).filter("test")
    by_user = cold.groupBy("user_id").count().collect()
    assert sorted(r["count"] for r in by_user) == [1, 1, 2]
    assert sorted(r["pos"] for r in splits.tail_rows(log, ["pos"], 1, held_out=True).collect()) == [1, 3, 4, 5]


def test_features(spark):
    log = log_of(spark, "u1:a,b u2:a,c")
    score = features.RecommenderScores(ItemKNN()).fit(log).transform(spark.createDataFrame([("u1", "c"), ("new", "c")], "user_id string, item_id string"))
    assert {r["user_id"]: r["model_score"] and round(r["model_score"], 3) for r in score.collect()} == {"u1": 0.707, "new": None}
    segments = spark.createDataFrame([("u1", "kid"), ("u2", "kid"), ("new", "kid"), ("u3", "adult")], "user_id string, segment string")
    part = features.SegmentPopularity(segments, 0).fit(log_of(spark, "u1:a u2:a u3:b")).transform(spark.createDataFrame([("new", "a"), ("new", "b"), ("who", "a")], "user_id string, item_id string"))
    assert {(r["user_id"], r["item_id"]): (r["segment_share"], r["segment_lift"]) for r in part.collect()} == {("new", "a"): (1.0, pytest.approx(1.5)), ("new", "b"): (0.0, 0.0), ("who", "a"): (None, None)}
    attributes = spark.createDataFrame([("a", 1.0, 0.0), ("b", 1.0, 1.0), ("c", 0.0, 1.0)], "item_id string, g1 double, g2 double")
    out = features.ProfileAffinity(attributes).fit(log_of(spark, "u1:a,b")).transform(spark.createDataFrame([("u1", "a"), ("u1", "c"), ("new", "a")], "user_id string, item_id string"))
    assert {(r["user_id"], r["item_id"]): (r["profile_share"], r["profile_cosine"] and round(r["profile_cosine"], 2)) for r in out.collect()} == {("u1", "a"): (1.0, 0.89), ("u1", "c"): (0.5, 0.45), ("new", "a"): (None, None)}
    with pytest.raises(ValueError, match="occurs 2 times"):
        features.JoinStatic("item", attributes.unionByName(attributes.limit(1))).fit(log)
    with pytest.raises(ValueError, match="unknown item_id"):
        features.JoinStatic("item", attributes, missing="error").transform(spark.createDataFrame([("u", "zz")], "user_id string, item_id string"))


def test_as_of_takes_the_latest_strictly_before(spark):
    pairs = spark.createDataFrame([(1, "x", 5), (2, "x", 10), (3, "x", 1), (4, "x", None), (5, "y", 9), (6, "x", 5)], "n int, k string, time long")
    history = spark.createDataFrame([("x", 1, 0.1), ("x", 5, 0.5), ("x", 7, None), ("x", None, 9.9)], "k string, time long, v double")
    got = {r["n"]: r["v"] for r in features.as_of(pairs, history, "k", ["v"]).collect()}
    assert got == {1: 0.1, 2: None, 3: None, 4: None, 5: None, 6: 0.1}


def test_cascade_beats_nothing_learned(spark):
    rng = np.random.default_rng(1)
    rows, n = [], 0
    for u in range(60):
        for item in [*rng.choice(30, 4, replace=False), 25 + rng.integers(5)]:
            rows.append((u, int(item), 1.0, n))
            n += 1
    log = spark.createDataFrame(rows, "user_id long, item_id long, value double, pos long")
    trending = spark.createDataFrame([(i, float(i >= 25)) for i in range(30)], "item_id long, trending double")
    made = features.Concat(score=features.GeneratorScores(), table=features.JoinStatic("item", trending))
    model = Cascade([MostPopular()], made, rankers.Pointwise(), order=["pos"], n_retrieved=25).fit(log)
    asked = spark.createDataFrame([(u,) for u in range(10)], "user_id long")
    assert all(x[0] >= 25 for x in lists(model.recommend(asked, 3)).values())
    blend = rankers.Blend([rankers.Pointwise(), rankers.ReciprocalRank()], cv=2)
    model = Cascade([MostPopular(), ItemKNN()], made, blend, order=["pos"], n_retrieved=25, postprocess=lambda q: q.assign(score=-q["score"])).fit(log)
    assert all(len(x) == 3 for x in lists(model.recommend(asked, 3)).values())
    assert model.predict(log.select("user_id", "item_id").limit(4)).filter("score IS NOT NULL").count() == 4


def test_explain(spark):
    log = log_of(spark, "u1:a,b u2:b,c u3:a u4:a u4:c,d")
    model = ItemKNN().fit(log)
    pairs = spark.createDataFrame([("u3", x) for x in "abdz"], "user_id string, item_id string")
    got = {r["item_id"]: (r["status"], r["by"]) for r in explain.explain(model, pairs, 1).collect()}
    assert got == {"a": ("excluded", "seen"), "b": ("ranked_out", None), "d": ("served", None), "z": ("unknown_item", None)}
    reasons = explain.history_attribution(model, pairs.filter("item_id = 'd'"), 2).collect()
    assert [(r["reason"], round(r["term"], 4), round(r["rest"], 4)) for r in reasons] == [("a", 0.5774, 0.0)]
    trace = explain.Trace()
    trace.add("knn", "served", model.recommend(users(spark, "u3"), 1))
    assert [(r["path"], r["kind"], r["item_id"], r["rank"]) for r in trace.events().collect()] == [("knn", "served", "d", 1)]


@pytest.mark.parametrize("make", [lambda: MostPopular(), lambda: MostPopular("sum"), lambda: ItemKNN(4), lambda: BM25(4), lambda: RP3Beta(4), lambda: EASE(5.0)])
def test_batches_equal_a_refit(spark, make):
    log = random_log(spark)
    first, later = log.filter("user_id < 36"), log.filter("user_id >= 36").unionByName(log.filter("user_id = 3"))
    chained = incremental.partial_fit(incremental.partial_fit(make(), first), later)
    whole = make().fit(first.unionByName(later))
    name = "pop" if isinstance(chained, MostPopular) else "s"
    key = lambda r: tuple(r)[:-1]
    order = ["item_id", "pop"] if name == "pop" else ["i", "j", "w"]
    a = {key(r): r[-1] for r in chained.tables[name].select(*order).collect()}
    b = {key(r): r[-1] for r in whole.tables[name].select(*order).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-8, abs=1e-12) for k in a)


def test_models_are_saved_and_loaded(spark, tmp_path):
    log = log_of(spark, "u1:a,b u2:a,b u3:a")
    ItemKNN(3).fit(log).save(f"file://{tmp_path}/m")
    model: Recommender = ItemKNN.load(spark, f"file://{tmp_path}/m")
    assert model.n_neighbors == 3 and lists(model.recommend(users(spark, "u3"), 1)) == {"u3": ["b"]}


def test_indexes(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 8))
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item_id long, v array<double>")
    queries = spark.createDataFrame([(i, i, rng.normal(size=8).tolist()) for i in range(20)], "qid long, user_id long, v array<double>")
    exact = index.make_index("exact").fit(items).query(queries, 5)
    for name, least in (("quantized", 0.99), ("lsh", 0.3)):
        params = {"length": 4.0} if name == "lsh" else {}
        assert index.index_recall(index.make_index(name, **params).fit(items).query(queries, 5), exact).first()["recall"] >= least
    codes = spark.createDataFrame([([0, 15, 7, 3, 9, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12],)], "c array<int>")
    packed = codes.withColumn("p", index.pack(F.col("c"), 4))
    back = packed.select("c", F.size("p").alias("n"), index.unpack(F.col("p"), 4, F.size("c")).alias("u")).first()
    assert back["u"] == back["c"] and back["n"] == 2
    with pytest.raises(ValueError, match="no index"):
        index.make_index("nothing")


def test_tuning(spark):
    space = {"x": tune.Float(0.0, 1.0), "n": tune.Int(1, 100, log=True), "c": tune.Categorical(["a", "b"])}
    study = tune.Study(space, tune.TPE(seed=1))
    study.enqueue({"x": 0.5, "n": 10, "c": "a"})
    study.optimize(lambda p: -((p["x"] - 0.3) ** 2) - abs(math.log(p["n"] / 20)) - (p["c"] == "a"), 80)
    assert study.trials[0].params == {"x": 0.5, "n": 10, "c": "a"}
    assert study.best.params["c"] == "b" and study.best.value > -0.4
    log = random_log(spark)
    marked = splits.latest_split(log, ["pos"], 0.3).cache()
    pair = (marked.filter("NOT test").drop("test"), marked.filter("test").drop("test"))
    tuned = tune.AutoTune(ItemKNN(5), metrics.scorer("recall@3"), [pair], freeze=["shrink"], n_trials=3).fit(log)
    assert len(tuned.study.trials) == 3 and set(tuned.study.best.params) == {"n_neighbors"} and tuned.best.r.count() == log.count()


def test_validation(spark):
    good = spark.createDataFrame([(1, 2, 1.0), (1, None, 1.0), (2, 3, float("nan"))], "u long, i long, v double")
    assert interactions(good, Schema("u", "i", "v")).count() == 1
    with pytest.raises(Exception, match="an interaction lacks"):
        interactions(good, Schema("u", "i", "v"), strict=True).collect()
    with pytest.raises(TypeError, match="fractional"):
        interactions(good, Schema("v", "i", None))
    with pytest.raises(ValueError, match="not in"):
        interactions(good, Schema("u", "x", "v"))


def test_streamed_matrix_equals_the_batch(spark, tmp_path):
    log = random_log(spark).select("user_id", "item_id", "value")
    for k in range(3):
        log.filter(F.col("user_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = keep_matrix(stream, f"file://{tmp_path}/r", f"file://{tmp_path}/c")
    query.processAllAvailable()
    query.stop()
    state = MatrixState(spark, f"file://{tmp_path}/r")
    got = {(r[0], r[1]): r[2] for r in state.read().select("user_id", "item_id", "r").collect()}
    assert got == {(r[0], r[1]): r[2] for r in log.collect()} and len(state.versions()) <= 2
    state.add(log.filter("user_id = 0"), state.versions()[-1])


def test_batched_requests(spark):
    calls = []

    def process(keys):
        calls.append(list(keys))
        if "bad" in keys and len(keys) > 1:
            raise RuntimeError("batch")
        return {k: k.upper() for k in keys}

    async def run():
        batcher = MicroBatcher(process, fallback=lambda k: "?" + k)
        return await asyncio.gather(*[batcher.submit(k) for k in ("a", "b", "a")]), await asyncio.gather(*[batcher.submit(k) for k in ("c", "bad")])

    assert asyncio.run(run()) == (["A", "B", "A"], ["?c", "?bad"]) and calls[0] == ["a", "b"]
    model = MostPopular().fit(log_of(spark, "u1:a,b u2:b"))
    served = AsyncRecommender(spark, model, k=1)

    async def ask():
        return await asyncio.gather(served.recommend("u2"), served.recommend("x"))

    assert asyncio.run(ask()) == [[("a", 1.0)], [("b", 2.0)]]


def test_sources(spark, tmp_path):
    (tmp_path / "u.data").write_text("1\t10\t3\t100\n1\t11\t4\t90\n2\t10\t5\t80\n")
    (tmp_path / "ua.base").write_text("1\t10\t3\t100\n2\t10\t5\t80\n")
    (tmp_path / "ua.test").write_text("1\t11\t4\t90\n")
    (tmp_path / "u.genre").write_text("unknown|0\nDrama|1\n\n")
    (tmp_path / "u.item").write_bytes("10|Café (1995)|01-Jan-1995||http://x|0|1\n11|No date|||http://y|1|0\n".encode("latin-1"))
    (tmp_path / "ratings.dat").write_text("1::10::3::100\n1::11::4::90\n2::10::5::80\n")
    (tmp_path / "movies.dat").write_bytes("10::Café (1995)::Drama|War\n11::None::Drama\n".encode("latin-1"))
    path = f"file://{tmp_path}"
    train, test = movielens.split_100k(spark, path, "ua")
    assert (train.count(), test.count()) == (2, 1)
    items = {r["item_id"]: r for r in movielens.items_100k(spark, path).collect()}
    assert items[10]["title"] == "Café (1995)" and str(items[10]["release_date"]) == "1995-01-01" and items[10]["genres"] == [False, True] and items[11]["release_date"] is None
    assert {r["item_id"]: (r["title"], r["year"], r["genres"]) for r in movielens.items_1m(spark, path).collect()} == {10: ("Café (1995)", 1995, ["Drama", "War"]), 11: ("None", None, ["Drama"])}
    train, test = movielens.leave_one_out_1m(spark, path)
    assert sorted((r["user_id"], r["item_id"]) for r in test.collect()) == [(1, 10), (2, 10)]
    rows = [(f"u{u}", f"i{i}", 1.0, 0) for u in range(5) for i in range(5)] + [("u9", "i0", 1.0, 0)]
    pd.DataFrame(rows).to_csv(tmp_path / "books.csv", index=False, header=False)
    kept = amazon.five_core(amazon.ratings(spark, f"{path}/books.csv"))
    assert kept.count() == 25
    assert [r["code"] for r in amazon.codes(kept, "item_id").orderBy("item_id").collect()] == list(range(5))


def test_require_known_names_samples(spark):
    with pytest.raises(ValueError, match=r"\[3, 4\]"):
        ranking.require_known(spark.createDataFrame([(3,), (4,), (1,)], "x long"), spark.createDataFrame([(1,)], "x long"), "x")


@pytest.mark.parametrize("text", [True, False])
def test_slim_beyond_its_old_limit_meets_its_optimality_conditions(spark, text):
    rng = np.random.default_rng(3)
    x = np.floor(rng.random((80, 30)) * 9) * (rng.random((80, 30)) < 0.2)
    name = (lambda p, k: f"{p}{k:02}") if text else (lambda p, k: int(k))
    kind = "string" if text else "long"
    rows = [(name("u", u), name("i", i), float(x[u, i])) for u, i in zip(*np.nonzero(x), strict=True)]
    model = SLIM(0.05, 0.5, None, max_items=10).fit(spark.createDataFrame(rows, f"user_id {kind}, item_id {kind}, value double"))
    w = np.zeros((30, 30))
    for r in model.tables["s"].collect():
        w[int(str(r["i"]).lstrip("i")), int(str(r["j"]).lstrip("i"))] = r["w"]
    slope = x.T @ x - x.T @ x @ w - 0.05 * 0.5 * 80 * w - 0.05 * 0.5 * 80
    off = ~np.eye(30, dtype=bool)
    assert (w >= 0).all() and (np.diag(w) == 0).all() and (w > 0).sum() > 100
    assert np.abs(slope[w > 0]).max() < 1e-4 and slope[off & (w == 0)].max() < 1e-4
    assert np.allclose(w[:, 4], elastic_net(x.T @ x, 4, 2.0, 2.0, True, 1000, 1e-12)[0], atol=1e-6)


def test_cascade_scores_only_the_queries_that_teach_it(spark):
    """Candidates of queries without a held-out hit get no predictions in fitting."""
    asked = []

    class Counting(MostPopular):
        def clone(self, **changes):
            return Counting(**{**self.params, **changes})

        def predict(self, pairs):
            asked.append({r["user_id"] for r in pairs.select("user_id").distinct().collect()})
            return super().predict(pairs)

    rows = [(u, i, 1.0, n) for u in range(12) for n, i in enumerate([u % 4, 4 + u % 3, 7 if u < 5 else 100 + u])] + [(50, 7, 1.0, 0), (51, 7, 1.0, 0)]
    log = spark.createDataFrame(rows, "user_id long, item_id long, value double, pos long")
    counts = features.Concat(generator=features.GeneratorScores(), counts=features.InteractionCounts("item"))
    model = Cascade([Counting()], counts, rankers.Pointwise(), order=["pos"], n_retrieved=20, split=0.4).fit(log)
    assert asked == [set(range(5))]
    assert model.recommend(log.select("user_id").distinct(), 3).count() == 3 * 14


def test_bpr_takes_more_items_than_go_to_a_task_at_a_time(spark, monkeypatch):
    """such catalogues were refused."""
    from rankloom.operators import factors

    monkeypatch.setattr(factors, "BROADCAST_ITEMS", 4)
    monkeypatch.setattr(factors, "CHUNK", 4)
    log = random_log(spark, density=0.4)
    bpr = BPR(4, max_iter=2, partitions=2).fit(log)
    got = bpr.recommend(log.select("user_id").distinct(), 3).collect()
    every = log.select("user_id").distinct().join(log.select("item_id").distinct())
    liked = {(r["user_id"], r["item_id"]) for r in log.collect()}
    want = {}
    for r in bpr.predict(every).collect():
        if (r["user_id"], r["item_id"]) not in liked:
            want.setdefault(r["user_id"], []).append((-r["score"], r["item_id"]))
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r["user_id"], []).append(r["item_id"])
    assert found == {u: [i for _, i in sorted(x)[:3]] for u, x in want.items()}


def test_factor_top_k_skips_tiles_and_loses_none(spark, monkeypatch):
    """equal items tie by id, and pruned tiles hold none of the best."""
    from rankloom.operators import factors

    rng = np.random.default_rng(4)
    monkeypatch.setattr(factors, "TILE", 16)
    p, q, bias = rng.normal(size=(40, 3)) * rng.lognormal(size=(40, 1)), np.round(rng.normal(size=(300, 3)) * rng.lognormal(size=(300, 1)), 1), np.round(rng.normal(size=300), 1)
    q[150:], bias[150:] = q[:150], bias[:150]
    queries = spark.createDataFrame([(i, i, x.tolist(), 0.0) for i, x in enumerate(p)], "qid long, user_id long, v array<double>, offset double")
    items = spark.createDataFrame([(i, x.tolist(), float(b)) for i, (x, b) in enumerate(zip(q, bias, strict=True))], "item_id long, v array<double>, bias double")
    banned = {(u, int(i)) for u in range(0, 40, 2) for i in rng.integers(0, 300, 30)}
    blocked = spark.createDataFrame(sorted(banned), "user_id long, item_id long")
    want = {u: sorted((-((p[u] * q[i]).sum() + bias[i]), i) for i in range(300) if (u, i) not in banned)[:7] for u in range(40)}
    assert lists(factor_top_k(queries, items, 7, blocked)) == {u: [i for _, i in x] for u, x in want.items()}


def test_als_solves_many_ids_at_a_time(spark, monkeypatch):
    """each id was a group of its own; the sweeps give the same factors as solves one by one."""
    from rankloom.operators import factors

    log = random_log(spark, density=0.4)
    monkeypatch.setattr(factors.ALS, "_sweep", lambda *_: pytest.fail("ids are solved one by one"))
    found = ALS(3, 2, reg_factors=1.0).fit(log)
    monkeypatch.undo()
    monkeypatch.setattr(factors, "BROADCAST_SIDE", 0)
    plain = ALS(3, 2, reg_factors=1.0).fit(log)
    for table, key in (("users", "user_id"), ("items", "item_id")):
        swept = [{r[key]: [*r["v"], r["bias"]] for r in m.tables[table].collect()} for m in (found, plain)]
        assert swept[0].keys() == swept[1].keys()
        assert all(np.allclose(swept[0][x], swept[1][x], atol=1e-9) for x in swept[0])
        assert found.tables[table].schema == plain.tables[table].schema
