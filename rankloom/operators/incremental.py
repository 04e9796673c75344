"""Micro-batch updates: new interactions are added, and what they touch is recomputed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import matrix
from ..session import cut
from .base import Recommender
from .linear import EASE
from .neighbours import BM25, ItemKNN, RP3Beta, cosine_edges, pruned_walk
from .popular import MostPopular


def merged(r: DataFrame, delta: DataFrame) -> DataFrame:
    """R with the values of ``delta`` (user_id, item_id, r) added."""
    return r.select("user_id", "item_id", "r").unionByName(delta.select("user_id", "item_id", "r")).groupBy("user_id", "item_id").agg(F.sum("r").alias("r"))


def affected_items(r: DataFrame, touched: DataFrame) -> DataFrame:
    """(item_id): ``touched`` (item_id) and all items that share a user with them."""
    users = r.join(touched.select("item_id").distinct(), "item_id", "left_semi").select("user_id").distinct()
    near = r.join(users, "user_id", "left_semi").select("item_id")
    return near.unionByName(touched.select("item_id")).distinct()


def partial_fit(model: Recommender, log: DataFrame) -> Recommender:
    """Adds a batch to a fitted model; the first batch fits it.

    Popularity, cosine neighbours, BM25, walks and EASE equal a refit on all rows so far.
    Cosine neighbours recompute the affected targets only, EASE updates its inverse; the
    global terms of BM25 and the chained pruning of walks change with every batch, so those
    two take the merged matrix anew. Other models are refitted on the merged matrix.
    """
    if not model.tables:
        return model.fit(log)
    delta = cut(matrix(log))
    old = model.r
    r = cut(merged(old, delta))
    if isinstance(model, MostPopular) and model.exposure is None:
        touched = delta.select("item_id").distinct()
        pop = F.count("user_id").cast("double") if model.weighting == "count" else F.sum("r")
        anew = r.join(touched, "item_id", "left_semi").groupBy("item_id").agg(pop.alias("pop"))
        model.tables["pop"] = cut(model.tables["pop"].join(touched, "item_id", "left_anti").unionByName(anew))
    elif isinstance(model, ItemKNN):
        targets = cut(affected_items(r, delta.select("item_id").distinct()))
        anew = cosine_edges(r, model.shrink, model.n_neighbors, targets)
        kept = model.tables["s"].join(targets.withColumnRenamed("item_id", "j"), "j", "left_anti")
        model.tables["s"] = cut(kept.select("i", "j", "w").unionByName(anew.select("i", "j", "w")))
    elif isinstance(model, EASE) and hasattr(model, "ids"):
        _update_ease(model, old, r, delta)
    elif isinstance(model, (BM25, RP3Beta)):
        model.fit_matrix(r)
        if isinstance(model, RP3Beta):
            model.tables["walk"] = cut(model.tables["walk"])
            model.tables["s"] = pruned_walk(model.tables["walk"], model.n_neighbors, model.normalize_similarity, model.units)
        model.tables["s"] = cut(model.tables["s"])
    else:
        model.fit_matrix(r)
    model.tables["r"] = r
    return model


def _update_ease(model: EASE, old: DataFrame, r: DataFrame, delta: DataFrame) -> None:
    """Rank-2u update of the inverse for the u users that changed; a refit where that is
    no smaller than the matrix, or where the matrix outgrows the driver."""
    users = delta.select("user_id").distinct()
    fresh = [row[0] for row in delta.select("item_id").distinct().orderBy("item_id").toLocalIterator()]
    known = set(model.ids)
    ids = sorted(known | set(fresh))
    n = len(ids)
    if n > model.most() or 2 * users.count() >= n:
        model.fit_matrix(r)
        return
    place = {x: i for i, x in enumerate(ids)}
    p = np.eye(n) / model.l2_reg
    at = np.array([place[x] for x in model.ids])
    p[np.ix_(at, at)] = model.p
    rows, sign = [], []
    for table, s in ((r, 1.0), (old, -1.0)):
        frame = table.join(users, "user_id", "left_semi").toPandas()
        for _, part in frame.groupby("user_id"):
            row = np.zeros(n)
            row[part["item_id"].map(place).to_numpy()] = part["r"].to_numpy()
            rows.append(row)
            sign.append(s)
    model.ids, model.p = ids, p
    model.update(np.array(rows), np.array(sign))
    model._keep(r, ids, model.p)
