"""Mixing sources to target weights by hierarchical budgeting (operator 6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import attach, cut, digest, digest_unit, text_or_empty

SEED = 7_031
#: Documents are taken from a leaf at most so many times.
MAX_EPOCHS = 4
#: The whole mixture's tokens, as a share of the tokens there are.
BUDGET_SHARE = 0.5

#: Levels of the tree, from the root. A leaf is a path through all of them.
LEVELS = ["domain", "lang", "source"]


def domain_of(source: Column) -> Column:
    """The domain of a source: its number modulo four; sources without one are "other"."""
    number = F.try_to_number(F.regexp_extract(source, r"(\d{1,9})$", 1), F.lit("999999999"))
    return F.coalesce(F.concat(F.lit("domain"), (number % 4).cast("int").cast("string")), F.lit("other"))


def token_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``, counted without making them."""
    return (F.size(F.split(F.concat(F.lit(" "), text, F.lit(" ")), r"[\x20\x09-\x0D]+")) - 2).cast("long")


def fill(children: DataFrame, parent: list[str], budget: str, weight: str, room: str, out: str) -> DataFrame:
    """Shares ``budget`` of each parent among its children in proportion to ``weight``.

    A child takes at most its ``room``; what it cannot take goes to its siblings, in
    proportion again, until the budget or their room is used up. In order of room /
    weight the children that are filled come first, and child k is one of them just if
    its room is at most its share of what the earlier ones leave.
    """
    order = Window.partitionBy(*(parent or [F.lit(0)])).orderBy(F.col(room) / F.col(weight), *[c for c in LEVELS if c in children.columns])
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    later = order.rowsBetween(0, Window.unboundedFollowing)
    left = F.greatest(F.col(budget) - F.coalesce(F.sum(room).over(earlier), F.lit(0.0)), F.lit(0.0))
    level = left / F.sum(weight).over(later)
    full = F.col(room) <= F.col(weight) * level
    children = children.withColumn("_level", level).withColumn("_full", full)
    # The first that is not filled sets the level for all after it.
    first = F.first(F.when(~F.col("_full"), F.col("_level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    share = F.when(first.isNull(), F.col(room)).otherwise(F.least(F.col(room), F.col(weight) * first))
    return children.withColumn(out, share).drop("_level", "_full")


def budgets(leaves: DataFrame, total: float, weights: dict[str, dict[str, float]], max_epochs: int) -> DataFrame:
    """Adds ``_budget`` (tokens) to ``leaves`` (LEVELS, tokens).

    ``weights`` holds for each level a weight by name; names not in it weigh 1, and a
    weight of 0 takes nothing. A node's room is what all leaves below can give in
    ``max_epochs``, so shortages go to siblings first and to an ancestor's siblings only
    when all of a parent's children are full.
    """
    nodes = leaves.withColumn("_room", F.col("tokens").cast("double") * max_epochs)
    for level in LEVELS:
        table = weights.get(level) or {}
        pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(float(v)))]
        nodes = nodes.withColumn(f"_w_{level}", F.coalesce(F.create_map(*pairs)[F.col(level)], F.lit(1.0)) if pairs else F.lit(1.0))
        nodes = nodes.withColumn("_room", F.when(F.col(f"_w_{level}") > 0, F.col("_room")).otherwise(0.0))
    path: list[str] = []
    given = None
    for level in LEVELS:
        kids = nodes.groupBy(*path, level).agg(F.sum("_room").alias("_room"), F.max(f"_w_{level}").alias("_w")).filter("_w > 0")
        if given is None:
            # The root's budget is a number; its children, the domains, are few.
            kids = kids.withColumn("_budget", F.lit(float(total)))
        else:
            kids = kids.join(given.select(*[F.col(c).alias(f"_p{c}") for c in path], "_budget"), _same(path)).drop(*[f"_p{c}" for c in path])
        given = fill(kids, path, "_budget", "_w", "_room", "_given").select(*path, level, F.col("_given").alias("_budget"))
        path = [*path, level]
    return given


def _same(columns: list[str]) -> Column:
    on = F.lit(True)
    for c in columns:
        on = on & F.col(c).eqNullSafe(F.col(f"_p{c}"))
    return on


def mix(docs: DataFrame, *, weights: dict[str, dict[str, float]] | None = None, budget: float | None = None, budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, text: str = "text", source: str = "source", lang: str = "lang", key: str = "doc_id", seed: int = SEED, rows: int = 2048) -> DataFrame:
    """How often each document is taken: adds ``n_tokens``, ``epochs``, ``_h`` to its key.

    The token budget (``budget``, or ``budget_share`` of all tokens) flows down the tree
    domain - language - source (:func:`budgets`). A leaf with budget B and V tokens gives
    its whole self floor(B / V) times; then the documents of one more epoch, in the order
    of a hash seeded by the epoch, whose preceding tokens are under what is left: the
    shortest prefix that reaches the leaf's budget, so it is passed by less than one
    document. Returns (key, domain, lang, source, n_tokens, epochs, leaf_budget,
    unspent, _h) for every row, ``epochs`` 0 for those left out, where ``_h`` is a hash of
    the text and ``unspent`` the part of the whole budget that no leaf has room for, as
    ``max_epochs`` is reached everywhere.

    Null source, language or text: a null names a node of its own; no words: no tokens,
    never taken, as no budget needs it. Repeated rows are separate; their order among
    themselves does not matter. No rows: no rows. No task holds a whole leaf.
    """
    body = text_or_empty(docs, text)
    base = docs.select(F.col(key).alias("_key"), domain_of(F.col(source)).alias("domain"), F.col(lang).alias("lang"), F.col(source).alias("source"), token_count(body).alias("n_tokens"), F.xxhash64(body).alias("_h"))
    base = cut(base)
    leaves = cut(base.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")))
    if budget is None:
        budget = (leaves.agg(F.sum("tokens")).first()[0] or 0) * budget_share
    shares = cut(budgets(leaves, budget, weights or {}, max_epochs))
    unspent = max(0.0, float(budget) - (shares.agg(F.sum("_budget")).first()[0] or 0.0))
    given = leaves.withColumnsRenamed({c: f"_p{c}" for c in LEVELS}).join(shares, _same(LEVELS), "left")
    whole = F.when(F.col("tokens") > 0, F.least(F.lit(max_epochs), F.floor(F.col("_budget") / F.col("tokens")))).otherwise(0)
    given = given.select(*[F.col(f"_p{c}").alias(c) for c in LEVELS], "tokens", F.coalesce("_budget", F.lit(0.0)).alias("leaf_budget"), F.coalesce(whole, F.lit(0)).cast("int").alias("_whole"))
    given = cut(given.withColumn("_rest", F.col("leaf_budget") - F.col("tokens") * F.col("_whole")))
    dealt = attach(base, given, LEVELS)
    dealt = dealt.withColumn("_u", digest(F.lit(seed), F.col("_whole"), F.col("_key"), F.col("n_tokens"))).withColumn("_at", digest_unit(F.col("_u")))
    dealt = cut(dealt)
    # A running sum of tokens by ranges of the shuffled order: ranges before, then within.
    sizes = cut(dealt.groupBy(*LEVELS).agg(F.count(F.lit(1)).alias("_size")))
    dealt = attach(dealt, sizes, LEVELS).withColumn("_range", F.floor(F.col("_at") * F.ceil(F.col("_size") / rows)).cast("long"))
    sums = dealt.groupBy(*LEVELS, "_range").agg(F.sum("n_tokens").alias("_n"))
    before = Window.partitionBy(*LEVELS).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(sums.select(*LEVELS, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    inside = Window.partitionBy(*LEVELS, "_range").orderBy("_at", "_u", "_key", "_h").rowsBetween(Window.unboundedPreceding, -1)
    dealt = attach(dealt, starts, [*LEVELS, "_range"])
    passed = F.col("_before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    extra = (passed < F.col("_rest")) & (F.col("n_tokens") > 0) & (F.col("_whole") < max_epochs)
    epochs = F.when(F.col("n_tokens") > 0, F.col("_whole")).otherwise(0) + F.when(extra, 1).otherwise(0)
    return dealt.select(F.col("_key").alias(key), *LEVELS, "n_tokens", epochs.cast("int").alias("epochs"), "leaf_budget", F.lit(unspent).alias("unspent"), "_h")


#: Weights of the production mixture; names that are not listed weigh 1.
WEIGHTS = {"domain": {"domain0": 3.0, "domain1": 2.0, "domain2": 2.0, "domain3": 1.0}, "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 1.0}}


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return mix(docs, weights=WEIGHTS).select("doc_id", *LEVELS, "n_tokens", "epochs", F.round("leaf_budget").cast("long").alias("leaf_budget"), F.round("unspent").cast("long").alias("unspent"))


def _sql() -> str:
    """DuckDB: the tree's levels by windows, then running sums of tokens in each leaf."""
    weight = lambda level: "CASE " + level + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.get(level, {"": 1.0}).items()) + " ELSE 1.0 END::DOUBLE"
    parts, path = [], []
    for level in LEVELS:
        here = [*path, level]
        names, by = ", ".join(here), ", ".join(path) or "1"
        order = ", ".join(f"{c} NULLS FIRST" for c in here)
        budget = f"JOIN g_{path[-1]} g ON " + " AND ".join(f"g.{c} IS NOT DISTINCT FROM k.{c}" for c in path) if path else "CROSS JOIN total"
        parts.append(f"""k_{level} AS (SELECT {names}, sum(tokens) * {float(MAX_EPOCHS)}::DOUBLE AS room, any_value({weight(level)}) AS w FROM leaves GROUP BY {names}),
b_{level} AS (SELECT k.*, budget FROM k_{level} k {budget}),
l_{level} AS (SELECT *, greatest(budget - coalesce(sum(room) OVER (PARTITION BY {by} ORDER BY room / w, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)
  / sum(w) OVER (PARTITION BY {by} ORDER BY room / w, {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM b_{level}),
f_{level} AS (SELECT *, first_value(CASE WHEN room > w * lvl THEN lvl END IGNORE NULLS) OVER (PARTITION BY {by} ORDER BY room / w, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS first FROM l_{level}),
g_{level} AS (SELECT {names}, CASE WHEN first IS NULL THEN room ELSE least(room, w * first) END AS budget FROM f_{level})""")
        path = here
    same = " AND ".join(f"d.{c} IS NOT DISTINCT FROM g.{c}" for c in LEVELS)
    key = ", ".join(LEVELS)
    return f"""
WITH d AS (SELECT doc_id, lang, source, coalesce('domain' || (nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '')::BIGINT % 4)::VARCHAR, 'other') AS domain,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents),
leaves AS (SELECT {key}, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY {key}),
total AS (SELECT sum(tokens)::DOUBLE * {BUDGET_SHARE}::DOUBLE AS budget FROM leaves),
{", ".join(parts)},
t AS (SELECT g.*, tokens, CASE WHEN tokens > 0 THEN least({MAX_EPOCHS}, floor(budget / tokens)) ELSE 0 END::INT AS whole FROM g_{LEVELS[-1]} g JOIN leaves d ON {same}),
u AS (SELECT d.*, g.budget, g.whole, g.budget - g.tokens * g.whole AS rest, md5(concat_ws('|', '{SEED}', g.whole::VARCHAR, d.doc_id::VARCHAR, d.n_tokens::VARCHAR)) AS u FROM d JOIN t g ON {same}),
p AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY {key} ORDER BY u, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS passed FROM u)
SELECT doc_id, {key}, n_tokens::BIGINT AS n_tokens, CASE WHEN n_tokens > 0 THEN whole + (passed < rest AND whole < {MAX_EPOCHS})::INT ELSE 0 END::INT AS epochs,
  round(budget)::BIGINT AS leaf_budget, round(greatest((SELECT budget FROM total) - (SELECT sum(budget) FROM g_{LEVELS[-1]}), 0))::BIGINT AS unspent FROM p
"""


SQL = _sql()
