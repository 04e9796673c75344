"""Quality rules with risk-controlled thresholds (operator 2)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import attach, cut, digest, small_batches, words_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Share of a stratum's good documents that all rules together may reject, at most.
ALPHA = 0.02
#: Chance that any stratum's share is larger, over all strata, rules and cutoffs.
DELTA = 0.05
#: Cutoffs of each rule: the rule rejects scores above one of them.
GRID = [0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
#: Rules: each score is in [0, 1] and high for bad documents.
RULES = ["symbols", "dup_lines", "repeats", "odd_words", "alone"]


def _codes(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    put = seen.setdefault
    return np.fromiter((put(w, len(seen)) for w in words), np.int64, len(words))


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words in windows of ``width`` that the text holds twice or more, the first included.

    Windows get exact codes by doubling: a code for each word, each pair of codes, each
    pair of pairs. ``width`` is a power of two.
    """
    n = len(words)
    if n <= width:
        return 0
    codes, have = _codes(words), 1
    while have < width:
        pairs = codes[:-have] * (n + 1) + codes[have:]
        _, codes = np.unique(pairs, return_inverse=True)
        have *= 2
    hit = np.bincount(codes)[codes] > 1
    if not hit.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(hit)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def features(text: str | None) -> tuple[int, int, int, int, int, float, float]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, odd_words, alone."""
    text = text or ""
    words = words_of(text)
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            if line in seen:
                dup += 1
            seen.add(line)
    if not n:
        return 0, 0, 0 if not text else symbols, dup, 0, 0.0, 0.0
    lengths = np.fromiter(map(len, words), np.int64, n)
    odd = float(((lengths > 25).sum()) / n)
    alone = float((lengths == 1).sum() / n)
    return n, chars, symbols, dup, repeated_words(words), odd, alone


_FEATURES = T.StructType([T.StructField(k, T.LongType()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [T.StructField(k, T.DoubleType()) for k in ("_odd", "_alone")] + [T.StructField("_n_lines", T.LongType())])


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base features of each whole text, counted in Arrow batches."""

    @F.pandas_udf(_FEATURES)
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = [(*features(t), 1 + (t or "").count("\n")) for t in batch]
            yield pd.DataFrame(rows, columns=_FEATURES.names)

    # Told to be nondeterministic, or a filter on the result would have Spark count twice.
    return docs.withColumn("_f", count.asNondeterministic()(F.col(text))).select(*docs.columns, "_f.*")


def with_scores(df: DataFrame) -> DataFrame:
    share = lambda a, b: F.least(F.lit(1.0), F.coalesce(F.try_divide(a, b), F.lit(0.0)))
    return df.withColumns({
        "_s_symbols": share(10 * F.col("n_symbols"), F.col("word_chars")),
        "_s_dup_lines": share(F.col("n_dup_lines"), F.col("_n_lines")),
        "_s_repeats": share(F.col("n_repeat_words"), F.col("n_words")),
        "_s_odd_words": share(10 * F.col("_odd"), F.lit(1.0)),
        "_s_alone": F.col("_alone"),
    })


def binomial_p_value(k: int, n: int, alpha: float) -> float:
    """P(Bin(n, alpha) <= k), exactly: under it, k false rejections or fewer are that rare
    if the true share is alpha or more. At most d just if the exact (Clopper-Pearson)
    upper bound of the share at level 1 - d is at most alpha."""
    if n == 0:
        return 1.0
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(alpha) + (n - k) * math.log1p(-alpha)
    term, total, i = 1.0, 1.0, k
    odds = (1 - alpha) / alpha
    while i > 0 and term > 1e-18 * total:
        term *= odds * i / (n - i + 1)
        total += term
        i -= 1
    return min(1.0, math.exp(min(0.0, log + math.log(total))))


def choose_cutoffs(scored: DataFrame, labels: DataFrame, *, key: str, stratum: str, alpha: float, delta: float) -> DataFrame:
    """(stratum, rule, cutoff): for each stratum the certified cutoffs, one a rule.

    Labelled documents are halved by a hash of the key. On the selection half, each rule
    picks the cutoff that rejects most bad documents beyond ten times the good ones. On
    the holdout half, all of a stratum's chosen rules are judged together in order of
    that gain (fixed-sequence testing): the good documents rejected by the first j rules
    must pass the exact binomial test at level ``delta`` / strata (Bonferroni); the first
    failure ends the sequence. So all rules together reject at most ``alpha`` of each
    stratum's good documents, in all strata at once, but with chance ``delta``.

    Sums for each (stratum, half, quality, rule, bin) are all that leaves the tasks.
    """
    marked = labels.filter(F.col("quality").isNotNull()).groupBy(key).agg(F.min("quality").alias("_good"))
    known = cut(scored.join(marked, key).filter("_base_ok").select(F.col(stratum).alias("_stratum"), (F.substring(digest(F.lit("half"), F.col(key)), 1, 1) < "8").alias("_pick"), (F.col("_good") == 1).alias("_good"), *[f"_s_{r}" for r in RULES]))
    strata = max(1, known.select("_stratum").distinct().count())
    above = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"_s_{r}").alias("score")) for r in RULES for c in GRID])
    tried = known.filter("_pick").select("_stratum", "_good", F.explode(above).alias("t")).filter("t.score > t.cutoff")
    gain = F.sum(F.when(F.col("_good"), -10).otherwise(1))
    best = tried.groupBy("_stratum", "t.rule", "t.cutoff").agg(gain.alias("gain")).filter("gain > 0")
    order = Window.partitionBy("_stratum", "rule").orderBy(F.desc("gain"), F.desc("cutoff"))
    best = best.withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    turn = Window.partitionBy("_stratum").orderBy(F.desc("gain"), "rule")
    chosen = cut(best.withColumn("turn", F.row_number().over(turn)).select("_stratum", "rule", "cutoff", "gain", "turn"))
    rows = chosen.groupBy("_stratum").agg(F.array_sort(F.collect_list(F.struct("turn", "rule", "cutoff"))).alias("_rules"))
    held = attach(known.filter("NOT _pick AND _good"), cut(rows), ["_stratum"])
    score = F.create_map(*[x for r in RULES for x in (F.lit(r), F.col(f"_s_{r}"))])
    first = F.array_min(F.transform(F.filter("_rules", lambda t: score[t["rule"]] > t["cutoff"]), lambda t: t["turn"]))
    counts = held.groupBy("_stratum").agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(first <= j, 1)).alias(f"k{j}") for j in range(1, len(RULES) + 1)])
    by_turn = counts.select(F.col("_stratum").alias("_s"), "n", F.explode(F.array(*[F.struct(F.lit(j).alias("turn"), F.col(f"k{j}").alias("k")) for j in range(1, len(RULES) + 1)])).alias("t"))

    @F.pandas_udf(T.DoubleType())
    def p_value(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([binomial_p_value(int(a), int(b), alpha) for a, b in zip(k, n, strict=True)])

    by_turn = by_turn.select("_s", "n", F.col("t.turn").alias("_t"), "t.k")
    tested = chosen.join(by_turn, F.col("_stratum").eqNullSafe(F.col("_s")) & (F.col("turn") == F.col("_t")))
    tested = tested.withColumn("p_value", p_value("k", "n"))
    so_far = turn.rowsBetween(Window.unboundedPreceding, 0)
    return tested.withColumn("certified", F.max("p_value").over(so_far) <= delta / strata).select("_stratum", "rule", "cutoff", "gain", "turn", "n", "k", "p_value", "certified")


_OUT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rules", "kept"]


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with base features, rule scores and ``base_failed``."""
    counted = with_scores(with_features(docs, text))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("_base_ok", ~failed)


def apply_cutoffs(counted: DataFrame, cutoffs: DataFrame, stratum: str) -> DataFrame:
    """``failed_rules`` (certified ones only) and ``kept`` for measured documents."""
    rules = cutoffs.filter("certified").groupBy("_stratum").agg(F.collect_list(F.struct("rule", "cutoff")).alias("_rules"))
    joined = attach(counted.withColumn("_stratum", F.col(stratum)), cut(rules), ["_stratum"])
    score = F.create_map(*[x for r in RULES for x in (F.lit(r), F.col(f"_s_{r}"))])
    broken = F.coalesce(F.transform(F.filter("_rules", lambda t: score[t["rule"]] > t["cutoff"]), lambda t: t["rule"]), F.array().cast("array<string>"))
    kept = ~F.col("base_failed") & (F.size("failed_rules") == 0)
    return joined.withColumn("failed_rules", broken).withColumn("kept", kept)


def judge(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``docs`` with the base features, ``base_failed``, ``failed_rules`` and ``kept``.

    A document is kept if it does not fail the base rules and exceeds no certified cutoff
    of its stratum. A stratum without enough labels certifies nothing and rejects nothing
    beyond the base rules; null strata are a stratum of their own. Null or empty texts
    have no words, so they fail the base. A label row with null quality is ignored;
    several labels of one key count as bad if one is. Rows with one key are judged each by
    its own text. Other columns pass through (a column named like one of the results
    gives way to it); no rows: no rows. The measures are taken in one pass and
    checkpointed without the texts to choose the cutoffs; where ``docs`` has other
    columns, a second pass carries them, as a join would have to shuffle the texts.
    """
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in _OUT]
    # The columns travel as one struct, so that their names meet no name used here.
    docs = docs.select(F.struct(*[F.col(c) for c in names]).alias("_row"), F.col(key).alias("_key"), F.col(stratum).alias("_by"), F.col(text).alias("_said"))
    labels = labels.select(F.col(key).alias("_key"), "quality")
    light = cut(measured(docs.select("_key", "_by", "_said"), "_said").drop("_said"))
    cutoffs = cut(choose_cutoffs(light, labels, key="_key", stratum="_by", alpha=alpha, delta=delta))
    if set(names) <= {key, stratum, text}:
        done = apply_cutoffs(light, cutoffs, "_by")
        return done.select(*[F.col({key: "_key", stratum: "_by"}[c]).alias(c) for c in names if c != text], *_OUT)
    return apply_cutoffs(measured(docs, "_said"), cutoffs, "_by").select("_row.*", *_OUT)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    rules = F.concat_ws(",", F.array_sort("failed_rules")).alias("failed_rules")
    return judge(docs, labels).select("doc_id", *_OUT[:6], rules, "kept")


def _sql() -> str:
    """DuckDB: the measures by lists and windows, the tests by sums of binomial terms."""
    symbols = "|".join(f"[{c}]" for c in SYMBOLS)
    hashes, have = ["h1 AS (SELECT doc_id, i, md5(word) AS h FROM p)"], 1
    while have < WINDOW:
        hashes.append(f"h{2 * have} AS (SELECT doc_id, i, md5(h || lead(h, {have}) OVER (PARTITION BY doc_id ORDER BY i)) AS h FROM h{have})")
        have *= 2
    grid = ", ".join(f"{c}::DOUBLE" for c in GRID)
    names = ", ".join(f"'{r}'" for r in RULES)
    scores = ", ".join(f"s_{r}" for r in RULES)
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws, string_split(text, chr(10)) AS ls FROM d),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
{", ".join(hashes)},
hit AS (SELECT doc_id, i, h IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, h) > 1 AS hit FROM h{WINDOW}),
cov AS (SELECT doc_id, max(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS cov FROM hit),
rep AS (SELECT doc_id, count(*) FILTER (cov) AS n_repeat_words FROM cov GROUP BY doc_id),
f AS (SELECT doc_id, lang, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '{symbols.replace("'", "''")}', '', 'g')))::BIGINT AS n_symbols,
  (len(list_filter(ls, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
  CASE WHEN len(ws) > 0 THEN len(list_filter(ws, lambda x: strlen(x) > 25))::DOUBLE / len(ws) ELSE 0 END AS odd, CASE WHEN len(ws) > 0 THEN len(list_filter(ws, lambda x: strlen(x) = 1))::DOUBLE / len(ws) ELSE 0 END AS alone
  FROM w LEFT JOIN rep USING (doc_id)),
m AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  CASE WHEN word_chars > 0 THEN least(1.0::DOUBLE, 10 * n_symbols::DOUBLE / word_chars) ELSE 0 END AS s_symbols, least(1.0::DOUBLE, n_dup_lines::DOUBLE / n_lines) AS s_dup_lines,
  CASE WHEN n_words > 0 THEN least(1.0::DOUBLE, n_repeat_words::DOUBLE / n_words) ELSE 0 END AS s_repeats, least(1.0::DOUBLE, 10 * odd) AS s_odd_words, alone AS s_alone FROM f),
known AS (SELECT m.*, substr(md5('half|' || doc_id::VARCHAR), 1, 1) < '8' AS pick, good = 1 AS good FROM m JOIN (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) USING (doc_id) WHERE NOT base_failed),
strata AS (SELECT greatest(count(*), 1) AS n FROM (SELECT DISTINCT lang FROM known)),
long AS (SELECT doc_id, lang, pick, good, unnest([{names}]) AS rule, unnest([{scores}]) AS score FROM known),
tried AS (SELECT lang, rule, cutoff, sum(CASE WHEN good THEN -10 ELSE 1 END) AS gain FROM long CROSS JOIN (SELECT unnest([{grid}]) AS cutoff) WHERE pick AND score > cutoff GROUP BY ALL HAVING gain > 0),
best AS (SELECT * FROM tried QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY gain DESC, cutoff DESC) = 1),
chosen AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY gain DESC, rule) AS turn FROM best),
first AS (SELECT l.lang, l.doc_id, min(c.turn) FILTER (l.score > c.cutoff) AS turn FROM long l JOIN chosen c ON c.lang IS NOT DISTINCT FROM l.lang AND c.rule = l.rule WHERE NOT pick AND good GROUP BY ALL),
counts AS (SELECT c.lang, c.rule, c.cutoff, c.turn, count(f.doc_id) AS n, count(*) FILTER (f.turn <= c.turn) AS k FROM chosen c LEFT JOIN first f ON f.lang IS NOT DISTINCT FROM c.lang GROUP BY ALL),
tested AS (SELECT *, CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}::DOUBLE) + (n - i) * ln(1 - {ALPHA}::DOUBLE)))) END AS pv FROM counts),
certified AS (SELECT lang, rule, cutoff FROM (SELECT *, max(pv) OVER (PARTITION BY lang ORDER BY turn) AS worst FROM tested) WHERE worst <= {DELTA}::DOUBLE / (SELECT n FROM strata)),
every AS (SELECT doc_id, lang, unnest([{names}]) AS rule, unnest([{scores}]) AS score FROM m),
failed AS (SELECT doc_id, string_agg(e.rule, ',' ORDER BY e.rule) AS failed_rules FROM every e JOIN certified c ON c.lang IS NOT DISTINCT FROM e.lang AND c.rule = e.rule AND e.score > c.cutoff GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(failed_rules, '') AS failed_rules, NOT base_failed AND failed_rules IS NULL AS kept FROM m LEFT JOIN failed USING (doc_id)
"""


SQL = _sql()
