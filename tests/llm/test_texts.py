"""Quality rules, substring and line dedup, secrets and near-duplicates on small texts,
each against a brute-force version."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from rankloom.llm import components, lines, neardup, quality, secrets, substrings

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" + (".\n" if rng.random() < 0.05 else "") for _ in range(n))


def corpus(seed=0):
    """Nulls, empties, a very long text, exact and near copies, shared passages and lines."""
    rng = random.Random(seed)
    passage, line = prose(rng, 60), "This very common line is found in many texts."
    texts = [prose(rng, rng.randrange(1, 200)) for _ in range(40)]
    texts += [None, "", " \n\t ", "one", "a b c d", " x y \x1cz", "A" * 5000, prose(rng, 9000)]
    base = prose(rng, 150)
    for k in range(12):
        words = base.split(" ")
        for _ in range(k // 2):
            words[rng.randrange(len(words))] = f"new{rng.random()}"
        texts.append(" ".join(words))
    texts += [base] * 5 + [base.replace(" ", "  ")]
    texts += [prose(rng, 80) + "\n" + passage + "\n" + prose(rng, 50) for _ in range(6)]
    texts += [f"{prose(rng, 20)}\n  {line.upper() if k % 2 else line}\t\n{prose(rng, 20)}\n{line}" for k in range(7)]
    return [(i, t, "en" if i % 3 else None, f"src{i % 4}", None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5)


def test_substring_dedup_equals_brute_force(docs):
    got = {r["doc_id"]: r for r in substrings.dedup(docs.withColumn("key", docs.text).withColumn("said", docs.text)).collect()}
    words = {i: WORDS.findall(t or "") for i, t, *_ in corpus()}
    counts = Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    longest = {}
    for width in (35, 70, 140, 280):
        longer = Counter(tuple(w[k : k + width]) for w in words.values() for k in range(len(w) - width + 1))
        for i, w in words.items():
            if any(longer[tuple(w[k : k + width])] > 1 for k in range(len(w) - width + 1)):
                longest[i] = width
    assert set(got) == set(words)
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - 34):
            if counts[tuple(w[k : k + 35])] > 1:
                gone.update(range(k, k + 35))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        row = got[i]
        assert (row["n_words"], row["n_removed"], row["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
        assert row["longest"] == longest.get(i, 0)
        assert {x for a, b in row["removed"] for x in range(a, b)} == gone


def test_substring_dedup_within_one_text_and_repeated_rows(spark):
    rng = random.Random(3)
    twice, other = prose(rng, 40), prose(rng, 30)
    rows = [(1, f"{twice} {other} {twice}"), (2, prose(rng, 50)), (2, prose(rng, 60)), (3, other), (3, other), (None, prose(rng, 40))]
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 40, 0), (1, 110, 80), (2, 50, 0), (2, 60, 0), (3, 30, 0), (3, 30, 0)]


def line_oracle(rows):
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t, *_ in rows:
        for s in (t or "").split("\n"):
            if len(key(s)) >= 20:
                holders[key(s)].add(i)
    out = {}
    for i, t, *_ in rows:
        own = (t or "").split("\n")
        keep = [not (len(holders[key(s)]) >= 3 and i < max(holders[key(s)])) for s in own]
        out[i] = (len(own), keep.count(False), hashlib.sha256("\n".join(s for s, k in zip(own, keep, strict=True) if k).encode()).hexdigest(), keep)
    return out


def test_line_dedup_equals_brute_force(spark, docs):
    from pyspark.sql import functions as F

    rows = corpus()
    done = lines.keep_bitmaps(docs.withColumn("doc", F.lit(1)).withColumn("h1", F.lit(2)))
    got = {r["doc_id"]: r for r in done.withColumn("kept", lines.kept_text(F.col("text"), F.col("keep_runs"))).collect()}
    for i, (n, dropped, digest, keep) in line_oracle(rows).items():
        row = got[i]
        assert (row["n_lines"], row["n_dropped"], hashlib.sha256(row["kept"].encode()).hexdigest()) == (n, dropped, digest)
        assert [k % 2 == 0 for k, run in enumerate(row["keep_runs"]) for _ in range(run)] == keep
        assert (row["doc"], row["h1"]) == (1, 2)


def test_line_keys_strip_and_lower_ascii_only(spark):
    from pyspark.sql import functions as F

    said = ["\x0b É ABC x \r", "ABC", "İI", " A"]
    rows = spark.createDataFrame([(s,) for s in said], "s string").select(lines.line_key(F.col("s"))).collect()
    assert [r[0] for r in rows] == ["É abc x", "abc", "İi", " a"]


def secret_oracle(t):
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(t) if len(m[1]) >= 12]
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return [x[2] for x in sorted(out)]


def test_secrets_find_the_base_and_more(spark, tmp_path):
    texts = [None, "", "é password = 'abcdefghijkl' TOKEN:0123456789abcdef0", "token=api_key:ABCDEFGHIJKLMNOP", "AKIA" + "B" * 14, "AKIAAKIA" + "1" * 9, "x" * 10 + "deadbeef" * 3, "ghp_" + "a1" * 20, "url https://bob:hunter22@example.com/", "ſecret=abcdefghijklmnop"]
    texts += texts[2:4]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ledger = secrets.BlobLedger(spark, f"file://{tmp_path}/ledger")
    got = {r["doc_id"]: r for r in ledger.scan(rows).collect()}
    for i, t in enumerate(texts):
        base = secret_oracle(t or "") if i != 9 else []
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(got[i]["spans"].split(","))
    assert got[7]["spans"].startswith("github:0:44") and "url_login" in got[8]["spans"]


@pytest.mark.parametrize("user, password", [("oauth2", "t0" * 150), ("u" * 150, "hunter22")])
def test_logins_of_any_length_are_found(user, password):
    text = f"see https://{user}:{password}@example.com/ now"
    assert f"url_login:4:{text.index('@') + 1}" in [s[2] for s in secrets.find(text)]


def test_ledger_scans_only_unseen_pairs(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    first = spark.createDataFrame([(1, "secret=abcdefghijklm"), (2, "clean"), (3, "clean")], "doc_id long, text string")
    secrets.BlobLedger(spark, path).scan(first).collect()
    assert secrets.BlobLedger(spark, path).rows().count() == 2
    more = first.union(spark.createDataFrame([(4, "clean"), (5, "new token: 0123456789abc")], first.schema))
    got = {r["doc_id"]: r["n_assign"] for r in secrets.BlobLedger(spark, path).scan(more).collect()}
    assert secrets.BlobLedger(spark, path).rows().count() == 3
    assert got == {1: 1, 2: 0, 3: 0, 4: 0, 5: 1}
    secrets.BlobLedger(spark, path).scan(first, version="2").collect()
    assert secrets.BlobLedger(spark, path).rows().count() == 5


def similar(a, b):
    x, y = Counter(a), Counter(b)
    if not x or not y:
        return 0.0
    nx, ny, every = sum(x.values()), sum(y.values()), x.keys() | y.keys()
    if sum(min(x[i] / nx, y[i] / ny) for i in x.keys() & y.keys()) < 0.7:
        return 0.0
    return float(sum(1 / sum(max(Fraction(x[j], x[i]), Fraction(y[j], y[i])) for j in every) for i in x.keys() & y.keys()))


def shingled(t):
    w = WORDS.findall(t or "")
    return [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []


def test_near_duplicates_equal_brute_force(docs):
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs.drop("lang").withColumn("cid", docs.text)).collect()}
    sets = {i: shingled(t) for i, t, *_ in corpus()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and similar(sets[i], sets[j]) >= 0.8:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    sizes = Counter(root(i) for i in sets)
    assert {i: (r["class_id"], r["class_size"]) for i, r in got.items()} == {i: (root(i), sizes[root(i)]) for i in sets}
    kept = {r["doc_id"] for r in neardup.keep_first(docs).collect()}
    assert kept == {root(i) for i in sets}


def test_near_duplicates_of_repeated_rows(spark):
    rng = random.Random(5)
    a, b = prose(rng, 50), prose(rng, 60)
    rows = spark.createDataFrame([(2, a), (2, a), (2, b), (1, b), (3, None), (3, None), (4, a)], "doc_id long, text string")
    kept = sorted((r["doc_id"], r["text"] or "") for r in neardup.keep_first(rows).collect())
    assert kept == sorted([(2, a), (1, b), (3, "")])


BIG = 2**53 + 1


def test_keys_beside_a_null_stay_exact(spark):
    """Ids beyond 2^53 in one batch with a null key; classes without keys stay apart."""
    rng = random.Random(12)
    passage, x, y = prose(rng, 60), prose(rng, 70), prose(rng, 80)
    rows = spark.createDataFrame([(BIG, f"{passage} {x}"), (BIG + 2, f"{y} {passage}"), (BIG + 4, f"{y} {passage}"), (None, prose(rng, 50)), (None, prose(rng, 55))], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(rows).collect()}
    assert {k: r["class_id"] for k, r in got.items()} == {BIG: BIG, BIG + 2: BIG + 2, BIG + 4: BIG + 2, None: None}
    assert sorted(r["doc_id"] or 0 for r in neardup.keep_first(rows).collect()) == [0, 0, BIG, BIG + 2]
    gone = {r["doc_id"]: r["n_removed"] for r in substrings.dedup(rows).collect()}
    assert gone == {BIG: 60, BIG + 2: 140, BIG + 4: 140, None: 0}


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 62, 120).astype(np.uint64)
    a, wa, b, wb = np.sort(x[:100]), rng.integers(1, 5, 100), np.sort(x[30:]), rng.integers(1, 5, 90)
    exact = neardup.probability_jaccard((a, wa), (b, wb))
    shift = [np.uint64(k * 7919) for k in range(200)]
    sig = neardup.sketches([v for s in shift for v in (a + s, b + s)], [w for _ in shift for w in (wa, wb)])
    seen = np.mean([(sig[2 * k] == sig[2 * k + 1]).mean() for k in range(200)])
    assert abs(seen - exact) < 0.01


@pytest.mark.parametrize(("pairs", "rounds"), [(3, 3), (3, 1), (64, 3)])
def test_a_hot_bucket_of_unrelated_texts_loses_no_link(spark, monkeypatch, pairs, rounds):
    """Texts that share a passage fill buckets; pairs among them are still found, by new
    centres and in blocks if a bucket is large."""
    monkeypatch.setattr(neardup, "PAIRS", pairs)
    monkeypatch.setattr(neardup, "ROUNDS", rounds)
    monkeypatch.setattr(neardup, "SIGNATURES", 8)
    rng = random.Random(8)
    passage = prose(rng, 100)
    texts = [f"{prose(rng, 60)} {passage} {prose(rng, 60)}" for _ in range(60)]
    texts += [texts[k] + " end" for k in range(10)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(rows).collect()}
    assert got == {i: i if i < 60 else i - 60 for i in range(70)}


def test_members_left_in_a_bucket_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SIGNATURES", 16)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 16, (50, neardup.REGISTERS)).astype(np.uint16)
    near = base.copy()
    near[:, :60] = rng.integers(0, 1 << 16, (50, 60))
    sigs = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate([*base, *near])], "cid long, sig binary")
    members = spark.createDataFrame([(7, i, 100) for i in range(100)], "bucket long, cid long, n long")
    got = {(r["a"], r["b"]) for r in neardup.close_in_blocks(members, sigs).collect()}
    assert {(min(p), max(p)) for p in got} == {(i, i + 50) for i in range(50)}


def test_repeated_passages_count_by_their_weight(spark):
    """Probability Jaccard is the rule: a passage pasted again and again makes another text."""
    rng = random.Random(21)
    a, line = prose(rng, 300), prose(rng, 12)
    texts = [f"{a} {line}", f"{a} {line} {line}", f"{a} " + f"{line} " * 40, f"{a} " + f"{line} " * 41, prose(rng, 100)]
    sets = [shingled(t) for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(rows).collect()}
    assert similar(sets[0], sets[1]) >= 0.8 > similar(sets[0], sets[2]) and similar(sets[2], sets[3]) >= 0.8
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}


def test_components_of_stars_and_chains(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    got = {r["v"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {v for v, r in got.items() if r == got[0]} == set(range(41))
    assert {v for v, r in got.items() if r == got[100]} == set(range(100, 130))


def base_oracle(t):
    t = t or ""
    w = WORDS.findall(t)
    where = defaultdict(list)
    for k in range(len(w) - 7):
        where[tuple(w[k : k + 8])].append(k)
    hit = {x for v in where.values() if len(v) > 1 for k in v for x in range(k, k + 8)}
    seen, dup = set(), 0
    for s in t.split("\n"):
        if WORDS.search(s):
            dup += s in seen
            seen.add(s)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit)


def test_quality_base_equals_brute_force(spark, docs):
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 1), (2, None)], "doc_id long, quality int")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = {r["doc_id"]: r for r in quality.judge(docs.withColumn("kept", docs.text), labels).collect()}
    for i, t, *_ in corpus():
        base = base_oracle(t)
        failed = base[0] < 20 or 100 * base[4] > 30 * base[0]
        assert tuple(got[i][n] for n in names) == base
        assert (got[i]["base_failed"], got[i]["kept"], got[i]["text"]) == (failed, not failed, t)


def test_cutoffs_are_certified_by_exact_binomial_tests(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(1600):
        bad = i % 4 == 0
        symbols = " ".join("|" for _ in range(60)) if bad else ""
        rows.append((i, f"{prose(rng, 60)} {symbols}", "en" if i % 8 < 7 else "few"))
        labels.append((i, int(not bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.judge(docs, marks, alpha=0.02, delta=0.05).collect()
    en = [r for r in got if r["lang"] == "en"] if "lang" in got[0] else got
    kept = {r["doc_id"]: r["kept"] for r in en}
    good = [kept[i] for i in kept if i % 4]
    assert sum(good) >= 0.98 * len(good) and sum(kept[i] for i in kept if i % 4 == 0) < 0.1 * len(kept) / 4
    # A stratum with too few labels certifies nothing.
    few = quality.judge(docs.filter("lang = 'few'").limit(100), marks, alpha=0.001).collect()
    assert all(r["kept"] for r in few)


@pytest.mark.parametrize(("k", "n", "alpha"), [(0, 10, 0.02), (3, 200, 0.02), (20, 1000, 0.02), (0, 0, 0.1), (7, 7, 0.5)])
def test_binomial_p_value_is_exact(k, n, alpha):
    p = Fraction(alpha)
    exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    assert quality.binomial_p_value(k, n, alpha) == pytest.approx(float(exact), rel=1e-9)


CLASHES = ["_text", "_odd", "_f", "_stratum", "_n_lines", "_drops", "_places", "row", "k", "h", "n", "doc", "th", "block", "at", "_row", "_key", "_by", "_said", "cid", "sig", "bands", "_k", "_n"]


def test_columns_of_clashing_names_pass_through(spark):
    from pyspark.sql import functions as F

    from rankloom.llm import pieces, sharding

    rows = spark.createDataFrame(corpus()[:12] + [(2**53 + 1, "odd one", None, None, None), (None, "odd", "en", "x", None)], SCHEMA)
    clashing = rows.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    for done in (quality.judge(clashing, labels), lines.keep_bitmaps(clashing), pieces.encode(clashing), neardup.keep_first(clashing)):
        got = done.collect()
        assert len(got) >= 10 and all(r[c] == i for r in got for i, c in enumerate(CLASHES))
        assert 2**53 + 1 in {r["doc_id"] for r in got} and None in {r["doc_id"] for r in got}
    assert sharding.shard(clashing.withColumn("size", F.lit(1)), 4).count() == 14
    assert substrings.dedup(clashing).count() == 14


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.judge(none, labels).count() == 0
    assert substrings.dedup(none).count() == 0
    assert lines.keep_bitmaps(none).count() == 0
    assert neardup.near_duplicates(none).count() == 0
    assert neardup.keep_first(none).count() == 0
    ledger = secrets.BlobLedger(spark, f"{spark.sparkContext.getCheckpointDir()}/empty-ledger")
    assert ledger.scan(none).count() == 0
