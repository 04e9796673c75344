"""Mixing, encoding, chat, neighbours, sharding and the pipeline."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import ann, chat, lines, mixing, pieces, queries, sharding

from .test_texts import SCHEMA, corpus, prose


def test_shards_match_the_mixture(spark):
    rng = random.Random(1)
    rows = [(i % 700, f"t{i % 50}é" if i % 9 else None, None, rng.choice(["a"] * 5 + ["b", "c", None]), 1) for i in range(1001)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("n_chars", "size")
    got = sharding.shard(docs, 8, rows=40).collect()
    assert len(got) == 1001
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    for source in ("a", "b", "c", None):
        own = Counter(r["shard"] for r in got if r["source"] == source)
        n = sum(own.values())
        assert all(abs(own[s] - n / 8) <= 2 for s in range(8))
    assert all(r["size"] in (1, len("t0é".encode()) + 1, len("t10é".encode()) + 1) for r in got)
    again = {(r["doc_id"], r["text_crc32"], r["source"]): r["shard"] for r in sharding.shard(docs.repartition(7), 8, rows=40).collect()}
    once = Counter((r["doc_id"], r["text_crc32"], r["source"]) for r in got)
    assert all(again[k] == r["shard"] for r in got if once[k := (r["doc_id"], r["text_crc32"], r["source"])] == 1)
    assert sharding.shard(spark.createDataFrame([], SCHEMA), 8).count() == 0


def fill_oracle(budget, weights, rooms):
    """Water-filling by repeated proportional shares."""
    out = [0.0] * len(weights)
    open_ = set(range(len(weights)))
    while budget > 1e-9 and open_:
        total = sum(weights[i] for i in open_)
        full = {i for i in open_ if out[i] + budget * weights[i] / total >= rooms[i] - 1e-12}
        if not full:
            for i in open_:
                out[i] += budget * weights[i] / total
            return out
        for i in full:
            budget -= rooms[i] - out[i]
            out[i] = rooms[i]
        open_ -= full
    return out


def test_budgets_fill_siblings_before_ancestors(spark):
    leaves = [("d0", "en", "s0", 100), ("d0", "en", "s4", 10), ("d0", "de", "s8", 1000), ("d1", "en", "s1", 1000), ("d1", None, "s5", 50)]
    table = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    got = {(r["domain"], r["lang"], r["source"]): r["_budget"] for r in mixing.budgets(table, 600.0, {"domain": {"d0": 2.0}, "lang": {"de": 0.0}}, 2).collect()}
    # d0 may take 400 but has room for 220 in English only, as German weighs nothing.
    assert got[("d0", "en", "s0")] == pytest.approx(200) and got[("d0", "en", "s4")] == pytest.approx(20)
    assert ("d0", "de", "s8") not in got
    # The rest, 380, goes to d1: half each until the smaller is full.
    assert got[("d1", None, "s5")] == pytest.approx(100) and got[("d1", "en", "s1")] == pytest.approx(280)


@pytest.mark.parametrize("seed", range(6))
def test_fill_equals_repeated_shares(spark, seed):
    rng = random.Random(seed)
    kids = [(0, f"s{i}", rng.choice([1.0, 2.0, 5.0]), float(rng.randrange(0, 60)), 100.0) for i in range(7)]
    frame = spark.createDataFrame(kids, "p int, source string, w double, room double, b double")
    got = {r["source"]: r["out"] for r in mixing.fill(frame, ["p"], "b", "w", "room", "out").collect()}
    want = fill_oracle(100.0, [k[2] for k in kids], [k[3] for k in kids])
    assert [got[k[1]] for k in kids] == pytest.approx(want)


def test_mixing_tells_what_it_cannot_spend(spark):
    docs = spark.createDataFrame([(i, "a b c d", "en", "src1", 7) for i in range(10)], SCHEMA)
    rows = mixing.mix(docs, budget=200.0, max_epochs=3).collect()
    assert {(r["epochs"], r["unspent"], r["leaf_budget"]) for r in rows} == {(3, 80.0, 120.0)}


def test_mixing_takes_each_leafs_shortest_prefix(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randrange(0, 30)) if i % 11 else None, rng.choice(["en", "de", None]), rng.choice(["src1", "src2", "other", None]), 0) for i in range(600)]
    docs = spark.createDataFrame(rows + rows[:5], SCHEMA).withColumn("domain", docs_domain())
    got = mixing.mix(docs, weights={"lang": {"en": 3.0}}, budget_share=0.7, max_epochs=3, rows=16).collect()
    assert len(got) == 605
    leaves = defaultdict(list)
    for r in got:
        leaves[(r["domain"], r["lang"], r["source"])].append(r)
        assert r["epochs"] <= 3 and (r["n_tokens"] or not r["epochs"])
    total = 0
    for own in leaves.values():
        taken, budget = sum(r["n_tokens"] * r["epochs"] for r in own), own[0]["leaf_budget"]
        assert budget - 1e-6 <= taken < budget + 30
        assert max(r["epochs"] for r in own if r["n_tokens"]) - min(r["epochs"] for r in own if r["n_tokens"]) <= 1
        total += budget
    assert total == pytest.approx(0.7 * sum(r["n_tokens"] for r in got))
    assert {(r["doc_id"], r["epochs"]) for r in mixing.mix(docs.repartition(3), weights={"lang": {"en": 3.0}}, budget_share=0.7, max_epochs=3, rows=16).collect()} == {(r["doc_id"], r["epochs"]) for r in got}
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0


def docs_domain():
    from pyspark.sql import functions as F

    return F.lit("clashing")


# Encoding.

TEXTS = [None, "", " ", "  a  b ", "\n\n x\ty", "日本語 テスト 🎉🎉", "é" * 300 + " " + "ab" * 700, "the of, Hello world", "q́ � \x00 z", "x" * 5000]


@pytest.fixture(scope="module")
def table():
    return pieces.PieceTable.load()


def test_ids_equal_the_library(spark, table):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = TEXTS + [t for _, t, *_ in corpus()]
    rows = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r["doc_id"]: r for r in pieces.encode(rows, table=table).collect()}
    for i, t in enumerate(texts):
        assert got[i]["ids"] == library.encode(t or ""), t
        assert got[i]["n_pieces"] == len(got[i]["ids"]) and got[i]["round_trip"]
    back = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(rows, table=table), table=table).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    marked = spark.createDataFrame([(1, "a▁b")], "doc_id long, text string")
    assert not pieces.encode(marked, table=table).first()["round_trip"]
    assert pieces.encode(spark.createDataFrame([], "doc_id long, text string"), table=table).count() == 0


def test_a_long_word_leaves_the_others_of_its_batch_alone(table):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    common = "the house probability of unbelievable segmentation quickly mathematics disagreement"
    texts = [common, "x" * 300, "y" * pieces.LONG + " " + "z" * (pieces.LONG - 1)]
    encoder = pieces.Encoder(table)
    assert [ids.tolist() for ids, _ in encoder.encode(texts)] == [library.encode(t) for t in texts]
    # Known words are reused, so wrong ones would reach later texts.
    assert encoder.encode([common])[0][0].tolist() == library.encode(common)


def test_words_are_forgotten_and_encoded_again(table, monkeypatch):
    import sentencepiece

    monkeypatch.setattr(pieces, "CACHE_WORDS", 40)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(9)
    encoder = pieces.Encoder(table)
    for _ in range(30):
        texts = [prose(rng, 12, 60) for _ in range(3)]
        assert [ids.tolist() for ids, _ in encoder.encode(texts)] == [library.encode(t) for t in texts]
    assert len(encoder.known) + len(encoder.before) < 140


def test_words_are_the_same_whatever_signs_follow(table):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    encoder = pieces.Encoder(table)
    encoder.encode(["hendingat hendingat. hendingat, hendingat,*** (hendingat)", "hendingat!\n"])
    assert sorted(w for w in encoder.known if "hendingat" in w) == ["▁(hendingat", "▁hendingat"]
    rng = random.Random(4)
    signs = "".join(sorted(table.signs()))
    letters = "".join(rng.choice("".join(p for _, p, _ in table.normal())) for _ in range(400))
    texts = ["".join(rng.choice((signs, letters, "etaonrishdl .,;*-_'\"()", " \n\t²½a1🎉👍▁")[rng.choice((0, 1, 2, 2, 3))]) for _ in range(rng.randrange(300))) for _ in range(400)]
    # The lattice over whole texts, not cut at all.
    whole = [table.normalized(t) for t in texts]
    _, counts = pieces.Lattice(table).encode([w or "a" for w in whole])
    for t, w, n, (ids, got, back) in zip(texts, whole, counts, encoder.round_trips(texts), strict=True):
        assert "".join(encoder.split(w)) == w
        assert ids.tolist() == library.encode(t), t
        assert got == (n if w else 0) and back == (table.decode(ids.tolist()) == t) == ("▁" not in t)


def test_signs_that_a_piece_holds_after_letters_stay_with_them(table):
    more = pieces.PieceTable([*table.pieces, "e.", "s²"], [*table.scores, 1.0, 2.0], [*table.types, 1, 1], pieces.BPE)
    assert "." in table.signs() and "." not in more.signs() and "²" not in more.signs()
    encoder = pieces.Encoder(more)
    texts = ["the. houses², e.e.e. s²²", "a.,b e", "...e...", ""]
    for t, (ids, n, back) in zip(texts, encoder.round_trips(texts), strict=True):
        assert ids.tolist() == (encoder.lattice.merge_long(more.normalized(t)) if t else [])
        assert n == (encoder.lattice.encode([more.normalized(t)])[1][0] if t else 0) and back
    assert len(table.pieces) in encoder.encode(["the."])[0][0].tolist()


def test_texts_that_do_not_come_back_are_told(table):
    # No bytes to fall back to: an unknown character is decoded to another text.
    bare = pieces.PieceTable(table.pieces, table.scores, [1 if t == 6 else t for t in table.types], pieces.BPE)
    encoder = pieces.Encoder(bare)
    texts = ["the house", "the 🦩 house", "🦩", "a▁b", "", "house 🦩🦩."]
    for _ in range(2):
        got = encoder.round_trips(texts)
        assert [back for *_, back in got] == [True, False, False, False, True, False]
        assert [back for *_, back in got] == [bare.decode(ids.tolist()) == t for t, (ids, _, _) in zip(texts, got, strict=True)]


def test_merges_take_the_first_of_equal_pairs(table):
    rng = random.Random(8)
    parts = ["ab", "ba", "aa", "bb", "aab", "abb", "baa", "abab", "bab", "aaaa"]
    chars = ["a", "b", "▁"]
    own = pieces.PieceTable([*chars, *parts], [float(rng.randrange(3)) for _ in [*chars, *parts]], [1] * (len(chars) + len(parts)), pieces.BPE)
    lattice = pieces.Lattice(own)
    words = ["".join(rng.choice("aabc") for _ in range(rng.randrange(1, 40))) for _ in range(800)]
    ids, counts = lattice.encode(words)
    assert [np.frombuffer(x, np.int32).tolist() for x in ids] == [lattice.merge_long(w) for w in words]
    scores = {p: s for _, p, s in own.normal()}
    assert counts == [len(best_path(w, scores, own.unknown_score(), own.max_chars)[1]) for w in words]


def best_path(word, scores, unknown, longest):
    best = [(0.0, [])] + [None] * len(word)
    for end in range(1, len(word) + 1):
        for a in range(max(0, end - longest), end):
            s = scores.get(word[a:end], unknown if end - a == 1 else None)
            if s is not None and best[a] is not None and (best[end] is None or best[a][0] + s > best[end][0]):
                best[end] = (best[a][0] + s, best[a][1] + [word[a:end]])
    return best[-1]


def test_viterbi_equals_brute_force_in_both_engines(spark, table):
    rng = random.Random(0)
    unigram = pieces.PieceTable(table.pieces, [s if s > -1e8 else 0.0 for s in table.scores], table.types, pieces.UNIGRAM)
    words = ["▁" + "".join(rng.choice("etaonrishdlé日") for _ in range(rng.randrange(1, 12))) for _ in range(300)] + ["the", "▁the", "▁▁", "é"]
    scores = {p: s for _, p, s in unigram.normal()}
    ids = {p: i for i, p, _ in unigram.normal()}
    want = {w: best_path(w, scores, unigram.unknown_score(), unigram.max_chars) for w in set(words)}
    coded, counts = pieces.Lattice(unigram).encode(words)
    for w, blob, n in zip(words, coded, counts, strict=True):
        path = want[w][1]
        assert np.frombuffer(blob, np.int32).tolist() == [x for p in path for x in ([ids[p]] if p in ids else unigram.fallback(p))]
        assert n == len(path)
    frame = spark.createDataFrame([(w,) for w in [*words, None, ""]], "word string")
    folded = pieces.word_edges(frame, unigram).withColumn("best", pieces.viterbi_fold(F.col("edges")))
    got = {r["word"]: (r["best"]["ids"], r["best"]["score"], r["best"]["n"]) for r in folded.collect()}
    assert got == {w: ([x for q in p for x in ([ids[q]] if q in ids else unigram.fallback(q))], s, len(p)) for w, (s, p) in want.items()}


@pytest.mark.parametrize("partitions", [1, 7])
def test_relational_lattice_equals_the_library(spark, table, partitions):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    common = "the house probability of unbelievable segmentation quickly mathematics disagreement"
    texts = [*TEXTS, common, "x" * 300, common, "y" * 300 + " z"] + [t for _, t, *_ in corpus()]
    rows = spark.createDataFrame([(2**53 + 1 + i if i % 5 else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, block int").repartition(partitions)
    got = {r["block"]: r for r in pieces.encode_relational(rows, table=table).collect()}
    plain = {r["block"]: r for r in pieces.encode(rows, table=table).collect()}
    assert got == plain
    for i, t in enumerate(texts):
        assert got[i]["ids"] == library.encode(t or ""), t
        assert got[i]["doc_id"] == (2**53 + 1 + i if i % 5 else None)
    assert pieces.encode_relational(rows.limit(0), table=table).count() == 0


# Chat.


def test_chat_round_trip_and_expansion(spark):
    rng = random.Random(6)
    nasty = [r"\### Assistant: </turn> ok", "a####b", "<</turn>\n", "\\", "\\\\/", "", None, "### user: x</turn>\n### assistant: y", "é\n" * 3, "x" * 20_000]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "ro:le", None]), rng.choice(nasty)) for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(99, 0, "user", "same"), (99, 0, "user", "same"), (None, 1, "assistant", "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_turns(turns.withColumn("position", turns.text))
    written = chat.write_examples(formatted)
    back = {r["conv_id"]: r for r in chat.read_back(written).collect()}
    want = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] or 0, r[1], r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    assert {c: [(t["role"], t["text"]) for t in r["turns"]] for c, r in back.items()} == want
    assert {c: r["loss_text"] for c, r in back.items()} == {c: "".join(t for r, t in own if r == "assistant") for c, own in want.items()}
    examples = chat.render(written).collect()
    assert Counter(e["conv_id"] for e in examples) == {c: n for c, own in want.items() if (n := sum(r == "assistant" for r, _ in own))}
    full = Counter()
    for e in examples:
        text, target = e["text"], e["text"][e["loss_start"] : e["loss_start"] + e["loss_chars"]]
        full[e["conv_id"]] += len(text)
        place = text.count(chat.END) - 1
        replies = [i for i, (r, _) in enumerate(want[e["conv_id"]]) if r == "assistant"]
        assert place == replies[e["example"]] and text.endswith(target + chat.END)
        assert re.sub(r"(?s)\\(.)", r"\1", target) == want[e["conv_id"]][place][1]
    assert {c: r["formatted_chars"] for c, r in back.items()} == {c: full[c] for c in want}
    # Bodies hold every segment once, however many examples share it.
    assert sum(len(r["body"]) for r in written.collect()) == sum(r["seg_start"] + len(r["segment"]) - r["seg_start"] for r in formatted.collect())
    assert chat.read_back(chat.write_examples(chat.format_turns(turns.limit(0)))).count() == 0
    assert chat.format_turns(turns.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    key = "doc_id" if "doc_id" in columns else "conv_id"

    def plain(frame):
        return [[None if str(x) in ("<NA>", "nan", "None") else x for x in r] for r in frame[columns].sort_values(key).to_numpy().tolist()]

    assert plain(got) == plain(want)


# Neighbours.


def exact_nearest(ids, v, k):
    u = v / np.linalg.norm(v, axis=1)[:, None]
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        score = (v * v[i]).sum(axis=1) / (np.linalg.norm(v, axis=1) * np.linalg.norm(v[i]))
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
        out[ids[i]] = [(ids[j], score[j]) for j in order]
    del u
    return out


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 200)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 150)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    v = (centres[rng.integers(0, 30, 4000)] + 0.4 * rng.normal(size=(4000, 16))).astype(np.float32)
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    got = defaultdict(list)
    for r in ann.ann(spark.createDataFrame(rows, "vec_id long, embedding array<float>, v int"), sample=1500).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = exact_nearest(np.arange(4000), v.astype(float), 5)
    assert set(got) == set(want) and all(len(x) == 5 for x in got.values())
    hits = [len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 5 for q in want]
    assert np.mean(hits) >= 0.9
    for q, found in got.items():
        for a, s in found:
            assert s == pytest.approx(float(v[q].astype(float) @ v[a].astype(float) / np.linalg.norm(v[q].astype(float)) / np.linalg.norm(v[a].astype(float))), abs=1e-12)


def test_neighbours_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.5, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, [0.0, 1.0]), (8, [0.0, 1.0]), (50, None), (100, [1.0, 1.0]), (None, [1.0, 1.0]), (9, [1.0, 2.0, 3.0]), (10, [])]
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in ann.ann(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()]
    half = round(math.sqrt(0.5), 6)
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 100, half), (0, 4, 8, 0.0), (100, 1, 0, half), (100, 2, 1, half), (100, 3, 2, half), (100, 4, 8, half)]
    assert ann.ann(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_parts_are_balanced():
    rng = np.random.default_rng(0)
    unit = ann._unit(rng.normal(size=(1000, 8)))
    part = ann.balanced_parts(ann.neighbours(unit, 8), 16, rng)
    assert np.bincount(part, minlength=16).min() >= 1000 // 16 - 1


# The pipeline.


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][:1] == ["quality rules"] and len(corpus_pipeline.STAGES) == 5
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == corpus_pipeline.COLUMNS, name
        assert 0 < docs.count() <= before
        before = docs.count()
    want = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == set(want) and all(r["round_trip"] for r in got.values())
    table = pieces.PieceTable.load()
    assert all(table.decode(got[i]["ids"]) == (t or "") for i, t in want.items())


def test_pipeline_stages_take_empty_and_odd_tables(spark, sf_dir):
    import corpus_pipeline

    odd = spark.createDataFrame([(1, None, None, None, None), (1, "x", "en", "src1", 1), (None, prose(random.Random(1), 40), "en", None, 9)], SCHEMA)
    for docs in (spark.createDataFrame([], SCHEMA), odd):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, sf_dir).count() <= docs.count()
    assert lines.MIN_CHARS == 20 and hashlib.sha256(b"").hexdigest() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
