"""SentencePiece encoding and decoding over a lattice of pieces (operator 4)."""

from __future__ import annotations

import heapq
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches, text_or_empty

#: The model file, unless a path is given.
MODEL = os.environ.get("RANKLOOM_PIECES", "/opt/tokenizers/piece_bpe_32k.model")

MARK = "▁"
UNIGRAM, BPE = 1, 2
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
#: What an unknown character costs below the least score.
_PENALTY = 10.0
#: Words whose encodings a worker keeps, half of them new or used since the last turn.
CACHE_WORDS = 240_000
#: Cells (words x characters) of a lattice worked on at once.
CELLS = 150_000
#: Longer words are merged with a heap, one by one.
LONG = 256


def _fields(blob: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = blob[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(blob):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, blob[at : at + n]
            at += n


@dataclass
class PieceTable:
    """The pieces of a model file; at most some hundred thousand, so it goes to all tasks."""

    pieces: list[str]
    scores: list[float]
    types: list[int]
    algorithm: int
    dummy_prefix: bool = True
    squeeze: bool = False
    max_chars: int = field(init=False)
    byte_ids: list[int] = field(init=False)
    unk: int = field(init=False)

    def __post_init__(self) -> None:
        self.max_chars = max((len(p) for p, t in zip(self.pieces, self.types, strict=True) if t == _NORMAL), default=1)
        by_name = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == _BYTE}
        self.byte_ids = [by_name[f"<0x{b:02X}>"] for b in range(256)] if len(by_name) == 256 else []
        self.unk = self.types.index(_UNKNOWN) if _UNKNOWN in self.types else 0
        inner = [p for p, t in zip(self.pieces, self.types, strict=True) if t == _NORMAL and MARK in p.lstrip(MARK)]
        if inner:
            raise NotImplementedError(f"pieces that reach over a space, such as {inner[0]!r}")

    @classmethod
    def load(cls, path: str = MODEL) -> PieceTable:
        with open(path, "rb") as f:
            blob = f.read()
        pieces, scores, types, algorithm, options = [], [], [], UNIGRAM, {}
        for number, value in _fields(blob):
            if number == 1:
                own = dict(_fields(value))
                pieces.append(own.get(1, b"").decode())
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                types.append(own.get(3, _NORMAL))
            elif number == 2:
                algorithm = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                options = dict(_fields(value))
        if options.get(2):
            raise NotImplementedError("a model with a character map")
        return cls(pieces, scores, types, algorithm, bool(options.get(3, 1)), bool(options.get(4, 1)))

    def normal(self) -> list[tuple[int, str, float]]:
        return [(i, p, s) for i, (p, s, t) in enumerate(zip(self.pieces, self.scores, self.types, strict=True)) if t == _NORMAL]

    def unknown_score(self) -> float:
        return min((s for _, _, s in self.normal()), default=0.0) - _PENALTY

    def normalized(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)

    def word_pattern(self) -> str:
        """Words that no piece reaches over: a run of marks and signs with what follows; line
        feeds stand alone if no piece holds one beside other characters. So a word is the
        same whatever signs come after it."""
        apart = "" if any("\n" in p and len(p) > 1 for _, p, _ in self.normal()) else "\n"
        signs = "".join(map(re.escape, sorted(self.signs() - {apart})))
        first = f"{MARK}*+[{signs}]*+" if signs else f"{MARK}*+"
        words = [f"{first}[^{MARK}{apart}{signs}]++", *([f"{MARK}*+[{signs}]++"] if signs else []), f"{MARK}++"]
        return "|".join([*([apart] if apart else []), *words])

    def signs(self) -> set[str]:
        """Characters, neither letters nor decimal digits, that stand in pieces only at their
        start or after marks and others of this set: before a run of them a text can be cut.
        Those beyond U+FFFF are left out, as they make a pattern's sets slow."""
        before: dict[str, set[str]] = {}
        for _, p, _ in self.normal():
            for i, c in enumerate(p):
                if not c.isalpha() and not c.isdecimal() and c != MARK and c <= "\uffff":
                    before.setdefault(c, set()).update(p[i - 1 : i] if i else "")
        out = set(before)
        while wrong := {c for c in out if not before[c] <= out | {MARK}}:
            out -= wrong
        return out

    def fallback(self, char: str) -> list[int]:
        """The ids of a character that is no piece."""
        return [self.byte_ids[b] for b in char.encode("utf-8", "replace")] if self.byte_ids else [self.unk]

    def decoder(self) -> list[bytes]:
        out = [p.encode() for p in self.pieces]
        for b, i in enumerate(self.byte_ids):
            out[i] = bytes([b])
        for i, t in enumerate(self.types):
            if t == _CONTROL:
                out[i] = b""
            elif t == _UNKNOWN:
                out[i] = " ⁇ ".encode()
        return out

    def decode(self, ids: list[int], table: list[bytes] | None = None) -> str:
        return self.spaced(b"".join(map((table or self.decoder()).__getitem__, ids)).decode("utf-8", "replace"))

    def spaced(self, text: str) -> str:
        """``text`` with spaces for marks, less the prefix."""
        text = text.replace(MARK, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


_U = np.uint64
_SEED, _MUL = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)


class Lattice:
    """The vectorised relational lattice: substrings of many words at once (explode),
    looked up in a hash table of the pieces (equi-join), as edges by word and place (group),
    folded over the places (Viterbi), or merged pair by pair as the model's BPE does."""

    def __init__(self, table: PieceTable):
        self.table = table
        normal = [(i, p) for i, p, _ in table.normal() if p]
        lengths = np.array([len(p) for _, p in normal], np.int64)
        codes = np.frombuffer("".join(p for _, p in normal).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        live, at, h = np.array([i for i, _ in normal], np.int64), np.cumsum(lengths) - lengths, np.full(len(normal), _SEED)
        known: dict[int, int] = {}
        n = 0
        while len(live):
            h = self._step(h, codes[at + n])
            n += 1
            ends = lengths == n
            known.update(zip(h[ends].tolist(), live[ends].tolist(), strict=True))
            for x in h[~ends].tolist():
                known.setdefault(x, -1)
            live, at, h, lengths = live[~ends], at[~ends], h[~ends], lengths[~ends]
        self.bits = max(10, int(np.ceil(np.log2(len(known) * 8))))
        size = 1 << self.bits
        self.keys, self.ids = np.zeros(size + 64, np.uint64), np.full(size + 64, -2, np.int32)
        self.reach = 1
        for h, i in known.items():
            at = h >> (64 - self.bits)
            n = 0
            while self.ids[at + n] != -2:
                n += 1
            self.keys[at + n], self.ids[at + n] = h, i
            self.reach = max(self.reach, n + 1)
        self.scores = np.array([*table.scores, table.unknown_score()], np.float64)
        self.unknown = len(table.scores)
        #: By piece, its score's place among all, from 1; 0 for the unknown one and for none (-1).
        self.ranks = np.append(np.unique(self.scores[:-1], return_inverse=True)[1] + 1, [0, 0]).astype(np.int32)

    @staticmethod
    def _step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (h ^ c) * _MUL
            return x ^ (x >> _U(31))

    def _join(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of each hash; -1: a proper prefix of one, -2: neither."""
        at = (hashes >> _U(64 - self.bits)).astype(np.int64)
        out = np.where(self.keys[at] == hashes, self.ids[at], -2)
        for n in range(1, self.reach):
            miss = np.flatnonzero(out == -2)
            if not len(miss):
                break
            where = at[miss] + n
            out[miss] = np.where(self.keys[where] == hashes[miss], self.ids[where], -2)
        return out

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """edges[n - 1, p, w]: the piece that is the n characters of word w from p, or -1;
        and the words' lengths. A character that is no piece is an edge of its own."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        width = int(lengths.max())
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        row = np.repeat(np.arange(len(words)), lengths)
        col = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        left = lengths[row] - col
        out = np.full((min(self.table.max_chars, width), width, len(words)), -1, np.int32)
        at, h = np.arange(len(codes)), np.full(len(codes), _SEED)
        for n in range(out.shape[0]):
            h = self._step(h, codes[at + n])
            found = self._join(h)
            hit = found >= 0
            out[n, col[at[hit]], row[at[hit]]] = found[hit]
            if n == 0:
                out[0, col[at[~hit]], row[at[~hit]]] = self.unknown
            live = (found != -2) & (left[at] > n + 1)
            at, h = at[live], h[live]
            if not len(at):
                break
        return out, lengths

    def viterbi(self, edges: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lengths of the best path's last piece up to each place, scores of whole words).

        Of equal paths the one whose last piece starts first is taken.
        """
        spans, width, words = edges.shape
        best = np.full((width + 1, words), -np.inf)
        back = np.zeros((width + 1, words), np.int32)
        best[0] = 0
        for end in range(1, width + 1):
            for n in range(min(spans, end), 0, -1):
                has = np.flatnonzero(edges[n - 1, end - n] >= 0)
                if not len(has):
                    continue
                score = best[end - n, has] + self.scores[edges[n - 1, end - n, has]]
                better = score > best[end, has]
                best[end, has[better]] = score[better]
                back[end, has[better]] = n
        return back.T, best[lengths, np.arange(words)]

    def merges(self, edges: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """ends[w, p]: whether a piece of word w ends at p, by repeated merging of the
        adjacent pair whose union scores best, the first of equals."""
        spans, width, words = edges.shape
        size = width + 2
        ends = (np.arange(width + 1) > 0) & (np.arange(width + 1) <= lengths[:, None])
        # By word and place: the end of the part that starts there, the start of the one that
        # ends there. Before a word stands -1, which is its last place, where no pair starts.
        after = np.tile(np.arange(1, size + 1), words)
        before = np.tile(np.arange(-1, size - 1), words)
        flat = edges.reshape(-1)

        def union(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
            n = end - start
            fits = (n <= spans) & (start >= 0)
            return np.where(fits, self.ranks[flat[np.where(fits, ((n - 1) * width + start) * words + row, 0)]], 0)

        # By live word and place: the rank of the union of the part there with the next one.
        rank = np.zeros((words, size), np.int32)
        if spans > 1:
            rank[:, :width] = self.ranks[edges[1]].T
        live = np.arange(words)
        while len(live):
            a = rank.argmax(axis=1)
            go = rank[np.arange(len(live)), a] > 0
            if not go.all():
                live, rank, a = live[go], rank[go], a[go]
            own, at = np.arange(len(live)), live * size
            b = after[at + a]
            c = after[at + b]
            ends[live, b] = False
            after[at + a], before[at + c] = c, a
            rank[own, b] = 0
            rank[own, a] = union(live, a, after[at + c])
            z = before[at + a]
            rank[own, z] = union(live, z, c)
        return ends

    def merge_long(self, word: str) -> list[int]:
        """The same for one long word, with a heap: n log n steps."""
        pieces = {p: (i, s) for i, p, s in self.table.normal()} if not hasattr(self, "_pieces") else self._pieces
        self._pieces = pieces
        n = len(word)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int, int]] = []

        def push(a: int) -> None:
            b = after[a]
            if b < n and (found := pieces.get(word[a : end[b]])) is not None:
                heapq.heappush(heap, (-found[1], a, b, end[b]))

        for a in range(n - 1):
            push(a)
        alive = [True] * n
        while heap:
            _, a, b, e = heapq.heappop(heap)
            if not alive[a] or b >= n or not alive[b] or after[a] != b or end[b] != e:
                continue
            alive[b] = False
            end[a], after[a] = e, after[b]
            if after[a] < n:
                before[after[a]] = a
            push(a)
            if before[a] >= 0:
                push(before[a])
        out, a = [], 0
        while a < n:
            found = pieces.get(word[a : end[a]])
            out += [found[0]] if found else self.table.fallback(word[a])
            a = end[a]
        return out

    def encode(self, words: list[str]) -> tuple[list[bytes], list[int]]:
        """For each word: its ids (int32) by the model's own algorithm, and the number of
        pieces on the Viterbi path."""
        ids: list[bytes] = [b""] * len(words)
        counts = [0] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        lengths = lengths[order]
        a = 0
        while a < len(order):
            # Longer words than LONG have chunks of their own: they are merged otherwise.
            fits = (np.arange(1, len(order) - a + 1) * lengths[a:] <= CELLS) & ((lengths[a:] > LONG) == (lengths[a] > LONG))
            b = a + max(1, len(fits) if fits.all() else int(fits.argmin()))
            self._chunk(order[a:b].tolist(), words, ids, counts)
            a = b
        return ids, counts

    def _chunk(self, which: list[int], words: list[str], ids: list[bytes], counts: list[int]) -> None:
        some = [words[i] for i in which]
        edges, lengths = self.edges(some)
        back, _ = self.viterbi(edges, lengths)
        rows = np.arange(len(some))
        path = np.zeros(back.shape, np.bool_)
        at, live = lengths.copy(), rows
        number = np.zeros(len(some), np.int64)
        while len(live):
            path[live, at[live]] = True
            number[live] += 1
            at[live] -= back[live, at[live]]
            live = live[at[live] > 0]
        long = self.table.algorithm == BPE and len(some[-1]) > LONG
        ends = path if self.table.algorithm == UNIGRAM or long else self.merges(edges, lengths)
        row, end = np.nonzero(ends)
        first = np.concatenate([[True], row[1:] != row[:-1]])
        start = np.where(first, 0, np.concatenate([[0], end[:-1]]))
        piece = edges[end - start - 1, start, row]
        bounds = np.searchsorted(row, np.arange(len(some) + 1))
        blob = piece.astype(np.int32).tobytes()
        places = (4 * bounds).tolist()
        for k, (i, n, p, q) in enumerate(zip(which, number.tolist(), places, places[1:], strict=False)):
            counts[i] = n
            ids[i] = np.array(self.merge_long(some[k]), np.int32).tobytes() if long else blob[p:q]
        if long:
            return
        for k in np.unique(row[piece == self.unknown]).tolist():
            out: list[int] = []
            for j in range(bounds[k], bounds[k + 1]):
                out += self.table.fallback(some[k][start[j]]) if piece[j] == self.unknown else [int(piece[j])]
            ids[which[k]] = np.array(out, np.int32).tobytes()


class Encoder:
    """Encodes whole texts; distinct words pass through the lattice once a batch."""

    def __init__(self, table: PieceTable):
        self.table, self.lattice = table, Lattice(table)
        self.split = re.compile(table.word_pattern()).findall
        self.decoder = table.decoder()
        self.sizes = np.array([len(x) for x in self.decoder], np.int64)
        #: By word: its head, which is minus twice the pieces on its Viterbi path, less one if
        #: its ids do not decode to it, then its ids. Words that were not used while ``known``
        #: filled up are forgotten at its next turn.
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, int]]:
        """(ids, pieces on the Viterbi paths) of each text."""
        return [(ids, n) for ids, n, _ in self.round_trips(texts)]

    def round_trips(self, texts: list[str]) -> list[tuple[np.ndarray, int, bool]]:
        """(ids, pieces on the Viterbi paths, whether decoding the ids gives it back) of each text.

        A text's ids decode to what its words' ids decode to, one after another, so each new
        word is decoded once; a text with a word that does not come back is decoded itself.
        """
        words = [self.split(self.table.normalized(t)) for t in texts]
        if len(self.known) > CACHE_WORDS // 2:
            self.before, self.known = self.known, {}
        new = []
        for w in set().union(*words).difference(self.known):
            if (found := self.before.get(w)) is None:
                new.append(w)
            else:
                self.known[w] = found
        if new:
            ids, counts = self.lattice.encode(new)
            heads = (-2 * np.array(counts, np.int32) - self._lost(new, ids)).astype(np.int32).tobytes()
            self.known.update((w, heads[4 * i : 4 * i + 4] + x) for i, (w, x) in enumerate(zip(new, ids, strict=True)))
        out = []
        for t, ws in zip(texts, words, strict=True):
            found = np.frombuffer(b"".join(map(self.known.__getitem__, ws)), np.int32)
            is_head = found < 0
            own, heads = found[~is_head], -found[is_head]
            back = self.table.decode(own.tolist(), self.decoder) if (heads & 1).any() else self.table.spaced("".join(ws))
            out.append((own, int((heads >> 1).sum()), back == t))
        return out

    def _lost(self, words: list[str], ids: list[bytes]) -> np.ndarray:
        """Whether each word's ids decode to something else than the word."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        flat = np.frombuffer(b"".join(ids), np.int32)
        ends = np.cumsum([len(x) // 4 for x in ids])
        places = np.concatenate([[0], np.cumsum(self.sizes[flat])])[np.concatenate([[0], ends])]
        decoded = b"".join(map(self.decoder.__getitem__, flat.tolist()))
        if np.array_equal(places[1:], np.cumsum([len(x) for x in raw])) and decoded == b"".join(raw):
            return np.zeros(len(words), np.bool_)
        places = places.tolist()
        return np.array([decoded[a:b] != x for a, b, x in zip(places, places[1:], raw, strict=False)], np.bool_)


_encoders: dict[str, Encoder] = {}


def _encoder(name: str, table: PieceTable) -> Encoder:
    """One encoder a worker and model, so its words stay known between batches."""
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = Encoder(table)
    return _encoders[name]


_OUT = "n_pieces long, n_viterbi long, ids array<int>, round_trip boolean"


def encode(docs: DataFrame, *, text: str = "text", table: PieceTable | None = None, texts_at_once: int = 64) -> DataFrame:
    """Adds ``n_pieces``, ``ids``, ``n_viterbi`` and ``round_trip`` to ``docs`` less its text.

    ``ids`` are those that the model's own algorithm gives: the Viterbi path over the
    lattice for unigram models, merging over the same lattice for BPE models, for which
    the Viterbi path is another segmentation; ``n_viterbi`` counts that path's pieces.
    ``round_trip``: decoding the ids gives the text back. That fails only for texts that
    hold U+2581 themselves, which the format cannot tell from spaces.

    Whole texts of any length; null or empty: no ids, and the round trip is "". Rows are
    independent, so repeats and ties do not matter. Other columns pass through; columns
    named like the results give way. No rows: no rows. Nothing is shuffled.
    """
    table = table or PieceTable.load()
    small_batches(docs.sparkSession)
    name = f"{len(table.pieces)}-{hash((tuple(table.pieces), table.algorithm))}"
    names = [x.split()[0] for x in _OUT.split(", ")]
    keep = [c for c in docs.columns if c not in (*names, text)]
    # The other columns stay in Spark: in pandas a null would turn whole numbers into doubles.
    rows = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(c) for c in keep]).alias("row"), text_or_empty(docs, text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, table)
        for batch in batches:
            for a in range(0, batch.num_rows, texts_at_once):
                part = batch.slice(a, texts_at_once)
                ids, counts, trips = zip(*encoder.round_trips(part.column("text").to_pylist()), strict=True)
                kept = [part.column("row").field(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, *_columns(ids, counts, trips)], names=[*keep, *names])

    shape = docs.select(*keep).schema
    for field in docs.sparkSession.createDataFrame([], _OUT).schema:
        shape = shape.add(field)
    return rows.mapInArrow(run, shape)


def _columns(ids: list[np.ndarray], counts: list[int], trips: list[bool]) -> list[pa.Array]:
    """The result's columns in Arrow."""
    sizes = [len(x) for x in ids]
    flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]).astype(np.int32)), pa.array(flat))
    return [pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), lists, pa.array(trips, pa.bool_())]


def decode(encoded: DataFrame, *, ids: str = "ids", out: str = "text", table: PieceTable | None = None) -> DataFrame:
    """Adds the text of ``ids`` (null: null) as column ``out``."""
    table = table or PieceTable.load()
    decoder = table.decoder()

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else table.decode(list(x), decoder))

    return encoded.withColumn(out, run(F.col(ids)))


def piece_frame(spark: SparkSession, table: PieceTable) -> DataFrame:
    """(piece, id, score): the piece table as a relation."""
    return spark.createDataFrame([(p, i, float(s)) for i, p, s in table.normal()], "piece string, id int, score double")


def word_edges(words: DataFrame, table: PieceTable) -> DataFrame:
    """(word) -> (word, edges): the lattice of each distinct word.

    Substrings of up to the longest piece's length are exploded, equi-joined to the piece
    table (broadcast: its size is the model's) and grouped by word. An edge is (end, less:
    minus its length, ids, score), in order of ends, longer ones first; a character that
    is no piece is an edge of its fallback ids.
    """
    pieces = F.broadcast(piece_frame(words.sparkSession, table))
    words = words.select("word").filter("word IS NOT NULL AND word <> ''")
    # Few words a task, so that their edges are grouped in memory.
    parts = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-words.count() // WORDS_A_TASK))
    words = words.repartition(parts, "word").distinct()
    starts = words.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("a"))
    spans = starts.select("word", "a", F.explode(F.sequence(F.lit(1), F.least(F.lit(table.max_chars), F.length("word") - F.col("a") + 1))).alias("n"))
    spans = spans.withColumn("piece", F.expr("substring(word, a, n)")).join(pieces, "piece", "left").filter("id IS NOT NULL OR n = 1")
    if table.byte_ids:
        code = F.hex(F.encode("piece", "utf-8"))
        byte = lambda i: F.conv(F.substr(code, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
        odd = F.transform(F.sequence(F.lit(0), F.octet_length("piece") - 1), lambda i: F.element_at(F.array(*map(F.lit, table.byte_ids)), byte(i) + 1))
    else:
        odd = F.array(F.lit(table.unk))
    ids = F.when(F.col("id").isNotNull(), F.array("id")).otherwise(odd)
    edge = F.struct((F.col("a") + F.col("n") - 1).alias("end"), (-F.col("n")).alias("less"), ids.alias("ids"), F.coalesce("score", F.lit(table.unknown_score())).alias("score"), F.col("id").isNotNull().alias("known"))
    return spans.groupBy("word").agg(F.array_sort(F.collect_list(edge)).alias("edges"))


def viterbi_fold(edges: Column) -> Column:
    """The best path of a word, struct<score, n, ids>, folded over its edges; of equal
    paths the one whose last piece starts first. ``n`` counts pieces."""
    node = "struct<score:double,n:int,ids:array<int>>"

    def step(nodes: Column, e: Column) -> Column:
        # nodes[k]: the best path over the first k characters; the last may be in the making.
        from_ = F.get(nodes, e["end"] + e["less"])
        score = from_["score"] + e["score"]
        new = F.array(F.struct(score.alias("score"), (from_["n"] + 1).alias("n"), F.concat(from_["ids"], e["ids"]).alias("ids")).cast(node))
        last = F.size(nodes) <= e["end"]
        return F.when(last, F.concat(nodes, new)).when(score > F.get(nodes, e["end"])["score"], F.concat(F.slice(nodes, F.lit(1), e["end"]), new)).otherwise(nodes)

    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("ids")).cast(node))
    return F.aggregate(edges, start, step, lambda nodes: F.element_at(nodes, -1))


def merged(lattice: DataFrame) -> DataFrame:
    """(word, n, edges) -> adds ``ids`` by a BPE model: of all adjacent parts whose union
    is a piece, the pair whose union scores best (the first of equals) is merged, until
    none is. The fold takes as many steps as a word may have merges; its state are the
    parts' bounds. Columns that a lambda reads are made in steps of their own, as Spark
    would evaluate them again for each element.
    """
    place = lambda a, c: 64 * a + (c - a)
    entry = lambda e: F.struct((64 * (e["end"] + e["less"]) - e["less"]).alias("k"), F.struct(e["score"].alias("score"), e["ids"].alias("ids"), e["known"].alias("known")).alias("v"))
    lattice = lattice.withColumn("_found", F.map_from_entries(F.transform("edges", entry)))
    found = F.col("_found")

    def step(bounds: Column, _: Column) -> Column:
        def pair(i: Column) -> Column:
            union = found[place(F.get(bounds, i), F.get(bounds, i + 2))]
            return F.struct((-union["score"]).alias("cost"), i.alias("i"))

        tried = F.filter(F.transform(F.sequence(F.lit(0), F.size(bounds) - 3), pair), lambda x: x["cost"].isNotNull())
        best = F.when(F.size(bounds) > 2, F.array_min(tried)["i"])
        # A fold over one element gives ``best`` a name.
        return F.aggregate(F.array(best), bounds, lambda b, k: F.when(k.isNull(), b).otherwise(F.filter(b, lambda x, i: i != k + 1)))

    bounds = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("n") - 1, F.lit(1))), F.sequence(F.lit(0), F.col("n")), step)
    lattice = lattice.withColumn("_bounds", bounds)
    parts = F.transform(F.slice("_bounds", 1, F.size("_bounds") - 1), lambda a, i: found[place(a, F.get("_bounds", i + 1))]["ids"])
    return lattice.withColumn("ids", F.flatten(parts)).drop("_found", "_bounds")


#: Words, with repeats in other blocks, whose lattices are made in one task, about.
WORDS_A_TASK = 50_000
#: Words of blocks that a task holds back to tell repeats.
HELD_WORDS = 600_000
#: Longer words are not folded, which takes time by their square, but encoded with a heap.
FOLD = 32
#: Code points of the texts that share a dictionary, at most, but for one longer text; texts
#: of up to SHORT are dealt alike, longer ones by their length's power of two.
BLOCK_CHARS, SHORT = 1 << 25, 13


class Cutter:
    """Cuts texts where no piece reaches over: between characters that are neighbours in no
    piece. No edge and no merge crosses such a place."""

    def __init__(self, table: PieceTable):
        self.table = table
        pairs = np.array(sorted({(ord(p[i]) << 21) | ord(p[i + 1]) for _, p, _ in table.normal() for i in range(len(p) - 1)}), np.uint64)
        self.bits = 18
        while len(np.unique(self._at(pairs))) < len(pairs) and self.bits < 26:
            self.bits += 1
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.keys[self._at(pairs)] = pairs
        self.more = np.setdiff1d(pairs, self.keys)

    def _at(self, pairs: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (pairs * _MUL) >> _U(64 - self.bits)

    def __call__(self, text: str) -> list[str]:
        text = self.table.normalized(text)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        if not len(codes):
            return []
        pairs = (codes[:-1] << _U(21)) | codes[1:]
        joined = self.keys[self._at(pairs)] == pairs
        if len(self.more):
            joined |= np.isin(pairs, self.more)
        ends = np.flatnonzero(~joined) + 1
        return [text[a:b] for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(text)], strict=True)]


def encode_relational(docs: DataFrame, *, text: str = "text", table: PieceTable | None = None) -> DataFrame:
    """The results of :func:`encode` by the relational lattice.

    Texts are dealt to blocks as they lie in the input (BLOCK_CHARS each). The distinct
    words of each block are collected in one pass; all distinct words together get their
    lattices (:func:`word_edges`), which are folded by Viterbi (:func:`viterbi_fold`) and,
    for a BPE model, by its merges (:func:`merged`); their ids are joined back to the
    blocks, and each block's dictionary meets its texts. Columns, nulls and empties as in
    :func:`encode`. Words of more than FOLD characters are encoded with a heap where
    their text is. A block that a lost executor deals anew finds its new words so too.
    """
    table = table or PieceTable.load()
    names = [x.split()[0] for x in _OUT.split(", ")]
    keep = [c for c in docs.columns if c not in (*names, text)]
    base = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(c) for c in keep]).alias("row"), text_or_empty(docs, text).alias("text"), F.monotonically_increasing_id().alias("at"))
    size = F.greatest(F.lit(SHORT), F.ceil(F.log2(F.length("text") + 1)).cast("int"))
    rows = F.greatest(F.lit(1), (F.lit(BLOCK_CHARS) / F.pow(F.lit(2.0), size)).cast("long"))
    block = F.xxhash64(F.shiftright("at", 33), size, F.floor(F.col("at").bitwiseAND((1 << 33) - 1) / rows))
    base = base.select(block.alias("block"), "row", "text")

    def words_of_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cutter, held, size = Cutter(table), {}, 0

        def out() -> Iterator[pd.DataFrame]:
            for b, ws in held.items():
                if ws:
                    yield pd.DataFrame({"block": b, "word": sorted(ws)})

        for batch in batches:
            for b, t in zip(batch["block"], batch["text"], strict=True):
                own = held.setdefault(b, set())
                before = len(own)
                own.update(w for w in cutter(t) if len(w) <= FOLD)
                size += len(own) - before
                if size > CACHE_WORDS:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    words = cut(base.select("block", "text").mapInPandas(words_of_blocks, "block long, word string"))
    lattice = word_edges(words, table).withColumn("n", F.length("word")).withColumn("best", viterbi_fold(F.col("edges")))
    if table.algorithm == BPE:
        lattice = merged(lattice.withColumn("n_viterbi", F.col("best.n")))
    else:
        lattice = lattice.select("word", F.col("best.n").alias("n_viterbi"), F.col("best.ids").alias("ids"))
    known = cut(lattice.select("word", "n_viterbi", "ids"))
    dictionary = words.join(known, "word")
    out_names = [*keep, *names]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        cutter, lattice = Cutter(table), _encoder(f"{len(table.pieces)}-{table.algorithm}", table).lattice
        ids = right.column("ids").combine_chunks()
        flat, ends = ids.flatten().to_numpy().astype(np.int32), np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))]) if len(ids) else np.zeros(1, np.int64)
        heads = np.negative(right.column("n_viterbi").to_numpy().astype(np.int32))
        known = {w: heads[i : i + 1].tobytes() + flat[ends[i] : ends[i + 1]].tobytes() for i, w in enumerate(right.column("word").to_pylist())}
        decoder = table.decoder()
        vit, flats, trips = [], [], []
        for t in left.column("text").to_pylist():
            parts = cutter(t)
            new = sorted({w for w in parts if w not in known})
            if new:
                blobs, n = lattice.encode(new)
                known.update((w, np.array([-k], np.int32).tobytes() + b) for w, b, k in zip(new, blobs, n, strict=True))
            found = np.frombuffer(b"".join(map(known.__getitem__, parts)), np.int32)
            head = found < 0
            own = found[~head]
            vit.append(-int(found[head].sum()))
            flats.append(own)
            trips.append(table.decode(own.tolist(), decoder) == t)
        row = left.column("row").combine_chunks()
        return pa.Table.from_arrays([*[row.field(c) for c in keep], *_columns(flats, vit, trips)], names=out_names)

    shape = docs.select(*keep).schema
    for field in docs.sparkSession.createDataFrame([], _OUT).schema:
        shape = shape.add(field)
    return base.groupBy("block").cogroup(dictionary.groupBy("block")).applyInArrow(run, shape)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs :func:`encode`: the same lattice in Arrow batches. :func:`encode_relational` gives
    equal rows but cannot meet the limits (figures in the README)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs)
