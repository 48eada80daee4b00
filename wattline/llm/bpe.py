"""BPE encoding and decoding with a tokenization automaton compiled from the merge list.

Compilation applies one *merge gadget* per merge, in rank order, to an automaton over tokens that at
first has one state with a loop for every byte. The gadget of (u, v) -> w cuts the arc v out of the
state that u leads to and adds an arc w, into the state v leads to, wherever u may be read. After the
last merge exactly the sequences that the merge procedure yields are accepted, so the automaton is
deterministic: a word has one accepted path, and so has each of its prefixes.

The compiled tables are plain arrays. Tokens are numbered so that a token, followed by the tokens that later merges
built upon it, is one run of numbers; what a gadget cuts is then an interval. ``cut_lo`` and ``cut_hi`` hold each state's
cut intervals, disjoint and in order (``first[a]`` to ``first[a + 1]``), and an arc is there unless its number is in one.
``step`` is the table of the byte automaton that spells the arcs' labels from their ends. ``encode`` finds the one arc by
which the accepted path of a word ends, then that of the part before it, and so on: the arcs that end at a position
are read from ``step``, and whether one may follow the path before it from the cut intervals. What a position's arc is
is settled once. ``decode`` emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

#: A worker keeps the ids of so many pieces, twice over, and none of more than CACHED_CHARS characters, so both bound its bytes.
CACHED_WORDS, CACHED_CHARS = 250_000, 64
#: Answers that the automaton keeps of which token may follow which.
CACHED_ARCS = 200_000
#: The pre-tokenizer's pattern of this vocabulary format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergeAutomaton:
    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]], singles: dict[int, int]) -> None:
        """labels: bytes of each token id; merges: (left, right, merged) in rank order; singles: byte -> id."""
        self.labels = labels
        n, never, born = len(labels), len(merges), {}
        for time, (u, v, w) in enumerate(merges):
            if w not in born:
                born[w] = (time, u, v)
        self._number(n, singles, born)
        self._cut(n, never, born)
        self._spell([*singles.values(), *born])
        del self.place, self.end, self.built  # only compiling needs them
        self.known: dict[int, bool] = {}

    def _number(self, n: int, singles: dict[int, int], born: dict) -> None:
        """place[t] and end[t]: t and all tokens that begin with it as their left part are place[t] .. end[t]; later merges come first."""
        above: dict[int, list[int]] = {}
        for w, (_, u, _) in born.items():
            above.setdefault(u, []).append(w)
        self.place, self.end = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.built = {u: sorted(ws, key=lambda w: -born[w][0]) for u, ws in above.items()}
        at, todo = 0, [(t, False) for t in dict.fromkeys(singles.values())]
        while todo:
            t, left = todo.pop()
            if left:
                self.end[t] = at - 1
                continue
            self.place[t] = at
            at += 1
            todo.append((t, True))
            todo += [(w, False) for w in reversed(self.built.get(t, ()))]

    def _cut(self, n: int, never: int, born: dict) -> None:
        """Each state's cut intervals: those of its own token's gadgets, of its right part's before it was born, and so on."""
        order = sorted(born.values(), key=lambda g: (g[1], g[0]))  # gadgets by left token, then time
        time, left, right = (np.array(c, np.int64) for c in zip(*order, strict=True)) if order else (np.zeros(0, np.int64),) * 3
        hi = self.place[right] if len(right) else right
        for k, (t, v) in enumerate(zip(time.tolist(), right.tolist(), strict=True)):
            later = [w for w in self.built.get(v, ()) if born[w][0] >= t]
            if later:
                hi[k] = self.end[later[-1]]
        lo, key, span = self.place[right] if len(right) else right, left * (never + 1) + time, never + 1
        tail, since = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        for w, (t, _, v) in born.items():
            tail[w], since[w] = v, t
        state, token, version = np.arange(n), np.arange(n), np.full(n, never)
        parts = []
        while len(state):
            a, b = np.searchsorted(key, token * span), np.searchsorted(key, token * span + version)
            k = b - a
            parts.append((np.repeat(state, k), np.repeat(a - (np.cumsum(k) - k), k) + np.arange(k.sum())))
            on = tail[token] >= 0
            state, version, token = state[on], since[token[on]], tail[token[on]]
        of, gadget = (np.concatenate(c) for c in zip(*parts, strict=True))
        x, y = lo[gadget], hi[gadget]
        by = np.lexsort((-y, x, of))
        of, x, y = of[by], x[by], y[by]
        reach = np.maximum.accumulate(of * (n + 1) + y) if len(of) else of
        keep = np.concatenate([[True], (of[1:] != of[:-1]) | (x[1:] > reach[:-1] - of[:-1] * (n + 1))])[: len(of)]
        self.cut_lo, self.cut_hi = array("i", x[keep].astype(np.int32).tobytes()), array("i", y[keep].astype(np.int32).tobytes())
        self.first = np.searchsorted(of[keep], np.arange(n + 1)).tolist()
        self.number = self.place.tolist()

    def _spell(self, tokens: list[int]) -> None:
        """step: (node << 8 | byte) -> node, over labels from their last byte on; ends: the token that a node spells, or -1."""
        self.step: dict[int, int] = {}
        self.ends = [-1]
        self.sizes = [len(x) for x in self.labels]
        for t in tokens:
            node = 0
            for b in reversed(self.labels[t]):
                nxt = self.step.get(node << 8 | b)
                if nxt is None:
                    nxt = self.step[node << 8 | b] = len(self.ends)
                    self.ends.append(-1)
                node = nxt
            self.ends[node] = t

    def arc(self, a: int, b: int) -> bool:
        """Whether b may be read in the state that a leads to."""
        p, start = self.number[b], self.first[a]
        i = bisect_right(self.cut_lo, p, start, self.first[a + 1]) - 1
        found = i < start or self.cut_hi[i] < p
        if len(self.known) >= CACHED_ARCS:
            self.known.clear()
        self.known[a << 32 | b] = found
        return found

    def encode(self, word: bytes) -> list[int]:
        n, step, ends, sizes, known = len(word), self.step.get, self.ends, self.sizes, self.known.get
        last: dict[int, int] = {}  # the arc that ends at a position
        open_: dict[int, list[int]] = {}  # the arcs that may, longest last
        todo = [n] if n else []
        while todo:
            at = todo[-1]
            arcs = open_.get(at)
            if arcs is None:
                arcs, node = [], 0
                for i in range(at - 1, -1, -1):
                    node = step(node << 8 | word[i])
                    if node is None:
                        break
                    if ends[node] >= 0:
                        arcs.append(ends[node])
                open_[at] = arcs
            while True:
                t = arcs[-1]
                before = at - sizes[t]
                if before:
                    a = last.get(before)
                    if a is None:
                        todo.append(before)
                        break
                    ok = known(a << 32 | t)
                    if not ok and (ok is not None or not self.arc(a, t)):
                        arcs.pop()
                        continue
                last[at] = t
                todo.pop()
                break
        path, at = [], n
        while at:
            path.append(last[at])
            at -= sizes[last[at]]
        path.reverse()
        return path

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.labels.__getitem__, ids))


class _Irregular(Exception):
    """A piece between two spaces that white space around it can join."""


class _Pieces(dict):
    """The ids of pieces between spaces; two generations bound what is kept."""

    def __init__(self, codec: ByteBpe, lead: str) -> None:
        self.codec, self.lead, self.old = codec, lead, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            if piece.isalpha():
                found = self.codec.encode_word(self.lead + piece)
            elif self.lead and (not piece or piece[0].isspace() or piece[-1].isspace()) or piece and piece[-1].isspace():
                raise _Irregular
            else:
                found = self.codec.encode_part(self.lead + piece)
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED_WORDS:
                self.old = dict(self)
                self.clear()
            self[piece] = found
        return found


class ByteBpe:
    """Encoder and decoder for a byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, symbols = spec["model"], byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocab = {**model["vocab"], **self.special}
        labels = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            labels[i] = token.encode() if token in self.special else bytes(symbols[c] for c in token)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.automaton = MergeAutomaton(labels, [(vocab[u], vocab[v], vocab[u + v]) for u, v in pairs], {b: vocab[c] for c, b in symbols.items() if c in vocab})
        self.pattern = regex.compile(PATTERN)
        self.outer = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.head, self.body = _Pieces(self, ""), _Pieces(self, " ")

    def encode_word(self, word: str) -> bytes:
        return array("I", self.automaton.encode(word.encode())).tobytes()

    def encode_part(self, text: str) -> bytes:
        """Ids, little-endian 32-bit, of text that no other text continues."""
        out = []
        for k, part in enumerate(self.outer.split(text) if self.outer and any(map(text.__contains__, self.special)) else [text]):
            if k % 2:
                out.append(self.special[part].to_bytes(4, "little"))
                continue
            for w in self.pattern.findall(part):
                rest = w[1:]
                out.append(self.body[rest] if w[0] == " " and rest.isalpha() else self.encode_word(w))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        pieces = text.split(" ")
        try:
            return self.head[pieces[0]] + b"".join(map(self.body.__getitem__, pieces[1:]))
        except _Irregular:
            return self.encode_part(text)

    def decode(self, ids: bytes) -> str:
        return self.automaton.decode(np.frombuffer(ids, "<u4").tolist()).decode("utf-8", "replace")


_codecs: dict[str, ByteBpe] = {}


def codec(path: str) -> ByteBpe:
    """One compiled automaton per Python worker and file."""
    if path not in _codecs:
        _codecs[path] = ByteBpe(path)
        tk.release()  # compiling took three times what is kept
    return _codecs[path]


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>); a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        for b in tk.slices(batches, "text"):
            ids = [np.frombuffer(bpe.encode(t or ""), "<i4") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of ``encode``'s rows; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        for b in batches:
            texts = [None if ids is None else bpe.decode(np.array(ids, "<u4").tobytes()) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of each text's ids and of what they decode to; with_ids adds the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        for b in tk.slices(batches, "text"):
            ids = [bpe.encode(t or "") for t in b.column("text").to_pylist()]
            columns = [b.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in ids]), pa.array([hashlib.sha256(bpe.decode(i).encode()).hexdigest() for i in ids])]
            if with_ids:
                columns.append(pa.array([np.frombuffer(i, "<i4") for i in ids], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
