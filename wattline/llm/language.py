"""Language ID by cross-parsing entropy.

For each language a suffix automaton is built over running labelled text: documents, long ones in chunks of ``CHUNK`` characters, in the
order of a hash of id and chunk, as many as fit into ``TEXT_BYTES`` (from a sample of ``DOCS`` documents a language). A text is
parsed greedily into the longest phrases that occur in a language's text, across words, and the language needing the
fewest normalised phrases wins: phrases x log2(length of its training text) per byte, the cross-parsing estimate of
entropy, so languages with less training text are not favoured (ties: the alphabetically first).

Texts and training texts are lower-cased letters with one blank for everything between words. Long texts are read in
blocks of ``BLOCK`` bytes side by side, whose phrases are then joined to those of one pass over the whole text. ``und`` (score 0) where a text is null or has no letter, or where nothing was learned. score
is the winner's share of 2 ** (-8 x normalised phrases) over all languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkit as tk
from .samples import sampled_ids
from .shared import stored

DOCS = 300
TEXT_BYTES = 32_000
CHUNK = 8_000
BLOCK = 256

_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """The transitions of the smallest automaton that reads every substring of text; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return step


def running(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(letters of all texts, one blank before each text and between its words; offsets)."""
    letter = _LETTER[buf]
    keep = letter.copy()
    keep[:-1] |= letter[1:]  # a blank stands for the byte before a word
    full = offsets[1:] > offsets[:-1]
    head = np.zeros(len(buf), dtype=bool)
    head[offsets[:-1][full]] = True
    blank = keep & ~letter & ~head
    begin = head & letter  # a text that starts with a letter gets its blank put in
    out = np.where(blank, 0x20, buf)
    kept = np.concatenate([[0], np.cumsum((letter | blank) + begin.astype(np.int64))])
    at = np.flatnonzero(letter | blank)
    flat = np.empty(int(kept[-1]), np.uint8)
    flat[kept[at] + begin[at]] = out[at]
    flat[kept[np.flatnonzero(begin)]] = 0x20
    return flat, kept[offsets]


class Parser:
    def __init__(self, texts: dict[str, bytes]) -> None:
        self.langs = sorted(texts)
        used = sorted({c for t in texts.values() for c in t})
        self.code = np.zeros(256, np.int64)  # 0: a byte no language has
        self.code[used] = np.arange(1, len(used) + 1)
        self.bits = np.array([np.log2(max(2, len(texts[lang]))) for lang in self.langs])
        self.tables = []
        for lang in self.langs:
            step = suffix_automaton(texts[lang])
            table = np.full((len(step) + 1, len(used) + 1), -1, np.int32)  # the last row: behind a byte that the language has not
            for s, arcs in enumerate(step):
                for c, t in arcs.items():
                    table[s, self.code[c]] = t
            self.tables.append(table)

    def phrases(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """[texts, languages]: greedy longest-match phrases of each text, which is flat[start:start + length]."""
        parts = -(-lengths // BLOCK)
        text, before = np.repeat(np.arange(len(starts)), parts), np.cumsum(parts) - parts
        at = (starts - BLOCK * before)[text] + BLOCK * np.arange(len(text))
        size = np.minimum(BLOCK, (starts + lengths)[text] - at)
        follows = np.ones(len(text), dtype=bool)
        follows[before[parts > 0]] = False
        coded, out = self.code[flat], np.zeros((len(starts), len(self.langs)), np.int64)
        for k, table in enumerate(self.tables):
            total = np.concatenate([[0], np.cumsum(_begins(table, coded, at, size, follows))])
            out[:, k] = total[starts + lengths] - total[starts]
        return out


def _begins(table: np.ndarray, coded: np.ndarray, at: np.ndarray, size: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Where a phrase begins. Blocks (at, size) are first read side by side, each from the start state; then every block that follows
    another of its text is read on from the state in which that one ended, until a phrase begins where one began before:
    from there on both readings agree. A block that was read to its end so, in another state, has the next one read again.
    """
    begins, end = np.zeros(len(coded), dtype=bool), np.zeros(len(at), np.int32)
    order = np.argsort(-size, kind="stable")
    longest, first = int(size.max(initial=0)), at[order]
    running_ = np.searchsorted(-size[order], -np.arange(longest), side="left")  # blocks that reach each position
    state, lost = np.zeros(len(at), np.int32), len(table) - 1
    begins[at] = True
    for i in range(longest):
        m = running_[i]
        pos = first[:m] + i
        c = coded[pos]
        to = table[state[:m], c]
        stop = np.flatnonzero(to < 0)
        begins[pos[stop]] = True
        again = table[0, c[stop]]
        to[stop] = np.where(again < 0, lost, again)
        state[:m] = to
    end[order] = state
    todo = np.flatnonzero(follows)
    while len(todo):
        state, live = end[todo - 1], np.arange(len(todo))
        open_ = np.ones(len(todo), dtype=bool)
        for i in range(longest):
            live = live[size[todo[live]] > i]
            if not len(live):
                break
            pos = at[todo[live]] + i
            c = coded[pos]
            to = table[state[live], c]
            stop = to < 0
            met = stop & begins[pos]
            begins[pos] = stop
            again = table[0, c]
            state[live] = np.where(stop, np.where(again < 0, lost, again), to)
            open_[live[met]] = False
            live = live[~met]
        moved = open_ & (end[todo] != state)
        end[todo[moved]] = state[moved]
        after = todo[moved] + 1
        after = after[after < len(at)]
        todo = after[follows[after]]
    return begins


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = DOCS, text_bytes: int = TEXT_BYTES) -> dict[str, bytes]:
    """Running training text of each language, from rows with a language."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    d = d.where(F.col("text").rlike(r"\p{L}"))
    ids = sampled_ids(d, "lang", docs_per_language)
    texts = stored(d.join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")), "language-sample")  # docs_per_language rows a language
    chunks = texts.select("doc_id", "lang", F.posexplode(F.expr(f"transform(sequence(0, (length(text) - 1) div {CHUNK}), k -> substring(text, k * {CHUNK} + 1, {CHUNK}))")).alias("k", "chunk"))
    sizes = chunks.where(F.col("chunk").rlike(r"\p{L}")).select("doc_id", "lang", "k", F.octet_length("chunk").alias("n"), F.when(F.col("k") == 0, F.xxhash64("doc_id", F.lit(17))).otherwise(F.xxhash64("doc_id", F.lit(17), "k")).alias("order"))
    order = Window.partitionBy("lang").orderBy("order", "doc_id", "k")
    size = F.sum(F.col("n") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0))
    some = sizes.select("doc_id", "lang", "k", size.alias("size"), F.row_number().over(order).alias("rank")).where((F.col("size") <= text_bytes) | (F.col("rank") == 1))
    some = texts.join(F.broadcast(some), ["doc_id", "lang"]).select("lang", F.lower(F.expr(f"substring(text, k * {CHUNK} + 1, {CHUNK})")).alias("text"), "rank")  # text_bytes a language
    out: dict[str, list[bytes]] = {}
    for r in some.orderBy("lang", "rank").toLocalIterator():  # text_bytes a language
        raw = r.text.encode()
        flat, _ = running(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        out.setdefault(r.lang, []).append(flat.tobytes())
    return {lang: b"".join(w) + b" " for lang, w in out.items()}


def predict(docs: DataFrame, texts: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row; null or repeated ids and equal rows are kept as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(texts)  # text_bytes a language
    made: list[Parser] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Parser(shared.value))
        parser = made[0]
        und, names = len(parser.langs), np.array([*parser.langs, "und"], dtype=object)
        for b in tk.slices(batches, "text"):
            flat, bounds = running(*tk.flat_bytes(b.column("text")))
            n, size = b.num_rows, np.diff(bounds)
            best, score = np.full(n, und), np.zeros(n)
            if und and len(flat):
                rate = parser.phrases(flat, bounds[:-1], size) * parser.bits / np.maximum(size, 1)[:, None]
                best = np.argmin(np.round(rate, 9), axis=1)
                share = np.exp2(-8 * (rate - rate.min(axis=1, keepdims=True)))
                score = share[np.arange(n), best] / share.sum(axis=1)
            letters = b.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            best = np.where(letters & (size > 0), best, und)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names[best], pa.string()), pa.array(np.where(best == und, 0.0, score))], ["doc_id", "lang_pred", "score"])

    text = F.col(text_col).cast("string")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(text).alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return d.mapInArrow(run, "doc_id long, lang_pred string, score double")
