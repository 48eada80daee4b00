"""Quality rules: fixed counting rules, then a calibrated logistic regression on hashed n-grams.

The model sees hashed word unigrams and hashed character (code point) 2-, 3- and 4-grams of the lower-cased text, each
kind as shares of the text's own total. It is fitted on at most ``SAMPLE`` labelled rows per class (those
with the smallest id hash), calibrated by Platt scaling on a fifth of them, in which each class counts by its share of
all labels, so the probability does not depend on the sample's size, and shipped as fixed-point
weights, so scores do not depend on how rows are batched. ``kept`` asks for a probability of at least
``KEEP``.

Words are runs outside ``\\x20`` and ``\\x09``-``\\x0D``. Null text: no words (all counts 0,
``base_failed``, not kept). Ids may be null or repeat. Without labelled rows of both classes the model
says 1 for every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .samples import sampled_ids

SAMPLE = 800
BITS = 15
KEEP = 0.5
GRAMS = (2, 3, 4)
SCALE = 1 << 24
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True


def features(buf: np.ndarray, offsets: np.ndarray, words: tk.Words, hashes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature: (hashed index of every occurrence, bounds per text)."""
    out = [((hashes >> np.uint64(64 - BITS)).astype(np.int64), words.bounds)]
    low = np.frombuffer(tk.LOWER[buf].tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
    bounds = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[offsets]  # in characters
    for k, n in enumerate(GRAMS, 1):
        starts, per = tk.runs(bounds, n)
        code = np.zeros(max(len(low) - n + 1, 0), np.uint64)
        for i in range(n):
            code = code * np.uint64(0x9E3779B97F4A7C15) + low[i : len(low) - n + 1 + i]
        code = (code * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - BITS)).astype(np.int64)
        out.append((code[starts] + (k << BITS), np.concatenate([[0], np.cumsum(per)])))
    return out


class Model:
    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float) -> None:
        self.fixed = np.round(weights * SCALE).astype(np.int64)
        self.bias, self.slope, self.shift = bias, slope, shift

    def probability(self, feats: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        z = np.full(len(feats[0][1]) - 1, self.bias)
        for index, bounds in feats:
            z += tk.segment_sum(self.fixed[index], bounds) / (np.maximum(np.diff(bounds), 1) * float(SCALE))
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -40, 40)))


def _fit(rows: list, share: float) -> Model:
    """Logistic regression by accelerated gradient steps on sparse rows; every fifth row calibrates. share: of label 1 in all labels."""
    size = (len(GRAMS) + 1) << BITS
    y = np.array([r.label for r in rows], float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(size), 0.0, 0.0, 40.0)
    index = [np.frombuffer(r.at, "<i4") for r in rows]
    value = [np.frombuffer(r.value, "<f4") for r in rows]
    cut = np.concatenate([[0], np.cumsum([len(i) for i in index])])
    i, v = np.concatenate(index), np.concatenate(value).astype(float)
    row = np.repeat(np.arange(len(rows)), np.diff(cut))
    held = np.arange(len(rows)) % 5 == 0
    weight = np.where(y == 1, 1 / max(1, (y[~held] == 1).sum()), 1 / max(1, (y[~held] == 0).sum())) * ~held / 2
    w, b, speed, push = np.zeros(size), 0.0, np.zeros(size), 0.0
    for step in range(150):
        z = np.bincount(row, v * w[i], len(rows)) + b
        g = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        speed = 0.9 * speed - 40.0 * (np.bincount(i, g[row] * v, size) + 1e-6 * w)
        push = 0.9 * push - 2.0 * g.sum()
        w, b = w + speed, b + push
    z = np.bincount(row, v * w[i], len(rows))[held] + b
    t = np.where(y[held] == 1, (y[held].sum() + 1) / (y[held].sum() + 2), 1 / ((1 - y[held]).sum() + 2))
    good = y[held] == 1
    c = np.where(good, share / max(1, good.sum()), (1 - share) / max(1, (~good).sum())) * len(z)
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton steps of Platt's scaling
        p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -40, 40)))
        q = c * np.maximum(p * (1 - p), 1e-6)
        grad = np.array([(c * (p - t) * z).sum() + 1e-2 * slope, (c * (p - t)).sum()])  # a weak prior keeps separable samples finite
        hess = np.array([[(q * z * z).sum() + 1e-2, (q * z).sum()], [(q * z).sum(), q.sum() + 1e-3]])
        d = np.linalg.solve(hess, grad)
        slope, shift = slope - d[0], shift - d[1]
    return Model(w, b, float(slope), float(shift))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    ids = sampled_ids(known, "label", sample)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tk.slices(batches, "text"):
            buf, offsets = tk.flat_bytes(b.column("text"))
            words = tk.Words(buf, offsets)
            feats = features(buf, offsets, words, tk.Words(tk.LOWER[buf], offsets).hashes())
            at, value = [], []
            for d in range(b.num_rows):
                parts = [np.unique(i[s[d] : s[d + 1]], return_counts=True) for i, s in feats]
                at.append(np.concatenate([p for p, _ in parts]).astype("<i4").tobytes())
                value.append(np.concatenate([n / max(1, n.sum()) for _, n in parts]).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(at, pa.binary()), pa.array(value, pa.binary())], ["doc_id", "label", "at", "value"])

    rows = d.join(F.broadcast(ids), "doc_id").select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, at binary, value binary")  # ids: 2 * sample rows
    share = known.where("label IS NOT NULL").agg(F.coalesce(F.avg((F.col("label") == 1).cast("double")), F.lit(0.0))).first()[0]
    return _fit(sorted(rows.toLocalIterator(), key=lambda r: (r.doc_id, r.label)), share)


def _repeated_words(hashes: np.ndarray, bounds: np.ndarray, n: int = 3) -> np.ndarray:
    """Per text, the words that lie in an n-word window found twice or more in that text."""
    starts, per = tk.runs(bounds, n)
    if not len(starts):
        return np.zeros(len(bounds) - 1, np.int64)
    doc = np.repeat(np.arange(len(per)), per)
    key = tk.mix(tk.ngram_hashes(hashes, n)[starts] + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    cover = np.zeros(len(hashes), dtype=bool)
    for i in range(n):
        cover[starts[twice] + i] = True
    return tk.segment_sum(cover, bounds)


def _repeated_lines(buf: np.ndarray, offsets: np.ndarray, words: tk.Words) -> np.ndarray:
    """Per text, the lines with a word that equal an earlier line."""
    cut = np.flatnonzero(buf == 0x0A)
    of = np.searchsorted(offsets, cut, side="right") - 1
    doc = np.repeat(np.arange(len(offsets) - 1), np.bincount(of, minlength=len(offsets) - 1) + 1)  # one line more than newlines
    head = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
    tail = np.concatenate([doc[1:] != doc[:-1], [True]]) if len(doc) else head
    starts, ends = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
    starts[head], starts[~head] = offsets[:-1], cut + 1
    ends[tail], ends[~tail] = offsets[1:], cut
    filled = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, doc = starts[filled], ends[filled], doc[filled]
    key = tk.mix(tk.span_hashes(buf, starts, ends) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    distinct = np.bincount(doc[np.unique(key, return_index=True)[1]], minlength=len(offsets) - 1)
    return np.bincount(doc, minlength=len(offsets) - 1) - distinct


def measure(batch: pa.RecordBatch, model: Model | None, text: str = "text") -> dict[str, np.ndarray]:
    buf, offsets = tk.flat_bytes(batch.column(text))
    words = tk.Words(buf, offsets)
    hashes = words.hashes()
    n_words = words.counts()
    points = np.concatenate([[0], np.cumsum(((buf & 0xC0) != 0x80) & ~tk.SPACE[buf])])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[buf])])
    out = {
        "n_words": n_words,
        "word_chars": points[offsets[1:]] - points[offsets[:-1]],
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": _repeated_lines(buf, offsets, words),
        "n_repeat_words": _repeated_words(hashes, words.bounds),
    }
    out["base_failed"] = (n_words < 50) | (100 * out["n_repeat_words"] > 50 * n_words)
    if model is not None:
        out["probability"] = model.probability(features(buf, offsets, words, tk.Words(tk.LOWER[buf], offsets).hashes()))
        out["kept"] = ~out["base_failed"] & (out["probability"] >= KEEP)
    return out


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tk.slices(batches, "text"):
            m = measure(b, shared.value)
            counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(m[c].astype(np.int64)) for c in counts), pa.array(m["base_failed"]), pa.array(m["kept"]), pa.array(m["probability"])], ["doc_id", *counts, "base_failed", "kept", "probability"])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
