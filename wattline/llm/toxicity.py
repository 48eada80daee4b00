"""Toxicity by a support vector machine on a subsequence string kernel with Nystroem landmarks.

The kernel of two tokens counts their common 3-byte subsequences, also gapped ones, that span at most
``SPAN`` bytes, each gap byte costing a factor ``DECAY``; it is normalised to 1 for equal
tokens and raised to ``POWER`` (still a kernel), which damps chance likeness. Inserted
or dropped characters (``id.iot``, ``losser``) leave most subsequences intact. Tokens of one or two bytes are read with
a blank at each end. Tokens of whose subsequences fewer than ``MIN_COMMON`` (or all, if they have fewer) or a share of
``MIN_SHARE`` occur in landmarks count as 0. A sentence is described by its tokens'
largest kernel values with the landmarks, mapped by the Nystroem factor of the landmark kernel; a linear
SVM scores sentences, a text has its worst sentence's score, calibrated by Platt scaling.

Training: at most ``SAMPLE`` labelled texts per class (smallest id hash) and their sentences. Landmarks
are the tokens most associated with toxic texts, by likelihood ratio. Labels mark
texts, so a toxic text's label is given to its worst sentence, chosen anew in each of ``ROUNDS`` fits.

Tokens are runs of non-space bytes of the lower-cased text without symbols at their ends; longer ones are
read in overlapping windows of ``WIDTH`` bytes. Runs of at least ``SPELLED`` tokens of one character (``i d i o t``) are also
read as one token, which stands in its first one's sentence. Null or empty texts have the score of a text with no
similar token. Without both classes the score is 0 for every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .samples import sampled_ids
from .shared import free_name, stored

SAMPLE = 2000
LANDMARKS = 128
SPAN = 5
DECAY = 0.6
POWER = 2
WIDTH = 32
MIN_COMMON = 3
MIN_SHARE = 0.35
SPELLED = 3
PER_TEXT = 3
LEAST_RATIO = 15.0
ROUNDS = 4
COST = 5.0
LOOK_ALIKE = 0.3
THRESHOLD = 0.3
#: Text bytes taken at once: a worker's memory goes with them.
SLICE_BYTES = 1 << 17
BITS = 18

_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[0x30:0x3A] = _ALNUM[0x61:0x7B] = _ALNUM[0x80:] = True
_OFFSETS = [(j, k) for k in range(2, SPAN) for j in range(1, k)]


def tokens(buf: np.ndarray, words: tk.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buf and behind it the joined runs, starts, ends, word) of each token window, by word; words of symbols only have none."""
    n = len(buf)
    solid = _ALNUM[buf]
    nxt = np.where(solid, np.arange(n), n)
    nxt = np.minimum.accumulate(nxt[::-1])[::-1] if n else nxt
    prv = np.maximum.accumulate(np.where(solid, np.arange(n), -1)) if n else nxt
    word = np.arange(len(words.starts))
    starts, ends = (nxt[words.starts], prv[words.ends - 1] + 1) if n else (words.starts, words.ends)
    ok = starts < ends
    starts, ends, word = starts[ok], ends[ok], word[ok]
    heads = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    one = np.flatnonzero(heads[ends] - heads[starts] == 1)
    text = words.docs()[word[one]]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(one) > 1) | (np.diff(text) > 0)])[: len(one)])
    size = np.diff(np.append(first, len(one)))
    first, size = first[size >= SPELLED], size[size >= SPELLED]
    if len(first):
        run = one[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        width = ends[run] - starts[run]
        at = np.repeat(starts[run] - (np.cumsum(width) - width), width) + np.arange(width.sum())
        edge = n + np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(size)])]
        buf = np.concatenate([buf, buf[at]])
        starts, ends, word = np.concatenate([starts, edge[:-1]]), np.concatenate([ends, edge[1:]]), np.concatenate([word, word[one[first]]])
        order = np.argsort(word, kind="stable")
        starts, ends, word = starts[order], ends[order], word[order]
    parts = np.maximum(-(-(ends - starts - WIDTH) // (WIDTH // 2)), 0) + 1
    at = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = np.repeat(starts, parts) + at * (WIDTH // 2)
    return buf, starts, np.minimum(starts + WIDTH, np.repeat(ends, parts)), np.repeat(word, parts)


class Tokens:
    """Tokens end to end: ``flat`` bytes, the token of each byte and how many bytes of it follow."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        short = ends - starts < 3  # these get a blank at each end
        starts, ends = starts - short, ends + short
        size = ends - starts
        self.count = len(size)
        self.of = np.repeat(np.arange(len(size)), size)
        at = np.arange(size.sum()) + np.repeat(starts - (np.cumsum(size) - size), size)
        blank = np.repeat(short, size) & ((at == np.repeat(starts, size)) | (at == np.repeat(ends, size) - 1))
        self.flat = np.where(blank, 0x20, buf[np.where(blank, 0, at)]).astype(np.uint32)
        self.left = np.repeat(ends, size) - at - 1

    @classmethod
    def of_words(cls, words: list[bytes]) -> Tokens:
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        return cls(np.frombuffer(b"".join(words), np.uint8), ends - np.array([len(w) for w in words], np.int64), ends)

    def subsequences(self) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """(first byte, code, weight) of all gapped 3-byte subsequences, one shape at a time."""
        f = self.flat
        for j, k in _OFFSETS:
            if len(f) > k:
                at = np.flatnonzero(self.left[: len(f) - k] >= k)
                yield at, f[at] << np.uint32(16) | f[at + j] << np.uint32(8) | f[at + k], DECAY ** (k - 2)

    def sparse(self, only: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``only``, code, weight) of those tokens, equal codes of a token added up, in order."""
        place = np.full(self.count, -1)
        place[only] = np.arange(len(only))
        keys, weights = [np.zeros(0, np.int64)], [np.zeros(0)]
        for at, code, w in self.subsequences():
            row = place[self.of[at]]
            keys.append(row[row >= 0] << 24 | code[row >= 0])
            weights.append(np.full(len(keys[-1]), w))
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        return key >> 24, key & 0xFFFFFF, np.bincount(back, np.concatenate(weights), len(key))


class Landmarks:
    def __init__(self, words: list[bytes]) -> None:
        self.words = words
        row, code, weight = Tokens.of_words(words).sparse(np.arange(len(words)))
        norm = np.sqrt(np.bincount(row, weight * weight, len(words)))
        order = np.argsort(code, kind="stable")
        self.codes, self.first = np.unique(code[order], return_index=True)
        self.first = np.append(self.first, len(code))
        self.mark, self.value = row[order], (weight / np.maximum(norm[row], 1e-12))[order]  # the landmarks of each code
        self.maybe = np.zeros(1 << BITS, dtype=bool)
        self.maybe[self._hash(self.codes)] = True

    @staticmethod
    def _hash(code: np.ndarray) -> np.ndarray:
        return (code.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(32 - BITS)

    def kernel(self, tokens: Tokens, every: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(tokens with enough in common, or every one; their kernel values with every landmark)."""
        common = np.zeros(tokens.count, np.int64)
        size = np.bincount(tokens.of, minlength=tokens.count)
        own = sum((np.maximum(size - k, 0) for _, k in _OFFSETS), np.zeros(tokens.count, np.int64))  # all subsequences of a token
        if len(self.codes):
            for at, code, _ in tokens.subsequences():
                common += np.bincount(tokens.of[at[self.maybe[self._hash(code)]]], minlength=tokens.count)
        rows = np.flatnonzero((own > 0) & (common >= np.minimum(MIN_COMMON, own)) & (common >= MIN_SHARE * own) | every)
        n = len(self.words)
        out = np.zeros((len(rows), n))
        if len(rows) and len(self.codes):
            row, code, weight = tokens.sparse(rows)
            norm = np.sqrt(np.bincount(row, weight * weight, len(rows)))
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            hit = np.flatnonzero(self.codes[at] == code)
            row, at, weight = row[hit], at[hit], (weight / norm[row])[hit]
            k = self.first[at + 1] - self.first[at]
            each = np.repeat(self.first[at] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            out = np.bincount(np.repeat(row, k) * n + self.mark[each], np.repeat(weight, k) * self.value[each], len(rows) * n).reshape(len(rows), n)
        return rows, out**POWER


def sentences(batch: pa.RecordBatch, marks: Landmarks) -> tuple[np.ndarray, np.ndarray]:
    """(text of each sentence with a similar token, its largest kernel values)."""
    buf, offsets = tk.flat_bytes(batch.column("text"))
    buf = tk.LOWER[buf]
    words = tk.Words(buf, offsets)
    buf, starts, ends, word = tokens(buf, words)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros((0, len(marks.words)))
    _, first, back = np.unique(tk.span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
    rows, values = marks.kernel(Tokens(buf, starts[first], ends[first]))
    place = np.full(len(first), -1)
    place[rows] = np.arange(len(rows))
    seen = place[back]
    used = np.flatnonzero(seen >= 0)
    if not len(used):
        return np.zeros(0, np.int64), np.zeros((0, len(marks.words)))
    sentence = np.cumsum(tk.sentence_heads(words))[word[used]]
    cut = np.flatnonzero(np.diff(sentence, prepend=-1))
    return words.docs()[word[used[cut]]], np.maximum.reduceat(values[seen[used]], cut, axis=0)


class Model:
    """decision(values) scores sentences; probability calibrates a text's worst decision."""

    def __init__(self, marks: Landmarks, weights: np.ndarray, bias: float, slope: float, shift: float) -> None:
        self.marks, self.weights, self.bias, self.slope, self.shift = marks, weights, bias, slope, shift

    def decision(self, values: np.ndarray) -> np.ndarray:
        return values @ self.weights + self.bias

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -40, 40)))

    def texts(self, batch: pa.RecordBatch) -> np.ndarray:
        of, values = sentences(batch, self.marks)
        worst = np.full(batch.num_rows, self.bias)
        np.maximum.at(worst, of, self.decision(values))
        return self.probability(worst)


def _svm(x: np.ndarray, y: np.ndarray, cost: float) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by Newton steps on the points inside the margin."""
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(a.shape[1])
    ridge = np.eye(a.shape[1])
    ridge[-1, -1] = 1e-3
    active = None
    for _ in range(30):
        now = y * (a @ w) < 1
        if active is not None and (now == active).all():
            break
        active = now
        s = a[active] * cost
        w = np.linalg.solve(ridge + s.T @ a[active], s.T @ y[active])
    return w[:-1], float(w[-1])


def _choose(stats: list, toxic: int, clean: int) -> list[bytes]:
    """The tokens with the largest likelihood ratio of their text counts, if it is above LEAST_RATIO."""
    scored = []
    for r in stats:
        p, q, both = r.toxic / toxic, r.clean / clean, (r.toxic + r.clean) / (toxic + clean)
        ratio = 2 * (r.toxic * np.log(max(p, 1e-12) / both) + (r.clean * np.log(q / both) if r.clean else 0))
        if p > q and ratio >= LEAST_RATIO:
            scored.append((-ratio, bytes(r.token)))
    return [t for _, t in sorted(scored)[:LANDMARKS]]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """The model of the labelled texts; where a class has no text, one that finds nothing toxic. Labels without a document, or null, teach nothing."""
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    ids = sampled_ids(known, "label", sample)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = d.join(F.broadcast(ids), "doc_id").select("doc_id", "label", F.lower("text").alias("text"))  # 2 * sample rows
    texts = stored(texts, "toxic-sample")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tk.slices(batches, "text", SLICE_BYTES):
            buf, offsets = tk.flat_bytes(b.column("text"))
            buf = tk.LOWER[buf]
            words = tk.Words(buf, offsets)
            buf, starts, ends, word = tokens(buf, words)
            doc = words.docs()[word]
            first = np.unique(tk.mix(tk.span_hashes(buf, starts, ends) + doc.astype(np.uint64)), return_index=True)[1]
            raw = buf.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([raw[starts[i] : ends[i]] for i in first], pa.binary()), b.column("label").take(pa.array(doc[first]))], ["token", "label"])

    counted = texts.mapInArrow(split, "token binary, label int").groupBy("token").agg(F.sum("label").cast("long").alias("toxic"), F.sum(1 - F.col("label")).cast("long").alias("clean"))
    sizes = {r.label: r["count"] for r in texts.groupBy("label").count().collect()}  # labels may have no document
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    none = Model(Landmarks([]), np.zeros(0), 0.0, 0.0, -40.0)
    if not toxic or not clean:
        return none
    odds = F.col("toxic") * F.log((F.col("toxic") + 0.1) / toxic / ((F.col("clean") + 0.1) / clean))
    bad = _choose(counted.where("toxic >= 2").orderBy(odds.desc(), "token").limit(4 * LANDMARKS).collect(), toxic, clean)
    if not bad:
        return none
    marks = spark.sparkContext.broadcast(bad)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Landmarks(marks.value)
        for b in tk.slices(batches, "text", SLICE_BYTES):
            of, values = sentences(b, own)
            order = np.lexsort((-values.max(axis=1, initial=0.0), of))
            cut = np.searchsorted(of[order], np.arange(b.num_rows + 1))
            best = [values[order[lo : min(hi, lo + PER_TEXT)]].astype("<f4").tobytes() for lo, hi in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(best, pa.binary())], ["doc_id", "label", "values"])

    share = known.where("label IS NOT NULL").agg(F.avg("label")).first()[0]
    rows = sorted(texts.mapInArrow(describe, "doc_id long, label int, values binary").toLocalIterator(), key=lambda r: (r.doc_id, r.label))
    return _fit(rows, Landmarks(bad), share)


def variants(marks: Landmarks, floor: np.ndarray) -> np.ndarray:
    """Kernel values of landmarks with an inserted symbol or a doubled character, as toxic training points.

    floor: the largest kernel value that each landmark has with a clean text; only variants above it are used,
    and none of landmarks that clean texts come near.
    """
    made = [(i, w[: len(w) // 2 + d] + more(w[len(w) // 2 + d - 1 :][:1]) + w[len(w) // 2 + d :]) for i, w in enumerate(marks.words) if len(w) > 3 for d in (0, 1) for more in (lambda c: b".", lambda c: c)]
    rows, values = marks.kernel(Tokens.of_words([w for _, w in made]))
    own = np.array([made[r][0] for r in rows], np.int64)
    return values[(values[np.arange(len(rows)), own] > floor[own] + 0.05) & (floor[own] < LOOK_ALIKE)]


def _fit(rows: list, marks: Landmarks, share: float) -> Model:
    n = len(marks.words)
    bags = [np.frombuffer(r["values"], "<f4").reshape(-1, n).astype(float) for r in rows]
    bags = [b if len(b) else np.zeros((1, n)) for b in bags]
    y = np.array([r.label for r in rows])
    _, full = marks.kernel(Tokens.of_words(marks.words), every=True)
    value, vector = np.linalg.eigh((full + full.T) / 2)
    keep = value > 1e-3 * value.max()  # smaller ones are noise that the factor would blow up
    factor = vector[:, keep] / np.sqrt(value[keep])
    mapped = [b @ factor for b in bags]
    clean = [b.max(axis=0) for b, label in zip(bags, y, strict=True) if not label]
    varied = variants(marks, np.max(clean, axis=0)) @ factor
    held = np.arange(len(rows)) % 5 == 0
    choice = [int(np.argmax(b.max(axis=1))) for b in bags]
    w, bias = np.zeros(factor.shape[1]), 0.0
    for _ in range(ROUNDS):
        x, t, of = [], [], []
        for i, b in enumerate(mapped):
            if not held[i]:
                some = b[choice[i]][None] if y[i] else b
                x.append(some)
                t += [1.0 if y[i] else -1.0] * len(some)
                of.append(len(some))
        x.append(varied)
        t = np.array(t + [1.0] * len(varied))
        w, bias = _svm(np.concatenate(x), t, COST)
        choice = [int(np.argmax(b @ w)) for b in mapped]
    z = np.array([max(bias, float((b @ w).max()) + bias) for b in mapped])
    at = held if held.any() and len(set(y[held])) == 2 else np.ones(len(y), dtype=bool)
    slope, shift = _platt(z[at], y[at], share)
    return Model(marks, factor @ w, bias, slope, shift)


def _platt(z: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and shift of the calibrated logit; rows count so that toxic ones have their share of all labels."""
    pos, neg = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    c = np.where(y == 1, share / max(pos, 1), (1 - share) / max(neg, 1)) * len(y)
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -40, 40)))
        q = c * np.maximum(p * (1 - p), 1e-6)
        grad = np.array([(c * (p - t) * z).sum() + 1e-2 * slope, (c * (p - t)).sum()])
        hess = np.array([[(q * z * z).sum() + 1e-2, (q * z).sum()], [(q * z).sum(), q.sum() + 1e-3]])
        d = np.linalg.solve(hess, grad)
        slope, shift = slope - d[0], shift - d[1]
    return float(slope), float(shift)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every row; predicted is 1 from THRESHOLD on."""
    shared = docs.sparkSession.sparkContext.broadcast((model.marks.words, model.weights, model.bias, model.slope, model.shift))
    made: list[Model] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            words, *rest = shared.value
            made.append(Model(Landmarks(words), *rest))
        for b in tk.slices(batches, "text", SLICE_BYTES):
            p = made[0].texts(b)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.col(text_col).cast("string")).alias("text"))
    return d.mapInArrow(run, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs, all its columns whatever their names, without the rows that the model predicts to be toxic."""
    shared = docs.sparkSession.sparkContext.broadcast((model.marks.words, model.weights, model.bias, model.slope, model.shift))
    made: list[Model] = []
    columns = docs.columns
    low = free_name(columns, "_low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            words, *rest = shared.value
            made.append(Model(Landmarks(words), *rest))
        for b in tk.slices(batches, low, SLICE_BYTES):
            clean = made[0].texts(pa.RecordBatch.from_arrays([b.column(low)], ["text"])) < THRESHOLD
            yield b.select(columns).filter(pa.array(clean))

    return docs.withColumn(low, F.lower(F.col(text_col).cast("string"))).mapInArrow(run, docs.schema)
