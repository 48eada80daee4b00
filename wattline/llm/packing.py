"""Packing documents into sequences of at most ``capacity`` tokens: dominance reduction, then best fit.

Pieces of one length are interchangeable, so an instance is a count per length: at most ``capacity`` numbers however
many documents there are. The plan is made on those counts, whole runs of equal pieces at a time, and holds a row a
run; it never holds a document. Runs are found by what length and free space allow, so their number is bounded by the
square of the capacity and does not grow with the data.

Reduction (Martello and Toth): take a length w, longest first, and look for a set of at most three pieces with w that
dominates every other set with w that fits, that is, whose pieces can stand in for those of the other set. Such a set
is a sequence of some best packing, so as many of it as there are pieces are fixed for good, and the search goes on with
what is left until a whole pass fixes nothing:

* nothing fits beside w: w alone;
* the largest v that fits beside w fills the sequence: {w, v};
* no two pieces fit beside w: {w, v};
* no three fit, and v is no shorter than the best two together: {w, v};
* no three fit, b is the largest that fits beside {w, v}, and no two pieces longer than b fit beside w: {w, v, b}.

What remains goes longest first into the fullest sequence that has room.

A null text is empty: its end id alone. Rows that repeat an id, and null ids, are documents of their own. An empty table has
no pieces. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkit as tk
from .rans import SLICE_BYTES, tokenizer, vocabulary_size
from .shared import sized, stored

CAPACITY = 2048
_RANKS = 1 << 40
_PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]


class Plan:
    """Runs (length, first rank, count, first sequence, offset): piece ``rank`` of that length goes to sequence first + rank - first rank."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY) -> None:
        if any(not 0 < w <= capacity for w in counts):
            raise ValueError("a piece is longer than a sequence")
        self.capacity, self.left = capacity, {w: n for w, n in counts.items() if n}
        self.lengths = sorted(self.left)
        self.used = dict.fromkeys(self.left, 0)
        self.sequences = 0
        self.runs: list[tuple[int, int, int, int, int]] = []
        while self._reduce():
            pass
        self.fixed, self.rest = self.sequences, dict(self.left)
        self._best_fit()

    def _take(self, w: int, count: int, sequence: int, offset: int) -> None:
        self.runs.append((w, self.used[w], count, sequence, offset))
        self.used[w] += count
        self.left[w] -= count
        if not self.left[w]:
            del self.left[w]
            self.lengths.pop(bisect_left(self.lengths, w))

    def _fix(self, *pieces: int) -> None:
        """As many sequences of these pieces as there are."""
        count = min(self.left[w] // pieces.count(w) for w in set(pieces))
        offset = 0
        for w in pieces:
            self._take(w, count, self.sequences, offset)
            offset += w
        self.sequences += count

    def _free(self, w: int, *without: int) -> bool:
        """Is there a piece of length w besides those of ``without``?"""
        return self.left.get(w, 0) > without.count(w)

    def _largest(self, room: int, *without: int) -> int:
        """The longest piece of at most ``room`` besides ``without``, 0 if there is none."""
        k = bisect_right(self.lengths, room) - 1
        while k >= 0 and not self._free(self.lengths[k], *without):
            k -= 1
        return self.lengths[k] if k >= 0 else 0

    def _smallest(self, n: int, above: int, *without: int) -> list[int]:
        """The n shortest pieces longer than ``above``, fewer if there are fewer."""
        out: list[int] = []
        k = bisect_right(self.lengths, above)
        while len(out) < n and k < len(self.lengths):
            w = self.lengths[k]
            out += [w] * min(n - len(out), self.left[w] - without.count(w))
            k += 1
        return out

    def _best_pair(self, room: int, w: int) -> int:
        """The largest sum of two pieces besides w that is at most ``room``."""
        best, lo, hi = 0, 0, bisect_right(self.lengths, room) - 1
        while lo <= hi:
            a, b = self.lengths[lo], self.lengths[hi]
            if a + b > room or not self._free(b, w):
                hi -= 1
            elif not self._free(a, w) or a == b and not self._free(a, w, a):
                lo += 1
            else:
                best = max(best, a + b)
                lo += 1
        return best

    def _dominating(self, w: int) -> tuple[int, ...] | None:
        room = self.capacity - w
        v = self._largest(room, w)
        if not v:
            return (w,)
        small = self._smallest(3, 0, w)
        if v == room or len(small) < 2 or small[0] + small[1] > room:
            return w, v
        if len(small) == 3 and sum(small) <= room:
            return None
        if v >= self._best_pair(room, w):
            return w, v
        b = self._largest(room - v, w, v)
        longer = self._smallest(2, b, w)
        if b and (len(longer) < 2 or sum(longer) > room):
            return w, v, b
        return None

    def _reduce(self) -> bool:
        before = self.sequences
        for w in reversed(self.lengths.copy()):
            while w in self.left and (found := self._dominating(w)):
                self._fix(*found)
        return self.sequences > before

    def _best_fit(self) -> None:
        room: dict[int, list[tuple[int, int]]] = {}  # by free space: (first sequence, count)
        sizes: list[int] = []

        def put(free: int, sequence: int, count: int) -> None:
            if free and count:
                if free not in room:
                    room[free] = []
                    insort(sizes, free)
                room[free].append((sequence, count))

        for w in reversed(self.lengths.copy()):
            while n := self.left.get(w, 0):
                k = bisect_left(sizes, w)
                if k < len(sizes):
                    free = sizes[k]
                    sequence, count = room[free].pop()
                    if not room[free]:
                        del room[free]
                        sizes.pop(k)
                else:
                    free, sequence = self.capacity, self.sequences
                    count = -(-n // (free // w))
                    self.sequences += count
                each = free // w  # the fullest sequence that has room is the one just filled
                full = min(count, n // each)
                for j in range(each if full else 0):
                    self._take(w, full, sequence, self.capacity - free + j * w)
                put(free - each * w, sequence, full)
                last = n - full * each if full < count else 0
                for j in range(last):
                    self._take(w, 1, sequence + full, self.capacity - free + j * w)
                put(free - last * w, sequence + full, int(last > 0))
                put(free, sequence + full + (last > 0), count - full - (last > 0))


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids and the end id, cut every ``capacity`` ids; ``part`` and ``rank`` number the pieces of a length within a task."""
    width = np.dtype("<u2" if vocabulary_size(vocabulary) <= 1 << 16 else "<u4")
    names = [*_PIECE, "part", "rank", *(["ids"] if with_ids else [])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, seen, part = tokenizer(vocabulary), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for b in tk.slices(batches, "text", SLICE_BYTES):
            flat, bounds = tk.flat_bytes(tok.encode(b.column("text"), end_id))
            size = np.diff(bounds) // width.itemsize
            many = -(-size // capacity)
            doc = np.repeat(np.arange(len(size)), many)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            start = piece * capacity
            length = np.minimum(size[doc] - start, capacity)
            ids = memoryview(flat.view(width).astype("<u4").tobytes())
            at = (bounds[:-1] // width.itemsize)[doc] + start
            own = [ids[4 * x : 4 * y] for x, y in zip(at.tolist(), (at + length).tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            new = np.ones(len(order), bool)
            new[1:] = np.diff(length[order]) > 0
            first = np.flatnonzero(new)
            rank = np.empty(len(order), np.int64)
            rank[order] = seen[length[order]] + np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
            seen += np.bincount(length, minlength=capacity + 1)
            more = [pa.array([bytes(x) for x in own], pa.binary())] if with_ids else []
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in own], pa.int64()), pa.array(np.full(len(doc), part, np.int32)), pa.array(rank), *more], names)

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long" + (", ids binary" if with_ids else ""))


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut (any columns with length, part and rank as ``pieces`` numbers them) with sequence_id and offset. cut is read twice, so it should be stored."""
    rest = [c for c in cut.columns if c not in ("part", "rank")]
    per = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sized(per.select("length", "part", "n", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base")), "piece-counts")
    counts = {r.length: r.n for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row a length
    plan = Plan(counts, capacity)
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 5)
    shared = cut.sparkSession.sparkContext.broadcast(runs)
    types = {f.name: f.dataType.simpleString() for f in cut.schema.fields}

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        keys = own[:, 0] * _RANKS + own[:, 1]
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            run = own[np.searchsorted(keys, length * _RANKS + rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4])], [*rest, "sequence_id", "offset"])

    ranked = cut.join(bases.drop("n"), ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base"))
    return ranked.select(*rest, "rank").mapInArrow(put, ", ".join(f"`{c}` {types[c]}" for c in rest) + ", sequence_id long, offset long")


def packed(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """The pieces of docs with their sequence_id and offset."""
    return place(stored(pieces(docs, vocabulary, capacity, end_id, with_ids=with_ids), "pieces"), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids) from pieces placed with ids: at most ``capacity`` ids a row, little-endian unsigned 32-bit."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    g = placed.groupBy("sequence_id").agg(rows.alias("r"))
    return g.select("sequence_id", F.aggregate("r", F.lit(b""), lambda x, r: F.concat(x, r["ids"])).alias("ids"), F.transform("r", lambda r: r["doc_id"]).alias("doc_ids"))
