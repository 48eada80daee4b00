"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

``near_duplicates(docs)`` gives one row per document: ``n_shingles`` (distinct word 5-grams; a text
with fewer words has its whole word sequence as one; no words: 0) and ``component_id``, the smallest
id reachable over links, where two texts link at 100 * |A & B| >= 75 * |A | B|.

How it works, and why it holds at scale:

* Documents of equal shingle sets are one *class*; only classes are compared, so a group of exact
  copies costs one row per copy.
* A count-min style sketch of fixed size (``sketch_bits``) counts every shingle of every document, without caps,
  and orders shingles rarest first. It sets the order and tells hot shingles, so any collision leaves results exact.
* A class joins on its first |A| - ceil(t|A|) + 1 shingles; of a pair the smaller class needs only
  its first |A| - ceil(2t/(1+t)|A|) + 1. Rarest first, a group of near copies meets in few shingles.
* In every shingle's bucket the class with the fewest rarer shingles is the hub; the first round
  verifies classes against hubs only (a star, not all pairs). The bucket of a shingle that the sketch counts more than
  ``HOT`` times is dealt by signature to so many tasks, each with a hub of its own, and these hubs against one of
  them: a star of stars. Only class pairs of a bucket that are
  still in different components are compared after that, each once, so no link is lost.
* Length, positional and suffix filters (a 64-cell count of each set, which bounds the overlap from
  above) come before the exact verification on the full 64-bit shingle sets.

Nulls: a null text is empty (n_shingles 0, own component); texts with a null id link like others, so they can connect
two documents; such a row's component is the smallest id it reaches, null if it reaches none. Repeated ids and rows
stay repeated.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.components import connected_components
from . import textkit as tk
from .shared import sized, stored, without

SKETCH_BITS = 22
SKETCH_BLOCKS = 64
SUFFIX_CELLS = 64
HOT = 4096
_LEVELS = 1000.0  # steps of the sketch per doubling of a count


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    words = tk.Words(tk.LOWER[buf], offsets)
    h = words.hashes()
    grams = tk.ngram_hashes(h, width)
    starts, per = tk.runs(words.bounds, width)
    picked, edge = grams[starts] if len(starts) else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(per)])
    out = []
    for d, n in enumerate(words.counts()):
        if n >= width:
            out.append(np.unique(picked[edge[d] : edge[d + 1]]))
        elif n:
            own = h[words.bounds[d] : words.bounds[d + 1]]
            out.append(tk.ngram_hashes(own, int(n)) ^ np.uint64(n))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signature(s: np.ndarray) -> int:
    """A 64-bit hash of the whole set."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        return int(tk.mix(np.array([np.bitwise_xor.reduce(tk.mix(s)) + np.add.reduce(tk.mix(s ^ np.uint64(0x5851F42D4C957F2D))) + np.uint64(len(s))], dtype=np.uint64)).view(np.int64)[0])


def _counts(payload: bytes) -> np.ndarray:
    """A packed part of the sketch."""
    return np.frombuffer(zlib.decompress(payload), np.uint64)


def prefix_lengths(n: np.ndarray | int, num: int = 75, den: int = 100) -> tuple:
    """(probe, index) prefix lengths of a set of n at Jaccard num/den."""
    probe = n - -(-num * n // den) + 1
    index = n - -(-2 * num * n // (num + den)) + 1
    return probe, index


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 75, den: int = 100, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text)).alias("key"), text.alias("text"))
    cells, block = 1 << sketch_bits, max(1, (1 << sketch_bits) // SKETCH_BLOCKS)

    # 1. classes and the sketch, in one pass
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(cells, np.uint32)
        names = ["doc_id", "key", "n", "sig", "block", "payload"]
        none = lambda k, t: pa.nulls(k, t)
        for b in tk.slices(batches, "text"):
            sets = shingle_sets(*tk.flat_bytes(b.column("text")), width)
            if any(map(len, sets)):
                np.add.at(counts, (np.concatenate(sets) >> np.uint64(64 - sketch_bits)).astype(np.int64), np.uint32(1))
            k = len(sets)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_signature(s) for s in sets], pa.int64()), none(k, pa.int32()), none(k, pa.binary())], names)
        for i in range(SKETCH_BLOCKS if counts.any() else 0):
            part = counts[i * block : (i + 1) * block].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([none(1, pa.int64()), none(1, pa.int64()), none(1, pa.int64()), none(1, pa.int64()), pa.array([i], pa.int32()), pa.array([zlib.compress(part, 1)], pa.binary())], names)

    scanned = stored(d.mapInArrow(scan, "doc_id long, key long, n long, sig long, block int, payload binary"), "shingles")
    rows = scanned.where("block IS NULL").select("doc_id", "key", "n", "sig")
    classes = rows.where("n > 0").groupBy("sig", "n").agg(F.min("doc_id").alias("rep"), F.coalesce(F.min("doc_id"), F.min("key")).alias("key"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, p in zip(b.column("block").to_pylist(), b.column("payload").to_pylist(), strict=True):
                sums.setdefault(i, np.zeros(block, np.uint64)).__iadd__(_counts(p))
        for i, t in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(t, 1)], pa.binary())], ["block", "payload"])

    parts = scanned.where("block IS NOT NULL").select("block", "payload")
    summed = parts.repartition("block", F.length("payload") % 16).mapInArrow(add, "block int, payload binary")  # partial sums, salted
    summed = summed.repartition("block").mapInArrow(add, "block int, payload binary")
    total = np.zeros(cells, np.uint64)
    for r in summed.toLocalIterator():  # 64 blocks of a table whose size is fixed
        total[r.block * block : (r.block + 1) * block] += _counts(r.payload)
    sketch = spark.sparkContext.broadcast(np.floor(np.log2(np.maximum(total, 1)) * _LEVELS).astype(np.uint16))  # 0: at most once

    # 2. prefixes in rare-first order
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = sketch.value, set()
        for b in tk.slices(batches, "text"):
            cols: list[list] = [[], [], [], []]
            for s in shingle_sets(*tk.flat_bytes(b.column("text")), width):
                n = len(s)
                sig = _signature(s)
                if not n or sig in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(sig)
                probe, _ = prefix_lengths(n, num, den)
                often = table[(s >> np.uint64(64 - sketch_bits)).astype(np.int64)]
                order = np.lexsort((s, often))[:probe]
                order_keep = often[order] > 0  # a cell counted once: no other text has it
                p = np.flatnonzero(order_keep)
                cols[0].append(s[order[p]])
                cols[1].append(np.full(len(p), sig, np.int64))
                cols[2].append(np.int64(n) << np.int64(32) | p.astype(np.int64))
                tasks = np.ceil(np.exp2(often[order[p]] / _LEVELS) / HOT).astype(np.int64)
                cols[3].append(np.where(tasks > 1, np.int64(sig & 0x7FFFFFFFFFFFFFFF) % tasks, -1).astype(np.int32))
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cols[0]).view(np.int64)), *(pa.array(np.concatenate(c)) for c in cols[1:])], ["sh", "sig", "place", "salt"])

    entries = d.select("text").mapInArrow(prefixes, "sh long, sig long, place long, salt int")  # place: set size and position in one number
    w = Window.partitionBy("sh", "salt")
    alone = entries.withColumn("rows", F.count("*").over(w)).where("rows > 1 OR salt >= 0")
    sized_ = alone.selectExpr("sh", "salt", "sig", "cast(place >> 32 AS int) AS n", "cast(place & 4294967295 AS int) AS pos", "rows")
    first = F.expr(f"pos <= n - ((2 * {num} * n + {num + den - 1}) div {num + den})")  # in the index prefix
    bucket = sized_.withColumns({"hub": F.min(F.struct("pos", "n", "sig")).over(w), "far": F.max(F.struct("sig", "n")).over(w), "near": F.min(F.struct("sig", "n")).over(w), "least": F.min(F.when(first, F.col("n"))).over(w)})
    bucket = bucket.where((F.col("salt") >= 0) | F.expr("far.sig <> near.sig OR far.n <> near.n") & (F.col("least") <= F.col("n")) & (first | (F.col("least") < F.col("n"))))  # else no pair of it is in both prefixes
    shared = stored(bucket.select("sh", "salt", "sig", "n", "pos", "rows", F.col("hub.sig").alias("hsig"), F.col("hub.n").alias("hn"), F.col("hub.pos").alias("hpos")), "buckets")

    def may_link(n1: str, p1: str, n2: str, p2: str) -> F.Column:
        """Length, index-prefix and positional filter of one common shingle."""
        need = f"(({num} * ({n1} + {n2}) + {num + den - 1}) div {num + den})"
        short = f"(CASE WHEN {n1} <= {n2} THEN {p1} <= {n1} - ((2 * {num} * {n1} + {num + den - 1}) div {num + den}) ELSE {p2} <= {n2} - ((2 * {num} * {n2} + {num + den - 1}) div {num + den}) END)"
        return F.expr(f"least({n1}, {n2}) * {den} >= greatest({n1}, {n2}) * {num} AND {short} AND least({n1} - {p1}, {n2} - {p2}) >= {need}")

    centres = shared.where("salt >= 0").select("sh", F.struct("hpos", "hn", "hsig").alias("h")).distinct()
    top = centres.join(centres.groupBy("sh").agg(F.min("h").alias("t")), "sh").where("h <> t").where(may_link("h.hn", "h.hpos", "t.hn", "t.hpos"))
    hubs = shared.where("sig <> hsig OR n <> hn").where(may_link("n", "pos", "hn", "hpos")).select(F.col("hsig").alias("a"), F.col("hn").alias("an"), F.col("sig").alias("b"), F.col("n").alias("bn"))
    hubs = stored(hubs.union(top.select("t.hsig", "t.hn", "h.hsig", "h.hn")).distinct(), "hubs")
    found = _verified(d, hubs, classes, width, num, den)
    parts1 = connected_components(found.select(F.expr("struct(a AS sig, an AS n)").alias("src"), F.expr("struct(b AS sig, bn AS n)").alias("dst")))
    parts1 = stored(parts1.select("node.sig", "node.n", F.xxhash64("component.sig", "component.n").alias("comp")), "parts")

    # 3. what a bucket still holds in different components; of two rows the only pair is done
    comp = shared.where("rows > 2 OR salt >= 0").select("sh", "sig", "n", "pos").join(parts1, ["sig", "n"], "left").withColumn("comp", F.coalesce("comp", F.xxhash64("sig", "n")))
    left = comp.groupBy("sh").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("sh")
    open_ = stored(comp.join(left, "sh", "left_semi").withColumn("len_bin", F.floor(F.log(F.col("n").cast("double")) / np.log(den / num)).cast("int")), "open")
    x = open_.select("sh", "len_bin", *(F.col(c).alias(f"x_{c}") for c in ("sig", "n", "pos", "comp")))
    y = open_.withColumn("len_bin", F.explode(F.array("len_bin", F.col("len_bin") + 1))).select("sh", "len_bin", *(F.col(c).alias(f"y_{c}") for c in ("sig", "n", "pos", "comp")))
    rest = x.join(y, ["sh", "len_bin"]).where("y_n <= x_n AND x_comp <> y_comp AND (y_n < x_n OR y_sig < x_sig)").where(may_link("x_n", "x_pos", "y_n", "y_pos"))
    rest = rest.select(F.col("x_sig").alias("a"), F.col("x_n").alias("an"), F.col("y_sig").alias("b"), F.col("y_n").alias("bn")).distinct()
    rest = rest.join(hubs, ["a", "an", "b", "bn"], "left_anti").join(hubs.select(F.col("b").alias("a"), F.col("bn").alias("an"), F.col("a").alias("b"), F.col("an").alias("bn")), ["a", "an", "b", "bn"], "left_anti")
    more = _verified(d, stored(rest, "rest"), classes, width, num, den)

    links = found.union(more)
    comps = connected_components(links.select(F.expr("struct(a AS sig, cast(an AS bigint) AS n)").alias("src"), F.expr("struct(b AS sig, cast(bn AS bigint) AS n)").alias("dst")))
    member = classes.join(comps.select("node.sig", "node.n", "component"), ["sig", "n"])
    named = member.join(member.groupBy("component").agg(F.min("rep").alias("id")), "component").select("sig", "n", "id")
    found = classes.join(named, ["sig", "n"], "left").select("sig", "n", F.coalesce("id", "rep").alias("component"))
    return rows.join(found, ["sig", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _verified(d: DataFrame, pairs: DataFrame, classes: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, an, b, bn) that do link: their texts are read again, once per class, and compared in full."""
    need = pairs.select(F.col("a").alias("sig"), F.col("an").alias("n")).union(pairs.select("b", "bn")).distinct()
    ids = sized(classes.join(need.withColumn("n", F.col("n").cast("long")), ["sig", "n"], "left_semi").select("key"), "candidates")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tk.slices(batches, "text"):
            found = shingle_sets(*tk.flat_bytes(b.column("text")), width)
            cells = [np.bincount((s & np.uint64(SUFFIX_CELLS - 1)).astype(np.int64), minlength=SUFFIX_CELLS).astype("<u4").tobytes() for s in found]
            yield pa.RecordBatch.from_arrays([pa.array([_signature(s) for s in found], pa.int64()), pa.array([len(s) for s in found], pa.int32()), pa.array(cells, pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], ["sig", "n", "cells", "items"])

    full = stored(d.join(ids, "key", "left_semi").select("text").mapInArrow(sets, "sig long, n int, cells binary, items binary").dropDuplicates(["sig", "n"]), "sets")

    def suffix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u4").reshape(-1, SUFFIX_CELLS) for c in ("ca", "cb"))
                n = b.column("an").to_numpy().astype(np.int64) + b.column("bn").to_numpy()
                keep = np.minimum(x, y).sum(1, dtype=np.int64) * (num + den) >= num * n
                yield b.select(["a", "an", "b", "bn"]).filter(pa.array(keep))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for p, q in zip(b.column("ia"), b.column("ib"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (p, q))
                both = np.concatenate([x, y])
                both.sort()
                i = int((both[1:] == both[:-1]).sum())
                keep.append(den * i >= num * (len(x) + len(y) - i))
            yield b.select(["a", "an", "b", "bn"]).filter(pa.array(keep, pa.bool_()))

    schema = "a long, an int, b long, bn int"
    side = lambda c, v, n: full.select(F.col("sig").alias(c), F.col("n").alias(c + "n"), F.col(v).alias(n))
    close = pairs.join(side("a", "cells", "ca"), ["a", "an"]).join(side("b", "cells", "cb"), ["b", "bn"]).select("a", "an", "b", "bn", "ca", "cb").mapInArrow(suffix, schema)
    linked = close.join(side("a", "items", "ia"), ["a", "an"]).join(side("b", "items", "ib"), ["b", "bn"]).select("a", "an", "b", "bn", "ia", "ib").mapInArrow(verify, schema)
    return stored(linked, "links")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without those whose component has a smaller id: one document of each group stays. Null ids stay."""
    found = near_duplicates(docs, id_col, text_col, **options)
    return without(docs, found.where("component_id <> doc_id").select(F.col("doc_id").alias(id_col)), id_col)
