"""Benchmark decontamination by spaced-seed hashing.

Tokens are runs of letters, digits and combining marks (by Unicode category), ASCII letters lower-cased. A mask such
as ``1100101`` hashes the tokens under its ones and ignores those under its zeros, so a substituted token under a
zero does not hide a match. The six masks were chosen so that each agreement of 60 % or more of 17 to 59 tokens that
tests/llm tries (any period up to 8, and random ones) holds one of them: measured recall 1.0. Seeds of the benchmark items are joined with the seeds of the documents,
and the overlap is verified token by token at each offset that a seed gives: over the item's whole length, and as
local runs (most agreeing less differing tokens), which are joined over offsets at most ``GAP`` apart, so that
inserted and dropped words do not end a run. An item is reported when at least ``min_share`` of its tokens agree at one
offset or in a joined run, or when a joined run has at least ``min_run`` agreeing tokens: a partial quote.

``overlaps`` returns (doc_id, item_id, n_matched, n_tokens, first_token): the best alignment of every
reported pair; first_token is where the item's first token stands, or would stand before a partial quote. ``decontaminate`` drops the documents that have one.

A bitmap of fixed size (2**BITMAP_BITS bits) of the benchmark's seeds goes to the tasks as a first filter, with the
sorted seeds themselves where there are at most ``EXACT_SEEDS``; what passes meets the seed table in an ordinary join,
which Spark broadcasts or shuffles by size. Items of up to ``LONGEST`` tokens are searched by ``SHORT_MASKS``: where 60 % of
so many tokens agree, three of them always lie within five places. Items of fewer than ``MIN_TOKENS`` tokens are not
searched. Null texts are empty and match nothing; a null doc_id can
be reported with a null id; rows with a null item_id are searched like others. Repeated documents are
reported once per doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import stored, without

MASKS = ("1100101", "110101", "1111", "11101", "11011", "1110001")
SHORT_MASKS = ("111", "1101", "1011", "11001", "10101", "10011")
MIN_TOKENS = 5
MIN_SHARE = 0.6
MIN_RUN = 13
GAP = 8
LEAST_RUN = 5
#: Items up to so many tokens are searched by SHORT_MASKS.
LONGEST = 16
BITMAP_BITS = 24
EXACT_SEEDS = 1_000_000


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, bounds per text)."""
    words = tk.Words(tk.LOWER[buf], offsets, inside=tk.word_bytes(buf))
    return words.hashes(), words.bounds


def seeds(h: np.ndarray, bounds: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(seed of every window of the mask's span that stays in its text, first token)."""
    starts, _ = tk.runs(bounds, len(mask))
    if not len(starts):
        return np.zeros(0, np.int64), starts
    n = len(h) - len(mask) + 1
    out = np.full(n, hash_of(mask), dtype=np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            out = out * np.uint64(0x9FB21C651E98DF25) + h[i : n + i]
    return tk.mix(out)[starts].view(np.int64), starts


def hash_of(mask: str) -> int:
    return int(mask, 2) + 1


def local_runs(same: np.ndarray) -> list[tuple[int, int]]:
    """(first, one past the last) of the best run, by most agreeing less differing tokens, of each cluster of agreeing ones."""
    at = np.flatnonzero(same)
    out = []
    for part in np.split(at, np.flatnonzero(np.diff(at) > 3) + 1) if len(at) else []:
        total = np.concatenate([[0], np.cumsum(np.where(same[part[0] : part[-1] + 1], 1, -1))])
        low = np.minimum.accumulate(total)
        end = int(np.argmax(total - low))
        out.append((int(part[0]) + int(np.flatnonzero(total[: end + 1] == low[end])[-1]), int(part[0]) + end))
    return out


def best_overlap(x: np.ndarray, y: np.ndarray, shifts: list[int]) -> tuple[int, int, int, int]:
    """Item y in region x: (most agreeing tokens at one shift, that shift, most in a joined run, its first shift)."""
    single, runs = (0, 0), []
    least = 3 if len(y) <= LONGEST else LEAST_RUN
    for s in sorted(shifts):
        lo, hi = max(0, -s), min(len(y), len(x) - s)
        if hi <= lo:
            continue
        same = np.zeros(len(y), dtype=bool)
        same[lo:hi] = y[lo:hi] == x[lo + s : hi + s]
        total = np.concatenate([[0], np.cumsum(same)])
        single = max(single, (int(total[-1]), -s))
        runs += [(e, b, s, total) for b, e in local_runs(same) if total[e] - total[b] >= least]
    runs.sort(key=lambda r: r[:3])
    ends, by, sums, first = (np.zeros(len(runs), np.int64) for _ in range(4))
    for k, (e, b, s, total) in enumerate(runs):
        ends[k], by[k], sums[k], first[k] = e, s, total[e] - total[b], s
        near = np.flatnonzero(np.abs(by[:k] - s) <= GAP)
        after = np.clip(np.maximum(ends[near], ends[near] + by[near] - s), b, e)  # behind the earlier run in item and region
        joined = sums[near] + total[e] - total[after]
        if len(near) and joined.max() > sums[k]:
            j = int(np.argmax(joined))
            sums[k], first[k] = joined[j], first[near[j]]
    top = int(np.argmax(sums)) if len(runs) else -1
    return single[0], -single[1], int(sums[top]) if len(runs) else 0, int(first[top]) if len(runs) else 0


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", masks: tuple[str, ...] = MASKS, min_share: float = MIN_SHARE, min_run: int = MIN_RUN) -> DataFrame:
    spark, longest = docs.sparkSession, LONGEST
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))

    def item_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tk.slices(batches, "text"):
            h, bounds = tokens(*tk.flat_bytes(b.column("text")))
            cut = list(zip(bounds[:-1], bounds[1:], strict=True))
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array([h[x:y].tobytes() for x, y in cut], pa.binary()), pa.array(np.diff(bounds))], ["item_id", "tokens", "n"])

    bench = stored(items.mapInArrow(item_tokens, "item_id long, tokens binary, n long").where(F.col("n") >= MIN_TOKENS).withColumn("item", F.xxhash64("item_id", "tokens")).dropDuplicates(["item"]), "bench")

    def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, raw in zip(b.column("item").to_pylist(), b.column("tokens").to_pylist(), strict=True):
                h = np.frombuffer(raw, np.uint64)
                bounds = np.array([0, len(h)])
                for m in masks if len(h) > longest else SHORT_MASKS:
                    s, at = seeds(h, bounds, m)
                    yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(np.full(len(s), item)), pa.array(at.astype(np.int32))], ["seed", "item", "at"])

    table = stored(bench.select("item", "tokens").mapInArrow(item_seeds, "seed long, item long, at int"), "bench-seeds")
    size = 1 << BITMAP_BITS
    bits = np.zeros(size // 64, np.uint64)
    marks = table.select(F.expr(f"shiftrightunsigned(seed & {size - 1}, 6)").alias("w"), F.expr("shiftleft(1L, cast(seed & 63 AS int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    for r in marks.toLocalIterator():  # at most size / 64 words, whatever the benchmark holds
        bits[r.w] = np.uint64(r.b & 0xFFFFFFFFFFFFFFFF)
    few = table.select("seed").distinct().limit(EXACT_SEEDS + 1).count() <= EXACT_SEEDS
    exact = np.sort(np.fromiter((r.seed for r in table.select("seed").distinct().toLocalIterator()), np.int64)) if few else None
    known = spark.sparkContext.broadcast((bits, exact))
    sizes = bench.agg(F.coalesce(F.min("n") <= longest, F.lit(False)).alias("short"), F.coalesce(F.max("n") > longest, F.lit(False)).alias("long")).first()
    shapes = [*(masks if sizes.long else ()), *(SHORT_MASKS if sizes.short else ())]
    reach = bench.agg(F.max("n")).first()[0] or 0

    # the parts of documents around seeds that the bitmap knows
    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, exact = known.value
        for b in tk.slices(batches, "text"):
            h, bounds = tokens(*tk.flat_bytes(b.column("text")))
            found, where = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for m in shapes:
                s, at = seeds(h, bounds, m)
                hit = np.flatnonzero(bits[(s & (size - 1)) >> 6] >> (s & 63).astype(np.uint64) & np.uint64(1))
                if exact is not None and len(hit):
                    hit = hit[exact[np.minimum(np.searchsorted(exact, s[hit]), len(exact) - 1)] == s[hit]]
                found.append(s[hit])
                where.append(at[hit])
            s, at = np.concatenate(found), np.concatenate(where)
            if not len(s):
                continue
            order = np.argsort(at, kind="stable")
            s, at = s[order], at[order]
            of = np.searchsorted(bounds, at, side="right") - 1
            new = np.concatenate([[True], (of[1:] != of[:-1]) | (at[1:] - at[:-1] > reach)])
            cut = np.concatenate([np.flatnonzero(new), [len(s)]])
            lo = np.maximum(bounds[of[cut[:-1]]], at[cut[:-1]] - reach)
            hi = np.minimum(bounds[of[cut[:-1]] + 1], at[cut[1:] - 1] + 2 * reach)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").take(pa.array(of[cut[:-1]])),
                    pa.array((lo - bounds[of[cut[:-1]]]).astype(np.int64)),
                    pa.array([h[x:y].tobytes() for x, y in zip(lo, hi, strict=True)], pa.binary()),
                    pa.array([s[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.list_(pa.int64())),
                    pa.array([at[x:y] - lo[k] for k, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True))], pa.list_(pa.int64())),
                ],
                ["doc_id", "base", "tokens", "seeds", "ats"],
            )

    near = stored(d.mapInArrow(regions, "doc_id long, base long, tokens binary, seeds array<long>, ats array<long>").withColumn("region", F.xxhash64("doc_id", "base", "tokens")).dropDuplicates(["region"]), "regions")
    hits = near.select("region", F.explode(F.arrays_zip("seeds", "ats")).alias("h")).select("region", F.col("h.seeds").alias("seed"), F.col("h.ats").alias("p"))
    starts = hits.join(table.select("seed", "item", "at"), "seed").select("region", "item", (F.col("p") - F.col("at")).alias("shift")).groupBy("region", "item").agg(F.collect_set("shift").alias("shifts"))
    full = starts.join(near.select("region", "doc_id", "base", F.col("tokens").alias("x")), "region").join(bench.select("item", "item_id", F.col("tokens").alias("y")), "item")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, item, base, shifts, x, y in zip(*(b.column(c).to_pylist() for c in ("doc_id", "item_id", "base", "shifts", "x", "y")), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                single, at, joined, first = best_overlap(x, y, shifts)
                if max(single, joined) >= min_share * len(y) or joined >= min_run:
                    out.append((doc, item, max(single, joined), len(y), base + (at if single >= joined else first)))
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "n_matched", "n_tokens", "first_token"])

    found = full.select("doc_id", "item_id", "base", "shifts", "x", "y").mapInArrow(verify, "doc_id long, item_id long, n_matched long, n_tokens long, first_token long")
    best = F.max(F.struct("n_matched", (-F.col("first_token")).alias("p"), "n_tokens")).alias("m")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.n_matched", "m.n_tokens", (-F.col("m.p")).alias("first_token"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the documents that contain a benchmark item."""
    return without(docs, overlaps(docs, benchmark, id_col, text_col, **options).select(F.col("doc_id").alias(id_col)), id_col)
