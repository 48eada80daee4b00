"""Line dedup: winnowed fingerprints of line parts, joined over documents, extended both ways; later repeats go.

A passage is found wherever it stands, also in the middle of a line, because nothing depends on the words
before it. The parts that are hashed are runs of two fifths of ``min_words`` words. Of every ``min_words``
words in a row (a *window*) the smallest part hash is picked (winnowing), so any run of ``min_words`` words or more that
occurs twice has a fingerprint in both places: that is the guaranteed length. A pick is kept once for all
windows in a row that share it (a *stretch*): about one fingerprint in sixteen words.

1. Fingerprints are joined on their hash alone. Documents without one that occurs elsewhere are done: they leave as
   they came, and none of their text is shuffled or read by Python again.
2. In the others each stretch is matched as a whole (hash of all its words) with the first document that has
   it (order: id, then text hash): the inside of long passages.
3. Where stretches of one fingerprint differ, at the ends of passages, the first document of each is extended window by
   window: the hash of all words of each window is joined with that window's first document, so matches reach the
   passage's exact ends in both directions and shorter matches, in which no whole window agrees, are left.

What was found is deleted; then a document's further windows are extended against its own first one, in order, unless
the window is deleted already.

A *line* is a sentence-sized unit: the text is cut at ``\\n`` and after ``.``, ``!`` or ``?`` followed by white space.
Output of ``dedup_lines``: the input's columns, ``text`` without the deleted words (null stays null),
and ``n_lines``, ``n_removed`` (which replace input columns so named); one row per input row. ``n_removed`` counts the
lines that go whole, in runs of ``min_words`` words or more; text can also be cut where it is 0. Documents that
repeat an id count as one text each; equal rows (same id and text) are one document and stay equal, each keeping what
the first keeps. A null id sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .shared import free_name, sized, stored

MIN_WORDS = 50


class Lines:
    """The lines of a slice: byte spans and word counts; ``bounds`` per text. ``heads`` are their first words."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray) -> None:
        self.text = words = tk.Words(buf, offsets)
        self.heads = at = np.flatnonzero(tk.sentence_heads(words))
        last = np.concatenate([at[1:], [len(words.starts)]]) - 1 if len(at) else at
        self.words = last - at + 1
        self.bounds = np.searchsorted(at, words.bounds)


def windows(h: np.ndarray, bounds: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, pick, key) of each run of min_words words that stays in its text; the pick is the smallest hash of its short runs."""
    short = max(1, 2 * min_words // 5)
    start, _ = tk.runs(bounds, min_words)
    if not len(start):
        return start, np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = tk.ngram_hashes(h, short)
    n, low, reach = min_words - short + 1, g, 1  # low[i] is the least of g[i : i + reach]
    while reach < n:
        step = min(reach, n - reach)
        low, reach = np.minimum(low[: len(low) - step], low[step:]), reach + step
    key = np.zeros(len(start), np.uint64)
    for at in [*range(0, min_words - short, short), min_words - short]:  # short runs that cover the window
        key = key * np.uint64(0x9FB21C651E98DF25) + g[start + at]
    return start, low[start].view(np.int64), tk.mix(key).view(np.int64)


def fingerprints(h: np.ndarray, bounds: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, windows, pick) of each stretch, and the windows' hashes; a stretch is at most as long as the guarantee needs."""
    start, pick, key = windows(h, bounds, min_words)
    of = np.searchsorted(bounds, start, side="right") - 1
    first = np.flatnonzero(np.concatenate([[True], (pick[1:] != pick[:-1]) | (of[1:] != of[:-1])])[: len(pick)])
    n = np.diff(np.append(first, len(pick)))
    widest = min_words - max(1, 2 * min_words // 5) + 1
    parts = -(-n // widest)  # a pick holds longer only where words repeat
    step = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * widest
    first, n = np.repeat(first, parts) + step, np.minimum(np.repeat(n, parts) - step, widest)
    return of[first], first, n, pick[first], key


def _identity(docs: DataFrame, id_col: str, text_col: str) -> tuple[F.Column, F.Column, F.Column]:
    """(doc, tag, name): id, a hash of the text, and one number for both."""
    doc, tag = F.col(id_col).cast("long"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return doc, tag, F.xxhash64(doc, tag)


def suspects(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(name): documents with a fingerprint that occurs in two places; all documents with a repeated run are among them."""
    *_, name = _identity(docs, id_col, text_col)

    def picks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tk.slices(batches, "text"):
            words = tk.Words(*tk.flat_bytes(b.column("text")))
            of, _, _, pick, _ = fingerprints(words.hashes(), words.bounds, min_words)
            yield pa.RecordBatch.from_arrays([pa.array(pick), b.column("name").take(pa.array(of))], ["pick", "name"])

    marks = stored(docs.select(F.col(text_col).cast("string").alias("text"), name.alias("name")).mapInArrow(picks, "pick long, name long"), "line-marks")
    twice = stored(marks.groupBy("pick").agg(F.count("*").alias("n")).where("n > 1").select("pick"), "line-picks")
    return marks.join(twice, "pick").select("name").distinct()


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, tag, at, n): n windows in a row, from word at on, that an earlier one of docs (doc, tag, text) has."""

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tk.slices(batches, "text"):
            words = tk.Words(*tk.flat_bytes(b.column("text")))
            of, first, n, pick, key = fingerprints(words.hashes(), words.bounds, min_words)
            span = tk.mix(key[first].view(np.uint64) * np.uint64(0x9FB21C651E98DF25) + key[first + n - 1].view(np.uint64) + n.astype(np.uint64)).view(np.int64)  # its outer windows cover it
            skipped = np.concatenate([[0], np.cumsum(np.maximum(words.counts() - min_words + 1, 0))])  # windows of earlier texts
            yield pa.RecordBatch.from_arrays([pa.array(pick), pa.array(span), b.column("doc").take(pa.array(of)), b.column("tag").take(pa.array(of)), pa.array((first - skipped[of]).astype(np.int32)), pa.array(n.astype(np.int32))], ["pick", "span", "doc", "tag", "at", "n"])

    marks = stored(docs.mapInArrow(stretches, "pick long, span long, doc long, tag long, at int, n int"), "line-stretches")
    who = F.struct("doc", "tag")
    spans = stored(marks.groupBy("pick", "span").agg(F.min(F.struct("doc", "tag", "at", "n")).alias("f"), F.max(who).alias("l")), "line-spans")
    whole = marks.join(spans.where("NOT (f.doc <=> l.doc AND f.tag = l.tag)").select("pick", "span", "f"), ["pick", "span"]).where("NOT (doc <=> f.doc AND tag = f.tag)").select("doc", "tag", "at", "n")
    mixed = spans.groupBy("pick").agg(F.count("*").alias("k")).where("k > 1").select("pick")
    ends = spans.join(mixed, "pick").groupBy("f.doc", "f.tag").agg(F.collect_list(F.struct("f.at", "f.n")).alias("open"))

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tk.slices(batches, "text"):
            words = tk.Words(*tk.flat_bytes(b.column("text")))
            _, _, key = windows(words.hashes(), words.bounds, min_words)
            skipped = np.concatenate([[0], np.cumsum(np.maximum(words.counts() - min_words + 1, 0))])
            some = b.column("open")
            of = np.repeat(np.arange(b.num_rows), some.value_lengths().to_numpy())
            at, n = (some.flatten().field(k).to_numpy().astype(np.int64) for k in (0, 1))
            at = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())
            of = np.repeat(of, n)
            yield pa.RecordBatch.from_arrays([pa.array(key[skipped[of] + at]), b.column("doc").take(pa.array(of)), b.column("tag").take(pa.array(of)), pa.array(at.astype(np.int32))], ["key", "doc", "tag", "at"])

    texts = docs.join(ends.withColumnsRenamed({"doc": "d", "tag": "t"}), F.expr("doc <=> d AND tag = t")).select("doc", "tag", "open", "text")
    found = stored(texts.mapInArrow(extended, "key long, doc long, tag long, at int"), "line-windows")
    firsts = stored(found.groupBy("key").agg(F.min(who).alias("f"), F.max(who).alias("l")).where("NOT f <=> l").select("key", "f"), "line-firsts")
    later = found.join(firsts, "key").where("NOT (doc <=> f.doc AND tag = f.tag)").select("doc", "tag", "at", F.lit(1).alias("n"))
    return whole.unionByName(later)


def _in_text(key: np.ndarray, of: np.ndarray) -> np.ndarray:
    return tk.mix(key.view(np.uint64) + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def own_repeats(h: np.ndarray, start: np.ndarray, key: np.ndarray, min_words: int, drop: np.ndarray) -> None:
    """Marks in drop the words of one document that repeat its own earlier runs; a window already marked whole is done."""
    _, first, back = np.unique(key, return_index=True, return_inverse=True)
    for i in np.flatnonzero(first[back] != np.arange(len(key))):
        at, shift = start[i], start[i] - start[first[back[i]]]
        if drop[at : at + min_words].all():
            continue
        differs = np.flatnonzero(h[shift:] != h[: len(h) - shift]) + shift  # x[k] against x[k - shift]
        k = np.searchsorted(differs, at)
        drop[(differs[k - 1] + 1 if k else shift) : (differs[k] if k < len(differs) else len(h))] = True


def whole_lines(gone: np.ndarray, words: np.ndarray, min_words: int) -> int:
    """Lines in runs of lines of which every word goes, at least min_words words a run."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
    total = np.concatenate([[0], np.cumsum(words)])
    begin, end = edge[::2], edge[1::2]
    return int((end - begin)[total[end] - total[begin] >= min_words].sum())


def line_count(text: F.Column) -> F.Column:
    """The number of lines: of words that are a text's first, or follow a newline or a word that ends in . ! ?"""
    inner = F.trim(text, F.lit(" \t\n\x0b\f\r"))  # each gap that is left has words on both sides, and is matched once
    return F.regexp_count(inner, F.lit(r"[.!?\n](?:(?<=\n)|[ \t-\r])[ \t-\r]*+")) + (inner != "").cast("int")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs, all its columns, with the later repeated runs cut out of the text; plus n_lines and n_removed."""
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    doc, tag, name = _identity(docs, id_col, text_col)
    key, again_, gone_, doc_, tag_ = (free_name(docs.columns, c) for c in ("_name", "_again", "_gone", "_doc", "_tag"))
    whole = docs.select(*(F.col(c).cast("string").alias(c) if c == text_col else F.col(c) for c in kept))
    marked = whole.withColumn(key, name).join(sized(suspects(docs, id_col, text_col, min_words).select(F.col("name").alias(key), F.lit(True).alias(again_)), "line-suspects"), key, "left")
    again = marked.where(F.col(again_)).select(*kept)
    gone = repeated_runs(again.select(doc.alias("doc"), tag.alias("tag"), F.col(text_col).alias("text")), min_words)
    gone = gone.groupBy("doc", "tag").agg(F.collect_set(F.struct("at", "n")).alias(gone_)).withColumnsRenamed({"doc": doc_, "tag": tag_})
    joined = again.join(gone, doc.eqNullSafe(F.col(doc_)) & (tag == F.col(tag_)), "left").select(*kept, gone_)
    schema = T.StructType([*whole.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tk.slices(batches, text_col):
            buf, offsets = tk.flat_bytes(b.column(text_col))
            lines = Lines(buf, offsets)
            words = lines.text
            h = words.hashes()
            start, _, hashed = windows(h, words.bounds, min_words)
            of = np.searchsorted(words.bounds, start, side="right") - 1
            cut = np.searchsorted(of, np.arange(b.num_rows + 1))
            mine = _in_text(hashed, of)
            first = np.unique(mine, return_index=True)[1]
            twice = np.bincount(of, minlength=b.num_rows) > np.bincount(of[first], minlength=b.num_rows)
            breaks = np.concatenate([[0], np.cumsum(buf == 0x0A)])
            texts, removed, gone = b.column(text_col).to_pylist(), [], b.column(gone_)
            for i in range(b.num_rows):
                at, n = (gone[i].values.field(k).to_numpy().astype(np.int64) if gone[i].is_valid else np.zeros(0, np.int64) for k in (0, 1))
                if not len(at) and not twice[i]:
                    removed.append(0)
                    continue
                lo, hi = words.bounds[i], words.bounds[i + 1]
                cover = np.bincount(at, minlength=hi - lo + 1) - np.bincount(at + n - 1 + min_words, minlength=hi - lo + 1)
                drop = np.cumsum(cover)[: hi - lo] > 0
                if twice[i]:
                    own_repeats(h[lo:hi], start[cut[i] : cut[i + 1]] - lo, hashed[cut[i] : cut[i + 1]], min_words, drop)
                heads = slice(lines.bounds[i], lines.bounds[i + 1])
                removed.append(whole_lines(np.logical_and.reduceat(drop, lines.heads[heads] - lo), lines.words[heads], min_words))
                keep = np.ones(offsets[i + 1] - offsets[i], dtype=bool)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], drop.view(np.int8), [0]])))
                for x, y in zip(edge[::2] + lo, edge[1::2] + lo, strict=True):
                    begin, end = words.starts[x], words.starts[y] if y < hi else offsets[i + 1]  # a passage goes with the space behind it,
                    if x > lo and y < hi and breaks[end] > breaks[words.ends[y - 1]] and breaks[begin] == breaks[words.ends[x - 1]]:
                        begin, end = words.ends[x - 1], words.ends[y - 1]  # but leaves the newline to a line that it ends
                    keep[begin - offsets[i] : end - offsets[i]] = False
                left = buf[offsets[i] : offsets[i + 1]][keep].tobytes().decode()
                texts[i] = left.rstrip(" \t\n") if drop[-1] else left
            columns = [pa.array(texts, pa.string()) if c == text_col else b.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(lines.bounds)), pa.array(removed, pa.int64())], [*kept, "n_lines", "n_removed"])

    clean = marked.where(F.col(again_).isNull()).select(*kept, F.coalesce(line_count(F.col(text_col)), F.lit(0)).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))
    return joined.mapInArrow(rewrite, schema).unionByName(clean)
