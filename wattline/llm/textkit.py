"""Vectorised text primitives shared by the operators.

All of them work on one Arrow record batch at a time and on bounded slices of it, so the memory of
a Python worker depends on the slice size and the longest text, never on the partition.
Texts stay UTF-8 bytes; a word is a maximal run of bytes outside ``\\x20`` and ``\\x09``-``\\x0D``.
Null texts count as empty.
"""

from __future__ import annotations

import ctypes
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE_KEYS = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power_table(name: str, base: int, n: int) -> np.ndarray:
    """base**i mod 2**64 for i < n, kept for the next call unless it is very long."""
    table = _powers.get(name)
    if table is None or len(table) < n:
        table = np.full(n, base, dtype=np.uint64)
        table[:1] = 1
        np.cumprod(table, out=table)
        if n <= 2 * SLICE_BYTES:
            _powers[name] = table
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal in, equal out, all bits spread."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def flat_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts end to end, offsets of each text); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of about ``limit`` text bytes; a longer text is a slice of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(sizes):
            continue
        cut = np.flatnonzero(np.diff(np.cumsum(sizes) // limit)) + 1
        for lo, hi in zip([0, *cut], [*cut, len(sizes)], strict=True):
            yield batch.slice(lo, hi - lo)
    release()


def release() -> None:
    """Gives freed memory back to the machine at a task's end: Python workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_ASCII_WORD = np.zeros(256, dtype=bool)
_ASCII_WORD[0x30:0x3A] = _ASCII_WORD[0x41:0x5B] = _ASCII_WORD[0x61:0x7B] = True
_word_points: list[np.ndarray] = []


def word_bytes(buf: np.ndarray) -> np.ndarray:
    """Which bytes belong to letters, digits or combining marks, by Unicode category; buf is whole UTF-8 characters."""
    out = _ASCII_WORD[buf]
    wide = np.flatnonzero(buf >= 0x80)
    if len(wide):
        if not _word_points:
            _word_points.append(np.fromiter((unicodedata.category(chr(c))[0] in "LNM" for c in range(0x110000)), bool, 0x110000))
        lead = np.flatnonzero(buf[wide] >= 0xC0)
        at, padded = wide[lead], np.concatenate([buf, np.zeros(3, np.uint8)]).astype(np.int64)
        size = np.where(buf[at] >= 0xF0, 4, np.where(buf[at] >= 0xE0, 3, 2))
        point = padded[at] & (0xFF >> (size + 1))
        for k in (1, 2, 3):
            point = np.where(size > k, point << 6 | padded[at + k] & 0x3F, point)
        owner = np.cumsum(buf[wide] >= 0xC0) - 1
        out[wide] = _word_points[0][point][owner]
    return out


class Words:
    """The words of a slice: ``starts``/``ends`` are byte positions, ``bounds[d]:bounds[d+1]`` are text d's words."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE, inside: np.ndarray | None = None) -> None:
        """``inside``, if given, marks the bytes of words; else they are those outside ``space``."""
        inside = ~space[buf] if inside is None else inside
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        full = offsets[:-1] < offsets[1:]
        head, tail = offsets[:-1][full], offsets[1:][full] - 1
        first[head] = inside[head]
        last[tail] = inside[tail]
        self.buf, self.offsets = buf, offsets
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def docs(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        return span_hashes(self.buf, self.starts, self.ends)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, equal for equal bytes wherever they stand."""
    n = len(buf)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE_KEYS[buf] * _power_table("up", _BASE, n + 1)[:n], out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * _power_table("down", _INVERSE, n + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Order-dependent hash of each n consecutive items; the caller drops those that cross texts."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9FB21C651E98DF25) + h[i : len(h) - n + 1 + i]
    return mix(out)


def runs(bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(start index of every n-window that stays inside its text, number of them per text)."""
    per = np.maximum(np.diff(bounds) - n + 1, 0)
    starts = np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(per)[:-1]]), per) + np.arange(per.sum())
    return starts.astype(np.int64), per


def segment_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i+1]] for each i."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def binary_column(parts: list[bytes] | np.ndarray) -> pa.Array:
    return pa.array(parts, pa.binary())


_STOP = np.zeros(256, dtype=bool)
_STOP[[0x21, 0x2E, 0x3F]] = True


def sentence_heads(words: Words) -> np.ndarray:
    """For each word, whether it begins a sentence: a text's first word, or after ``\\n`` or a word ending in . ! ?"""
    n = len(words.starts)
    first = np.zeros(n + 1, dtype=bool)
    first[words.bounds] = True
    first = first[:n]
    if n > 1:
        breaks = np.concatenate([[0], np.cumsum(words.buf == 0x0A)])
        first[1:] |= breaks[words.starts[1:]] > breaks[words.ends[:-1]]
        first[1:] |= _STOP[words.buf[words.ends[:-1] - 1]]
    return first


def span_matrix(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """The first ``width`` bytes of each span as rows, padded with 0."""
    at = starts[:, None] + np.arange(width)
    inside = at < ends[:, None]
    return np.where(inside, buf[np.minimum(at, max(len(buf) - 1, 0))], 0).astype(np.uint8) if len(buf) else np.zeros((len(starts), width), np.uint8)
