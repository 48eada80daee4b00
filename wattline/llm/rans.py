"""Token-ID output coded with a static range asymmetric numeral system.

File format (all integers little-endian), one file per about ``FILE_TOKENS`` tokens of a range of doc_ids:

    header   magic "WRANS2", u32 symbols, u32 scale bits, u64 crc32 of the shared table
    blocks   each: u32 tokens, u32 lanes, u32 words, u32 checkpoints, u32 crc32 of what follows,
             lanes u64 start states, checkpoints x (u32 step, u32 word, lanes u64 states), words u32
    index    zlib, per block: u64 position, u64 first token (of the file), u32 documents; then per document:
             i64 doc_ids, u8 null flags, u64 lengths
    footer   u64 index position, u32 index bytes, u32 documents, u32 blocks, u64 tokens, u32 index crc32, magic

A block holds whole documents. Its tokens go round its lanes (token i to lane i mod lanes), all lanes share the one
frequency table and one word stream, so that one vector operation codes a token of each lane. Blocks are independent:
each is decoded by a task row of its own (``read_tokens``), and a decoder may also begin at any checkpoint inside
(``tokens_at``). The frequency table is built from all documents, is as long as the vocabulary and stored once.

The ids are stored once, unordered, as they leave the tokenizer; one range shuffle puts them in ascending doc_id
order (null first, equal ids by text hash) and each range is coded as it arrives.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkit as tk
from .bpe import byte_symbols
from .shared import fresh_path, stored

MAGIC = b"WRANS2"
LANES = 2048
BLOCK_TOKENS = 1 << 19
CHECKPOINT_STEPS = 128
FILE_TOKENS = 1 << 25
SLICE_BYTES = 4 << 20
#: A worker keeps the ids of so many pieces, twice over, and none of more than CACHED_CHARS characters, so both bound its bytes; with fewer, those of one slice drive out the last one's.
CACHED_WORDS, CACHED_CHARS = 400_000, 64
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(0xFFFFFFFF)


class Table:
    """Frequencies scaled to 2**bits, at least one each, and their running sums."""

    def __init__(self, freq: np.ndarray, bits: int) -> None:
        self.bits, self.freq = bits, freq.astype(np.uint64)
        self.low = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        n = len(counts)
        bits = max(16, int(n - 1).bit_length() + 3)
        spare = (1 << bits) - n
        share = counts * (spare / max(1, int(counts.sum())))
        freq = 1 + np.floor(share).astype(np.int64)
        rest = (1 << bits) - int(freq.sum())  # what rounding left goes to the most frequent
        freq[int(np.argmax(counts))] += rest
        return cls(freq, bits)


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    n = len(ids)
    lanes = LANES
    while lanes > 1 and lanes * 16 > n:
        lanes //= 2
    steps = -(-n // lanes)
    f, lo, bits = table.freq, table.low, np.uint64(table.bits)
    x = np.full(lanes, _LOW, dtype=np.uint64)
    out: list[np.ndarray] = []
    marks: list[tuple[int, int, bytes]] = []
    count = 0
    for s in range(steps - 1, -1, -1):
        t = ids[s * lanes : (s + 1) * lanes]
        k = len(t)
        ft, y = f[t], x[:k]
        full = y >= ft << (np.uint64(63) - bits)
        if full.any():
            w = (y[full] & _WORD).astype("<u4")[::-1]
            out.append(w)
            count += len(w)
            y[full] >>= np.uint64(32)
        q = y // ft
        x[:k] = (q << bits) + (y - q * ft) + lo[t]
        if s and s % CHECKPOINT_STEPS == 0:
            marks.append((s, count, x.astype("<u8").tobytes()))
    words = np.concatenate(out)[::-1] if out else np.zeros(0, "<u4")
    body = x.astype("<u8").tobytes() + b"".join(struct.pack("<II", s, count - c) + states for s, c, states in reversed(marks)) + words.astype("<u4").tobytes()
    return struct.pack("<IIIII", n, lanes, count, len(marks), zlib.crc32(body)) + body


def decode_block(data: memoryview, table: Table, step: int = 0) -> tuple[np.ndarray, int]:
    """(ids from the last checkpoint at or before ``step`` on, bytes of the block)."""
    n, lanes, count, marks, crc = struct.unpack_from("<IIIII", data)
    size = 20 + lanes * 8 + marks * (8 + lanes * 8) + count * 4
    body = data[20:size]
    if zlib.crc32(body) != crc:
        raise ValueError("a block's checksum does not match")
    x = np.frombuffer(body, "<u8", lanes).astype(np.uint64)
    begin = word = 0
    for i in range(marks):
        at = lanes * 8 + i * (8 + lanes * 8)
        s, c = struct.unpack_from("<II", body, at)
        if s <= step:
            begin, word, x = s, c, np.frombuffer(body, "<u8", lanes, at + 8).astype(np.uint64)
    words = np.frombuffer(body, "<u4", count, size - 20 - count * 4)
    f, lo, bits, mask = table.freq, table.low, np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    ids = np.empty(n - begin * lanes, dtype=np.uint32)
    for at in range(0, len(ids), lanes):
        k = min(lanes, len(ids) - at)
        y = x[:k]
        slot = y & mask
        t = table.symbol[slot]
        ids[at : at + k] = t
        y[:] = f[t] * (y >> bits) + slot - lo[t]
        need = y < _LOW
        m = int(need.sum())
        if m:
            y[need] = (y[need] << np.uint64(32)) | words[word : word + m]
            word += m
    return ids, size


_tokenizers: dict = {}


class FileWriter:
    """Appends documents to one file; at most a block's tokens (or one longer document) are held."""

    def __init__(self, out, table: Table) -> None:
        self.out, self.table, self.at, self.tokens = out, table, 0, 0
        self.held: list[np.ndarray] = []
        self.n_held = self.docs_held = 0
        self.blocks: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self._put(MAGIC + struct.pack("<IIQ", len(table.freq), table.bits, table.crc))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, tokens: np.ndarray) -> None:
        if self.n_held and self.n_held + len(tokens) > BLOCK_TOKENS:
            self._flush()
        self.held.append(tokens)
        self.ids.append(doc_id)
        self.lengths.append(len(tokens))
        self.n_held, self.docs_held = self.n_held + len(tokens), self.docs_held + 1

    def _flush(self) -> None:
        if self.docs_held:
            self.blocks.append((self.at, self.tokens, self.docs_held))
            self._put(encode_block(np.concatenate(self.held), self.table))
            self.tokens += self.n_held
            self.held, self.n_held, self.docs_held = [], 0, 0

    def close(self) -> None:
        self._flush()
        per = [np.array(c, k).tobytes() for c, k in zip(zip(*self.blocks, strict=True) if self.blocks else ([], [], []), ("<u8", "<u8", "<u4"), strict=True)]
        docs = np.array([d or 0 for d in self.ids], "<i8").tobytes() + bytes(d is None for d in self.ids) + np.array(self.lengths, "<u8").tobytes()
        index = zlib.compress(b"".join(per) + docs, 6)
        self._put(index + struct.pack("<QIIIQI", self.at, len(index), len(self.ids), len(self.blocks), self.tokens, zlib.crc32(index)) + MAGIC)


class FileIndex:
    """The blocks and documents of one file, from its footer and index."""

    FOOTER = 32 + len(MAGIC)

    def __init__(self, f, size: int, table: Table | None = None) -> None:
        tail = f.read_at(self.FOOTER, size - self.FOOTER) if size >= self.FOOTER else b""
        if tail[-len(MAGIC) :] != MAGIC or f.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError("not a token file")
        at, n, docs, blocks, self.tokens, crc = struct.unpack_from("<QIIIQI", tail)
        raw = f.read_at(n, at)
        if zlib.crc32(raw) != crc:
            raise ValueError("the file's index is damaged")
        if table is not None and struct.unpack("<IIQ", f.read_at(16, len(MAGIC))) != (len(table.freq), table.bits, table.crc):
            raise ValueError("the file was written with another frequency table")
        index = zlib.decompress(raw)
        self.position, self.first = (np.frombuffer(index, "<u8", blocks, k * blocks * 8).astype(np.int64) for k in (0, 1))
        self.docs = np.frombuffer(index, "<u4", blocks, 16 * blocks).astype(np.int64)
        self.end = np.append(self.position[1:], at)
        index = index[20 * blocks :]
        self.ids = [None if z else d for d, z in zip(np.frombuffer(index, "<i8", docs).tolist(), index[8 * docs : 9 * docs], strict=True)]
        self.lengths = np.frombuffer(index[9 * docs :], "<u8").astype(np.int64)
        self.doc_at = np.concatenate([[0], np.cumsum(self.docs)])


def tokens_at(path: str, table: Table, start: int, n: int) -> np.ndarray:
    """n ids of a file from its token ``start`` on; only the blocks that hold them are read, from the checkpoint before."""
    fs, root = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(root) as f:
        index = FileIndex(f, f.size(), table)
        out, k = [np.zeros(0, np.uint32)], max(0, int(np.searchsorted(index.first, start, side="right")) - 1)
        while k < len(index.first) and index.first[k] < start + n:
            data = memoryview(f.read_at(int(index.end[k] - index.position[k]), int(index.position[k])))
            lanes = struct.unpack_from("<I", data, 4)[0]
            ids, _ = decode_block(data, table, max(0, start - int(index.first[k])) // lanes)
            stop = int(index.first[k + 1]) if k + 1 < len(index.first) else index.tokens
            base = stop - len(ids)
            out.append(ids[max(0, start - base) : max(0, start + n - base)])
            k += 1
    return np.concatenate(out)


#: The pre-tokenizer's pattern of this vocabulary format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Bytes that end an ASCII or Latin-1 letter are 1 and 3 (after the lead byte 0xC3), marks that no letter or contraction continues are 2.
_ENDS = np.zeros(256, np.uint8)
_ENDS[0x41:0x5B] = _ENDS[0x61:0x7B] = 1
_ENDS[[ord(c) for c in "!#$%&()*+,-./:;<=>?@|"]] = 2
_ENDS[0x80:0xC0] = 3
_BLANKS = bytes(32 if c in b"\t\n\v\f\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))


class WordTokenizer:
    """The tokenizers library for vocabularies that drop white space and letter case; one per Python worker.

    Words never cross white space, so a text's ids are those of its pieces between blanks, of which each is encoded
    once. A piece of characters below U+0250, whose lower case and composed form are the character's own, is cut as the
    vocabulary's pre-tokenizer does and its parts go to the library's BPE model; any other piece, and every piece of a
    vocabulary that is built otherwise, goes to the library whole.
    """

    PLAIN = re.compile("[\x21-\x7e\xa1-\u012f\u0131-\u024f]*")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.direct = steps == ["NFC", "Replace", "Lowercase"] and len(cuts) == 2 and cuts[0].get("pattern") == {"Regex": PATTERN} and cuts[1].get("type") == "ByteLevel"
        self.blank = len(self._ids("a  b")) == len(self._ids("a b")) == len(self._ids("a")) + len(self._ids("b"))
        self.kind = np.dtype("<u2" if vocabulary_size(path) <= 1 << 16 else "<u4")
        self.cut = regex.compile(PATTERN)
        self.bytes_as = {b: c for c, b in byte_symbols().items()}
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.int64)

    def _part(self, part: str) -> bytes:
        """The ids of one lower-case pre-token."""
        found = self.parts.get(part)
        if found is None:
            shown = part if part.isascii() else "".join(map(self.bytes_as.__getitem__, part.encode()))
            found = array(self.code, [t.id for t in self.tok.model.tokenize(shown)]).tobytes()
            if len(part) <= CACHED_CHARS:
                if len(self.parts) >= CACHED_WORDS:
                    self.parts = {}
                self.parts[part] = found
        return found

    def piece(self, piece: str) -> bytes:
        """The ids of what stands between two blanks; its ASCII letters are lower-case already."""
        if self.direct and piece.isascii() and piece.isalpha():
            return self._part(piece)
        if not self.direct or not self.PLAIN.fullmatch(piece) or any(map(piece.__contains__, self.special)):
            return self._ids(piece).astype(self.kind).tobytes()
        low = piece.lower()
        return self._part(low) if low.isalpha() else b"".join(map(self._part, self.cut.findall(low)))

    def encode(self, texts: pa.Array, end_id: int) -> pa.Array:
        """The ids of every text and the end id behind them, little-endian, ``kind`` wide; null is empty."""
        buf, offsets = tk.flat_bytes(texts)
        if not self.blank:
            ids = [np.append(self._ids(t or ""), end_id).astype(self.kind).tobytes() for t in texts.to_pylist()]
            return pa.array(ids, pa.binary())
        if self.direct and len(buf):  # a blank between a word and its punctuation: the pre-tokenizer cuts there too
            kind = _ENDS[buf]
            letter = kind == 1
            letter[1:] |= (kind[1:] == 3) & (buf[:-1] == 0xC3) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
            cut = np.flatnonzero(letter[:-1] & (kind[1:] == 2)) + 1
            if not any(s.encode() in buf.tobytes() for s in self.special):
                buf, offsets = np.insert(buf, cut, 0x20), offsets + np.searchsorted(cut, offsets, side="left")
        text = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(buf.tobytes().translate(_BLANKS))])
        split = pc.split_pattern(text, " ")
        coded = split.flatten().dictionary_encode()
        known, old, piece, ids = self.known, self.old, self.piece, []
        for p in coded.dictionary.to_numpy(zero_copy_only=False).tolist():
            found = known.get(p)
            if found is None:
                found = old.get(p) or piece(p)
                if len(p) <= CACHED_CHARS:
                    known[p] = found
            ids.append(found)
        if len(known) > CACHED_WORDS:
            self.old, self.known = known, {}
        ids.append(np.array([end_id], self.kind).tobytes())
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        ends = split.offsets.to_numpy().astype(np.int64)
        word = np.insert(coded.indices.to_numpy(), ends[1:], len(ids) - 1)  # each text's end id
        bounds = np.concatenate([[0], np.cumsum(size[word])[ends[1:] + np.arange(len(texts))]])
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(b"".join(map(ids.__getitem__, word.tolist())))])


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
        tk.release()
    return _tokenizers[path]


def write_tokens(docs: DataFrame, vocabulary: str, out: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> tuple[DataFrame, Table]:
    """Encode docs and write rANS files under ``out`` in ascending doc_id order (null first); (manifest, table).

    The manifest has a row per file: path, size, tokens and ``base``, the number of its first token. A null text is
    empty: only its end id. Rows that repeat an id are written next to each other, by text hash.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    symbols = vocabulary_size(vocabulary)
    symbols = max(symbols, end_id + 1)
    kind = "<u2" if vocabulary_size(vocabulary) <= 1 << 16 else "<u4"

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, total = tokenizer(vocabulary), np.zeros(symbols, np.int64)
        names, squeeze = ["doc_id", "tag", "ids", "symbol", "n"], pa.Codec("zstd").compress
        for b in tk.slices(batches, "text", SLICE_BYTES):
            ids = tok.encode(b.column("text"), end_id)
            flat, bounds = tk.flat_bytes(ids)
            total += np.bincount(flat.view(kind), minlength=symbols)
            packed = [squeeze(flat[x:y], asbytes=True) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tag"), pa.array(packed, pa.binary()), pa.nulls(len(ids), pa.int32()), pa.array(np.diff(bounds))], names)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.binary()), pa.array(at.astype(np.int32)), pa.array(total[at])], names)

    tagged = d.withColumn("tag", F.xxhash64(F.coalesce("text", F.lit(""))))
    stored_ids = stored(tagged.mapInArrow(tokenize, "doc_id long, tag long, ids binary, symbol int, n long"), "token-ids")  # n: bytes of the ids, or counts of the symbol
    counts = np.zeros(symbols, np.int64)
    for r in stored_ids.where("symbol IS NOT NULL").groupBy("symbol").agg(F.sum("n").alias("n")).collect():  # at most one row a symbol
        counts[r.symbol] = r.n
    table = Table.of_counts(counts)
    shared = spark.sparkContext.broadcast((table.freq.astype(np.uint32), table.bits))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, fs, root = Table(*shared.value), *pafs.FileSystem.from_uri(out)
        fs.create_dir(root, recursive=True)
        writer = draft = name = None
        files, expand = [], pa.Codec("zstd").decompress

        def finish() -> None:
            writer.close()
            writer.out.close()
            fs.move(draft, name)  # a repeated task puts the same bytes in the same place
            files.append((f"{out}/{os.path.basename(name)}", part, len(files), writer.at, writer.tokens))

        for b in batches:
            part = b.column("part")[0].as_py() if b.num_rows else None
            for doc_id, ids, n in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), b.column("n").to_pylist(), strict=True):
                if writer is None:
                    name, draft = f"{root}/part-{part:06d}-{len(files):04d}.rans", f"{root}/.{part:06d}-{uuid.uuid4().hex}"
                    writer = FileWriter(fs.open_output_stream(draft), own)
                writer.add(doc_id, np.frombuffer(expand(ids, n), kind).astype(np.uint32))
                if writer.tokens + writer.n_held >= FILE_TOKENS:
                    finish()
                    writer = None
        if writer is not None:
            finish()
        columns = zip(*files, strict=True) if files else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["path", "part", "k", "size", "tokens"])

    ordered = stored_ids.where("symbol IS NULL").select("doc_id", "tag", "ids", "n").repartitionByRange("doc_id", "tag").sortWithinPartitions("doc_id", "tag")
    written = stored(ordered.withColumn("part", F.spark_partition_id()).select("part", "doc_id", "ids", "n").mapInArrow(write, "path string, part int, k int, size long, tokens long"), "token-files")
    before = F.sum("tokens").over(Window.orderBy("part", "k").rowsBetween(Window.unboundedPreceding, -1))  # a row a file
    return stored(written.withColumn("base", F.coalesce(before, F.lit(0)).cast("long")), "token-manifest"), table


def vocabulary_size(path: str) -> int:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))])


def read_tokens(manifest: DataFrame, table: Table) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files, from the decoded ids; a row of work a block."""
    spark = manifest.sparkSession
    shared = spark.sparkContext.broadcast((table.freq.astype(np.uint32), table.bits))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Table(*shared.value)
        for b in batches:
            for path, size, base in zip(*(b.column(c).to_pylist() for c in ("path", "size", "base")), strict=True):
                fs, root = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(root) as f:
                    index = FileIndex(f, size, own)
                n = len(index.position)
                cut = [slice(x, y) for x, y in zip(index.doc_at[:-1], index.doc_at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * n, pa.string()), pa.array(index.position), pa.array(index.end - index.position), pa.array(index.first + base), pa.array([index.ids[c] for c in cut], pa.list_(pa.int64())), pa.array([index.lengths[c] for c in cut], pa.list_(pa.int64()))],
                    ["path", "at", "size", "first", "ids", "lengths"],
                )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Table(*shared.value)
        for b in batches:
            for path, at, size, first, ids, lengths in zip(*(b.column(c).to_pylist() for c in b.schema.names), strict=True):
                fs, root = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(root) as f:
                    flat, _ = decode_block(memoryview(f.read_at(size, at)), own)
                ends, n = np.cumsum(lengths), np.array(lengths)
                raw = memoryview(flat.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lengths, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(first + ends - n), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    work = manifest.select("path", "size", "base").mapInArrow(blocks, "path string, at long, size long, first long, ids array<long>, lengths array<long>")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # given, as rows of work are too small to be coalesced by size
    return work.repartition(tasks, F.xxhash64("path", "at")).mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def coded(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> DataFrame:
    """write_tokens into the shared folder, then read_tokens. An empty table gives no rows."""
    return read_tokens(*write_tokens(docs, vocabulary, fresh_path(docs.sparkSession, "rans"), id_col, text_col, end_id))
