"""Secret scans with structural confirmation.

Base kinds, leftmost and non-overlapping each: ``assign`` (a password-like name with a value), ``access``
(AKIA key ids) and ``hex`` (long lower-case hex runs). The method adds spans whose decoded content has
the structure of a key, so that plain long strings are not reported:

* ``jwt``    three dot-separated base64url parts whose first decodes to a JSON object with ``alg`` and
             whose second to a JSON object;
* ``pem``    a PEM block, with or without headers, whose base64 decodes to a DER SEQUENCE with consistent nested
             lengths, to an OpenSSH key, or to whole cipher blocks where the headers name a cipher;
* ``der``    a bare base64 or hex run, also wrapped at 64 or 76 characters, that decodes to such a SEQUENCE with at least two members;
* ``ssh``    a base64 run that decodes to length-prefixed strings which fill it, the first naming an
             SSH key type.

``scan`` returns one row per input row: doc_id, the number of base spans of each kind, a digest of the
base spans, all spans as text, and the number of confirmed spans. A null text is empty. Each text is
read once, whole; matching time is linear in it. Null or repeated ids and equal rows are kept as they are.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

BASE = ("assign", "access", "hex")
CONFIRMED = ("jwt", "pem", "der", "ssh")
_NAMES = re.compile("password|passwd|secret|token|api_?key", re.ASCII)
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{12,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----")
_END = re.compile(r"-----END ([A-Z0-9 ]+)-----")
_HEADER = re.compile(r"\s*[A-Za-z][A-Za-z0-9-]*:[^\n]*\n")
_CONTENT = re.compile(r"[A-Za-z0-9+/=\s]*")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{64}\r?\n|[A-Za-z0-9+/]{76}\r?\n)+[A-Za-z0-9+/]{1,76}={0,2}(?![A-Za-z0-9+/=])")
_SALT = re.compile(r"DEK-Info:\s*[A-Z0-9-]+,([0-9A-Fa-f]+)")
#: Key type names of the SSH wire format.
_SSH_TYPES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521", b"sk-ssh-ed25519@openssh.com", b"sk-ecdsa-sha2-nistp256@openssh.com")


def _unbase64(s: str) -> bytes | None:
    try:
        return base64.b64decode((s.replace("-", "+").replace("_", "/").rstrip("=") + "==="[: -len(s.rstrip("=")) % 4]).encode(), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_members(data: bytes, start: int, end: int) -> int | None:
    """The number of elements that exactly fill data[start:end], all constructed contents checked to any depth; else None."""
    count, todo = None, [(start, end)]
    while todo:
        at, stop = todo.pop()
        n = 0
        while at < stop:
            if stop - at < 2 or data[at] & 0x1F == 0x1F:
                return None
            tag, size, body = data[at], data[at + 1], at + 2
            if size & 0x80:
                k = size & 0x7F
                if not 1 <= k <= 4 or body + k > stop:
                    return None
                size, body = int.from_bytes(data[body : body + k], "big"), body + k
            if body + size > stop:
                return None
            if tag & 0x20 and size:
                todo.append((body, body + size))
            at, n = body + size, n + 1
        count = n if count is None else count
    return count


def is_der(data: bytes | None) -> bool:
    """Whether data is one SEQUENCE of at least two members with consistent nested lengths."""
    if not data or len(data) < 24 or data[0] != 0x30 or der_members(data, 0, len(data)) != 1:
        return False
    skip = 2 + (data[1] & 0x7F if data[1] & 0x80 else 0)
    return (der_members(data, skip, len(data)) or 0) >= 2


def _fields(data: bytes, at: int = 0) -> list[bytes] | None:
    """The length-prefixed strings that exactly fill data from ``at`` on; else None."""
    out = []
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 > len(data) or at + 4 + size > len(data):
            return None
        out.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return out


def _is_container(data: bytes) -> bool:
    """The OpenSSH container: cipher, kdf and its options, number of keys, each public key, the private part, all lengths nested."""
    at, parts = len(b"openssh-key-v1\0"), []
    for _ in range(3):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return False
        parts.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    keys = int.from_bytes(data[at : at + 4], "big")
    rest = _fields(data, at + 4) if at + 4 <= len(data) else None
    if not parts[0].isascii() or not rest or not 1 <= keys == len(rest) - 1 or not rest[-1]:
        return False
    return all((f := _fields(k)) is not None and len(f) >= 2 and f[0] in _SSH_TYPES for k in rest[:-1])


def is_ssh(data: bytes | None) -> bool:
    """Whether data is an SSH key: length-prefixed strings that fill it, first a key type, or the OpenSSH container."""
    if not data:
        return False
    if data.startswith(b"openssh-key-v1\0"):
        return _is_container(data)
    fields = _fields(data)
    return fields is not None and len(fields) >= 2 and fields[0] in _SSH_TYPES


def is_pem(headers: str, data: bytes | None) -> bool:
    """A key by its structure, or an encrypted one: its headers name a cipher and a whole vector, its content is whole blocks."""
    if is_der(data) or is_ssh(data):
        return True
    salt = _SALT.search(headers)
    return bool(data and salt and "ENCRYPTED" in headers and len(salt[1]) in (16, 32) and len(data) % (len(salt[1]) // 2) == 0)


def is_jwt(header: str, payload: str) -> bool:
    try:
        head, body = json.loads(_unbase64(header) or b""), json.loads(_unbase64(payload) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    if _NAMES.search(text.lower()):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


def _starts_object(part: str) -> bool:
    """Whether base64url text begins as a JSON object does, white space before it allowed."""
    head = _unbase64(part[:16])
    return bool(head) and head.lstrip()[:1] in (b"{", b"")


class _Covered:
    """Whether a place lies in one of disjoint spans in order."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]

    def __contains__(self, at: int) -> bool:
        k = bisect_right(self.starts, at) - 1
        return k >= 0 and at < self.ends[k]


def pem_blocks(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, headers, content) of each BEGIN with its END, nothing but header lines and base64 between them.

    A block reaches at most to the next BEGIN, so each BEGIN reads only up to there and the whole scan is linear; with several lines
    of colons between, only those before the base64 are headers.
    """
    if "-----BEGIN " not in text:
        return
    begins = list(_BEGIN.finditer(text))
    stops = [m.start() for m in begins[1:]] + [len(text)]
    for m, stop in zip(begins, stops, strict=True):
        at = m.end()
        while h := _HEADER.match(text, at, stop):
            at = h.end()
        body = _CONTENT.match(text, at, stop)
        end = _END.match(text, body.end(), stop)
        if end and end[1] == m[1]:
            yield m.start(), end.end(), text[m.end() : at], body[0]


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    if text.count(".") > 1:
        out += [(m.start(), m.end(), "jwt") for m in _JWT.finditer(text) if _starts_object(m[1]) and is_jwt(m[1], m[2])]
    blocks = []
    for start, end, headers, content in pem_blocks(text):
        if is_pem(headers, _unbase64("".join(content.split()))):
            out.append((start, end, "pem"))
            blocks.append((start, end))
    kind = lambda data: "der" if is_der(data) else "ssh" if is_ssh(data) else None
    inside = _Covered(blocks)
    more = []
    for m in _WRAPPED.finditer(text):
        if m.start() not in inside and (k := kind(_unbase64("".join(m[0].split())))):
            out.append((m.start(), m.end(), k))
            more.append((m.start(), m.end()))
    inside = _Covered(sorted(blocks + more))
    for m in _RUN.finditer(text):
        run = m[0]
        if m.start() in inside:  # part of a key already reported
            continue
        try:
            data = bytes.fromhex(run)
        except ValueError:
            data = _unbase64(run)
        if k := kind(data):
            out.append((m.start(), m.end(), k))
    return out


_ORDER = {k: i for i, k in enumerate((*BASE, *CONFIRMED))}


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], _ORDER[x[2]])))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tk.slices(batches, "text"):
            base = [base_spans(t or "") for t in b.column("text").to_pylist()]
            more = [confirmed_spans(t or "") for t in b.column("text").to_pylist()]
            counts = [pa.array([sum(k == kind for _, _, k in s) for s in base], pa.int64()) for kind in BASE]
            digest = [hashlib.sha256(_joined(s).encode()).hexdigest() for s in base]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, pa.array(digest), pa.array([_joined(x + y) for x, y in zip(base, more, strict=True)]), pa.array([len(y) for y in more], pa.int64())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long")
