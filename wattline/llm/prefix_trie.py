"""The trie of conversation prefixes, from vertical bitmaps.

Every (position, turn) of a shard has a posting: the bitset of the conversations with that turn there. Below a node, the
turn that follows of the smallest conversation left gives a posting whose intersection with the node's bitset is a child;
depth-first, so a shard holds the bitsets of one path. Popcounts are members, and the members whose last turn a node has
are its end list.

A shard is a range of ``2**width_bits`` conversation ids and ``depth_block`` positions, so a turn, a conversation or a
prefix that a third of all rows share is cut over the shards and reaches the merge as one row a shard. Shards are merged
on a 128-bit key, the exclusive or of hashes of (position, turn); it has no order, so the key at the top of a later
block of positions is a sum over the blocks before. What is summed over a subtree is summed over members instead: a
node belongs to its smallest member, which then owns the whole rest of its path, so each shard adds up what its own
conversations own, and shards add.

Rows without conv_id are in no conversation. Null role and text are empty; rows of one turn number are ordered by role,
then by hash of the text; a null turn comes first. A repeated row is a turn of its own. Extra columns are ignored. An empty table has no nodes, not even a
root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import stored

WIDTH_BITS = 10
DEPTH_BLOCK = 128
#: Conversations whose ids share all but the last two digits may begin with the same turns: at most so many less one.
HEAD_TURNS = 6
KEY = ["k1", "k2"]
_LOCAL = "shard long, block long, k1 long, k2 long, i int, up int, depth long, entry boolean, n long, low long, chars long, ends array<int>, through array<int>"
_PART = "k1 long, k2 long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, p, h1, h2, chars): each turn's place from 1, two hashes of role and text, and the text's code points."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(11), text, role).alias("h2"), F.length(text).cast("long").alias("chars"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "h1", "h2")
    return d.select("conv_id", F.row_number().over(order).cast("long").alias("p"), "h1", "h2", "chars")


def with_shared_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): conversation c begins with the first h turns of c - c % 100, then has its own after its first h; h is crc32(c) % 6.

    turns are those of ``numbered``, conversations (conv_id, n) has the new number of turns, 0 included.
    """
    heads = turns.where((F.col("conv_id") % 100 == 0) & (F.col("p") < HEAD_TURNS)).groupBy(F.col("conv_id").alias("head")).agg(F.array_sort(F.collect_list(F.struct("p", "h1", "h2", "chars"))).alias("first"))
    convs = turns.groupBy("conv_id").agg(F.max("p").alias("own")).withColumns({"head": F.col("conv_id") - F.col("conv_id") % 100, "h": (F.crc32(F.col("conv_id").cast("string")) % HEAD_TURNS).cast("int")})
    convs = convs.join(heads, "head", "left").withColumn("first", F.coalesce(F.slice("first", 1, F.col("h")), F.expr("cast(array() AS array<struct<p: bigint, h1: bigint, h2: bigint, chars: bigint>>)")))
    convs = stored(convs.select("conv_id", "h", F.size("first").alias("k"), (F.greatest(F.col("own") - F.col("h"), F.lit(0)) + F.size("first")).cast("long").alias("n"), "first"), "trie-heads")
    head = convs.select("conv_id", "n", F.explode("first").alias("t")).select("conv_id", "n", "t.*")
    own = turns.join(convs.select("conv_id", "n", "h", "k"), "conv_id").where("p > h").select("conv_id", "n", (F.col("p") - F.col("h") + F.col("k")).alias("p"), "h1", "h2", "chars")
    return head.unionByName(own), convs.select("conv_id", "n")


def _bits(bitset: int) -> list[int]:
    out = []
    while bitset:
        low = bitset & -bitset
        out.append(low.bit_length() - 1)
        bitset ^= low
    return out


def _walk(width_bits: int, depth_block: int):
    def walk(key: tuple, t: pa.Table) -> pa.Table:
        shard, block = (k.as_py() for k in key)
        member, p, z1, z2, chars, n = (t.column(c).to_numpy() for c in ("member", "p", "z1", "z2", "chars", "n"))
        order = np.lexsort((z2, z1, p))
        member, p, z1, z2, chars, n = (a[order] for a in (member, p, z1, z2, chars, n))
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1]) | (z1[1:] != z1[:-1]) | (z2[1:] != z2[:-1])
        turn, first = np.cumsum(new) - 1, np.flatnonzero(new)
        top = block * depth_block
        postings = [0] * len(first)
        follows: list[dict[int, int]] = [{} for _ in range(depth_block + 2)]  # by position: the turn of each member
        alive, ended = [0] * (depth_block + 2), [0] * (depth_block + 2)
        for m, at, k, size in zip(member.tolist(), (p - top).tolist(), turn.tolist(), (n - top).tolist(), strict=True):
            postings[k] |= 1 << m
            follows[at][m] = k
            alive[at] |= 1 << m
            if size == at:
                ended[at] |= 1 << m
        t1, t2, tc = z1[first].tolist(), z2[first].tolist(), chars[first].tolist()
        out: list[tuple] = []
        everyone = alive[0]
        stack = [(0, k, everyone & postings[k], -1, 0, 0) for k in set(follows[0].values())]
        while stack:
            at, k, bits, up, k1, k2 = stack.pop()
            k1, k2, i = k1 ^ t1[k], k2 ^ t2[k], len(out)
            entry = at == 0 and block > 0
            ends = 0 if entry else bits & ended[at]
            rest = bits & alive[at + 1]
            through = bits & ~ended[at] if at == depth_block else 0
            out.append((shard, block, k1, k2, i, up, top + at, entry, bits.bit_count(), (shard << width_bits) + (bits & -bits).bit_length() - 1, tc[k], _bits(ends), _bits(through)))
            while rest:
                child = follows[at + 1][(rest & -rest).bit_length() - 1]
                own = bits & postings[child]
                stack.append((at + 1, child, own, i, k1, k2))
                rest &= ~own
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _ARROW, strict=True)], names=_NAMES)

    return walk


_ARROW = [pa.int64()] * 4 + [pa.int32(), pa.int32(), pa.int64(), pa.bool_()] + [pa.int64()] * 3 + [pa.list_(pa.int32())] * 2
_NAMES = [c.split()[0] for c in _LOCAL.split(", ")]


def _add_up(nodes: pa.Table, later: pa.Table) -> pa.Table:
    """What a shard's own conversations add to each node, subtree by subtree from below; ``later`` is what they own in later blocks."""
    d = {c: v for c, v in zip(nodes.column_names, (x.to_pylist() for x in nodes.sort_by("i").columns), strict=True)}
    carry = dict(zip(later.column("member").to_pylist(), zip(later.column("saved").to_pylist(), later.column("leaves").to_pylist(), strict=True), strict=True))
    size = len(d["i"])
    children = [0] * size
    leaves = [int(o and f and not e) for o, f, e in zip(d["own"], d["leaf"], d["entry"], strict=True)]
    saved = [0 if e else (n - o) * c for n, o, c, e in zip(d["n"], d["own"], d["chars"], d["entry"], strict=True)]
    for i in range(size - 1, -1, -1):
        for m in d["through"][i]:
            more = carry[m]
            saved[i], leaves[i] = saved[i] + more[0], leaves[i] + more[1]
        up = d["up"][i]
        if up >= 0:
            saved[up], leaves[up], children[up] = saved[up] + saved[i], leaves[up] + leaves[i], children[up] + d["own"][i]
    for i in range(size):
        if d["entry"][i]:  # the block before has these sums by the carry
            saved[i] = leaves[i] = 0
    parent = [d["glow"][u] if u >= 0 else None for u in d["up"]]
    columns = [d["k1"], d["k2"], d["depth"], d["glow"], parent, d["gn"], children, leaves, saved]
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in _PART.split(", ")])


def build(turns: DataFrame, convs: DataFrame, width_bits: int = WIDTH_BITS, depth_block: int = DEPTH_BLOCK) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of turns (conv_id, n, p, h1, h2, chars) and conversations (conv_id, n).

    nodes: key (k1, k2), conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens.
    ends: key, base, ends: the members that end at a node, as ascending distances from a shard's first id; a row a shard.
    """
    z = turns.select("conv_id", "n", "p", F.xxhash64("p", "h1", "h2").alias("z1"), F.xxhash64("h2", "p", "h1").alias("z2"), "chars", F.floor((F.col("p") - 1) / depth_block).alias("block"))
    blocks = stored(z.where(F.col("n") > depth_block).groupBy("conv_id", "n", "block").agg(F.bit_xor("z1").alias("z1"), F.bit_xor("z2").alias("z2"), F.sum("chars").alias("chars")), "trie-blocks")
    ahead = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    entries = blocks.select("conv_id", "n", (F.col("block") * depth_block).alias("p"), F.bit_xor("z1").over(ahead).alias("z1"), F.bit_xor("z2").over(ahead).alias("z2"), F.lit(0).cast("long").alias("chars"), "block").where("block > 0")
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", "n", zero.alias("p"), zero.alias("z1"), zero.alias("z2"), zero.alias("chars"), zero.alias("block"))
    shard, member = F.shiftright("conv_id", width_bits), F.col("conv_id").bitwiseAND((1 << width_bits) - 1).cast("int")
    rows = z.unionByName(entries).unionByName(roots).withColumns({"shard": shard, "member": member}).drop("conv_id")
    local = stored(rows.groupBy("shard", "block").applyInArrow(_walk(width_bits, depth_block), _LOCAL), "trie-local")

    whole = local.where("NOT entry").groupBy(*KEY).agg(F.sum("n").alias("gn"), F.min("low").alias("glow"), (F.sum("n") == F.sum(F.size("ends"))).alias("leaf"))
    known = stored(local.drop("ends").join(whole, KEY).withColumn("own", (F.col("low") == F.col("glow")).cast("int")), "trie-owners")
    owned = known.where("own = 1 AND NOT entry").groupBy(F.col("low").alias("conv_id"), "block").agg(F.sum("chars").alias("b"), F.sum(F.col("leaf").cast("int")).alias("l"))
    after = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    later = blocks.join(owned, ["conv_id", "block"], "left").fillna(0, ["b", "l"])
    later = later.select(shard.alias("shard"), "block", member.alias("member"), F.sum(F.col("chars") - F.col("b")).over(after).alias("saved"), F.sum("l").over(after).alias("leaves")).where("saved IS NOT NULL")
    parts = known.groupBy("shard", "block").cogroup(later.groupBy("shard", "block")).applyInArrow(_add_up, _PART)
    once, total = ("depth", "conv_id", "parent_conv_id", "n_convs"), ("n_children", "n_leaves", "saved_tokens")
    nodes = parts.groupBy(*KEY).agg(*(F.max(c).alias(c) for c in once), *(F.sum(c).alias(c) for c in total))
    return nodes, local.where(F.size("ends") > 0).select(*KEY, F.shiftleft("shard", width_bits).alias("base"), "ends")


def ends_digest(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256): of the ends' decimal ids, ascending and comma-joined. The hash runs on over a node's shards, of which one is held at a time."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, run = None, None
        done: list[tuple] = []
        for b in batches:
            for k1, k2, base, ends in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "base", "ends")), strict=True):
                text = ",".join(str(base + e) for e in ends)
                if (k1, k2) == at:
                    run.update(b"," + text.encode())
                    continue
                if at is not None:
                    done.append((*at, run.hexdigest()))
                at, run = (k1, k2), hashlib.sha256(text.encode())
            yield out(done)
            done = []
        if at is not None:
            yield out([(*at, run.hexdigest())])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        c = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string())], [*KEY, "ends_sha256"])

    return ends.repartition(*KEY).sortWithinPartitions(*KEY, "base").mapInArrow(digest, "k1 long, k2 long, ends_sha256 string")


def shared_head_trie(conversations: DataFrame, width_bits: int = WIDTH_BITS, depth_block: int = DEPTH_BLOCK) -> DataFrame:
    """The nodes of the conversations rebuilt with shared heads, each with the digest of its end list."""
    turns = stored(numbered(conversations), "trie-turns")
    nodes, ends = build(*with_shared_heads(turns), width_bits, depth_block)
    none = hashlib.sha256(b"").hexdigest()
    return nodes.join(ends_digest(ends), KEY, "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
