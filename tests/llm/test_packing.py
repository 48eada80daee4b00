"""The packing plan against exhaustive search, and the pieces against the tokenizers library."""

import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
from tokenizers import Tokenizer

from wattline.llm import packing
from wattline.llm.queries import vocabulary

SF = "/root/testdata/sf0.01"


def fewest(lengths: list[int], capacity: int) -> int:
    """By exhaustive search: each subset of pieces with the fewest sequences and the least in the last one."""
    n = len(lengths)

    @cache
    def best(left: int) -> tuple[int, int]:
        if not left:
            return 0, capacity
        found = (n + 1, 0)
        for i in range(n):
            if left >> i & 1:
                k, used = best(left ^ (1 << i))
                found = min(found, (k, used + lengths[i]) if used + lengths[i] <= capacity else (k + 1, lengths[i]))
        return found

    return best((1 << n) - 1)[0]


def held(plan: packing.Plan, counts: dict[int, int]) -> dict[int, list]:
    """Each sequence's (offset, length); every piece is placed once, none overlaps and none leaves a gap."""
    at, seen = defaultdict(list), Counter()
    for w, rank, count, sequence, offset in plan.runs:
        for i in range(count):
            seen[w, rank + i] += 1
            at[sequence + i].append((offset, w))
    assert seen == Counter({(w, r): 1 for w, n in counts.items() for r in range(n)})
    assert sorted(at) == list(range(plan.sequences))
    for places in at.values():
        end = 0
        for offset, w in sorted(places):
            assert offset == end
            end += w
        assert end <= plan.capacity
    return at


def test_reduction_keeps_a_best_packing():
    r = random.Random(1)
    fixed = 0
    for case in range(250):
        capacity = r.choice([10, 20, 50])
        lengths = [r.randint(*((1, capacity), (capacity // 4, capacity // 2 + 2), (capacity // 5, capacity))[case % 3]) for _ in range(r.randint(1, 10))]
        counts = Counter(lengths)
        plan = packing.Plan(counts, capacity)
        held(plan, counts)
        least = fewest(lengths, capacity)
        rest = [w for w, n in plan.rest.items() for _ in range(n)]
        assert plan.fixed + (fewest(rest, capacity) if rest else 0) == least
        assert plan.sequences <= -(-11 * least // 9) + 1
        fixed += plan.fixed
    assert fixed > 250


@pytest.mark.parametrize(("capacity", "most", "kinds"), [(2048, 500, 2048), (2048, 10**4, 300), (100, 3, 100)])
def test_plan_of_many(capacity, most, kinds):
    r = random.Random(capacity + most)
    counts = {r.randint(1, capacity): r.randint(1, most) for _ in range(kinds)}
    plan = packing.Plan(counts, capacity)
    if sum(counts.values()) < 10**6:
        held(plan, counts)
    assert plan.sequences >= -(-sum(w * n for w, n in counts.items()) // capacity)
    assert len(plan.runs) < capacity * capacity // 4


def test_plan_of_billions_is_made_by_runs():
    counts = {2048: 10**12, 1500: 10**11, 548: 7 * 10**10, 700: 3 * 10**10 + 1, 1: 5}
    plan = packing.Plan(counts)
    assert len(plan.runs) < 100 and sum(n for _, _, n, _, _ in plan.runs) == sum(counts.values())


def checked(docs, rows, capacity):
    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    tok.no_truncation()
    tok.no_padding()
    expected, places, sizes = Counter(), defaultdict(list), Counter()
    for doc_id, text in docs:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            expected[doc_id, k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
            sizes[len(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        end = 0
        for offset, n in sorted(p):
            assert offset == end
            end += n
        assert end <= capacity
    assert len(places) == packing.Plan(sizes, capacity).sequences


def test_edges(spark):
    docs = [(1, None), (1, None), (None, ""), (2, "a b " * 5000), (3, "Ünïcode 漢字 😀"), (4, "x" * 40000), (5, "hi"), (5, "hi")]
    df = spark.createDataFrame([(*d, 3, "p") for d in docs], "doc_id long, text string, rank int, part string").repartition(3)
    rows = packing.packed(df, vocabulary("word_bpe_49k.json"), 64)
    checked(docs, rows.collect(), 64)
    assert packing.packed(df.limit(0), vocabulary("word_bpe_49k.json")).count() == 0


def test_whole_table_and_its_sequences(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").repartition(7)
    placed = packing.packed(df, vocabulary("word_bpe_49k.json"), with_ids=True)
    rows = placed.collect()
    checked([(r.doc_id, r.text) for r in df.collect()], rows, 2048)
    whole = {r.sequence_id: r for r in packing.sequences(placed).collect()}
    assert sum(len(r.ids) for r in whole.values()) == 4 * sum(r.length for r in rows)
    for r in rows:
        assert zlib.crc32(whole[r.sequence_id].ids[4 * r.offset : 4 * (r.offset + r.length)]) == r.ids_crc32
    used = sum(r.length for r in rows)
    assert len(whole) <= 1.01 * used / 2048 + 1
