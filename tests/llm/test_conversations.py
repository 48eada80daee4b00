"""The prefix trie and the structure repair against plain Python over the same conversations."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import defaultdict

import pytest

from wattline.llm import prefix_trie, structure_repair

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, n long, shard string, k1 string"


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def trie_by_force(rows: list[tuple]) -> list[tuple]:
    original = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            original[c].append((turn is not None, turn or 0, role or "", text or ""))
    original = {c: [x[2:] for x in sorted(v)] for c, v in original.items()}
    rebuilt = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = original.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]
    members, kids = defaultdict(list), defaultdict(set)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
            if d:
                kids[tuple(rebuilt[c][: d - 1])].add(tuple(rebuilt[c][:d]))

    def subtree(v):
        stack = [v]
        while stack:
            u = stack.pop()
            yield u
            stack += kids[u]

    out = []
    for v, m in list(members.items()):
        under = list(subtree(v))
        ends = [c for c in m if len(rebuilt[c]) == len(v)]
        saved = sum((len(members[u]) - 1) * (len(u[-1][1]) if u else 0) for u in under)
        out.append((m[0], len(v), members[v[:-1]][0] if v else None, len(m), len(kids[v]), sum(not kids[u] for u in under), saved, sha(",".join(map(str, ends)))))
    return sorted(out, key=repr)


def found(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def invented(seed: int, convs: int, most: int, kinds: int) -> list[tuple]:
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-150, 900), convs):
        for t in range(r.randint(1, most)):
            rows.append((c, t * 2, r.choice(["user", "assistant", "system", None]) if r.random() < 0.2 else ("user", "assistant")[t % 2], r.choice(["", None, "é😀"]) if r.random() < 0.1 else f"t{r.randrange(kinds)}."))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("convs", "most", "kinds", "width", "block"), [(300, 6, 1, 4, 2), (200, 12, 2, 10, 4), (60, 40, 1, 3, 3), (150, 9, 3, 6, 128)])
def test_trie_equals_brute_force(spark, convs, most, kinds, width, block):
    rows = invented(convs, convs, most, kinds) + [(None, 0, "user", "x")]
    df = spark.createDataFrame([(*x, 7, "s", "k") for x in rows], SCHEMA)  # the extra columns have names that the operator uses
    assert found(prefix_trie.shared_head_trie(df, width, block)) == trie_by_force(rows)


def test_trie_of_one_conversation_many_times_and_of_a_long_one(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(400) for t in range(3)] + [(777, t, "user", "ü" * (t % 3)) for t in range(300)]
    df = spark.createDataFrame([(*x, 7, "s", "k") for x in rows], SCHEMA)
    assert found(prefix_trie.shared_head_trie(df, 5, 16)) == trie_by_force(rows)


def test_trie_of_null_and_tied_turns(spark):
    rows = [(100, None, "user", "a"), (100, 3, "user", "b"), (101, 3, None, None), (101, None, "user", "a"), (205, 1, "user", "a"), (205, 1, "assistant", "a"), (205, 1, "assistant", "a")]
    df = spark.createDataFrame([(*x, 7, "s", "k") for x in rows], SCHEMA)
    assert found(prefix_trie.shared_head_trie(df, 2, 1)) == trie_by_force(rows)
    assert prefix_trie.shared_head_trie(df.limit(0)).count() == 0


def test_trie_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert found(prefix_trie.shared_head_trie(df)) == trie_by_force([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def damage(rows: list[tuple]) -> dict:
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        shown = [" " if x is None else x for x in (conv, turn, role, text)]
        kind = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        role, text = shown[2:]
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [] if kind == 0 else [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(v) for c, v in out.items()}


def faults(rows: list[tuple]) -> list[str]:
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip("\t\n\v\f\r ")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def price(letter: str, fault: str) -> int:
    return {"K": 0, "R": 3, "D": 4, "I": 3}[letter] + (3 if fault == "truncated" and letter in "KR" else 0)


def by_enumeration(rows: list[tuple]) -> tuple:
    """(cost, audit, repaired) over all edit strings with at most two insertions in a place."""
    fault = faults(rows)
    gap = [(), *((x,) for x in ("user", "assistant")), *itertools.product(("user", "assistant"), repeat=2)]
    best = None
    for gaps in itertools.product(gap, repeat=len(rows) + 1):
        for edits in itertools.product(("K", "D", "user", "assistant"), repeat=len(rows)):
            if any(f in ("blank", "duplicate") and e != "D" for f, e in zip(fault, edits)):
                continue
            out, audit, cost = [], "", 0
            for i, g in enumerate(gaps):
                out += [(r, "") for r in g]
                audit += "I" * len(g)
                cost += 3 * len(g)
                if i < len(rows):
                    letter = edits[i] if edits[i] in "KD" else "R"
                    audit += letter
                    cost += price(letter, fault[i])
                    if letter != "D":
                        out.append((rows[i][0] if letter == "K" else edits[i], rows[i][1]))
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, "\n".join(f"{r}:{t}" for r, t in out)
    return best


def forwards(rows: list[tuple]) -> tuple:
    """The same by a table of cheapest (cost, audit, roles) a state, from the front."""
    fault = faults(rows)
    to = {("", "u"): "u", ("", "s"): "s", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def insertions(table):
        for _ in range(3):
            for state, (cost, audit, out) in list(table.items()):
                for name in ("user", "assistant"):
                    if (state, name[0]) in to:
                        new = (cost + 3, audit + "I", (out, (name, "")))
                        if to[state, name[0]] not in table or new[:2] < table[to[state, name[0]]][:2]:
                            table[to[state, name[0]]] = new
        return table

    table = insertions({"": (0, "", None)})
    for (role, text), f in zip(rows, fault, strict=True):
        after: dict = {}

        def offer(state, new):
            if state not in after or new[:2] < after[state][:2]:
                after[state] = new

        for state, (cost, audit, out) in table.items():
            offer(state, (cost + 4, audit + "D", out))
            if f not in ("blank", "duplicate"):
                for letter, name in (("K", role), ("R", "user"), ("R", "assistant")):
                    if name[:1] == "" or (state, name[0]) in to:
                        offer(to[state, name[0]] if name else state, (cost + price(letter, f), audit + letter, (out, (name, text))))
        table = insertions(after)
    cost, audit, out = min((table[s] for s in ("", "a") if s in table), key=lambda x: x[:2])
    lines = []
    while out:
        out, (role, text) = out
        lines.append(f"{role}:{text}")
    return cost, audit, "\n".join(reversed(lines))


def repair_by_force(rows: list[tuple], best=forwards) -> list[tuple]:
    out = []
    for conv, live in damage(rows).items():
        turns = [t for known, t, _, _ in live if known]
        plain = [x[2:] for x in live]
        f = faults(plain)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(plain, plain[1:]))
        cost, audit, text = best(plain)
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal, cost, audit, sha(text)))
    return sorted(out, key=repr)


def broken(seed: int, convs: int, most: int) -> list[tuple]:
    r = random.Random(seed)
    texts = ["Yes.", "No!", "why? \n", "cut off", "", " \t", None, "a.b", "é…", "!"]
    rows = [(c, r.choice([None, t, t, t + r.randrange(3)]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown"]), r.choice(texts) if r.random() < 0.5 else f"text {r.random()}.") for c in r.sample([None, *range(-50, 5 * convs)], convs) for t in range(r.randint(1, most))]
    r.shuffle(rows)
    return rows


def test_both_brute_forces_agree():
    for seed in range(12):
        for live in damage(broken(seed, 3, 3)).values():
            plain = [x[2:] for x in live][:3]
            assert by_enumeration(plain) == forwards(plain)


@pytest.mark.parametrize(("seed", "convs", "most"), [(1, 400, 6), (2, 120, 30), (3, 6, 700)])
def test_repair_equals_brute_force(spark, seed, convs, most):
    rows = broken(seed, convs, most)
    df = spark.createDataFrame([(*x, 7, "s", "k") for x in rows], "conv_id long, turn long, role string, text string, n long, p string, fault string")
    assert found(structure_repair.audited(df)) == repair_by_force(rows)


def test_repaired_turns_are_legal_and_have_the_digest(spark):
    rows = structure_repair.coded(structure_repair.damaged(spark.createDataFrame(broken(5, 80, 90), "conv_id long, turn long, role string, text string"))).cache()
    turns = defaultdict(list)
    for r in structure_repair.repaired_turns(rows).orderBy("conv_id", "place").collect():
        turns[r.conv_id].append((r.role, r.text))
    for r in structure_repair.repaired(rows).collect():
        assert re.fullmatch("(s?(ua)+)?", "".join(role[:1] for role, _ in turns[r.conv_id]))
        assert sha("\n".join(f"{role}:{text}" for role, text in turns[r.conv_id])) == r.repaired_sha256
    assert rows.where("n > 64").count() > 0 and structure_repair.checkpoints(rows).count() > 0


def test_repair_of_long_text_dropped_and_empty(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "x"), (5, 1, "user", "y" * 300_000 + ". "), (5, 2, "assistant", " ." + " " * 300_000 + "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert found(structure_repair.audited(df)) == repair_by_force(rows)
    assert structure_repair.audited(df.limit(0)).count() == 0


def test_repair_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert found(structure_repair.audited(df)) == repair_by_force([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
