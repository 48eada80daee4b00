"""Cases in which an operator once did less than its whole job."""

import collections
import re

import numpy as np
import pytest

from wattline.llm import decontaminate, line_dedup, quality, queries, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("n", [50, 51, 55, 60])
def test_passages_in_mid_sentence_go(spark, n):
    passage = [f"p{i}" + "." * (i % 17 == 8) for i in range(n)]
    rows = [(i, " ".join([*(f"a{i}_{k}" for k in range(7 + i)), *passage, *(f"z{i}_{k}" for k in range(9))])) for i in range(4)]
    rows.append((9, " ".join(["only", *passage[:49], "short"])))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1] and got[9] == rows[-1][1]
    for i in (1, 2, 3):
        assert got[i] == " ".join([*(f"a{i}_{k}" for k in range(7 + i)), *(f"z{i}_{k}" for k in range(9))])


def test_a_phrase_of_an_earlier_document_hides_no_passage(spark):
    core = [f"c{i}" for i in range(30)]
    left, right = [f"l{i}" for i in range(15)], [f"r{i}" for i in range(15)]
    rows = [(0, " ".join(["x"] + core + ["y"])), (1, " ".join(left + core + right + ["end"])), (2, " ".join(["before"] + left + core + right))]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: rows[0][1], 1: rows[1][1], 2: "before"}


def test_words_equal_brute_force(spark):
    doc = {r.doc_id: WORD.findall(r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    first, own = {}, {}
    for i in sorted(doc):
        mine = own[i] = collections.Counter(tuple(doc[i][s : s + 50]) for s in range(len(doc[i]) - 49))
        for k in mine:
            first.setdefault(k, i)
    got = {r.doc_id: WORD.findall(r.text or "") for r in queries.op8_line_dedup(spark, SF).collect()}
    cut = 0
    for i, w in doc.items():
        gone = {p for s in range(len(w) - 49) if first[tuple(w[s : s + 50])] != i for p in range(s, s + 50)}
        if max(own[i].values(), default=0) < 2:  # repeats within a document: test_lines_equal_brute_force
            assert got[i] == [x for p, x in enumerate(w) if p not in gone]
            cut += bool(gone)
    assert cut > 5


def test_partial_quotes_and_shifted_words_are_found(spark):
    item = [f"tok{i}" for i in range(59)]
    short = [f"s{i}" for i in range(9)]
    fill = [f"f{i}" for i in range(40)]
    docs = {
        1: fill + item[10:40] + fill,  # half of the item
        2: fill + item[:30] + ["new"] + item[30:] + fill,  # a word inserted
        3: fill + item[:30] + item[31:],  # a word dropped
        4: fill + short[:4] + ["other"] + short[5:],  # 8 of 9
        5: ["s0", "x", "s2", "s3", "y", "s5", "s6", "z", "s8"],  # 6 of 9, no three in a row
        6: fill + item[:9] + fill + short[:5],
    }
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short))], "item_id long, text string")
    rows = decontaminate.overlaps(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string"), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.n_matched, r.first_token) for r in rows) == [(1, 1, 30, 30), (2, 1, 59, 40), (3, 1, 58, 40), (4, 2, 8, 40), (5, 2, 6, 0)]


@pytest.mark.parametrize("n", [13, 20, 30, 59])
def test_substituted_items_are_found(spark, n):
    """Each agreement of 60 % and more with a period of up to 8, and random ones."""
    rng, item = np.random.default_rng(n), [f"tok{i}" for i in range(n)]
    keeps = [np.resize([c >> i & 1 for i in range(p)], n).astype(bool) for p in range(2, 9) for c in range(1 << p)]
    keeps += [np.isin(np.arange(n), rng.permutation(n)[: int(np.ceil(share * n))]) for share in (0.6, 0.7, 0.8, 0.9, 1.0) for _ in range(40)]
    keeps = [k for k in keeps if k.sum() >= 0.6 * n]
    rows = [(i, " ".join([f"a{i}", *(w if k else f"other{i}" for w, k in zip(item, keep, strict=True)), "end"])) for i, keep in enumerate(keeps)]
    found = {r.doc_id: r for r in decontaminate.overlaps(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert len(found) == len(rows) and all(found[i].n_matched == k.sum() for i, k in enumerate(keeps))


def test_typographic_marks_end_tokens(spark):
    item = "naïve café söger åtta ฟ้า 中文 ½ three four five six"
    doc = "“naïve”—café…söger«åtta»ฟ้า、中文—½ three four five six"
    got = decontaminate.overlaps(spark.createDataFrame([(1, doc)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r.n_matched, r.n_tokens) for r in got] == [(11, 11)]


def test_fingerprints_are_sparse_and_guaranteed():
    """Two texts that share a run of the guaranteed length share a pick; picks are few, and no other choice of part would do."""
    rng = np.random.default_rng(1)
    same = rng.integers(1, 1 << 62, 50, dtype=np.uint64)
    picks, words = [], 0
    for k in range(200):
        h = np.concatenate([rng.integers(1, 1 << 62, 100 + k, dtype=np.uint64), same, rng.integers(1, 1 << 62, 90, dtype=np.uint64)])
        picks.append(set(line_dedup.fingerprints(h, np.array([0, len(h)]), 50)[3].tolist()))
        words += len(h)
    assert set.intersection(*picks) and sum(map(len, picks)) < words / 12
    start, pick, _ = line_dedup.windows(h, np.array([0, len(h)]), 50)
    parts = line_dedup.tk.ngram_hashes(h, 20).view(np.int64)
    assert all(pick[i] in parts[s : s + 31] and pick[i].view(np.uint64) == parts[s : s + 31].view(np.uint64).min() for i, s in enumerate(start))


@pytest.mark.parametrize("insult", ["zug", "xq", "blorgwit"])
def test_short_and_spelled_insults_are_scored(spark, insult):
    clean = ["the river runs slowly past a mill", "we ate bread and soup at noon", "her letter came back on monday", "trains leave every hour from here", "an old oak shades our garden wall"]
    texts = [(i, f"{clean[i % 5]} {clean[(i // 5) % 5]}" + f" {insult}" * (i % 2), i % 2) for i in range(100)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    model = toxicity.train(docs, docs.select("doc_id", "toxic"))
    assert insult.encode() in model.marks.words
    tests = [(0, clean[0]), (1, f"{clean[0]} {insult}"), (2, f"{clean[0]} {' '.join(insult)} now")]
    got = {r.doc_id: r.predicted for r in toxicity.score(spark.createDataFrame(tests, "doc_id long, text string"), model).collect()}
    assert got[0] == 0 and got[1] == 1, got
    assert len(insult) < 3 or got[2] == 1


def test_a_short_landmark_keeps_the_landmark_kernel():
    marks = toxicity.Landmarks([b"idiot", b"zug", b"xq", b"q"])
    rows, kernel = marks.kernel(toxicity.Tokens.of_words(marks.words), every=True)
    assert rows.tolist() == [0, 1, 2, 3] and np.allclose(np.diag(kernel), 1)
    assert toxicity.Landmarks([b"zug", b"xq"]).kernel(toxicity.Tokens.of_words([b"zug", b"xq", b"and"]))[0].tolist() == [0, 1]


def test_quality_probability_is_the_frequency_above_the_cap(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(4000):
        good = int(rng.random() < 6 / 7)
        sign = rng.random() < (0.7 if good else 0.2)
        rows.append((i, " ".join(["plain", "words", "zzyzx" if sign else "quuxo"] * 20), good, bool(sign)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int, sign boolean")
    model = quality.train(docs.where("doc_id < 3000"), docs.where("doc_id < 3000").select("doc_id", "quality"), sample=300)
    got = {r.doc_id: r.probability for r in quality.score(docs.where("doc_id >= 3000"), model).collect()}
    for sign in (True, False):
        some = [(got[i], good) for i, _, good, s in rows if i >= 3000 and s == sign]
        p, f = np.mean(some, axis=0)
        assert abs(p - f) < 0.08, (sign, p, f)


def test_texts_without_an_id_connect_documents(spark):
    from wattline.llm.ngram_join import near_duplicates

    base = [f"w{i}" for i in range(120)]
    half = [*base[:60], "one", *base[61:]]
    other = ["first", "second", *base[2:60], "one", *base[61:110], *(f"z{i}" for i in range(10))]
    rows = [(1, " ".join(base)), (None, " ".join(half)), (2, " ".join(other)), (None, "quite alone here with six words")]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [set(zip(*[w[k:] for k in range(5)], strict=False)) for w in (base, half, other)]
    assert [4 * len(a & b) >= 3 * len(a | b) for a, b in ((sets[0], sets[1]), (sets[1], sets[2]), (sets[0], sets[2]))] == [True, True, False]
    assert got[1, 116] == got[2, 116] == got[None, 116] == 1 and got[None, 2] is None


@pytest.mark.parametrize("hot", [3, 4096])
def test_dealt_hot_buckets_lose_no_link(spark, monkeypatch, hot):
    from wattline.llm import ngram_join

    monkeypatch.setattr(ngram_join, "HOT", hot)
    rng = np.random.default_rng(2)
    base, rows = [f"w{i}" for i in range(60)], []
    for i in range(150):
        words = base[:]
        for p in rng.integers(0, 60, i % 7):
            words[p] = f"x{i}_{p}"
        rows.append((i, " ".join(words)))
    sets = {i: set(zip(*[t.split()[k:] for k in range(5)], strict=False)) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in sets}
