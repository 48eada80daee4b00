"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names, for every operator."""

import random
import re

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wattline.llm import bpe, decontaminate, language, line_dedup, ngram_join, quality, rans, secrets, surrogates, toxicity

SCHEMA = "doc_id long, text string, lang string, tag string, key string, label int, seed long, n long"
LONG = " ".join(f"word{i % 977}" for i in range(30_000)) + "x" * 5_000
ROWS = [(1, None), (2, ""), (3, " \n\t"), (4, LONG), (5, "a b"), (5, "a b"), (None, "one two three four five six"), (6, "naïve café x\n\ny"), (7, LONG)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if i and i % 2 else None, "t", "k", 1, 2, 3) for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 1), (6, 0, 0), (4, None, None)], "doc_id long, quality int, toxic int")


def ids(df):
    return sorted((r.doc_id for r in df.collect()), key=str)


ALL = sorted((i for i, _ in ROWS), key=str)


def test_scan(docs, none):
    assert ids(secrets.scan(docs)) == ALL and secrets.scan(none).count() == 0


def test_codec(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    out = rans.coded(docs, path)
    assert ids(out) == ALL and {r.n_tokens for r in out.collect() if r.doc_id in (1, 2, 3)} == {1}
    assert rans.coded(none, path).count() == 0


def test_bpe(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert ids(bpe.round_trip(docs, path)) == ALL and bpe.round_trip(none, path).count() == 0
    back = {(r.doc_id, r.text) for r in bpe.decode(bpe.encode(docs, path), path).collect()}
    assert back == {(i, t or "") for i, t in ROWS}


def test_near_duplicates(docs, none):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()]
    assert sorted(g[0] for g in got if g[0] is not None) == sorted(i for i, _ in ROWS if i is not None)
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (5, 1, 5), (None, 2, None)} <= set(got)
    assert {c for i, _, c in got if i in (4, 7)} == {4}
    assert ngram_join.near_duplicates(none).count() == 0
    kept = ngram_join.one_per_group(docs)
    assert kept.columns == docs.columns and 7 not in ids(kept)


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([(1, "one two three four five six", "x"), (2, None, "y"), (3, "a b", "z")], "item_id long, text string, tag string")
    got = [(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench).collect()]
    assert got == [(None, 1)]
    assert decontaminate.overlaps(none, bench).count() == 0 and decontaminate.overlaps(docs, bench.limit(0)).count() == 0
    assert decontaminate.decontaminate(docs, bench).columns == docs.columns


def test_line_dedup(docs, none):
    out = line_dedup.dedup_lines(docs)
    assert ids(out) == ALL and out.columns == ["doc_id", "text", "lang", "tag", "key", "label", "seed", "n", "n_lines", "n_removed"]
    assert {r.doc_id: r.text for r in out.collect()}[7] == ""
    assert line_dedup.dedup_lines(none).count() == 0


def test_classifiers(docs, none, labels):
    for table in (docs, none):
        n = table.count()
        assert toxicity.score(table, toxicity.train(table, labels)).count() == n
        assert toxicity.drop_toxic(table, toxicity.train(table, labels.limit(0))).columns == table.columns
        assert quality.score(table, quality.train(table, labels)).count() == n
        assert language.predict(table, language.train(table)).count() == n
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, language.train(docs)).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)


def test_surrogates(spark, docs, none):
    assert ids(surrogates.pseudonymize(docs, "k")) == ALL and surrogates.pseudonymize(none, "k").count() == 0


def test_columns_with_the_names_that_operators_work_with(spark):
    import corpus_pipeline

    names = ("_low", "_name", "_again", "_gone", "_doc", "_tag", "_was", "_cut")
    rows = [(i, t, *(f"{n}{i}" for n in names), 5) for i, t in ((1, "You IDIOT. " + "w " * 60), (2, "w " * 70), (3, None))]
    df = spark.createDataFrame(rows, f"doc_id long, text string, {', '.join(f'`{n}` string' for n in names)}, n_chars long")
    model = toxicity.Model(toxicity.Landmarks([]), toxicity.np.zeros(0), 0.0, 0.0, -40.0)
    for out in (toxicity.drop_toxic(df, model), line_dedup.dedup_lines(df), corpus_pipeline.drop_repeated_lines(spark, df, "")):
        got = {r.doc_id: r for r in out.collect()}
        assert all(r[n] == f"{n}{i}" for i, r in got.items() for n in names) and got[1].text.startswith("You IDIOT.")


def test_labels_without_their_documents(spark):
    docs = spark.createDataFrame([(i, f"plain text {i}") for i in range(30)], "doc_id long, text string")
    for toxic, clean in (((100,), range(30)), (range(30), (100,)), ((100,), (101,))):
        labels = spark.createDataFrame([(i, 1) for i in toxic] + [(i, 0) for i in clean], "doc_id long, toxic int")
        scores = toxicity.score(docs, toxicity.train(docs, labels)).collect()
        assert len(scores) == 30 and not any(r.predicted for r in scores)


@pytest.mark.parametrize("line", ["a: -----BEGIN X-----\n", "-----BEGIN RSA PRIVATE KEY-----\n", "-----BEGIN X-----\nk: v\n", " \n\t\n", "-----END X-----\n", "x: y\n", "eyJhbGciOi.", "A" * 64 + "\n", "token = ", "-----BEGIN X----- ", "AKIA", "DEK-Info: A,"])
def test_scanning_takes_linear_time(line):
    from time import process_time

    text = line * (1_000_000 // len(line))
    began = process_time()
    secrets.base_spans(text), secrets.confirmed_spans(text)
    assert process_time() - began < 3


def test_forms_of_names(spark):
    said = ["Mr. McDonald came.", "Mr. O'Brien and O'Brien left.", "Mr. J. Smith met Smith.", "Mr. JOHN SMITH spoke", "Mr. de la Cruz paid, Cruz too.", "Dear Anna, hi", "Juan de la Cruz lives", "Frau von der Leyen sagte", "Mark my words, USA", "Mr. Smith saw the van in the USA."]
    hidden = [("McDonald",), ("O'Brien",), ("Smith", "J."), ("JOHN", "SMITH"), ("Cruz",), ("Anna",), ("Juan", "Cruz"), ("Leyen",), (), ("Smith",)]
    rows = surrogates.pseudonymize(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string"), "key").collect()
    for r in rows:
        assert not any(name in r.text for name in hidden[r.doc_id]) and (r.n_entities > 0) == bool(hidden[r.doc_id])
    text = {r.doc_id: r.text for r in rows}
    assert text[8] == said[8] and text[9].endswith(" saw the van in the USA.") and text[1].split()[1] == text[1].split()[3] and text[2].split()[-1][:-1] in text[2].split()[2]


def test_lines_are_counted_by_one_pattern(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice(" \t\n\x0b\f\r.!?abé") for _ in range(rng.randrange(14))) for _ in range(3000)]
    want = []
    for t in texts:
        words = list(re.finditer(r"[^ \t-\r]+", t))
        want.append(sum(not i or "\n" in t[words[i - 1].end() : w.start()] or words[i - 1].group()[-1] in ".!?" for i, w in enumerate(words)))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", line_dedup.line_count(F.col("t")).alias("n"))
    assert [r.n for r in df.orderBy("i").collect()] == want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_") + plan.count("RLIKE") == 1


def test_a_tokenizer_keeps_the_pieces_of_earlier_slices():
    tok = rans.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    asked = []
    tok.piece = lambda p: asked.append(p) or b"\x05\x00"
    slices = [pa.array([" ".join(f"w{i}" for i in range(at, at + 80_000))]) for at in range(0, 320_000, 80_000)]
    for _ in range(2):
        for s in slices:
            assert len(tok.encode(s, 1)[0].as_py()) == 2 * 80_001
    assert len(asked) == 320_000  # once each
