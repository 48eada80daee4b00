"""The pipeline's stages on the small table: what each keeps follows from its own input."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stored(stage(spark, docs, SF), "test")
        assert out.columns == columns, name
        kept = {r.doc_id for r in out.collect()}
        assert kept <= seen and len(kept) > 0.5 * len(seen), name
        docs, seen = out, kept
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in last.collect()} == seen and all(len(r.ids) == r.n_tokens for r in last.collect())
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == seen
