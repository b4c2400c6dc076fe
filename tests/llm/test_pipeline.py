"""The pipeline's stages, each on what the one before kept."""

import re

import corpus_pipeline
from trailspark.llm import decontaminate, toxicity
from tests.llm.test_pages import base
from tests.llm.test_search import linked


def test_stages(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, d).cache()
        assert docs.columns == columns
        kept[name] = (before.collect(), docs.collect())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "decontamination", "pii", "packing"]

    before, after = kept["toxicity"]
    model = toxicity.train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    scores = dict(zip((r.doc_id for r in before), model.scores([r.text or "" for r in before]), strict=True))
    assert {r.doc_id for r in after} == {r.doc_id for r in before if scores[r.doc_id] < 0.5}

    before, after = kept["ngram_join"]
    want = {c for _, _, c in linked([(r.doc_id, r.text) for r in before], 5, 80, 100)}
    assert {r.doc_id for r in after} == want and len(after) == len(want)

    before, after = kept["decontamination"]
    flat = lambda t: " " + " ".join(decontaminate.words(t)) + " "
    items = [flat(r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    leaked = {r.doc_id for r in before if any(x in flat(r.text) for x in items)}
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert leaked <= gone and len(gone) <= 1.1 * len(leaked) + 1

    before, after = kept["pii"]
    assert len(before) == len(after) and not any(base(r.text) for r in after)
    changed = {r.doc_id for r in after} & {r.doc_id for r in before if base(r.text)}
    assert all(re.search(r"\[(EMAIL|IP|CARD|PHONE|SECRET)\]", r.text) for r in after if r.doc_id in changed)
    assert all(r.n_chars == len(r.text) for r in after)

    packed = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in after}
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
