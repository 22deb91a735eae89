"""The pipeline's stages, each against what its operator says of its own input."""

import corpus_pipeline
from lattica.llm import jaccard_join, quality_classifier, quality_rules, secret_scan
from lattica.llm.common import materialize


def test_stages_take_effect(spark):
    d = "/root/testdata/sf0.01"
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "quality_rules", "jaccard_join", "secret_scan", "packing"]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    first = docs
    inputs = []
    for name, stage in corpus_pipeline.STAGES:
        inputs.append(docs)
        docs = materialize(stage(spark, docs, d), name)
        if name != "packing":
            assert docs.columns == first.columns
    ids = [{r["doc_id"] for r in x.select("doc_id").collect()} for x in inputs]

    voter = quality_classifier.fit(inputs[0], spark.read.parquet(f"{d}/labels.parquet"))
    assert ids[1] == {r["doc_id"] for r in quality_classifier.classify(inputs[0], voter).where("score >= 0.3").collect()}
    assert ids[2] == {r["doc_id"] for r in quality_rules.apply_rules(inputs[1]).where("kept").collect()}
    assert ids[3] == {r["component_id"] for r in jaccard_join.jaccard_components(inputs[2]).collect()}
    assert ids[4] == ids[3]
    assert secret_scan.find_secrets(inputs[4]).where("size(base) > 0").count() == 0
    assert secret_scan.find_secrets(inputs[3]).where("size(base) > 0").count() > 0
    assert {r["doc_id"] for r in docs.collect()} == ids[4]
    labels = spark.read.parquet(f"{d}/labels.parquet").where("quality = 1")
    good = {r["doc_id"] for r in labels.collect()} & ids[0]
    assert len(good & ids[1]) >= 0.99 * len(good)


def test_stages_on_nothing_and_odd_rows(spark):
    d = "/root/testdata/sf0.001"
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id string"
    odd = spark.createDataFrame([(None, None, None, None, None, None), (1, "", "", "", 0, ""), (1, None, None, None, None, "x"), (None, "some words " * 20, "en", "s", 1, "y")], schema)
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, d)
            assert out.count() <= 8
            if name != "packing":
                assert out.columns == docs.columns
