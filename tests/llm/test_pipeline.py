"""The pipeline, stage by stage, against brute force on a small fixture."""

import itertools

import corpus_pipeline
from tests.llm.test_operators import hit_by_brute_force, library_ids, shingles

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "sentencepiece"]
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        kept.append(docs.collect())
    assert set(docs.columns) >= {"doc_id", "ids"}
    good, single, clean, ids = kept
    sets = {r.doc_id: shingles(r.text) for r in good}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert {r.doc_id for r in single} == {find(i) for i in sets}
    assert {r.doc_id for r in clean} == {r.doc_id for r in single if not hit_by_brute_force(r.text, items)[3]}
    assert {r.doc_id: r.ids for r in ids} == {r.doc_id: library_ids(r.text) for r in clean}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == {r.doc_id for r in ids}


def test_pipeline_on_odd_tables(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, None, "en", "s", 0)], empty.schema)
    for docs in (empty, odd):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            assert docs.count() == 0
