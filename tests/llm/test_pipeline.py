import duckdb
from helpers import odd_documents
from test_packing import library
from test_secrets import plain_base
from test_simhash import brute_components, plain_fingerprint

import corpus_pipeline as pipeline
from tidemark.llm import decontaminate, secrets, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r[0]: r for r in duckdb.sql(f"SELECT doc_id, text, lang, source, n_chars FROM '{SF}/documents.parquet'").fetchall()}
    stages = dict(pipeline.STAGES)
    # toxicity: the model's own scores, document by document
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    left = {d: r for d, r in rows.items() if model.above(__import__("numpy").array([model.score(r[1])]))[0, 0] < toxicity.THRESHOLD}
    got = stages["toxicity"](spark, docs, SF)
    assert {r.doc_id for r in got.collect()} == set(left) and got.columns == docs.columns
    # near copies: all pairs
    fps = {d: plain_fingerprint(r[1]) for d, r in left.items()}
    root = brute_components(list(fps.values()), 4)
    least = {}
    for d in sorted(fps, reverse=True):
        least[root[fps[d]]] = d
    left = {d: left[d] for d in least.values()}
    got = stages["simhash_near_dedup"](spark, got, SF)
    assert {r.doc_id for r in got.collect()} == set(left) and got.columns == docs.columns
    # benchmark: all items
    items = [decontaminate.word_hashes(t) for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    left = {d: r for d, r in left.items() if all(
        sum(n for *_, n in decontaminate.tile(decontaminate.word_hashes(r[1]), i, 5)) < decontaminate.COVERAGE * len(i) for i in items)}
    got = stages["benchmark_decontamination"](spark, got, SF)
    assert {r.doc_id for r in got.collect()} == set(left) and got.columns == docs.columns
    # secrets: no base span is left, everything else stays
    got = stages["secret_scans"](spark, got, SF)
    clean = {r.doc_id: r for r in got.collect()}
    assert set(clean) == set(left) and got.columns == docs.columns
    for d, r in left.items():
        assert not plain_base(clean[d].text) and (clean[d].text == r[1] or secrets.spans_of(r[1])) and clean[d].n_chars == len(clean[d].text)
    packed = stages["best_fit_packing"](spark, got, SF).collect()
    assert sum(r.length for r in packed) == sum(len(library(r.text)) + 1 for r in clean.values())


def test_odd_documents_pass_all_stages(spark):
    docs = odd_documents(spark)
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == odd_documents(spark).columns
    assert {r.doc_id for r in pipeline.STAGES[-1][1](spark, docs, SF).collect()} == {1, 2, 5, 6}
    empty = odd_documents(spark).limit(0)
    for name, stage in pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0
