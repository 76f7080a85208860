"""The pipeline's stages on odd rows, on an empty table, and against what each operator says."""

import corpus_pipeline as cp
from airlake.llm import decontamination, mixing, near_dedup
from airlake.llm.common import documents
from airlake.sources.tables import load

from test_operators import ODD, SCHEMA


def test_stages(spark, sf):
    docs = documents(spark, sf)
    assert len(cp.STAGES) == 5
    out = {}
    for i, (name, stage) in enumerate(cp.STAGES):
        got = stage(spark, docs, sf)
        assert i == len(cp.STAGES) - 1 or got.columns == docs.columns
        out[name] = sorted(r.doc_id for r in got.select("doc_id").collect())
    every = {r.doc_id for r in docs.select("doc_id").collect()}
    assert len(out["language ID"]) >= 0.99 * len(every)
    assert out["near duplicates"] == sorted(r.doc_id for r in near_dedup.near_components(docs).filter("kept").collect())
    leaked = {r.doc_id for r in decontamination.leaks(docs, load(spark, sf, "benchmark")).collect()}
    assert set(out["decontamination"]) == every - leaked
    copies = [r.doc_id for r in mixing.mix(docs).selectExpr("doc_id", "explode(__mix_positions)").collect()]
    assert out["mixing"] == sorted(copies)
    assert out["sharding"] == sorted(every)


def test_odd_rows_and_empty(spark, sf):
    for rows in (ODD, []):
        docs = spark.createDataFrame(rows, SCHEMA)
        for _, stage in cp.STAGES:
            docs = stage(spark, docs, sf)
            assert docs.count() <= 2 * len(ODD)


def test_near_duplicates_of_repeated_and_missing_ids(spark):
    words = [[f"{x}{n}" for n in range(60)] for x in "abcde"]
    a, b, c, d, e = (" ".join(w) for w in words)
    near_a, near_b = (" ".join([*w[:-1], "other"]) for w in words[:2])
    rows = [(3, b), (5, a), (5, b), (None, b), (8, near_b), (7, d), (7, d), (None, e), (None, e), (9, ""), (9, None), (2, near_a), (6, c), (5, c)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1, None, None, None) for i, t in rows], SCHEMA)
    got = cp.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    want = [(3, b), (2, near_a), (7, d), (None, e), (9, ""), (9, None), (5, c)]
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, want))


def test_run(spark, sf):
    rows = cp.run(spark, sf).collect()
    assert rows and {r.law for r in rows} == {"key"}
