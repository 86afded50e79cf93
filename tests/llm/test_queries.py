"""Registered queries against DuckDB, and the pipeline against its stages' own rules, on the driver's tables."""

import re
from pathlib import Path

import pytest

import corpus_pipeline
from compare import connect, differences
from geomatch.llm.common import read
from geomatch.llm.oracles import ORACLES
from geomatch.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_one_row_for_each_input_row(spark, name):
    table = {"op1": "pages", "op3": "conversations", "op6": "documents", "op7": "pages", "op9": "documents", "op13": "conversations"}.get(name.split("_")[0], "documents")
    rows = QUERIES[name](spark, SF_DIR)
    key = {"pages": "page_id", "documents": "doc_id", "conversations": "conv_id"}[table]
    found = {r[0] for r in rows.select(key).distinct().collect()}
    have = {r[0] for r in read(spark, SF_DIR, table).select(key).distinct().collect()}
    if name.startswith(("op9", "op11")):
        assert found <= have  # rows for contaminated documents only, and for the best of each item
    else:
        assert found == have | ({-7} if name.startswith("op3_") else set())


def test_pipeline_stages_take_effect(spark):
    docs = read(spark, SF_DIR, "documents")
    benchmark = [" ".join(re.findall(r"[^\W_]+", r.text.lower())) for r in read(spark, SF_DIR, "benchmark").collect()]
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "language_id", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, SF_DIR).persist()
        if name != "best_fit_packing":
            assert docs.columns == before.columns and docs.count() <= before.count()
            assert docs.exceptAll(before).count() == 0
        if name == "simhash_near_dedup":
            assert docs.select("text").distinct().count() == docs.count()
        if name == "benchmark_decontamination":
            texts = [" ".join(re.findall(r"[^\W_]+", r.text.lower())) for r in docs.collect()]
            assert not any(b in t for b in benchmark for t in texts)
            kept = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in docs.collect()} == kept
    assert corpus_pipeline.run(spark, SF_DIR).count() == docs.count()
