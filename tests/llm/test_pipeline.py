"""The pipeline and the registered queries on the smallest tables, and odd inputs stage by stage."""

import os
import sys

import duckdb
import pytest
from helpers import make_docs, ugly_rows, with_clashes

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import corpus_pipeline  # noqa: E402
from check_oracles import TABLES, compare  # noqa: E402

from cartlens.llm.queries import ORACLES, QUERIES  # noqa: E402
from cartlens.session import materialise  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_operator_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in QUERIES
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5


@needs_tables
def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    before = docs.count()
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialise(stage(spark, docs, SF_DIR), "stage")
        if number + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == COLUMNS, name
            after = docs.count()
            assert 0.6 * before <= after <= before, name
            before = after
    assert docs.columns == [*COLUMNS, "copy", "shuffle_key"]


@needs_tables
def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF_DIR), "stage")
    want = sorted(map(tuple, docs.collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF_DIR).collect())) == want


@needs_tables
@pytest.mark.parametrize("number", range(5))
def test_stages_take_odd_rows(spark, number):
    _, stage = corpus_pipeline.STAGES[number]
    docs = with_clashes(make_docs(spark, ugly_rows()))
    if number < 4:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns and 0 < out.count() <= len(ugly_rows())
    else:
        assert stage(spark, docs, SF_DIR).count() > 0
    assert stage(spark, docs.where("false"), SF_DIR).count() == 0


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS FROM read_parquet('{SF_DIR}/{table}.parquet')")
    frame = QUERIES[name](spark, SF_DIR).toPandas()
    assert compare(frame, connection.execute(ORACLES[name]).fetchdf()) is None


@needs_tables
def test_native_operators_run_no_python(spark):
    for name in ("op3_line_dedup", "op6_license_scan", "op7_mixing", "op9_quality_rules"):
        plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan, name
