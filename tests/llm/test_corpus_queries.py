"""The registered queries on the smallest tables: against SQL where SQL expresses them, and the pipeline."""

import glob
import os

import duckdb
import pytest

import corpus_pipeline
from linewarden.llm import queries


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for file in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query(spark, sf, duck, name):
    frame = queries.QUERIES[name](spark, sf)
    result = duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    expected = rows(columns, result.fetchall())
    assert expected and rows(frame.columns, frame.collect()) == expected


NATIVE = ("op3_tool_calls", "op7_url_rules", "op9_quality_rules")


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans_have_no_python(spark, sf, name):
    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def test_toxicity_is_learned(spark, sf):
    labels = {r.doc_id: r.toxic for r in queries.table(spark, sf, "labels").collect()}
    got = queries.op5_toxicity(spark, sf).collect()
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)


def test_pipeline(spark, sf):
    docs = queries.table(spark, sf, "documents")
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        folder = corpus_pipeline.work_folder(spark, "test-stage")
        out = stage(spark, docs, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.dtypes == docs.dtypes
        out.write.parquet(folder)
        docs = spark.read.parquet(folder)
        sizes.append(docs.count())
    assert 200 > sizes[0] > sizes[1] >= sizes[2] > 0
    assert sizes[3] == sizes[4]
    assert corpus_pipeline.run(spark, sf).count() == sizes[4]
