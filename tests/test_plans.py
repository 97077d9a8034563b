import re

import pytest
from pyspark.sql import functions as F

from linewarden.operators.chunks import hits_in_chunks
from linewarden.operators.correlate import correlate
from linewarden.operators.lines import with_language
from linewarden.operators.report import json_documents, sarif_documents, severity_counts
from linewarden.operators.responses import parse_responses
from linewarden.plans.audit import build_prompts, review, static_audit, static_hits, static_results
from linewarden.operators.prompts import chunk_hits


@pytest.fixture(scope="module")
def sources(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("t") / "sources")
    rows = [("a.c", "gets(x);", "unused"), ("b.txt", "gets(x);", "unused")]
    spark.createDataFrame(rows, "path string, content string, unread string").write.parquet(folder)
    return spark.read.parquet(folder)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_file_grain_work_never_shuffles(sources):
    for df in (
        static_hits(sources),
        static_audit(sources),
        static_results(sources),
        json_documents(static_results(sources)),
        sarif_documents(static_results(sources)),
        build_prompts(sources),
        parse_responses(build_prompts(sources).withColumnRenamed("prompt", "response")),
    ):
        text = plan(df)
        assert "Exchange" not in text and "Join" not in text and "Python" not in text
        assert "unread" not in text


def test_only_needed_columns_are_read(sources):
    text = plan(with_language(sources).groupBy("lang").count())
    assert "ReadSchema: struct<path:string>" in text
    assert "ReadSchema: struct<path:string,content:string>" in plan(severity_counts(static_audit(sources)))


def test_static_findings_are_never_high(sources):
    assert "FileScan" not in plan(static_audit(sources, minimum="high"))


def test_joins_are_equi_joins_on_spread_keys(spark, sources):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = static_hits(sources)
        chunks = chunk_hits(with_language(sources)).drop("hits", "content")
        responses = build_prompts(sources).withColumnRenamed("prompt", "response")
        joined = plan(hits_in_chunks(hits, chunks))
        reviewed = plan(review(responses, hits))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for text in (joined, reviewed):
        assert "NestedLoop" not in text and "Cartesian" not in text and "Broadcast" not in text
    assert re.search(r"SortMergeJoin \[path#\d+, block#\d+L?\]", joined)
    assert re.search(r"SortMergeJoin \[path#\d+, near_line#\d+L?\]", reviewed)
    # one shuffle per side: the distinct of the near lines already has the partitioning of the join
    assert reviewed.count("Exchange hashpartitioning") == 2


def test_null_lines_do_not_share_a_key(spark):
    rows = [("hot", i, 0, None, "e", "LOW") for i in range(2000)]
    found = spark.createDataFrame(rows, "path string, chunk_id int, seq int, line bigint, explanation string, confidence string")
    hits = spark.createDataFrame([("hot", 1)], "path string, line int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = correlate(found, hits).groupBy(F.spark_partition_id().alias("p")).agg(
            F.count("*").alias("n"), F.bool_or("corroborated").alias("near")
        ).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 8 and max(r["n"] for r in sizes) < 500 and not any(r["near"] for r in sizes)
