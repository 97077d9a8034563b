import json
import time

import pytest
from pyspark.sql import functions as F

from linewarden.functions.json_text import field, first_array, objects
from linewarden.operators.correlate import correlate, near_lines
from linewarden.operators.findings import CONFIDENCES, min_confidence, suppress, with_severity
from linewarden.operators.responses import decode_responses, parse_responses, rebase_lines, response_coverage, unreviewed_lines
from linewarden.plans import queries
from linewarden.plans.audit import build_prompts, review, review_sources, static_audit, static_hits

GOOD = {"line": 3, "severity": "HIGH", "category": "c", "pattern": "p", "explanation": "e", "suggestion": "s"}


def texts(spark, build, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string").select("i", build(F.col("t")).alias("r"))
    got = {r["i"]: r["r"] for r in df.collect()}
    return [got[i] for i in range(len(values))]


def test_first_array(spark):
    cases = {
        "no array": "no array",
        "x [1, [2]] y [3]": "[1, [2]]",
        '["]", "\\"]"] tail': '["]", "\\"]"]',
        "[1, [2]": "[1, [2]",
        '["open ] ': '["open ] ',
        'say "[" then [1]': '[" then [1]',
        "é[é]é": "[é]",
        "[\\]]]": "[\\]]",
        "[a\\": "[a\\",
        "a\n[1,\n2]\nb": "[1,\n2]",
        "😀[😀]😀": "[😀]",
    }
    assert texts(spark, first_array, list(cases)) == list(cases.values())


def test_objects(spark):
    cases = {
        "none": [],
        "{a} {b}": ["{a}", "{b}"],
        "{a{b}c}": ["{a{b}c}"],
        '{"}"}{"\\"}"}': ['{"}"}', '{"\\"}"}'],
        "[{a}, {b": ["{a}", "{b"],
        '" { x } " {y}': ["{ x }", "{y}"],
        "\\{a} \\\\{b}": ["{a}", "{b}"],
        '{a\\}b}': ["{a\\}b}"],
        "}{a}": ["{a}"],
        '{"open } ': ['{"open } '],
        "é{é}\n{\n}": ["{é}", "{\n}"],
    }
    assert texts(spark, objects, list(cases)) == list(cases.values())


def test_field(spark):
    cases = {
        '{"key": "v"}': "v",
        '{key = "v"}': "v",
        '{"key":"a \\"b\\" c", "x": "y"}': 'a "b" c',
        '{"key": ""}': None,
        "{key: v}": None,
        '{"other": "v"}': None,
        '{"key": "line\nbreak"}': "line\nbreak",
        '{"key": "back\\\\slash"}': "back\\slash",
        '{"key": "never closed \\"}': "never closed \\",
        '{"mykey": "v"}': "v",
    }
    assert texts(spark, lambda c: field(c, "key"), list(cases)) == list(cases.values())
    long = '{"key": "' + 'ab\\"' * 20000 + '"}'
    assert texts(spark, lambda c: field(c, "key"), [long])[0] == 'ab"' * 20000


def decode(spark, *answers):
    rows = [("f", i, a) for i, a in enumerate(answers)]
    df = spark.createDataFrame(rows, "path string, chunk_id int, response string")
    return [(r["parse_status"], r["answer"]) for r in decode_responses(df).orderBy("chunk_id").collect()]


def test_strict_answers(spark):
    got = decode(
        spark,
        "[]",
        json.dumps([GOOD]),
        json.dumps([{**GOOD, "line": None, "confidence": "HIGH", "extra": {"a": [1]}}]),
        json.dumps([{k: v for k, v in GOOD.items() if k != "line"}]),
        "Result: " + json.dumps([GOOD, {**GOOD, "line": 4294967295}]) + " done [1]",
    )
    assert [s for s, _ in got] == ["strict"] * 5
    assert got[0][1] == []
    assert tuple(got[1][1][0]) == (3, "HIGH", "c", "p", "e", "s", "LOW")
    assert tuple(got[2][1][0]) == (None, "HIGH", "c", "p", "e", "s", "HIGH")
    assert got[3][1][0]["line"] is None
    assert [f["line"] for f in got[4][1]] == [3, 4294967295]


@pytest.mark.parametrize(
    "change",
    [{"severity": 1}, {"pattern": None}, {"line": "3"}, {"line": 3.5}, {"line": 3.0}, {"line": -1}, {"line": 4294967296},
     {"confidence": "high"}, {"confidence": None}, {"line": True}, {"suggestion": ["s"]}],
)
def test_one_bad_item_rejects_the_array(spark, change):
    status, answer = decode(spark, json.dumps([GOOD, {**GOOD, **change}]))[0]
    assert status == "recovered" and len(answer) == 2 and answer[0]["confidence"] == "MEDIUM"


def test_missing_key_and_non_objects(spark):
    short = {k: v for k, v in GOOD.items() if k != "suggestion"}
    got = decode(spark, json.dumps([short]), "[1, 2]", "{}", json.dumps(GOOD), "")
    assert [s for s, _ in got] == ["recovered", "failed", "failed", "recovered", "failed"]
    assert got[0][1][0]["suggestion"] == "" and got[0][1][0]["line"] == 3


def test_recovered_answers(spark):
    got = decode(
        spark,
        '[{line: 7 severity: "LOW" type: "t" risk: "r" fix: "f"}, {Line = 9, category: "c"}]',
        '[{"line": "12", "description": "d \\"q\\""} {"severity": "HIGH"} {"pattern": "p"',
        '[{"category": "c" "pattern": "a { b }" "explanation": "x"}]',
    )
    assert [s for s, _ in got] == ["recovered"] * 3
    assert tuple(got[0][1][0]) == (7, "LOW", "t", "", "r", "f", "MEDIUM")
    assert tuple(got[0][1][1]) == (9, "MEDIUM", "c", "", "", "", "MEDIUM")
    assert [tuple(f) for f in got[1][1]] == [
        (12, "MEDIUM", "unknown", "", 'd "q"', "", "MEDIUM"),
        (None, "MEDIUM", "unknown", "p", "", "", "MEDIUM"),
    ]
    assert got[2][1][0]["pattern"] == "a { b }"


def test_answers_of_many_objects_are_read_in_proportion(spark):
    one = '{line: 7 severity: "LOW" type: "t" risk: "r {x} \\"q\\"" fix: "f"}'

    def seconds(n):
        start = time.perf_counter()
        [(status, answer)] = decode(spark, "é" + ", ".join([one] * n))
        assert status == "recovered" and len(answer) == n
        return time.perf_counter() - start

    seconds(10)
    few, many = seconds(400), seconds(3200)
    assert many < 12 * few + 1


def test_unreviewed_lines(spark):
    chunks = [("a.c", k, 1 + 10 * k, 10) for k in range(6)] + [("b.c", 0, 1, 3), ("b.c", 1, 4, 2), ("c.c", 0, 1, 5), ("d.c", 0, 1, 0)]
    answers = [("a.c", 0, "[]"), ("a.c", 3, "[]"), ("a.c", 1, None), ("c.c", 0, "[]"), ("c.c", 0, "[1]")]
    got = unreviewed_lines(
        spark.createDataFrame(chunks, "path string, chunk_id int, start_line int, line_count int"),
        spark.createDataFrame(answers, "path string, chunk_id int, response string"),
    )
    assert sorted(map(tuple, got.collect())) == [
        ("a.c", 11, 30, "partly reviewed"), ("a.c", 41, 60, "partly reviewed"), ("b.c", 1, 5, "unreviewed"),
    ]


def test_error_row(spark):
    status, answer = decode(spark, "é" * 500)[0]
    assert status == "failed"
    f = answer[0]
    assert (f["line"], f["severity"], f["category"], f["confidence"]) == (None, "INFO", "parse-error", "LOW")
    assert f["explanation"].endswith("Raw output: " + "é" * 400)


def found(spark, rows):
    return spark.createDataFrame(rows, "path string, chunk_id int, seq int, line bigint, explanation string, confidence string")


def test_correlation(spark):
    hits = spark.createDataFrame([("a", 10), ("a", 10), ("a", 1), ("b", 50)], "path string, line int")
    assert near_lines(hits).where("path = 'a'").count() == 10
    rows = [
        ("a", 0, 0, 12, "two away", "LOW"),
        ("a", 0, 1, 13, "three away", "LOW"),
        ("a", 0, 2, None, "no line", "MEDIUM"),
        ("a", 0, 3, 90, "sure", "HIGH"),
        ("c", 0, 4, 10, "other file", "MEDIUM"),
        ("a", 1, 0, 8, "two before", "MEDIUM"),
        ("a", 1, 1, 8, "again", "MEDIUM"),
    ]
    got = {r["explanation"]: (r["raw_confidence"], r["confidence"]) for r in correlate(found(spark, rows), hits).collect()}
    assert got == {
        "two away": ("LOW", "HIGH"),
        "three away": ("LOW", "MEDIUM"),
        "no line": ("MEDIUM", "MEDIUM"),
        "sure": ("HIGH", "HIGH"),
        "other file": ("MEDIUM", "MEDIUM"),
        "two before": ("MEDIUM", "HIGH"),
        "again": ("MEDIUM", "HIGH"),
    }


def test_hot_file_and_missing_lines_are_spread(spark):
    """Half of all findings in one file, most without a line: brute force agrees, no row is lost."""
    hits = [("hot", i * 7) for i in range(300)] + [("cold", 5)]
    rows = [("hot", i % 9, i, None if i % 3 else i % 500, f"e{i}", CONFIDENCES[i % 2]) for i in range(3000)]
    rows += [(f"f{i}", 0, i, i % 11, "x", "LOW") for i in range(3000)]
    got = correlate(found(spark, rows), spark.createDataFrame(hits, "path string, line int"))
    lines = {}
    for path, line in hits:
        lines.setdefault(path, []).append(line)

    def expect(path, line):
        return "HIGH" if line is not None and any(abs(line - h) <= 2 for h in lines.get(path, ())) else "MEDIUM"

    result = sorted((r["path"], r["chunk_id"], r["seq"], r["confidence"]) for r in got.collect())
    assert result == sorted((p, c, s, expect(p, n)) for p, c, s, n, _, _ in rows)


def test_rebase(spark):
    df = spark.createDataFrame([(1, 5), (101, 5), (101, None)], "start_line int, line bigint")
    assert [r["line"] for r in rebase_lines(df).collect()] == [5, 105, None]


def test_review_with_and_without_prompt_columns(spark):
    code = "int f(int a) {\n" + "x;\n" * 2500 + "}\nint g(int b) {\ngets(b);\n}\nint z;\n"
    sources = spark.createDataFrame([("a.c", code), ("b.rs", "ok\n")], "path string, content string")
    made = build_prompts(sources)
    assert made.count() == 3
    rows = [(r["path"], r["chunk_id"], r["start_line"], r["lang"]) for r in made.collect()]
    second = [r for r in rows if r[1] == 1][0]
    answers = [(p, c, json.dumps([{**GOOD, "line": 3}])) for p, c, _, _ in rows]
    responses = spark.createDataFrame(answers, "path string, chunk_id int, response string")
    slim = review(responses, static_hits(sources), made)
    wide = review(responses.join(made.select("path", "chunk_id", "lang", "start_line"), ["path", "chunk_id"]), static_hits(sources))
    direct = review_sources(sources, responses)
    expected = sorted(map(tuple, slim.collect()))
    assert expected == sorted(map(tuple, wide.collect())) == sorted(map(tuple, direct.collect()))
    by_key = {(r["path"], r["chunk_id"]): (r["line"], r["confidence"]) for r in slim.collect()}
    assert by_key[("a.c", 1)] == (second[2] + 2, "HIGH") and by_key[("b.rs", 0)] == (3, "MEDIUM")
    assert by_key[("a.c", 0)] == (3, "MEDIUM")
    assert review(responses, static_hits(sources), made, minimum="high").count() == 1
    with pytest.raises(ValueError, match="start_line"):
        review(responses, static_hits(sources))
    kept = response_coverage(made, responses.where("path = 'a.c'"))
    assert {(r["path"], r["status"]) for r in kept.collect()} == {("a.c", "answered"), ("b.rs", "missing")}


def test_confidence_levels(spark):
    df = spark.createDataFrame([(c,) for c in CONFIDENCES], "confidence string")
    assert [min_confidence(df, x).count() for x in ("low", "medium", "high")] == [3, 2, 1]
    with pytest.raises(ValueError):
        min_confidence(df, "sure")


def test_suppressions_and_severity(spark):
    sources = spark.createDataFrame([("a.c", "gets(x);\nsystem(y);"), ("b.c", "gets(x);")], "path string, content string")
    listed = spark.createDataFrame([("a.c", "gets"), ("a.c", "gets"), ("z", "q")], "path string, category string")
    left = suppress(static_audit(sources), listed)
    assert sorted((r["path"], r["category"]) for r in left.collect()) == [("a.c", "system-call"), ("b.c", "gets")]
    assert with_severity(static_audit(sources), "CRITICAL").count() == 3
    assert static_audit(sources, minimum="high").count() == 0


def test_parse_keeps_order(spark):
    answer = json.dumps([{**GOOD, "pattern": str(i)} for i in range(5)])
    df = spark.createDataFrame([("f", 0, answer), ("g", 0, None)], "path string, chunk_id int, response string")
    rows = parse_responses(df).orderBy("seq").collect()
    assert [(r["seq"], r["pattern"]) for r in rows] == [(i, str(i)) for i in range(5)]


def test_report_makes_answers_once(spark, tmp_path):
    texts = ["one line. two lines. " * 200, "short", "", None]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    report = queries.reviewed_report(spark, str(tmp_path))
    # answers, findings and gaps are stored tables: what is left reads files for their names alone
    assert "rlike" not in report._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {r["file"] for r in report.collect()} == {"doc/d0.c", "doc/d1.cpp", "doc/d2.cs", "doc/d3.rs"}


def test_review_cuts_no_matched_text_out_of_lines(spark, tmp_path):
    spark.createDataFrame([(0, "one line. two lines. " * 200)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def cut(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(code")

    assert cut(static_hits(queries.document_sources(spark, str(tmp_path)))) > 0
    # the lines' hits say where they are, and no more: the only matched texts are those of the answers
    assert cut(queries.document_review(spark, str(tmp_path))) == cut(queries.document_responses(spark, str(tmp_path)))
