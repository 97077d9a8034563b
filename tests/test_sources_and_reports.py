import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from linewarden.functions import labels
from linewarden.functions.text import detect_language
from linewarden.operators import report
from linewarden.operators.lines import explode_lines, with_language
from linewarden.plans.audit import audit_files, static_audit, static_hits_of_files, static_results
from linewarden.sources.files import lines_from_files, rejected_files, sources_from_files
from linewarden.sources.tables import spread
from linewarden.streaming.incremental import stream_files, write_increment


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "code"
    for name, data in {
        "a.c": b"gets(x);\r\nint y;\n",
        "sub/deep/b.rs": b"x.unwrap();",
        "sub/.hidden/h.c": b"system(z);",
        ".git.c": b"gets(x);",
        "bad.c": b"gets(\xff);",
        "notes.txt": b"gets(x);",
        "UPPER.C": b"gets(x);",
        "empty.cs": b"",
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return root


def names(df, column="path"):
    return sorted(os.path.basename(r[column]) for r in df.collect())


def test_detect_language(spark):
    cases = {
        "a/b.c": "C", "x.h": "C", "a.cpp": "C++", "a.cc": "C++", "a.cxx": "C++", "a.hpp": "C++", "a.hxx": "C++", "p.cs": "C#/.NET",
        "m.rs": "Rust", "A.C": None, "a.RS": None, ".c": None, "d/.c": None, "..c": "C", "a.c.txt": None, "a.tar.c": "C",
        "noext": None, "d.c/file": None, "a.": None,
    }
    df = spark.createDataFrame([(p,) for p in cases], "path string").select("path", detect_language(F.col("path")).alias("l"))
    assert {r["path"]: r["l"] for r in df.collect()} == cases


def test_directory_source(spark, tree):
    got = sources_from_files(spark, str(tree))
    assert names(got) == [".git.c", "a.c", "b.rs", "empty.cs", "h.c"]
    assert names(rejected_files(spark, str(tree))) == ["bad.c"]
    hidden = sources_from_files(spark, str(tree / "sub/.hidden"))
    assert names(hidden) == ["h.c"]
    every = sources_from_files(spark, str(tree), override="c")
    assert names(every) == [".git.c", "UPPER.C", "a.c", "b.rs", "empty.cs", "h.c", "notes.txt"]


def test_lines_of_split_files(spark, tmp_path):
    root = tmp_path / "big"
    root.mkdir()
    texts = {"one.c": "".join(f"line {i}\r\n" for i in range(5000)), "two.rs": "x.unwrap();\n\n" * 900 + "end", "bad.c": "ok\n" * 50}
    for name, text in texts.items():
        (root / name).write_bytes(text.encode() + (b"\xff\n" if name == "bad.c" else b""))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = lines_from_files(spark, str(root)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = sorted((os.path.basename(r["path"]), r["line"], r["code"]) for r in rows)
    expected = [(n, i, x) for n in ("one.c", "two.rs") for i, x in enumerate(texts[n].replace("\r", "").removesuffix("\n").split("\n"), 1)]
    assert got == sorted(expected)


def test_long_files_are_audited_like_short_ones(spark, tmp_path):
    root = tmp_path / "two parts+1"
    root.mkdir()
    (root / "short.c").write_text("gets(a);\n")
    (root / "long one.c").write_text("int x;\r\ngets(b);  system(c);\r\n" * 40)
    (root / ".hidden.c").write_text("gets(a);\n" * 40)
    columns = ["path", "line", "rule_ord", "rule", "matched_text"]
    whole = sorted(map(tuple, static_hits_of_files(spark, str(root)).select(columns).collect()))
    assert names(sources_from_files(spark, str(root))) == [".hidden.c", "long one.c", "short.c"]
    assert rejected_files(spark, str(root)).count() == 0
    assert sorted(map(tuple, static_hits_of_files(spark, str(root), range_bytes=100).select(columns).collect())) == whole
    assert len(whole) == 121


def test_single_files_and_empty_input(spark, tree, tmp_path):
    assert names(sources_from_files(spark, str(tree / "a.c"))) == ["a.c"]
    assert sources_from_files(spark, str(tree / "notes.txt")).count() == 0
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.txt").write_text("x")
    with pytest.raises(ValueError, match="no supported source files"):
        sources_from_files(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="unknown language"):
        sources_from_files(spark, str(tree), override="go")


def test_audit_files(spark, tree):
    rows = {os.path.basename(r["file"]): r for r in audit_files(spark, str(tree)).collect()}
    assert [f["category"] for f in rows["a.c"]["findings"]] == ["gets"]
    assert rows["empty.cs"]["findings"] == [] and rows["b.rs"]["language"] == "Rust"
    over = {os.path.basename(r["file"]): r for r in audit_files(spark, str(tree), override="c").collect()}
    assert over["notes.txt"]["language"] == "C" and len(over["notes.txt"]["findings"]) == 1


def test_stream_equals_batch(spark, tree, tmp_path):
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    schema_columns = ["path", "line", "category", "pattern"]

    def run():
        write_increment(stream_files(spark, str(tree), files_per_batch=1), out, mark).awaitTermination()
        return spark.read.parquet(out).select(schema_columns)

    listed = sources_from_files(spark, str(tree)).where("path NOT LIKE '%/.%'")
    batch = static_audit(listed).select(schema_columns)
    assert sorted(map(tuple, run().collect())) == sorted(map(tuple, batch.collect()))
    (tree / "new.c").write_text("strcpy(a, b);")
    assert run().count() == batch.count() + 1
    assert run().count() == batch.count() + 1


@pytest.fixture
def results(spark):
    sources = spark.createDataFrame(
        [("src/a.c", "gets(x);\nprintf(y);\n\nsystem(z); malloc(n);"), ("src/b.rs", "fn main() {}"), ("src/c.rs", 'e("q").unwrap();')],
        "path string, content string",
    )
    return static_results(sources)


def test_json(spark, results, tmp_path):
    docs = {json.loads(r["document"])["file"]: json.loads(r["document"]) for r in report.json_documents(results).collect()}
    assert docs["src/b.rs"] == {"file": "src/b.rs", "language": "Rust", "findings": []}
    assert [f["line"] for f in docs["src/a.c"]["findings"]] == [1, 2, 4, 4]
    assert [f["category"] for f in docs["src/a.c"]["findings"]][2:] == ["malloc-no-null-check", "system-call"]
    assert list(docs["src/c.rs"]["findings"][0]) == [
        "line", "severity", "category", "pattern", "explanation", "suggestion", "confidence",
    ]
    report.write_json(results, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3


def test_sarif(spark, results, tmp_path):
    logs = {r["file"]: json.loads(r["document"]) for r in report.sarif_documents(results).collect()}
    log = logs["src/a.c"]
    assert log["version"] == "2.1.0" and set(log) == {"$schema", "version", "runs"}
    run = log["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["gets", "malloc-no-null-check", "printf-format-string", "system-call"]
    assert run["tool"]["driver"]["rules"][1]["name"] == "MallocNoNullCheck"
    first = run["results"][0]
    assert first["level"] == "error" and first["rank"] == 60.0 and "fixes" not in first
    assert first["locations"][0]["physicalLocation"]["region"] == {"startLine": 1}
    assert logs["src/b.rs"]["runs"][0]["results"] == []
    report.write_sarif(results, str(tmp_path / "s"))
    lines = spark.read.text(str(tmp_path / "s")).collect()
    assert len(lines) == 3 and all(json.loads(r[0])["version"] == "2.1.0" for r in lines)


def test_one_sarif_log_over_many_parts(spark, tmp_path):
    rows = [(f"f{i:03}.c", "C", 0, i % 3, None if i % 5 == 0 else i, "HIGH", f"rule-{i % 4}", "p", "e", "fix" if i % 2 else "", "HIGH") for i in range(200)]
    columns = "path string, lang string, chunk_id int, seq int, line bigint, severity string, category string, pattern string, explanation string, suggestion string, confidence string"
    found = spark.createDataFrame(rows, columns).repartition(7)
    out = str(tmp_path / "log")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    report.write_sarif_log(found, out)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = sorted(glob.glob(out + "/part-*"))
    log = json.loads("".join(open(p).read() for p in parts))
    run = log["runs"][0]
    assert len(parts) > 1 and len(run["results"]) == 200
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["rule-0", "rule-1", "rule-2", "rule-3"]
    fixes = [r for r in run["results"] if "fixes" in r]
    assert len(fixes) == 100 and fixes[0]["fixes"] == [{"description": {"text": "fix"}}]
    empty = str(tmp_path / "empty")
    report.write_sarif_log(found.where("false"), empty)
    log = json.loads("".join(open(p).read() for p in sorted(glob.glob(empty + "/part-*"))))
    assert log["runs"][0]["results"] == [] and log["runs"][0]["tool"]["driver"]["rules"] == []


def test_summary_and_text(results):
    row = report.run_summary(results).collect()[0]
    assert tuple(row) == (3, 5, 2, 1, 1, 1)
    text = {r["file"]: r for r in report.file_report(results).collect()}
    assert text["src/b.rs"]["section"] == "[Rust] src/b.rs\n  No findings"
    assert "[CRITICAL] gets line 1 [medium]\n  Pattern   : gets(\n  Risk      : gets() reads" in text["src/a.c"]["section"]


def test_labels(spark):
    df = spark.createDataFrame([("use-after-move",), ("a",), ("",), ("x--y",), ("éa-bC",)], "s string")
    assert [r[0] for r in df.select(labels.pascal_case(F.col("s"))).collect()] == ["UseAfterMove", "A", "", "XY", "ÉaBC"]
    sev = spark.createDataFrame([(s,) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO", "odd")], "s string")
    assert [r[0] for r in sev.select(labels.sarif_level(F.col("s"))).collect()] == ["error", "error", "warning", "note", "note", "note"]


def test_reviewed_summary(spark):
    files = with_language(spark.createDataFrame([("a.c", ""), ("b.c", "")], "path string, content string"))
    rows = [("a.c", c, s, s, "HIGH", "cat", f"{c}/{s}", "e", "s", "HIGH") for c in range(25) for s in range(3)]
    found = spark.createDataFrame(
        rows[::-1],
        "path string, chunk_id int, seq int, line bigint, severity string, category string, pattern string, explanation string, suggestion string, confidence string",
    )
    assert tuple(report.reviewed_summary(files, found).collect()[0]) == (2, 75, 0, 75, 0, 0)
    assert tuple(report.reviewed_summary(files, found.where("false")).collect()[0]) == (2, 0, 0, 0, 0, 0)


def test_spread_leaves_wide_inputs_alone(spark):
    wide = spark.range(0, 100, 1, 16)
    assert spread(wide, 8) is wide and spread(spark.range(0, 10, 1, 1), 8).rdd.getNumPartitions() == 8


def test_split_lines_keep_a_last_carriage_return(spark, tmp_path):
    texts = {"cr.c": "gets(a);\r\ngets(b);\r", "crlf.c": "gets(a);\r\ngets(b);\r\n", "plain.c": "gets(a);\n\r", "long.c": "x\r\n" * 50 + "y\r"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    whole = explode_lines(with_language(sources_from_files(spark, str(tmp_path)))).select("path", "line", "code")
    split = lines_from_files(spark, str(tmp_path)).select("path", "line", "code")
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, whole.collect()))


def test_sarif_uris_are_relative_and_encoded(spark, tmp_path):
    found = spark.createDataFrame(
        [("file:/data/code/sp ace/a+b%.c",), ("/data/code/ü.c",), ("s3://b/x y.c",), ("src/a:b.c",), ("/data/codes/a.c",), (None,)], "path string"
    )
    uris = [r[0] for r in found.select(report.sarif_uri(found.path, "/data/code/")).collect()]
    assert uris == ["sp%20ace/a%2Bb%25.c", "%C3%BC.c", "s3://b/x%20y.c", "src/a%3Ab.c", "/data/codes/a.c", None]
    (tmp_path / "sp ace.c").write_text("gets(a);\n")
    results = audit_files(spark, str(tmp_path))
    for root, uri, base in ((str(tmp_path), "sp%20ace.c", "%SRCROOT%"), (None, f"file:{tmp_path}/sp%20ace.c", None)):
        log = json.loads(report.sarif_documents(results, root).collect()[0]["document"])
        place = log["runs"][0]["results"][0]["locations"][0]["physicalLocation"]["artifactLocation"]
        assert place["uri"] == uri and place.get("uriBaseId") == base
