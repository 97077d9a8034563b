"""Files of every size: listing, ranges, the same results for whole and tiny ranges, documents of fragments."""

import glob
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from linewarden.operators import documents
from linewarden.operators.chunks import chunk_files
from linewarden.operators.lines import explode_lines, with_language
from linewarden.operators import long_chunks
from linewarden.operators.long_chunks import line_chunks
from linewarden.operators.prompts import chunk_hits, prompts
from linewarden.operators.totals import running_total
from linewarden.plans import audit
from linewarden.sources.files import rejected_files, sources_from_files
from linewarden.sources.ranges import OPEN_BYTES, list_files, ranges_of, read_pieces, with_tasks

TINY = 64
LINES = ["gets(a);", "int f(int a)", "{", "}", "", "x.unwrap();", "é ü ß system(z);", "  strcpy(b, c); // ☃☃", "for (;;)", "a" * 150]


def text_of(rng, n, end="\n"):
    return "".join(rng.choice(LINES) + rng.choice([end, end, "\r\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    rng, root = random.Random(4), tmp_path_factory.mktemp("tree")
    files = {
        "a.c": text_of(rng, 150).encode(),
        "deep/er/.hidden/b.rs": text_of(rng, 60).encode() + b"x.unwrap();\r",
        "_under/.c.cpp": b"\xef\xbb\xbf" + text_of(rng, 80).encode(),
        "empty.cs": b"",
        "one line.c": b"gets(a); " * 40,
        "blank.c": b"\n" * 100,
        "bad.c": b"gets(a);\n" * 50 + b"\xff\n" + b"gets(b);\n" * 50,
        "small bad.c": b"\xff",
        "cut.c": ("é" * 200).encode()[:-1],
        "notes.txt": b"gets(a);\n" * 50,
    }
    for name, data in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    return root


def ordered(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_listing_has_hidden_and_empty_files_but_follows_no_links(spark, tree, tmp_path, monkeypatch):
    monkeypatch.setattr("linewarden.sources.ranges.LISTED", 2)
    os.symlink(tmp_path, tmp_path / "round")
    os.symlink(tree / "a.c", tmp_path / "linked.c")
    (tmp_path / "sub").mkdir()
    os.symlink("..", tmp_path / "sub" / "up")
    (tmp_path / "sub" / "own.c").write_text("x")
    assert ordered(list_files(spark, str(tmp_path)).drop("modified")) == [(f"file:{tmp_path}/sub/own.c", 1)]
    names = [os.path.relpath(p[5:], tree) for p, *_ in ordered(list_files(spark, str(tree)))]
    assert sorted(names) == sorted(
        ["a.c", "deep/er/.hidden/b.rs", "_under/.c.cpp", "empty.cs", "one line.c", "blank.c", "bad.c", "small bad.c", "cut.c"]
    )
    assert list_files(spark, str(tree), override="c").count() == 10
    assert list_files(spark, f"{tree}/.c*", f"{tree}/_*/.*.cpp", f"{tree}/*.cs", str(tree / "empty.cs")).count() == 2
    with pytest.raises(FileNotFoundError):
        list_files(spark, str(tree / "none"))


def test_pieces_are_the_files(spark, tree):
    for size in (11, 1 << 20):
        rows = read_pieces(list_files(spark, str(tree)), size).orderBy("path", "first_line").collect()
        texts = {}
        for r in rows:
            name = os.path.relpath(r["path"][5:], tree)
            assert r["first_line"] == texts.get(name, "").count("\n") + 1
            texts[name] = texts.get(name, "") + r["content"]
        whole = {n: (tree / n).read_bytes() for n in texts}
        assert {n: t.encode() for n, t in texts.items()} == whole
        assert sorted(texts) == sorted(["a.c", "deep/er/.hidden/b.rs", "_under/.c.cpp", "empty.cs", "one line.c", "blank.c"])
    reasons = {os.path.basename(r["path"]): r["reason"] for r in rejected_files(spark, str(tree), range_bytes=TINY).collect()}
    assert reasons == {"bad.c": "not UTF-8", "small bad.c": "not UTF-8", "cut.c": "not UTF-8"}


def test_marked_pieces_begin_behind_semicolons(spark, tree):
    rows = read_pieces(list_files(spark, str(tree / "a.c")), 16, mark=";").orderBy("first_line").collect()
    assert "".join(r["content"] for r in rows) == (tree / "a.c").read_bytes().decode() and len(rows) > 20
    assert all(";" in r["content"].rstrip("\n").rsplit("\n", 1)[-1] for r in rows[:-1])


def test_audits_are_the_same_for_whole_and_tiny_ranges(spark, tree):
    def results(size):
        hits = audit.static_hits_of_files(spark, str(tree), range_bytes=size)
        rows = audit.audit_files(spark, str(tree), range_bytes=size)
        flat = hits.select("path", "lang", F.col("line").cast("bigint"), "rule", "matched_text")
        texts = {}
        for r in documents.json_fragments(rows).orderBy(*documents.KEYS).collect():
            texts[r["file"]] = texts.get(r["file"], "") + r["text"]
        found = audit.static_audit(sources_from_files(spark, str(tree), range_bytes=size))
        files = with_language(sources_from_files(spark, str(tree), range_bytes=size)).where("first_line = 1")
        logs = {}
        for r in documents.sarif_fragments(files, found, str(tree)).orderBy(*documents.KEYS).collect():
            logs[r["file"]] = logs.get(r["file"], "") + r["text"]
        return ordered(flat), texts, logs

    whole, tiny = results(1 << 20), results(TINY)
    assert whole == tiny
    hits, texts, logs = tiny
    assert len(hits) > 80 and len(texts) == len(logs) == 6
    by_file = {name: json.loads(t) for name, t in texts.items()}
    assert by_file[f"file:{tree}/empty.cs"] == {"file": f"file:{tree}/empty.cs", "language": "C#/.NET", "findings": []}
    assert sum(len(d["findings"]) for d in by_file.values()) == len(hits)
    for name, log in logs.items():
        run = json.loads(log)["runs"][0]
        assert len(run["results"]) == len(by_file[name]["findings"])
        assert [r["id"] for r in run["tool"]["driver"]["rules"]] == sorted({f["category"] for f in by_file[name]["findings"]})


def test_one_document_over_many_tasks(spark, tmp_path):
    rows = [("a.c", c, s, s, "HIGH", "cat", f"{c}/{s}", 'e "q"', "s", "HIGH") for c in range(1500) for s in range(2)]
    found = spark.createDataFrame(
        rows[::-1],
        "path string, chunk_id int, seq int, line bigint, severity string, category string, pattern string, explanation string,"
        " suggestion string, confidence string",
    )
    files = with_language(spark.createDataFrame([("a.c", ""), ("b.c", ""), ("ä.rs", "")], "path string, content string"))
    fragments = documents.reviewed_json_fragments(files, found.repartition(5))
    out = str(tmp_path / "docs")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    documents.write_documents(fragments, out)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = sorted(glob.glob(out + "/part-*"))
    data = b"".join(open(p, "rb").read() for p in parts)
    index = {r["file"]: data[r["start"] : r["start"] + r["bytes"]] for r in documents.document_index(fragments).collect()}
    assert len(parts) > 2 and sum(map(len, index.values())) == len(data)
    docs = {name: json.loads(text) for name, text in index.items()}
    assert [f["pattern"] for f in docs["a.c"]["findings"]] == [f"{c}/{s}" for c in range(1500) for s in range(2)]
    assert docs["b.c"]["findings"] == [] and docs["ä.rs"]["language"] == "Rust"


def test_even_tasks(spark):
    sizes = [(f"f{i:05}.c", 40_000 + i % 7 * 1000) for i in range(10_000)] + [("g.c", 500_000_000)]
    files = spark.createDataFrame(sizes, "path string, length bigint").repartition(6)
    placed, n = with_tasks(ranges_of(files), 32 << 20)
    # Bytes, and the starts of files as ``OPEN_BYTES`` each.
    cost = F.sum(F.col("stop") - F.col("start") + F.when(F.col("start") == 0, OPEN_BYTES).otherwise(0))
    tasks = sorted(r["cost"] for r in placed.groupBy("task").agg(cost.alias("cost")).collect())
    assert len(tasks) == n and tasks[-1] <= 2 * tasks[len(tasks) // 2]
    assert sum(tasks) == sum(s + OPEN_BYTES for _, s in sizes)


def test_running_total(spark):
    rows = [(i * 7 % 101, i) for i in range(101)]
    got = running_total(spark.createDataFrame(rows, "k int, v bigint").repartition(5), "v", "before", "k").collect()
    by_key = dict(rows)
    assert {r["k"]: r["before"] for r in got} == {k: sum(by_key[j] for j in range(k)) for k in range(101)}
    assert running_total(spark.createDataFrame([], "k int, v bigint"), "v", "before", "k").collect() == []


def chunk_rows(df):
    return ordered(df.select("path", "lang", "chunk_id", F.col("start_line").cast("int"), "line_count", "content"))


def test_chunks_from_lines_equal_chunks_of_rows(spark):
    rng = random.Random(8)
    shapes = [0, 0, 1, 30, 30, 200, 2500, 6000, 7000]
    rows = [(f"{i}.c", "\n".join("x" * rng.choice(shapes) for _ in range(rng.randint(60, 200))) + "\n" * rng.choice([0, 1, 2])) for i in range(12)]
    rows += [("blank.c", "\n" * 7000), ("top.c", "\n" * 40 + "y" * 6500 + "\n" * 40 + "z\n")]
    files = with_language(spark.createDataFrame(rows, "path string, content string")).where("octet_length(content) > 6000")
    assert chunk_rows(line_chunks(explode_lines(files), block=10, fan=6)) == chunk_rows(chunk_files(files))


def test_blocks_hand_on_little(spark, tmp_path, monkeypatch):
    folders = []

    def folder(_, name):
        folders.append(f"{tmp_path}/{name}-{len(folders)}")
        return folders[-1]

    monkeypatch.setattr(long_chunks, "work_folder", folder)
    rows = [(f"{i}.c", "some words of a line\n" * (400 if i < 3 else 5)) for i in range(200)]
    files = with_language(spark.createDataFrame(rows, "path string, content string"))
    got = line_chunks(explode_lines(files), block=16, fan=4).groupBy("path").count().collect()
    assert sorted(r["count"] for r in got) == [1] * 197 + [2] * 3
    stored = [spark.read.parquet(f).select(F.length(F.to_json(F.struct("*"))).alias("n")).agg(F.count("n"), F.max("n")).first() for f in folders]
    # a row for each block of the long files alone, and no row with a number for each byte of the budget
    assert [n for n, _ in stored] == [197 + 3 * 25, 3 * 25, 3 * 7, 3 * 7, 3 * 2, 3 * 2, 3]
    assert max(m for _, m in stored) < 10_000


def test_functions_of_stretches(spark):
    rng = random.Random(3)
    for shapes in ([0, 1], [0, 30, 70], [0, 0, 200, 6000], [1, 2500, 5999, 6000, 6001], [6001, 6002, 0]):
        for slack in (0, 1):
            sizes = [rng.choice(shapes) for _ in range(90)]
            cuts = [0, 1, 40, 90]
            pieces = [long_chunks.block_pieces(sizes[a:b], slack) for a, b in zip(cuts, cuts[1:])]
            whole = long_chunks.composed(long_chunks.composed(*pieces[:2]), pieces[2])
            for before in (0, 1, 2, 500, 5929, 5998, 5999, 6000, 6001):
                used, full = before, 0
                for n in sizes:
                    closes = used > 0 and used + n + slack > 6000
                    full += closes
                    used = min(n if closes or not used else used + 1 + n, 6001)
                assert whole.at(before) == (used, full)


def test_chunks_and_prompts_of_files_of_every_size(spark, tmp_path):
    rng = random.Random(9)
    for i in range(5):
        body = [f"int fun{k}(int a) {{\n{text_of(rng, rng.choice([1, 20, 150, 900]))}}}\n" for k in range(rng.choice([0, 1, 4, 30]))]
        text = text_of(rng, rng.choice([0, 5])) + "".join(body) + text_of(rng, rng.choice([0, 600]))
        (tmp_path / f"{i}.{rng.choice(['c', 'cpp'])}").write_text(text)
    (tmp_path / "r.rs").write_text("".join(f"pub fn g{k}() {{\n{text_of(rng, 60)}}}\n\n" for k in range(40)))
    files = with_language(sources_from_files(spark, str(tmp_path)))
    got = audit.chunks_from_files(spark, str(tmp_path), keep_preamble=True, range_bytes=6000)
    assert chunk_rows(got) == chunk_rows(chunk_files(files, keep_preamble=True))
    columns = ["path", "lang", "chunk_id", "start_line", "line_count", "hit_count", "prompt"]
    whole = prompts(chunk_hits(files.drop("first_line", "whole"))).select(columns)
    assert ordered(audit.prompts_from_files(spark, str(tmp_path), range_bytes=6000).select(columns)) == ordered(whole)
    with pytest.raises(Exception, match="is in pieces"):
        audit.build_prompts(sources_from_files(spark, str(tmp_path), range_bytes=6000)).collect()
