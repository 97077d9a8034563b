import random
import re
import time

import pytest
from pyspark.sql import functions as F

from linewarden.operators.chunks import FUNCTION_STARTS, chunk_files, function_starts, hits_in_chunks
from linewarden.operators.lines import explode_lines, with_language
from linewarden.operators.prompts import chunk_hits, hit_list, hit_lists, prompts
from linewarden.operators.scan import scan_lines


def chunk(spark, content, lang="C", **options):
    files = spark.createDataFrame([("f", lang, content)], "path string, lang string, content string")
    rows = chunk_files(files, **options).orderBy("chunk_id").collect()
    return [(r["start_line"], r["line_count"], r["content"]) for r in rows]


def test_small_file_is_unchanged(spark):
    assert chunk(spark, "fn main() {}\r\n", "Rust") == [(1, 1, "fn main() {}\r\n")]
    assert chunk(spark, "") == [(1, 0, "")]
    edge = "a" * 5999 + "\n"
    assert chunk(spark, edge) == [(1, 1, edge)]


def test_budget_counts_bytes(spark):
    text = "é" * 3000 + "\nx"
    assert chunk(spark, text) == [(1, 1, "é" * 3000), (2, 1, "x")]
    fits = "é" * 2999 + "\nx"
    assert chunk(spark, fits) == [(1, 2, fits)]


def test_lines_are_packed(spark):
    line = "let x = some_func().unwrap();"
    got = chunk(spark, (line + "\n") * 300, "Rust")
    # 30 bytes each: 200 lines make 5,999, and the next line would pass the budget
    assert got == [(1, 200, "\n".join([line] * 200)), (201, 100, "\n".join([line] * 100))]


def test_blank_lines_in_front_are_dropped_but_counted(spark):
    got = chunk(spark, "\n\n" + "a" * 5990 + "\n" + "b" * 20 + "\n")
    assert got == [(1, 1, "a" * 5990), (4, 1, "b" * 20)]
    assert chunk(spark, "\n" * 7000) == []


def test_line_over_budget_stays_whole(spark):
    got = chunk(spark, "x\n" + "y" * 9000 + "\nz\n")
    assert got == [(1, 1, "x"), (2, 1, "y" * 9000), (3, 1, "z")]


def body(name, size):
    return f"int {name}(int a)\n{{\n" + ";" * size + "\n}"


def test_functions_are_packed_and_the_preamble_is_lost(spark):
    parts = [body("one", 2000), body("two", 3000), body("three", 9000), body("four", 10)]
    text = "#include <x>\n\n" + "\n".join(parts) + "\n"
    got = chunk(spark, text)
    assert [(s, n) for s, n, _ in got] == [(3, 8), (11, 4), (15, 4)]
    assert got[0][2] == parts[0] + "\n" + parts[1]
    assert got[1][2] == parts[2] and got[2][2] == parts[3]
    kept = chunk(spark, text, keep_preamble=True)
    assert kept[0][0] == 1 and kept[0][2] == "#include <x>\n\n" + parts[0] + "\n" + parts[1]


def test_joining_newline_is_free_for_functions(spark):
    first, second = body("one", 2960), body("two", 3002)
    assert len(first) + len(second) == 6000
    text = first + "\n" + second
    assert chunk(spark, text) == [(1, 8, text)]


def test_one_function_is_not_enough(spark):
    got = chunk(spark, body("one", 100) + "\n" + "x;\n" * 3000)
    assert got[0][0] == 1 and len(got) == 2


def test_boundary_languages(spark):
    filler = "// " + "x" * 4000
    rust = f"\n\npub(crate) async fn a() {{\n{filler}\n}}\n\n  fn b() {{\n{filler}\n}}\n"
    assert [(s, n) for s, n, _ in chunk(spark, rust, "Rust")] == [(1, 5), (6, 4)]
    net = f"class A {{\n\n  public int F(int x)\n{filler}\n\tprivate List<int> G (\n{filler}\n}}\n"
    assert [(s, n) for s, n, _ in chunk(spark, net, "C#/.NET")] == [(2, 3), (5, 3)]
    marked = f"int a\u0001(int b) {{\n{filler}\n" + body("two", 10) + f"\n{filler}\n" + body("three", 10)
    assert [s for s, _, _ in chunk(spark, marked, "C++")] == [3]


def test_crlf_files(spark):
    text = ("a" * 100 + "\r\n") * 80
    got = chunk(spark, text)
    assert [(s, n) for s, n, _ in got] == [(1, 59), (60, 21)]
    assert "\r" not in got[0][2]


def test_large_single_parameter_list(spark):
    text = "int f(" + "int aaaaaaa, " * 20000 + "int z) {\n}\nint q;\nint g(int a) {\n}\n"
    assert [s for s, _, _ in chunk(spark, text)] == [1, 4]
    # the parameter list runs on to the last brace before a semicolon, so this is one function
    assert [s for s, _, _ in chunk(spark, text.replace("int q;", ""))] == [1, 2]


@pytest.fixture(scope="module")
def corpus(spark):
    line = {"C": "gets(a); strcpy(b, c);", "Rust": "x.unwrap();"}
    rows = []
    for lang, ext in (("C", "c"), ("Rust", "rs")):
        for size in (0, 1, 3, 400, 1500):
            content = "".join((line[lang] if i % 3 else "\n") + "\n" for i in range(size))
            rows.append((f"{size}.{ext}", content))
    return with_language(spark.createDataFrame(rows, "path string, content string"))


def test_interval_join_equals_rows(corpus):
    inside = chunk_hits(corpus)
    joined = hits_in_chunks(scan_lines(explode_lines(corpus)), inside.drop("hits", "content"), block=16)
    left = joined.groupBy("path", "chunk_id").agg(F.count("*").alias("n"))
    right = inside.where(F.size("hits") > 0).select("path", "chunk_id", F.size("hits").cast("bigint").alias("n"))
    assert sorted(map(tuple, left.collect())) == sorted(map(tuple, right.collect()))
    for relative in (True, False):
        a = hit_lists(joined, relative)
        b = inside.where(F.size("hits") > 0).select("path", "chunk_id", hit_list(F.col("hits"), F.col("start_line"), relative))
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_prompt_text(spark):
    files = spark.createDataFrame([("a.c", "C", "int x;\ngets(b);"), ("b.rs", "Rust", "ok")], "path string, lang string, content string")
    rows = {r["path"]: r for r in prompts(chunk_hits(files)).collect()}
    assert "  - Line 2: [CRITICAL] `gets` matched `gets(` — gets() reads" in rows["a.c"]["prompt"]
    assert "int x;\ngets(b);" in rows["a.c"]["prompt"] and "written in C." in rows["a.c"]["prompt"]
    assert "None detected." in rows["b.rs"]["prompt"] and rows["b.rs"]["hit_count"] == 0


ATOMS = {
    "C": ["int", "f", " ", "\n", "\n", "(", ")", "{", "}", ";", "*", "::", "const", "noexcept", "_a", "9", ",", " (", ") {", "int f(int a) {\n"],
    "Rust": ["pub", "fn", " ", "\n", "\n\n", "  ", "(crate)", "( crate )", "async", "fn f", "\t", "(", "pub fn a", "{", ";", "\npub(crate) async fn z"],
    "C#/.NET": ["public", "static", "int", "List<int>", " ", "\n", "\n\n", "  ", "F", "F(", "(", "\t", "{", "\n  public int G(", ";", "async "],
}


def test_function_starts_are_those_of_the_patterns(spark):
    rng = random.Random(1)
    atoms = ATOMS | {"C++": ATOMS["C"]}
    rows = [(lang, "".join(rng.choice(atoms[lang]) for _ in range(rng.randint(0, 30)))) for lang in atoms for _ in range(1500)]
    df = spark.createDataFrame(rows, "lang string, t string")
    got = df.select("lang", "t", function_starts(F.col("t"), F.col("lang")).alias("s")).collect()
    expected = [[r.t.count("\n", 0, m.start()) for m in re.finditer(FUNCTION_STARTS[r.lang], r.t)] for r in got]
    assert [list(r.s) for r in got] == expected and sum(map(bool, expected)) > 1000


@pytest.mark.parametrize(
    ("lang", "text"),
    [("C", "int foo bar baz\n" * 66_000), ("C", "  foo(bar)\nint q(a)\n" * 50_000), ("C#/.NET", "\n" * 1_000_000), ("Rust", "\n " * 500_000)],
)
def test_function_starts_are_linear(spark, lang, text):
    df = spark.createDataFrame([(lang, text)], "lang string, t string").select(F.size(function_starts(F.col("t"), F.col("lang"))))
    df.collect()
    start = time.perf_counter()
    assert df.collect()[0][0] == 0 and time.perf_counter() - start < 2
