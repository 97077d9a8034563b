import random
import re
from collections import Counter
from dataclasses import replace

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linewarden.functions.ambiguity import exponential
from linewarden.functions.required import required_texts
from linewarden.functions.text import split_lines
from linewarden.operators.scan import MAX_LITERAL_RULES, file_hits, scan_lines, scan_lines_by_join
from linewarden.sources.catalogue import Catalogue, Rule
from linewarden.sources.samples import FINDS

CATALOGUE = Catalogue.builtin()

def hits(spark, pairs):
    rows = [(f"f{i}", lang, 1, code) for i, (lang, code) in enumerate(pairs)]
    lines = spark.createDataFrame(rows, "path string, lang string, line int, code string")
    found = {}
    for r in scan_lines(lines, CATALOGUE).collect():
        found.setdefault(r["path"], {})[r["rule"]] = r
    return [found.get(f"f{i}", {}) for i in range(len(pairs))]


def test_catalogue_shape():
    counts = Counter((r.lang, r.severity) for r in CATALOGUE.rules)
    assert len(CATALOGUE.rules) == 83
    assert [len(CATALOGUE.of(x)) for x in ("C", "C++", "C#/.NET", "Rust")] == [20, 18, 25, 20]
    assert counts[("C#/.NET", "CRITICAL")] == 9 and counts[("Rust", "HIGH")] == 13
    assert {r.name for r in CATALOGUE.of("C")} == set(FINDS["C"])


def test_every_rule_finds_its_line(spark):
    cases = [(lang, rule, code) for lang, rows in FINDS.items() for rule, code in rows.items()]
    assert len(cases) == 83
    found = hits(spark, [(lang, code) for lang, _, code in cases])
    missed = [(lang, rule) for (lang, rule, _), hit in zip(cases, found) if rule not in hit]
    assert not missed
    severity = {(r.lang, r.name): r.severity for r in CATALOGUE.rules}
    assert all(hit[rule]["severity"] == severity[(lang, rule)] for (lang, rule, _), hit in zip(cases, found))


def test_harmless_lines_and_first_match(spark):
    found = hits(
        spark,
        [
            ("C", 'int main(void) { printf("%s", "x"); return 0; }'),
            ("Rust", 'fn main() { println!("x"); }'),
            ("C", "fgets(b, 9, f); mygets (b);"),
            ("C", "gets(a); gets  (b);"),
            ("C++", "int* b = new int[n * 4];"),
            ("C", "// gets(x) in a comment counts"),
        ],
    )
    assert found[0] == found[1] == found[2] == {}
    assert found[3]["gets"]["matched_text"] == "gets("
    assert set(found[4]) == {"raw-new-array", "integer-overflow-alloc"}
    assert "gets" in found[5]


def test_unicode_word_boundaries(spark):
    found = hits(spark, [("C", "égets(x)"), ("C", "gets (x)"), ("C#/.NET", "ſtring pwd"), ("C", "é gets(x)"), ("C#/.NET", 'PAſſword = "abcd"'), ("C#/.NET", "new random(")])
    assert found[0] == {} and found[2] == {}
    assert "hardcoded-password" in found[4] and "weak-prng" not in found[5]
    assert "gets" in found[1] and "gets" in found[3]


@pytest.mark.parametrize("lang", ["C", "C++", "C#/.NET", "Rust"])
def test_needles_never_hide_a_match(lang):
    for rule in CATALOGUE.of(lang):
        assert rule.needles and all(n == n.lower() for n in rule.needles)
        check_needles(rule)


def check_needles(rule):
    @settings(max_examples=25, deadline=None, phases=[Phase.generate], suppress_health_check=list(HealthCheck))
    @given(st.from_regex(re.compile(rule.regex)))
    def check(text):
        assert any(n in text.replace("ſ", "s").lower() for n in rule.needles), (rule.name, text)

    check()


def test_three_scan_forms_agree(spark):
    samples = [(r.lang, s) for r in CATALOGUE.rules for s in (FINDS[r.lang][r.name], FINDS[r.lang][r.name].upper(), "x" + FINDS[r.lang][r.name] * 2)]
    rows = [(f"f{i % 7}", lang, i, code) for i, (lang, code) in enumerate(samples)]
    lines = spark.createDataFrame(rows, "path string, lang string, line int, code string")
    columns = ["lang", "line", "rule_ord", "rule", "severity", "description", "matched_text"]
    literal = sorted(map(tuple, scan_lines(lines, CATALOGUE).select(columns).collect()))
    assert len(literal) >= 83 * 2
    unguarded = Catalogue(tuple(replace(r, needles=()) for r in CATALOGUE.rules))
    for catalogue in (CATALOGUE, unguarded):
        assert sorted(map(tuple, scan_lines_by_join(lines, catalogue).select(columns).collect())) == literal
    assert sorted(map(tuple, scan_lines(lines, unguarded).select(columns).collect())) == literal
    files = spark.createDataFrame([(str(i), lang, code) for i, (lang, code) in enumerate(samples)], "path string, lang string, content string")
    inside = file_hits(files, CATALOGUE).select("path", "lang", F.explode("hits").alias("h")).select(
        "lang", F.col("path").cast("int").alias("line"), *[f"h.{c}" for c in columns[2:]]
    )
    assert sorted(map(tuple, inside.collect())) == literal


def test_user_rules(spark):
    mine = [
        {"lang": "C", "name": "todo", "regex": "TODO.*", "severity": "LOW", "description": "d"},
        {"lang": "C", "name": "broken", "regex": "(", "severity": "LOW", "description": "d"},
        {"lang": "C", "name": "ahead", "regex": "a(?=b)", "severity": "LOW", "description": "d"},
        {"lang": "C", "name": "quote'd", "regex": r"it's\\ok", "severity": "LOW", "description": "it's"},
        {"lang": "C", "name": "empty", "regex": "q*", "severity": "LOW", "description": "d"},
    ]
    catalogue = CATALOGUE.with_rules(spark, mine)
    assert [r[1] for r in catalogue.rejected] == ["broken", "ahead"]
    assert catalogue.rejected_df(spark).count() == 2
    assert catalogue.of("C")[20].rule_ord == 21
    lines = spark.createDataFrame([("a", "C", 1, "x // TODO me  "), ("a", "C", 2, r"it's\ok")], "path string, lang string, line int, code string")
    found = {(r["line"], r["rule"]): r["matched_text"] for r in scan_lines(lines, catalogue).collect()}
    assert found == {(1, "todo"): "TODO me", (2, "quote'd"): r"it's\ok", (1, "empty"): "", (2, "empty"): ""}
    with pytest.raises(ValueError, match="duplicate"):
        CATALOGUE.with_rules(spark, [{**mine[0], "name": "gets"}])
    with pytest.raises(ValueError, match="language"):
        CATALOGUE.with_rules(spark, [{**mine[0], "lang": "Go"}])


def test_large_catalogue_uses_the_join(spark):
    many = [Rule("C", f"r{i}", f"word{i}\\b", "LOW", "d") for i in range(MAX_LITERAL_RULES)]
    catalogue = CATALOGUE.with_rules(spark, many)
    lines = spark.createDataFrame([("a", "C", 1, "word7 word77 gets(")], "path string, lang string, line int, code string")
    assert {r["rule"] for r in scan_lines(lines, catalogue).collect()} == {"gets", "r7", "r77"}


def test_thousands_of_rules_meet_only_by_grams(spark):
    words = [f"{a}{b}{c}" for a in ("get", "put", "do", "x") for b in ("_", ".", "") for c in range(420)]
    many = [Rule("C", f"r{i}", rf"\b{re.escape(w)}\s*\(", "LOW", "d") for i, w in enumerate(words)]
    many += [Rule("C", f"two{i}", rf"(alpha{i}|beta{i});", "LOW", "d") for i in range(5)] + [Rule("C", "digits", r"\d{7}", "LOW", "d")]
    catalogue = Catalogue(tuple(replace(r, rule_ord=i) for i, r in enumerate(many, 1)))
    assert len(catalogue.rules) > 5_000
    rng = random.Random(2)
    pieces = [w + rng.choice(["(", " (", "x(", ";"]) for w in rng.sample(words, 300)] + ["alpha1;", "beta1;", "alpha3; beta3;", "1234567", "ab"]
    codes = [" ".join(rng.choice(pieces) for _ in range(rng.randint(0, 6))) for _ in range(400)]
    lines = spark.createDataFrame([("f", "C", i, c) for i, c in enumerate(codes)], "path string, lang string, line int, code string")
    joined = scan_lines(lines, catalogue)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = sorted((r["line"], r["rule_ord"], r["matched_text"]) for r in joined.collect())
    patterns = [(r.rule_ord, re.compile(r.regex)) for r in catalogue.rules]
    expected = [(i, n, m.group().strip()) for i, c in enumerate(codes) for n, p in patterns if (m := p.search(c))]
    assert got == sorted(expected) and len(got) > 300


def test_grams_are_found_once_and_in_one_pass(spark, monkeypatch):
    words = ["gets", "é☃", "😀", "a😀b", "x\u2028y", "ſystem", "tail😀z"]
    rules = [Rule("C", f"r{i}", re.escape(w), "LOW", "d", rule_ord=i) for i, w in enumerate(words)]
    codes = ["", "g", "gets", "é☃", "😀😀", "a😀b", "x\u2028y", "ſystem gets", "tail😀z", "tail", "a😀😀b", "b" * 5000 + "gets"]
    lines = spark.createDataFrame([("f", "C", i, c) for i, c in enumerate(codes)], "path string, lang string, line int, code string")
    expected = sorted((i, r.rule_ord) for i, c in enumerate(codes) for r in rules if words[r.rule_ord] in c)
    for most in (8 << 20, 0):
        monkeypatch.setattr("linewarden.operators.scan.MAX_BROADCAST_BYTES", most)
        found = scan_lines_by_join(lines, Catalogue(tuple(rules)))
        assert sorted((r["line"], r["rule_ord"]) for r in found.collect()) == expected
        assert found._jdf.queryExecution().optimizedPlan().toString().count("(?=(.{4}))") == 1


def test_required_texts():
    cases = {
        r"\bgets\s*\(": ("gets",), r"(foo|bar+)x": ("ba", "foo"), r"a?b*": (), r"(?:ab|c\d)+ef": ("ef",), r"x{0,2}yz": ("yz",),
        r"(?i)Process\.Start": ("process.start",), r"(?i)pipx": ("px",), r"é+": (), r"(": (), r"(?x) a b": (), r"a|b": (), "": (),
    }
    assert {p: required_texts(p) for p in cases} == cases


def test_ambiguous_patterns_are_rejected(spark):
    bad = [r"(a+)+$", r"(a*)*b", r"(a|aa)+$", r"([a-z]+\d?)*x", r"(\w+\s?)*$", r"(x+x+)+y", r"(.*)*", r"(a|b|ab)*c", r"(?i)(ab|AB)+$", r"(?<n>a+)+b"]
    good = [r"a+$", r"a*a*b", r"(ab+)+c", r"(\w+\s)*$", r"\bf\s*\([^)]*\)", r"(a|b)*c", r"x{2,5}y", r"(\d+,)*\d+", r"(?:ab|cd)+", r"\p{L}+"]
    assert [p for p in bad if not exponential(p)] == [] and [p for p in good if exponential(p)] == []
    assert [r.name for r in CATALOGUE.rules if exponential(r.regex)] == []
    mine = [{"lang": "C", "name": "slow", "regex": bad[0], "severity": "LOW", "description": "d"}]
    assert [r[1] for r in CATALOGUE.with_rules(spark, mine).rejected] == ["slow"]


def test_join_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr("linewarden.operators.scan.MAX_BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [("hot", lang, i, code) for lang in FINDS for i, code in enumerate(FINDS[lang].values())]
        lines = spark.createDataFrame(rows, "path string, lang string, line int, code string")
        joined = scan_lines_by_join(lines, CATALOGUE)
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, scan_lines(lines, CATALOGUE).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_split_lines(spark):
    cases = {
        "": [],
        "\n": [""],
        "a": ["a"],
        "a\n": ["a"],
        "a\n\n": ["a", ""],
        "a\r\nb\r\n": ["a", "b"],
        "a\r\r\nb\r": ["a\r", "b\r"],
        "\r\n\r\n": ["", ""],
        "a b\u0085c\n": ["a b\u0085c"],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, content string").select("i", split_lines(F.col("content")).alias("l"))
    got = {r["i"]: r["l"] for r in df.collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
