"""The rule scan: every line against every rule of its language, at most one hit per rule and line.

The default form puts the patterns into the plan as literals, so each task compiles them once.  A line
is first tested for the needles of its language with plain byte searches; only lines that pass meet the
regexes.  Nothing here shuffles.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewarden.functions.columns import settled
from linewarden.functions.required import required_texts
from linewarden.functions.text import TRIM_PATTERN, fold_case_sql, split_lines, sql_text, trim_unicode
from linewarden.sources.catalogue import Catalogue, Rule
from linewarden.sources.rules import LANGUAGES

HIT_COLUMNS = ("rule_ord", "rule", "severity", "description", "matched_text")
_HIT_TYPES = {"rule_ord": "int", "rule": "string", "severity": "string", "description": "string", "matched_text": "string"}

# Above this many rules for one language the plan text grows too large; use the join form.
MAX_LITERAL_RULES = 200
# More tests than this would make one generated method too long for the JIT compiler.
MAX_INLINE_NEEDLES = 8
MAX_BROADCAST_BYTES = 8 << 20
#: Letters of the grams that needles are indexed by; a shorter needle is its own gram.
GRAM = 4

# The expressions below hold up to a few hundred literals, so they are written as SQL text: Spark
# parses it in one go, where building the same Column tree costs thousands of calls.


def _any_needle(folded: str, needles) -> str:
    """SQL condition: the text contains one of the needles."""
    wanted = sorted(n for n in set(needles) if not any(m != n and m in n for m in needles))
    if len(wanted) > MAX_INLINE_NEEDLES:
        return f"exists(array({', '.join(map(sql_text, wanted))}), n -> contains({folded}, n))"
    return "(" + " OR ".join(f"contains({folded}, {sql_text(n)})" for n in wanted) + ")"


def _rule_hit(rule: Rule, code: str, folded: str, fields: tuple[str, ...] = HIT_COLUMNS) -> str:
    pattern = sql_text(rule.pattern)
    match = f"rlike({code}, {pattern})"
    if rule.needles:
        match = f"{_any_needle(folded, rule.needles)} AND {match}"
    values = {
        "rule_ord": str(rule.rule_ord),
        "rule": sql_text(rule.name),
        "severity": sql_text(rule.severity),
        "description": sql_text(rule.description),
        "matched_text": f"regexp_replace(regexp_extract({code}, {pattern}, 0), {sql_text(TRIM_PATTERN)}, '')",
    }
    return f"CASE WHEN {match} THEN named_struct({', '.join(f'{sql_text(c)}, {values[c]}' for c in fields)}) END"


def _by_language(lang: str, catalogue: Catalogue, build, default: str) -> str:
    branches = [
        f"WHEN {lang} = {sql_text(name)} THEN {build(catalogue.of(name))}" for name in LANGUAGES if catalogue.of(name)
    ]
    return f"CASE {' '.join(branches)} ELSE {default} END" if branches else default


def may_hit(lang: str, folded: str, catalogue: Catalogue) -> str:
    """SQL condition; false only for lines that no rule of the language can match."""

    def build(rules):
        if any(not r.needles for r in rules):
            return "true"
        return _any_needle(folded, [n for r in rules for n in r.needles])

    return _by_language(lang, catalogue, build, "false")


def line_hits(lang: str, code: str, folded: str, catalogue: Catalogue, fields: tuple[str, ...] = HIT_COLUMNS) -> str:
    """SQL expression: hits of one line as an array of structs in catalogue order."""
    kind = "array<struct<" + ",".join(f"{c}:{_HIT_TYPES[c]}" for c in fields) + ">>"

    def build(rules):
        return "array_compact(array(" + ", ".join(_rule_hit(r, code, folded, fields) for r in rules) + "))"

    return _by_language(lang, catalogue, build, f"cast(array() AS {kind})")


def scan_lines(lines: DataFrame, catalogue: Catalogue | None = None, fields: tuple[str, ...] = HIT_COLUMNS) -> DataFrame:
    """``path, lang, line, code`` -> hits ``path, lang, line`` and the given fields of ``HIT_COLUMNS``.

    Counts ask for few fields, so that no text is cut out of lines for them.
    """
    catalogue = catalogue or Catalogue.builtin()
    if max(len(catalogue.of(lang)) for lang in LANGUAGES) > MAX_LITERAL_RULES:
        return scan_lines_by_join(lines, catalogue).select("path", "lang", "line", *fields)
    return _scan_literal(lines, catalogue, fields)


def _scan_literal(lines: DataFrame, catalogue: Catalogue, fields: tuple[str, ...] = HIT_COLUMNS) -> DataFrame:
    return (
        # settled: the condition looks at the folded text dozens of times
        settled(lines, folded=F.expr(fold_case_sql("code")))
        .where(may_hit("lang", "folded", catalogue))
        .select(
            "path",
            "lang",
            "line",
            # the outer form keeps the optimizer from evaluating the patterns a second time in a filter
            F.explode_outer(F.expr(line_hits("lang", "code", "folded", catalogue, fields))).alias("hit"),
        )
        .where(F.col("hit").isNotNull())
        .select("path", "lang", "line", *[f"hit.{c}" for c in fields])
    )


def _indexed(catalogue: Catalogue) -> tuple[list[tuple], list[Rule]]:
    """Index rows by the rarest gram of every text that a rule needs, and the rules that need none.

    A row is lang, gram, rule_ord, rule, severity, description, pattern, needle, and the rule's earlier needles.
    """
    needed = [(r, r.needles or required_texts(r.regex)) for r in catalogue.rules]
    grams = {n: [n[i : i + GRAM] for i in range(max(1, len(n) - GRAM + 1))] for _, needles in needed for n in needles}
    often = Counter(g for found in grams.values() for g in set(found))
    rows = []
    for rule, needles in needed:
        for k, needle in enumerate(needles):
            gram = min(grams[needle], key=lambda g: (-len(g), often[g], g))
            fields = (rule.lang, gram, rule.rule_ord, rule.name, rule.severity, rule.description, rule.pattern)
            rows.append((*fields, needle, list(needles[:k])))
    return rows, [r for r, needles in needed if not needles]


def _grams(rows: list[tuple], small: bool) -> str:
    """SQL expression: the distinct grams of a folded line, of a small index those that it has.

    A look ahead finds a gram at every character in one pass over the line.
    """
    known = {r[1] for r in rows}
    each = []
    for n in sorted({len(g) for g in known}):
        found = f"regexp_extract_all(folded, '(?s)(?=(.{{{n}}}))', 1)"
        if small:
            found = f"filter({found}, g -> g IN ({', '.join(sorted(sql_text(g) for g in known if len(g) == n))}))"
        each.append(found)
    return f"array_distinct(concat({', '.join(each)}))"


def scan_lines_by_join(lines: DataFrame, catalogue: Catalogue) -> DataFrame:
    """The same hits for a large catalogue, by an inverted index of the texts that its rules need.

    Every needle is indexed by its rarest gram; the grams of a line meet the index by an equi-join on language and
    gram, and only the few rules found so are tried: needle first, then pattern.  A rule with several needles is
    tried for the first one that the line holds, so it hits once.  An index below 8 MB is broadcast, and drops other
    grams before they become rows; beyond, grams travel without the lines, and the pairs found meet the lines by
    (path, line), which must be unique then.  Rules without any needed text are few in practice; they are
    tried as literals, ``MAX_LITERAL_RULES`` in a pass.
    """
    rows, bare = _indexed(catalogue)
    scans = [_scan_literal(lines, Catalogue(tuple(bare[k : k + MAX_LITERAL_RULES]))) for k in range(0, len(bare), MAX_LITERAL_RULES)]
    if rows:
        scans.append(_scan_index(lines, rows))
    found = scans[0] if scans else _scan_literal(lines, catalogue)
    for more in scans[1:]:
        found = found.unionByName(more)
    return found


def _scan_index(lines: DataFrame, rows: list[tuple]) -> DataFrame:
    index = lines.sparkSession.createDataFrame(
        rows,
        "lang string, gram string, rule_ord int, rule string, severity string, description string, pattern string, needle string,"
        " earlier array<string>",
    )
    small = sum(sum(len(x) for x in (*r[:2], *r[3:8])) + sum(map(len, r[8])) + 128 for r in rows) <= MAX_BROADCAST_BYTES
    folded = settled(lines.select("path", "lang", "line", "code"), folded=F.expr(fold_case_sql("code")))
    # settled: the optimizer would find the grams a second time in a filter
    each = settled(folded, grams=F.expr(_grams(rows, small))).withColumn("gram", F.explode("grams")).drop("grams")
    if small:
        tried = each.join(F.broadcast(index), ["lang", "gram"])
    else:
        keys = ["path", "line", "lang"]
        tried = each.select(*keys, "gram").join(index, ["lang", "gram"]).join(folded, keys)
    hit = "contains(folded, needle) AND NOT exists(earlier, n -> contains(folded, n)) AND rlike(code, pattern)"
    return tried.where(hit).select(
        "path",
        "lang",
        "line",
        "rule_ord",
        "rule",
        "severity",
        "description",
        trim_unicode(F.expr("regexp_extract(code, pattern, 0)")).alias("matched_text"),
    )


def hits_of_lines(lines: str, lang: str, catalogue: Catalogue, first_line: str = "1", kind: str = "int") -> str:
    """SQL expression: hits of an array of lines inside one row, ordered by line and rule.

    Used where the result belongs to a row anyway (one file, one chunk): it saves the shuffle that
    grouping exploded hits back would need.
    """
    numbered = (
        f"transform({lines}, (code, i) -> named_struct('line', cast({first_line} + i AS {kind}), 'code', code, "
        f"'folded', {fold_case_sql('code')}))"
    )
    candidates = f"filter({numbered}, x -> {may_hit(lang, 'x.folded', catalogue)})"
    fields = ", ".join(f"'{c}', h.{c}" for c in HIT_COLUMNS)
    hits = line_hits(lang, "x.code", "x.folded", catalogue)
    return f"flatten(transform({candidates}, x -> transform({hits}, h -> named_struct('line', x.line, {fields}))))"


def file_hits(files: DataFrame, catalogue: Catalogue | None = None) -> DataFrame:
    """``path, lang, hits`` with one row per file or piece of a file, clean ones included; no shuffle."""
    catalogue = catalogue or Catalogue.builtin()
    first = [c for c in files.columns if c == "first_line"]
    lines = files.select("path", "lang", *first, split_lines(F.col("content")).alias("lines"))
    hits = hits_of_lines("lines", "lang", catalogue, *(["first_line", "bigint"] if first else []))
    return settled(lines, hits=F.expr(hits)).select("path", "lang", *first, "hits")
