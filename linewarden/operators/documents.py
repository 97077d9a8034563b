"""Documents per file as ordered fragments, so that one document of any size is the work of many tasks.

A fragment is ``file, part, name, major, minor, text``.  Sorted by all columns before ``text`` the fragments of a
file are its document: what opens it, a fragment for every rule and finding, what closes it.  A fragment that is not
the first of its part begins with a comma; the least keys per file and part are all that is gathered for that.
Files without findings have documents too.  The fragments are read twice, so store what is costly before.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewarden.operators import report
from linewarden.operators.findings import FINDING_FIELDS
from linewarden.operators.totals import running_total

KEYS = ("file", "part", "name", "major", "minor")
_WITH_NULLS = {"ignoreNullFields": "false"}


def _fragment(part: int, text: Column, major=None, minor=None, name=None) -> Column:
    nothing = F.lit(None)
    return F.struct(
        F.lit(part).alias("part"),
        (nothing if name is None else name).cast("string").alias("name"),
        (nothing if major is None else major).cast("bigint").alias("major"),
        (nothing if minor is None else minor).cast("bigint").alias("minor"),
        text.alias("text"),
    )


def _frame(texts: dict[int, Column]) -> Column:
    return F.array(*[_fragment(part, text) for part, text in texts.items()])


def with_commas(fragments: DataFrame, *parts: int) -> DataFrame:
    """A comma in front of every fragment of the given parts but the first of a file."""
    key = F.struct("name", "major", "minor")
    first = fragments.where(F.col("part").isin(*parts)).groupBy("file", "part").agg(F.min(key).alias("least"))
    more = key != F.col("least")
    joined = fragments.join(first, ["file", "part"], "left")
    return joined.select(*KEYS, F.when(more, F.concat(F.lit(","), "text")).otherwise(F.col("text")).alias("text"))


def _rows(file_results: DataFrame) -> DataFrame:
    """Result rows with ``first``, the number of the first line they stand for."""
    first = F.col("first_line") if "first_line" in file_results.columns else F.lit(1)
    return file_results.select("file", "language", first.cast("bigint").alias("first"), "findings")


def _json_frame() -> Column:
    head = F.concat(F.lit('{"file":'), _quoted("file"), F.lit(',"language":'), _quoted("language"), F.lit(',"findings":['))
    return _frame({0: head, 2: F.lit("]}")})


def _quoted(column: str) -> Column:
    """A JSON string."""
    one = F.to_json(F.array(F.col(column)))
    return F.substr(one, F.lit(2), F.char_length(one) - 2)


def json_fragments(file_results: DataFrame) -> DataFrame:
    """Fragments of one JSON object per file, from result rows; several rows may stand for pieces of one file."""
    one = F.transform("findings", lambda f, i: _fragment(1, F.to_json(f, _WITH_NULLS), F.col("first"), i))
    frame = F.when(F.col("first") == 1, _json_frame()).otherwise(F.filter(_json_frame(), lambda x: F.lit(False)))
    each = _rows(file_results).select("file", F.explode(F.concat(frame, one)).alias("x")).select("file", "x.*")
    return with_commas(each, 1)


def reviewed_json_fragments(files: DataFrame, findings: DataFrame) -> DataFrame:
    """The same from ``path, lang`` of all files and exploded findings, a fragment each."""
    named = files.select(F.col("path").alias("file"), F.col("lang").alias("language"))
    frames = named.select("file", F.explode(_json_frame()).alias("x")).select("file", "x.*")
    body = F.to_json(F.struct(*FINDING_FIELDS), _WITH_NULLS)
    one = findings.select(F.col("path").alias("file"), _fragment(1, body, F.col("chunk_id"), F.col("seq")).alias("x"))
    return with_commas(frames.unionByName(one.select("file", "x.*")), 1)


# --- SARIF ------------------------------------------------------------------------------------

_HEAD = (
    f'{{"$schema":"{report.SARIF_SCHEMA}","version":"{report.SARIF_VERSION}",'
    f'"runs":[{{"tool":{{"driver":{json.dumps(report.TOOL, separators=(",", ":"))[:-1]},"rules":['
)


def sarif_fragments(files: DataFrame, findings: DataFrame, root: str | None = None) -> DataFrame:
    """Fragments of one SARIF log per file, from ``path, lang`` of all files and exploded findings.

    Findings are in the order of (line, rule_ord) or of (chunk_id, seq).
    """
    frame = _frame({0: F.lit(_HEAD), 2: F.lit(']}},"results":['), 4: F.lit("]}]}")})
    frames = files.select(F.col("path").alias("file"), F.explode(frame).alias("x")).select("file", "x.*")
    rules = findings.select(F.col("path").alias("file"), "category").distinct()
    rule = _fragment(1, F.to_json(report.rule_object(F.col("category"))), name=F.col("category"))
    major, minor = ("chunk_id", "seq") if "chunk_id" in findings.columns else ("line", "rule_ord")
    body = F.to_json(report.result_object(F.struct(*FINDING_FIELDS), report.sarif_uri(F.col("path"), root)))
    one = findings.select(F.col("path").alias("file"), _fragment(3, body, F.col(major), F.col(minor)).alias("x"))
    every = frames.unionByName(rules.select("file", rule.alias("x")).select("file", "x.*")).unionByName(one.select("file", "x.*"))
    return with_commas(every, 1, 3)


# --- text -------------------------------------------------------------------------------------


def report_fragments(files: DataFrame, findings: DataFrame, unreviewed: DataFrame) -> DataFrame:
    """Fragments of the text section of every file, a line or a finding each.

    ``unreviewed`` has ``path, first_line, last_line`` of lines that no answer covers: they are named, and a
    file reads as one without findings only if nothing of it is left out.
    """
    named = files.select(F.col("path").alias("file"), F.col("lang").alias("language"))
    heads = named.select("file", _fragment(0, report.report_head(F.col("language"), F.col("file"))).alias("x"))
    entry = report.report_entry(F.struct(*FINDING_FIELDS))
    entries = findings.select(F.col("path").alias("file"), _fragment(1, entry, F.col("chunk_id"), F.col("seq")).alias("x"))
    told = F.format_string("  Not reviewed: lines %d to %d", F.col("first_line"), F.col("last_line"))
    gaps = unreviewed.select(F.col("path").alias("file"), _fragment(2, told, F.col("first_line")).alias("x"))
    some = findings.select(F.col("path").alias("file")).union(unreviewed.select("path")).distinct()
    clean = named.join(some, "file", "left_anti").select("file", _fragment(3, F.lit(report.NO_FINDINGS)).alias("x"))
    return heads.unionByName(entries).unionByName(gaps).unionByName(clean).select("file", "x.*")


# --- writing ----------------------------------------------------------------------------------


def write_documents(fragments: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """All documents as text parts, one after the other in the order of file names when joined in name order.

    The sort is by ranges over all tasks: a document begins in one part and may end in a later one.
    """
    fragments.orderBy(*KEYS).select("text").write.mode(mode).text(path)


def document_index(fragments: DataFrame) -> DataFrame:
    """``file, start, bytes``: where each document stands in the joined text parts; every fragment ends with a line feed."""
    sizes = fragments.groupBy("file").agg(F.sum(F.octet_length("text") + 1).alias("bytes"))
    return running_total(sizes, "bytes", "start", "file").select("file", "start", "bytes")
