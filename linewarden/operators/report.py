"""Reports at file grain and run grain.

A *file result* is one row per audited file: ``file, language, findings``; clean files have ``[]``.
Static results are made inside the row of the file, so JSON, SARIF and text reports need no shuffle.
A file that was read in pieces has a row per piece, with ``first_line``; its one document, and documents
of reviewed findings, are made of fragments (``documents``), so no group grows with a file.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewarden.functions import labels
from linewarden.operators.findings import CONFIDENCES, FINDING_FIELDS, SEVERITIES, at_least, finding_struct
from linewarden.operators.scan import file_hits
from linewarden.sources.catalogue import Catalogue

TOOL = {"name": "linewarden", "version": "0.1.0"}
SARIF_VERSION = "2.1.0"
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"

# The text around the rules and the results of a log.
SARIF_HEAD = f'{{"$schema": "{SARIF_SCHEMA}", "version": "{SARIF_VERSION}", "runs": [{{"tool": {{"driver": {json.dumps(TOOL)[:-1]}, "rules": ['
SARIF_MIDDLE = ']}}, "results": ['
SARIF_TAIL = "]}]}"

#: A scheme and the slashes after it, in front of an absolute URI.
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:/+"


def static_file_results(
    files: DataFrame, catalogue: Catalogue | None = None, minimum: str = "low"
) -> DataFrame:
    """Static audit at file grain; no shuffle, no join."""
    findings = F.transform("hits", finding_struct)
    if minimum.upper() != CONFIDENCES[0]:
        findings = F.filter(findings, lambda f: at_least(f["confidence"], minimum))
    hits = file_hits(files, catalogue)
    names = [F.col("path").alias("file"), F.col("lang").alias("language"), *[F.col(c) for c in hits.columns if c == "first_line"]]
    return hits.select(*names, findings.alias("findings"))


def reviewed_summary(files: DataFrame, findings: DataFrame) -> DataFrame:
    """One row like that of ``run_summary``, from all files and exploded findings; nothing is grouped by file."""
    found = findings.select(F.lit(0).alias("file"), F.lit(1).alias("finding"), "severity")
    rows = files.select(F.lit(1).alias("file"), F.lit(0).alias("finding"), F.lit(None).cast("string").alias("severity")).unionByName(found)
    return rows.agg(
        F.coalesce(F.sum("file"), F.lit(0)).alias("files"),
        F.coalesce(F.sum("finding"), F.lit(0)).alias("findings"),
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES],
    )


# --- JSON -------------------------------------------------------------------------------------


def json_documents(file_results: DataFrame) -> DataFrame:
    """``file, document``: one JSON object per file row."""
    body = F.struct("file", "language", "findings")
    return file_results.select("file", F.to_json(body, {"ignoreNullFields": "false"}).alias("document"))


def write_json(file_results: DataFrame, path: str, mode: str = "errorifexists") -> None:
    file_results.select("file", "language", "findings").write.mode(mode).option("ignoreNullFields", "false").json(path)


# --- SARIF ------------------------------------------------------------------------------------


def relative_path(path: Column, root: str | None) -> Column:
    """The path below ``root``; unchanged if it lies elsewhere or there is no root.

    Spark names local files ``file:/...``, so a root without a scheme is taken off such paths as well.
    """
    if not root:
        return path
    top = root.rstrip("/") + "/"
    tops = [top] + (["file:" + top] if top.startswith("/") else [])
    out = path
    for t in tops:
        out = F.when(F.startswith(path, F.lit(t)), F.substr(path, F.lit(len(t) + 1))).otherwise(out)
    return out


def sarif_uri(path: Column, root: str | None = None) -> Column:
    """The path below ``root``, every segment percent-encoded; a scheme in front stays as it is."""
    path = relative_path(path, root)
    scheme = F.regexp_extract(path, _SCHEME, 0)
    rest = F.url_encode(F.substr(path, F.char_length(scheme) + 1))
    return F.concat(scheme, F.replace(F.replace(rest, F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20")))


def sarif_results(findings: DataFrame, root: str | None = None) -> DataFrame:
    """Flat SARIF results, one row per finding; ``uri`` is relative to ``root``."""
    fix = F.when(F.col("suggestion") != "", F.col("suggestion"))
    return findings.select(
        F.col("category").alias("rule_id"),
        labels.sarif_level(F.col("severity")).alias("level"),
        labels.confidence_rank(F.col("confidence")).alias("rank"),
        labels.sarif_message(F.col("explanation"), F.col("suggestion")).alias("message"),
        sarif_uri(F.col("path"), root).alias("uri"),
        F.coalesce("line", F.lit(1)).alias("start_line"),
        fix.alias("fix"),
    )


def rule_ids(findings: DataFrame) -> DataFrame:
    return findings.select(F.col("category").alias("rule_id")).distinct().orderBy("rule_id")


def sarif_rules(findings: DataFrame) -> DataFrame:
    """Flat SARIF rule definitions: the distinct categories, sorted."""
    rule = F.col("rule_id")
    return rule_ids(findings).select(
        "rule_id",
        labels.pascal_case(rule).alias("name"),
        labels.rule_text(rule).alias("short_description"),
        F.array(F.lit("security")).alias("tags"),
        F.lit("medium").alias("precision"),
    )


def rule_object(rule: Column) -> Column:
    return F.struct(
        rule.alias("id"),
        labels.pascal_case(rule).alias("name"),
        F.struct(labels.rule_text(rule).alias("text")).alias("shortDescription"),
        F.struct(F.array(F.lit("security")).alias("tags"), F.lit("medium").alias("precision")).alias("properties"),
    )


def result_object(f: Column, uri: Column) -> Column:
    fix = F.array(F.struct(F.struct(f["suggestion"].alias("text")).alias("description")))
    base = F.when(~F.rlike(uri, F.lit(_SCHEME)), "%SRCROOT%")  # an absolute URI has no base
    place = F.struct(
        F.struct(uri.alias("uri"), base.alias("uriBaseId")).alias("artifactLocation"),
        F.struct(F.coalesce(f["line"], F.lit(1)).alias("startLine")).alias("region"),
    )
    return F.struct(
        f["category"].alias("ruleId"),
        labels.sarif_level(f["severity"]).alias("level"),
        labels.confidence_rank(f["confidence"]).alias("rank"),
        F.struct(labels.sarif_message(f["explanation"], f["suggestion"]).alias("text")).alias("message"),
        F.array(F.struct(place.alias("physicalLocation"))).alias("locations"),
        F.when(f["suggestion"] != "", fix).alias("fixes"),
    )


def _run_object(root: str | None) -> Column:
    categories = F.array_sort(F.array_distinct(F.transform("findings", lambda f: f["category"])))
    driver = F.struct(
        F.lit(TOOL["name"]).alias("name"),
        F.lit(TOOL["version"]).alias("version"),
        F.transform(categories, rule_object).alias("rules"),
    )
    return F.struct(
        F.struct(driver.alias("driver")).alias("tool"),
        F.transform("findings", lambda f: result_object(f, sarif_uri(F.col("file"), root))).alias("results"),
    )


def sarif_documents(file_results: DataFrame, root: str | None = None) -> DataFrame:
    """``file, document``: a complete SARIF log per file row, made inside the row; URIs are relative to ``root``."""
    log = F.struct(
        F.lit(SARIF_SCHEMA).alias("$schema"), F.lit(SARIF_VERSION).alias("version"), F.array(_run_object(root)).alias("runs")
    )
    return file_results.select("file", F.to_json(log).alias("document"))


def write_sarif(file_results: DataFrame, path: str, mode: str = "errorifexists", root: str | None = None) -> None:
    """One SARIF log per line and file row; every line is a valid log of its own."""
    sarif_documents(file_results, root).select("document").write.mode(mode).text(path)


def sarif_log_lines(findings: DataFrame, root: str | None = None) -> DataFrame:
    """``part, rule_id, key, text``: one SARIF log for the whole run, one text row per rule and result.

    Sorted by (part, rule_id, key) the rows are the log: head, rules, middle, results, tail.  All that is
    gathered is one row with the least rule and the least key, as these get no comma in front.  The
    findings are read twice, so store costly ones before.
    """
    key = F.struct(*[c for c in ("path", "chunk_id", "seq", "line", "rule_ord") if c in findings.columns])
    first = findings.agg(F.struct(F.min("category").alias("rule_id"), F.min(key).alias("key")).alias("first")).scalar()

    def comma(column, least):
        return F.when(column.eqNullSafe(least), "").otherwise(",")

    results = findings.select(key.alias("key"), F.struct(*FINDING_FIELDS).alias("f"), "path")
    body = F.to_json(result_object(F.col("f"), sarif_uri(F.col("path"), root)))
    result_rows = results.select(
        F.lit(3).alias("part"),
        F.lit(None).cast("string").alias("rule_id"),
        "key",
        F.concat(comma(F.col("key"), first["key"]), body).alias("text"),
    )
    no_key = F.lit(None).cast(results.schema["key"].dataType).alias("key")
    rule = F.col("category")
    rule_rows = (
        findings.select("category")
        .distinct()
        .select(
            F.lit(1).alias("part"),
            rule.alias("rule_id"),
            no_key,
            F.concat(comma(rule, first["rule_id"]), F.to_json(rule_object(rule))).alias("text"),
        )
    )
    fixed = findings.sparkSession.createDataFrame(
        [(0, SARIF_HEAD), (2, SARIF_MIDDLE), (4, SARIF_TAIL)], "part int, text string"
    ).select("part", F.lit(None).cast("string").alias("rule_id"), no_key, "text")
    return fixed.unionByName(rule_rows).unionByName(result_rows)


def write_sarif_log(findings: DataFrame, path: str, mode: str = "errorifexists", root: str | None = None) -> None:
    """One SARIF log for the whole run, as text parts that make up the log when joined in name order.

    The sort is by ranges of keys over all tasks, so no task holds the log.  Findings need a key that
    is unique per row: (path, line, rule_ord) for static, (path, chunk_id, seq) for reviewed ones.
    """
    sarif_log_lines(findings, root).orderBy("part", "rule_id", "key").select("text").write.mode(mode).text(path)


# --- text and run summary ---------------------------------------------------------------------


# --- fixed values: the text of a report ---------------------------------------------------------
NO_FINDINGS, NO_LINE = "  No findings", "—"
PATTERN_LABEL, RISK_LABEL, FIX_LABEL = "  Pattern   : ", "  Risk      : ", "  Fix       : "


def report_head(language: Column, file: Column) -> Column:
    return F.concat(F.lit("["), language, F.lit("] "), file)


def report_entry(f: Column) -> Column:
    """The text of a finding struct, without colours."""
    line = F.when(f["line"].isNull(), NO_LINE).otherwise(F.concat(F.lit("line "), f["line"].cast("string")))
    head = F.concat(
        F.lit("\n  ["), f["severity"], F.lit("] "), f["category"], F.lit(" "), line, F.lit(" ["), F.lower(f["confidence"]), F.lit("]\n")
    )
    pattern = F.when(f["pattern"] == "", "").otherwise(F.concat(F.lit(PATTERN_LABEL), f["pattern"], F.lit("\n")))
    return F.concat(head, pattern, F.lit(RISK_LABEL), f["explanation"], F.lit("\n" + FIX_LABEL), f["suggestion"])


def file_report(file_results: DataFrame) -> DataFrame:
    """``file, language, finding_count, section``: the text section of each file, without colours."""
    body = F.when(F.size("findings") == 0, NO_FINDINGS).otherwise(F.array_join(F.transform("findings", report_entry), "\n"))
    return file_results.select(
        "file",
        "language",
        F.size("findings").alias("finding_count"),
        F.concat(report_head(F.col("language"), F.col("file")), F.lit("\n"), body).alias("section"),
    )


def run_summary(file_results: DataFrame) -> DataFrame:
    """One row: files, findings and the four severity counts (INFO counts only in the total); one pass."""

    def count(severity):
        return F.coalesce(F.sum(F.size(F.filter("findings", lambda f: f["severity"] == severity))), F.lit(0))

    files = F.count_if(F.col("first_line") == 1) if "first_line" in file_results.columns else F.count(F.lit(1))
    return file_results.agg(
        files.alias("files"),
        F.coalesce(F.sum(F.size("findings")), F.lit(0)).alias("findings"),
        *[count(s).alias(s.lower()) for s in SEVERITIES],
    )


def severity_counts(findings: DataFrame) -> DataFrame:
    """One row of the four severity counts from exploded findings."""
    return findings.agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES])
