"""Small expressions of the SARIF and text reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def confidence_rank(confidence: Column) -> Column:
    # fixed values: SARIF rank per confidence
    return F.when(confidence == "LOW", 25.0).when(confidence == "MEDIUM", 60.0).when(confidence == "HIGH", 90.0)


def sarif_level(severity: Column) -> Column:
    # fixed values: SARIF level per severity
    return F.when(severity.isin("CRITICAL", "HIGH"), "error").when(severity == "MEDIUM", "warning").otherwise("note")


def pascal_case(name: Column) -> Column:
    """``use-after-move`` -> ``UseAfterMove``; only the first letter of each part changes."""
    return F.array_join(
        F.transform(F.split(name, "-", -1), lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substring(p, 2, 1 << 30))), ""
    )


def rule_text(name: Column) -> Column:
    return F.concat(F.lit("Security vulnerability: "), F.replace(name, F.lit("-"), F.lit(" ")))


def sarif_message(explanation: Column, suggestion: Column) -> Column:
    return F.concat(explanation, F.lit(" — "), suggestion)


def cwe_numbers(text: Column) -> Column:
    """All ``CWE-n`` mentions of a text."""
    return F.regexp_extract_all(text, F.lit("(CWE-[0-9]+)"), 1)
