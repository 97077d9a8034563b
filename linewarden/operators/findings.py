"""Findings: from hits, and filters on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: confidence levels in rising order ------------------------------------------
CONFIDENCES = ("LOW", "MEDIUM", "HIGH")
# --- fixed values: severities that reports count ----------------------------------------------
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")

FINDING_FIELDS = ("line", "severity", "category", "pattern", "explanation", "suggestion", "confidence")


def finding_struct(hit: Column) -> Column:
    """A hit struct as a finding struct: static findings are of MEDIUM confidence, without a fix text."""
    return F.struct(
        hit["line"].cast("bigint").alias("line"),
        hit["severity"].alias("severity"),
        hit["rule"].alias("category"),
        hit["matched_text"].alias("pattern"),
        hit["description"].alias("explanation"),
        F.lit("").alias("suggestion"),
        F.lit("MEDIUM").alias("confidence"),
    )


def findings_from_hits(hits: DataFrame) -> DataFrame:
    hit = F.struct(*[F.col(c) for c in ("line", "rule_ord", "rule", "severity", "description", "matched_text")])
    finding = finding_struct(hit)
    return hits.select("path", "lang", "rule_ord", finding.alias("f")).select(
        "path", "lang", *[f"f.{c}" for c in FINDING_FIELDS], "rule_ord"
    )


def confidence_level(confidence: Column) -> Column:
    level = F.when(confidence == CONFIDENCES[0], 0)
    for i, name in enumerate(CONFIDENCES[1:], 1):
        level = level.when(confidence == name, i)
    return level


def at_least(confidence: Column, minimum: str) -> Column:
    name = minimum.upper()
    if name not in CONFIDENCES:
        raise ValueError(f"unknown confidence {minimum!r}; expected one of {CONFIDENCES}")
    return confidence_level(confidence) >= CONFIDENCES.index(name)


def min_confidence(findings: DataFrame, minimum: str = "low") -> DataFrame:
    keep = at_least(F.col("confidence"), minimum)
    return findings if minimum.upper() == CONFIDENCES[0] else findings.where(keep)


def with_severity(findings: DataFrame, severity: str) -> DataFrame:
    return findings.where(F.col("severity") == severity)


def suppress(findings: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Drop findings whose (path, category) is on the suppression list."""
    return findings.join(suppressions.select("path", "category"), ["path", "category"], "left_anti")
