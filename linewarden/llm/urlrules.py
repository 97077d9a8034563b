"""URL verdicts from host and path rules, found by hashed expressions.

Every URL is expanded into host-suffix and path-prefix expressions, the expressions meet the rules in an
equi-join on short hash prefixes, and full digests and rule precedence decide.  Built-in functions only.

Defined results: a NULL URL or one without ``://`` has an empty host and path and gets the default verdict,
as does an empty table's every row (none).  Of several rules that fit the longest wins; of equally long ones
that with the longer host, and of the same rule given twice with two verdicts the block.  Repeated rows and
URLs each keep their row.  Other columns of the pages pass through; columns that are already named like a
result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of a digest that make the join key: 32 bits, as rule lists sent to clients use them.
PREFIX_DIGITS = 8
#: Rule tables up to this many rows are sent to every task; larger ones are joined by a shuffle.
BROADCAST_RULES = 100_000
RESULTS = ("host", "path", "rule", "verdict")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The lower-cased host after the first ``://`` and the path after it; both empty where there is none."""
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _digest(expression: Column) -> Column:
    return F.sha2(expression.cast("binary"), 256)


def compile_rules(rules: DataFrame) -> DataFrame:
    """Rules as (prefix, digest, best): one row for each distinct host and path."""
    rule = F.concat(F.translate("host", UPPER, LOWER), "path")
    return (
        rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
        .withColumn("rule", rule)
        .withColumn("digest", _digest(rule))
        .groupBy("rule", "digest", F.length("host").alias("host_length"))
        .agg(F.max(F.col("verdict") == "block").alias("block"))
        .select(
            F.substring("digest", 1, PREFIX_DIGITS).alias("prefix"),
            "digest",
            F.struct(F.length("rule").alias("length"), "host_length", "block", "rule").alias("best"),
        )
    )


def _shapes(rules: DataFrame) -> list[tuple[int, int]]:
    """The (labels, path length) pairs that rules have; both are short, so there are few, whatever the rules."""
    labels = F.size(F.split("host", "[.]"))
    found = rules.where("host IS NOT NULL AND path IS NOT NULL").select(labels.alias("n"), F.length("path").alias("m"))
    return sorted((r.n, r.m) for r in found.distinct().collect())


def expressions(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Host suffixes joined to path prefixes, of the shapes that some rule has."""
    labels = F.split(host, "[.]")
    made = [
        F.when(
            (F.size(labels) >= n) & (F.length(path) >= m),
            F.concat(F.array_join(F.slice(labels, -n, n), "."), F.substring(path, 1, m)),
        )
        for n, m in shapes
    ]
    return F.array_compact(F.array(*made)) if made else F.array().cast("array<string>")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Pages with ``host``, ``path``, the ``rule`` that decides (else NULL) and the ``verdict``."""
    compiled = compile_rules(rules)
    if compiled.count() <= BROADCAST_RULES:
        compiled = F.broadcast(compiled)
    host, path = host_and_path(F.col(url))
    base = pages.drop(*[c for c in RESULTS if c in pages.columns and c != url])
    base = base.withColumn("__host", host).withColumn("__path", path)
    keys = base.select("__host", "__path").distinct()
    digest = F.explode(F.transform(expressions(F.col("__host"), F.col("__path"), _shapes(rules)), _digest))
    tried = keys.select("__host", "__path", digest.alias("tried"))
    met = tried.join(compiled, F.substring("tried", 1, PREFIX_DIGITS) == F.col("prefix")).where("tried = digest")
    best = met.groupBy("__host", "__path").agg(F.max("best").alias("__best"))
    judged = base.join(best, ["__host", "__path"], "left")
    verdict = F.when(F.col("__best").isNull(), F.lit(default)).when(F.col("__best.block"), "block").otherwise("allow")
    kept = [F.col(c) for c in base.columns if c not in ("__host", "__path") and c not in RESULTS]
    return judged.select(
        *kept,
        F.col("__host").alias("host"),
        F.col("__path").alias("path"),
        F.col("__best.rule").alias("rule"),
        verdict.alias("verdict"),
    )
