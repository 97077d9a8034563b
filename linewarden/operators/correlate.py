"""Raise the confidence of reviewed findings that lie near a rule hit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed value: how many lines away a hit still corroborates ----------------------------------
NEAR_LINES = 2


def near_lines(hits: DataFrame) -> DataFrame:
    """Every (path, line) with a hit of any rule at most two lines away, once."""
    line = F.col("line").cast("bigint")
    reach = F.sequence(line - NEAR_LINES, line + NEAR_LINES)
    return hits.select("path", F.explode(reach).alias("line")).distinct()


def correlate(findings: DataFrame, hits: DataFrame) -> DataFrame:
    """Set ``confidence``: HIGH stays, else HIGH near a hit and MEDIUM elsewhere; keep ``raw_confidence``.

    The band is a constant, so it becomes an equi-join on (path, line), and a file with very many hits
    spreads over its lines.  Findings without a line can never match: they get negative keys that
    scatter them instead of one hot NULL key.  Each finding meets at most one row, so no rows are
    added and AQE may split a hot (path, line) on the side of the findings.
    """
    # far below the lines that the band can reach
    scatter = -16 - F.pmod(F.xxhash64("path", *[c for c in ("chunk_id", "seq", "explanation") if c in findings.columns]), F.lit(4096))
    keyed = findings.withColumn("near_line", F.coalesce("line", scatter))
    near = near_lines(hits).select("path", F.col("line").alias("near_line"), F.lit(True).alias("corroborated"))
    joined = keyed.join(near, ["path", "near_line"], "left").drop("near_line")
    sure = (F.col("raw_confidence") == "HIGH") | F.col("corroborated")
    return (
        joined.withColumn("corroborated", F.coalesce("corroborated", F.lit(False)))
        .withColumnRenamed("confidence", "raw_confidence")
        .withColumn("confidence", F.when(sure, "HIGH").otherwise("MEDIUM"))
    )
