"""Source files -> languages -> numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewarden.functions.text import detect_language, override_language, split_lines


def with_language(sources: DataFrame, override: str | None = None) -> DataFrame:
    """Add ``lang``; drop files of no known language, unless an override names one for all files."""
    if override is not None:
        return sources.withColumn("lang", F.lit(override_language(override)))
    return sources.withColumn("lang", detect_language(F.col("path"))).where(F.col("lang").isNotNull())


def explode_lines(files: DataFrame) -> DataFrame:
    """One row per line: ``path, lang, line, code`` with 1-based line numbers; narrow, no shuffle.

    Pieces of files (``sources.ranges``) say by ``first_line`` where they begin.
    """
    first = F.col("first_line") if "first_line" in files.columns else 1
    return (
        files.select(
            "path",
            "lang",
            *[c for c in files.columns if c == "first_line"],
            # the outer form keeps the optimizer from evaluating the split a second time in a filter
            F.posexplode_outer(split_lines(F.col("content"))).alias("pos", "code"),
        )
        .where(F.col("code").isNotNull())
        .select("path", "lang", (F.col("pos") + first).alias("line"), "code")
    )
