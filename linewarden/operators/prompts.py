"""Review prompts as a table: one prompt per chunk, with the rule hits of the chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewarden.functions.columns import settled
from linewarden.operators.chunks import chunk_files
from linewarden.operators.scan import hits_of_lines
from linewarden.sources.catalogue import Catalogue

# --- fixed values: text for a chunk without hits, and the form of a hit in the prompt ------------
NO_HITS = "None detected."
HIT_FORMAT = "  - Line %d: [%s] `%s` matched `%s` — %s"

INSTRUCTIONS = """You review source code for security problems.
The code below is written in {lang}.

Rule matches:
{hits}

Code:
{code}

Answer with one JSON array and no other text. Every element has the keys "line" (number, counted from
the first line of the code above), "severity" (CRITICAL, HIGH, MEDIUM or LOW), "category", "pattern",
"explanation" and "suggestion". Answer [] if you find nothing.
"""


def hit_text(line: Column, hit: Column) -> Column:
    return F.format_string(HIT_FORMAT, line, hit["severity"], hit["rule"], hit["matched_text"], hit["description"])


def chunk_hits(
    files: DataFrame, catalogue: Catalogue | None = None, keep_preamble: bool = False
) -> DataFrame:
    """Chunks with their hits as an array column; file line numbers; no shuffle."""
    catalogue = catalogue or Catalogue.builtin()
    chunks = chunk_files(files, keep_preamble=keep_preamble, with_lines=True)
    hits = hits_of_lines("scan_lines", "lang", catalogue, "start_line")
    return settled(chunks, hits=F.expr(hits)).drop("scan_lines")


def hit_list(hits: Column, start_line: Column, relative: bool = True) -> Column:
    """The hits of one chunk as prompt text, counted from the chunk start or from the file start."""
    shift = start_line - 1 if relative else F.lit(0)
    text = F.array_join(F.transform(hits, lambda h: hit_text(h["line"] - shift, h)), "\n")
    return F.when(F.size(hits) == 0, F.lit(NO_HITS)).otherwise(text)


def hit_lists(hits_by_chunk: DataFrame, relative: bool = True) -> DataFrame:
    """The same text from exploded rows of ``hits_in_chunks``, grouped by chunk (a bounded group)."""
    row = F.struct("line", "rule_ord", "rule", "severity", "description", "matched_text")
    grouped = hits_by_chunk.groupBy("path", "chunk_id", "start_line").agg(F.array_sort(F.collect_list(row)).alias("hits"))
    return grouped.select(
        "path", "chunk_id", hit_list(F.col("hits"), F.col("start_line"), relative).alias("hit_list")
    )


def prompt_text(lang: Column, hits: Column, code: Column) -> Column:
    parts = INSTRUCTIONS
    pieces = []
    for name, column in (("{lang}", lang), ("{hits}", hits), ("{code}", code)):
        before, parts = parts.split(name)
        pieces += [F.lit(before), column]
    return F.concat(*pieces, F.lit(parts))


def prompts(chunks: DataFrame, relative: bool = True) -> DataFrame:
    """From ``chunk_hits``: the prompts table, keyed by (path, chunk_id), that an outside reviewer answers."""
    listed = hit_list(F.col("hits"), F.col("start_line"), relative)
    return chunks.select(
        "path",
        "lang",
        "chunk_id",
        "start_line",
        "line_count",
        F.size("hits").alias("hit_count"),
        prompt_text(F.col("lang"), listed, F.col("content")).alias("prompt"),
    )
