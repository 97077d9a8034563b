"""End-to-end audits: static, prompt making and review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewarden.operators.chunks import CHUNK_BYTES, chunk_files
from linewarden.operators.correlate import correlate
from linewarden.operators.findings import findings_from_hits, min_confidence
from linewarden.operators.lines import explode_lines, with_language
from linewarden.operators.long_chunks import long_file_chunks, with_hits
from linewarden.operators.prompts import chunk_hits, prompts
from linewarden.operators.report import static_file_results
from linewarden.operators.responses import parse_responses, rebase_lines
from linewarden.operators.scan import HIT_COLUMNS, scan_lines
from linewarden.sources.catalogue import Catalogue
from linewarden.sources.files import sources_from_files
from linewarden.sources.ranges import RANGE_BYTES, list_files, read_pieces


def static_hits(
    sources: DataFrame, catalogue: Catalogue | None = None, override: str | None = None, fields: tuple[str, ...] = HIT_COLUMNS
) -> DataFrame:
    """``path, content`` -> all rule hits, one row each, with the given fields of a hit."""
    return scan_lines(explode_lines(with_language(sources, override)), catalogue, fields)


def static_hits_of_lines(
    lines: DataFrame, catalogue: Catalogue | None = None, override: str | None = None
) -> DataFrame:
    """``path, line, code`` -> all rule hits: for line tables."""
    return scan_lines(with_language(lines, override), catalogue)


def static_audit(
    sources: DataFrame, catalogue: Catalogue | None = None, override: str | None = None, minimum: str = "low"
) -> DataFrame:
    """``path, content`` -> static findings, one row each; a narrow plan from scan to result."""
    return min_confidence(findings_from_hits(static_hits(sources, catalogue, override)), minimum)


def static_hits_of_files(
    spark: SparkSession, *paths: str, catalogue: Catalogue | None = None, override: str | None = None, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """All rule hits of files on disk, of every size."""
    return static_hits(sources_from_files(spark, *paths, override=override, range_bytes=range_bytes), catalogue, override)


def static_results(
    sources: DataFrame, catalogue: Catalogue | None = None, override: str | None = None, minimum: str = "low"
) -> DataFrame:
    """``path, content`` -> one result row per file (or piece of a file), clean files included."""
    return static_file_results(with_language(sources, override), catalogue, minimum)


def build_prompts(
    sources: DataFrame,
    catalogue: Catalogue | None = None,
    override: str | None = None,
    keep_preamble: bool = False,
    relative: bool = True,
) -> DataFrame:
    """``path, content`` -> the prompts table.  Write it before the reviewer reads it."""
    return prompts(chunk_hits(with_language(sources, override), catalogue, keep_preamble), relative)


def chunks_from_files(
    spark: SparkSession, *paths: str, override: str | None = None, keep_preamble: bool = False, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Chunks of files on disk: inside the row of a file, or, for files longer than a range, by the parallel scan."""
    whole, lines, marked = _short_and_long(spark, paths, override, range_bytes)
    return chunk_files(whole, keep_preamble).unionByName(long_file_chunks(lines, marked, keep_preamble=keep_preamble))


def prompts_from_files(
    spark: SparkSession,
    *paths: str,
    catalogue: Catalogue | None = None,
    override: str | None = None,
    keep_preamble: bool = False,
    relative: bool = True,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """The prompts table of files on disk, of every size."""
    whole, lines, marked = _short_and_long(spark, paths, override, range_bytes)
    chunks = with_hits(long_file_chunks(lines, marked, keep_preamble=keep_preamble), scan_lines(lines, catalogue))
    short = prompts(chunk_hits(whole, catalogue, keep_preamble), relative)
    return short.unionByName(prompts(chunks, relative))


def _short_and_long(spark: SparkSession, paths: tuple[str, ...], override: str | None, range_bytes: int):
    """Files of one piece; the lines of the others, and their pieces cut behind semicolons."""
    size = max(range_bytes, CHUNK_BYTES)
    files = list_files(spark, *paths, override=override)
    pieces = with_language(read_pieces(files, size), override)
    marked = with_language(read_pieces(files.where(F.col("length") > size), size, mark=";"), override)
    return pieces.where("whole").drop("first_line", "whole"), explode_lines(pieces.where("NOT whole")), marked


def review(
    responses: DataFrame,
    hits: DataFrame,
    chunks: DataFrame | None = None,
    minimum: str = "low",
) -> DataFrame:
    """Answers -> findings with file lines and final confidence.

    ``responses`` has ``path, chunk_id, response``.  If it carries ``lang`` and ``start_line`` over from
    the prompts table nothing else is needed; else ``chunks`` supplies them, and only its keys and
    positions are joined, never its text.
    """
    if not {"lang", "start_line"} <= set(responses.columns):
        if chunks is None:
            raise ValueError("responses carry no lang and start_line: pass the chunks or prompts table")
        responses = responses.select("path", "chunk_id", "response").join(
            chunks.select("path", "chunk_id", "lang", "start_line"), ["path", "chunk_id"]
        )
    keyed = responses.select("path", "lang", "chunk_id", "start_line", "response")
    found = correlate(rebase_lines(parse_responses(keyed)), hits)
    return min_confidence(found, minimum).select(
        "path", "lang", "chunk_id", "seq", "line", "severity", "category", "pattern", "explanation", "suggestion",
        "confidence", "raw_confidence", "parse_status",
    )


def review_sources(
    sources: DataFrame, responses: DataFrame, catalogue: Catalogue | None = None, override: str | None = None,
    minimum: str = "low",
) -> DataFrame:
    """``review`` straight from the sources, without stored hits and prompts."""
    files = with_language(sources, override)
    chunks = None if {"lang", "start_line"} <= set(responses.columns) else chunk_files(files)
    return review(responses, static_hits(sources, catalogue, override), chunks, minimum)


def audit_files(
    spark: SparkSession, *paths: str, override: str | None = None, minimum: str = "low", range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Static audit of files on disk: a result row for each file, or for each piece of one longer than a range.

    ``documents.json_fragments`` makes one document per file of it.
    """
    sources = sources_from_files(spark, *paths, override=override, range_bytes=range_bytes)
    return static_results(sources, None, override, minimum)


__all__ = [
    "audit_files", "build_prompts", "chunks_from_files", "prompts_from_files", "review", "review_sources", "static_audit", "static_hits", "static_hits_of_files",
    "static_hits_of_lines", "static_results",
]
