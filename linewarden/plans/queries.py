"""One query per operator over the given tables.

Line-grain queries audit the corpus of small files made from ``orders``; file-grain, chunk, prompt and
review queries use the corpus made from the whole texts of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewarden.functions import labels, text
from linewarden.operators import chunks as chunking
from linewarden.operators import documents, long_chunks, report
from linewarden.operators import prompts as prompting
from linewarden.operators.correlate import near_lines
from linewarden.operators.findings import min_confidence, suppress, with_severity
from linewarden.operators.lines import explode_lines, with_language
from linewarden.operators.responses import decode_responses, parse_responses, response_coverage, unreviewed_lines
from linewarden.operators.scan import scan_lines_by_join
from linewarden.plans import audit
from linewarden.session import work_folder
from linewarden.sources import corpus
from linewarden.sources.catalogue import Catalogue
from linewarden.sources.rules import EXTENSIONS, OVERRIDES
from linewarden.sources.tables import read_table, spread
from linewarden.streaming.incremental import stream_table, write_increment
from linewarden.streaming.state import changes, refresh_sources

Query = Callable[[SparkSession, str], DataFrame]

USER_RULES = (
    {"lang": "C", "name": "return-zero", "regex": r"\breturn\s+0\s*;", "severity": "LOW", "description": "A fixed status."},
    {"lang": "Rust", "name": "any-comment", "regex": r"^\s*//.*$", "severity": "INFO", "description": "A comment line."},
    {"lang": "C++", "name": "broken", "regex": r"(unclosed", "severity": "LOW", "description": "Never compiles."},
)

CATALOGUE = Catalogue.builtin()
#: What counts of hits need of them.
_COUNTED = ("rule_ord", "rule", "severity")
#: What a review needs of them beside their lines.
_PLACED = ("rule_ord",)


def order_sources(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.sources_from_orders(spread(read_table(spark, sf, "orders", "o_orderkey", "o_custkey")))


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(read_table(spark, sf, "documents", "doc_id", "text"))


def document_sources(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.sources_from_documents(_documents(spark, sf))


def part_sources(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.sources_from_parts(spread(read_table(spark, sf, "part", "p_partkey")))


def text_sources(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.sources_from_texts(_documents(spark, sf))


def document_files(spark: SparkSession, sf: str) -> DataFrame:
    return with_language(document_sources(spark, sf))


def document_responses(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.responses_from_chunks(prompting.chunk_hits(document_files(spark, sf), CATALOGUE))


def document_review(spark: SparkSession, sf: str, minimum: str = "low") -> DataFrame:
    hits = audit.static_hits(document_sources(spark, sf), fields=_PLACED)
    return audit.review(document_responses(spark, sf), hits, minimum=minimum)


def _flat(file_results: DataFrame) -> DataFrame:
    """File results back to one row per finding."""
    return file_results.select("file", "language", F.posexplode("findings").alias("pos", "f")).select(
        "file", "language", "pos", "f.*"
    )


# --- static audit -----------------------------------------------------------------------------


def static_scan_counts(spark, sf):
    hits = audit.static_hits(order_sources(spark, sf), fields=_COUNTED)
    return hits.groupBy("lang", "rule", "severity").agg(F.count(F.lit(1)).alias("hits"))


def document_scan_counts(spark, sf):
    hits = audit.static_hits(document_sources(spark, sf), fields=_COUNTED)
    return hits.groupBy("lang", "rule", "severity").agg(F.count(F.lit(1)).alias("hits"))


def rule_scan_counts(spark, sf):
    """Hits of all rules, on a corpus that shows each of them."""
    hits = audit.static_hits(part_sources(spark, sf), fields=_COUNTED)
    return hits.groupBy("lang", "rule", "severity").agg(F.count(F.lit(1)).alias("hits"))


def extension_counts(spark, sf):
    """Files and lines of every extension and language."""
    lines = explode_lines(with_language(part_sources(spark, sf)))
    return lines.groupBy("lang", text.extension(F.col("path")).alias("ext")).agg(
        F.count_distinct("path").alias("files"), F.count(F.lit(1)).alias("lines")
    )


def overrides(spark, sf):
    """Findings of the same files under every override."""
    found = None
    for name in sorted(OVERRIDES):
        one = audit.static_hits(order_sources(spark, sf), override=name, fields=_COUNTED)
        one = one.groupBy("lang", "rule").agg(F.count(F.lit(1)).alias("hits"))
        found = one if found is None else found.unionByName(one)
    return found


def hits_by_line(spark, sf):
    return audit.static_hits(order_sources(spark, sf), fields=_COUNTED).orderBy("path", "line", "rule_ord").select(
        "path", "lang", "line", "rule_ord", "rule", "severity"
    )


def matched_text(spark, sf):
    return audit.static_hits(document_sources(spark, sf)).select("path", "line", "rule", "matched_text")


def multi_rule_lines(spark, sf):
    hits = audit.static_hits(order_sources(spark, sf), fields=("rule_ord",))
    return hits.groupBy("path", "line").agg(F.count(F.lit(1)).alias("rules")).where("rules > 1")


def rule_join_scan(spark, sf):
    lines = explode_lines(with_language(order_sources(spark, sf)))
    hits = scan_lines_by_join(lines, CATALOGUE)
    return hits.groupBy("lang", "rule").agg(
        F.count(F.lit(1)).alias("hits"), F.sum(F.length("matched_text")).alias("matched_chars")
    )


def user_rules(spark, sf):
    catalogue = CATALOGUE.with_rules(spark, USER_RULES)
    hits = audit.static_hits(order_sources(spark, sf), catalogue)
    names = [r["name"] for r in USER_RULES]
    return hits.where(F.col("rule").isin(names)).groupBy("lang", "rule", "severity", "matched_text").agg(
        F.count(F.lit(1)).alias("hits")
    )


def lang_detect(spark, sf):
    dim = spark.createDataFrame(list(EXTENSIONS.items()), "ext string, lang string")
    files = document_sources(spark, sf).select("path").withColumn("ext", text.extension(F.col("path")))
    joined = files.join(F.broadcast(dim), "ext")  # nine fixed rows
    return joined.groupBy("lang", "ext").agg(F.count(F.lit(1)).alias("files"))


def lang_override(spark, sf):
    found = audit.static_audit(order_sources(spark, sf), override="c")
    return found.groupBy("lang", "category").agg(F.count(F.lit(1)).alias("findings"))


def line_split(spark, sf):
    return explode_lines(document_files(spark, sf)).select("path", "line", "code")


def line_totals(spark, sf):
    lines = explode_lines(with_language(text_sources(spark, sf)))
    return lines.groupBy("path").agg(
        F.max("line").alias("lines"), F.sum(F.octet_length("code")).alias("bytes"), F.max(F.char_length("code")).alias("longest")
    )


def static_findings(spark, sf):
    return audit.static_audit(document_sources(spark, sf)).drop("rule_ord")


def critical_only(spark, sf):
    return with_severity(audit.static_audit(order_sources(spark, sf)), "CRITICAL").select("path", "line", "category", "pattern")


def severity_summary(spark, sf):
    return report.severity_counts(audit.static_audit(order_sources(spark, sf)))


def run_totals(spark, sf):
    return report.run_summary(audit.static_results(document_sources(spark, sf)))


def rule_ids(spark, sf):
    return report.rule_ids(audit.static_audit(order_sources(spark, sf)))


def findings_per_file(spark, sf):
    results = audit.static_results(document_sources(spark, sf))
    first = F.get("findings", F.lit(0))
    return results.select(
        "file",
        "language",
        F.size("findings").alias("finding_count"),
        first["line"].alias("first_line"),
        first["category"].alias("first_category"),
        F.array_join(F.transform("findings", lambda f: F.concat(f["line"].cast("string"), F.lit(":"), f["category"])), ",").alias(
            "finding_list"
        ),
    )


def json_documents(spark, sf):
    return report.json_documents(audit.static_results(document_sources(spark, sf)))


def file_report(spark, sf):
    return report.file_report(audit.static_results(document_sources(spark, sf)))


def sarif_results(spark, sf):
    return report.sarif_results(audit.static_audit(document_sources(spark, sf)))


def sarif_rules(spark, sf):
    rules = report.sarif_rules(audit.static_audit(order_sources(spark, sf)))
    return rules.withColumn("tags", F.array_join("tags", ","))


def sarif_documents(spark, sf):
    return report.sarif_documents(audit.static_results(document_sources(spark, sf)))


def sarif_log(spark, sf):
    folder = work_folder(spark, "findings")
    audit.static_audit(order_sources(spark, sf)).write.parquet(folder)
    return report.sarif_log_lines(spark.read.parquet(folder)).orderBy("part", "rule_id", "key").select("part", "text")


def cwe_rollup(spark, sf):
    hits = audit.static_hits(document_sources(spark, sf), fields=_COUNTED).groupBy("lang", "rule").agg(F.count(F.lit(1)).alias("n"))
    rules = CATALOGUE.to_df(spark).select("lang", F.col("name").alias("rule"), "cwe")
    return hits.join(F.broadcast(rules), ["lang", "rule"]).groupBy("cwe").agg(F.sum("n").alias("hits"))


def cwe_mentions(spark, sf):
    hits = audit.static_hits(document_sources(spark, sf))
    mentions = labels.cwe_numbers(F.concat_ws(" ", "description", "matched_text"))
    return hits.groupBy("rule").agg(F.sum(F.size(mentions)).alias("mentions"))


def suppressed(spark, sf):
    found = audit.static_audit(order_sources(spark, sf))
    orders = read_table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    listed = corpus.sources_from_orders(orders.where("o_orderstatus = 'F'")).select("path", F.lit("gets").alias("category"))
    kept = suppress(found, listed)
    return kept.groupBy("lang", "category").agg(F.count(F.lit(1)).alias("findings"))


def incremental_scan(spark, sf):
    """The audit as a stream over the table's files, run until nothing is new; then its output table."""
    orders = stream_table(spark, sf, "o_orderkey bigint, o_custkey bigint", glob="orders.parquet")
    out = work_folder(spark, "incremental")
    write_increment(corpus.sources_from_orders(orders), f"{out}/findings", f"{out}/checkpoint").awaitTermination()
    found = spark.read.parquet(f"{out}/findings")
    return found.groupBy("lang", "category", "confidence").agg(F.count(F.lit(1)).alias("findings"))


def incremental_changes(spark, sf):
    """What a second version of the corpus changes: new, edited and deleted files against the first."""
    orders = spread(read_table(spark, sf, "orders", "o_orderkey", "o_custkey"))
    edited = F.col("o_custkey") + F.when(F.col("o_orderkey") % 7 == 0, 3).otherwise(0)
    first = orders.where("o_orderkey % 5 <> 0").withColumn("o_custkey", edited)
    state = work_folder(spark, "state")
    refresh_sources(corpus.sources_from_orders(first), state)
    refresh_sources(corpus.sources_from_orders(orders.where("o_orderkey % 11 <> 0")), state)
    return changes(spark, state).groupBy("change", "lang", "category").agg(F.count(F.lit(1)).alias("findings"))


# --- chunks and prompts -----------------------------------------------------------------------


def _chunk_columns(chunks: DataFrame) -> DataFrame:
    return chunks.select("path", "lang", "chunk_id", "start_line", "line_count", "content")


def chunk_small(spark, sf):
    small = text_sources(spark, sf).where(F.octet_length("content") <= chunking.CHUNK_BYTES)
    return _chunk_columns(chunking.chunk_files(with_language(small)))


def chunk_lines(spark, sf):
    return _chunk_columns(chunking.chunk_files(with_language(text_sources(spark, sf))))


def chunk_pages(spark, sf):
    pages = spread(read_table(spark, sf, "pages", "page_id", "html"))
    return _chunk_columns(chunking.chunk_files(with_language(corpus.sources_from_pages(pages))))


def chunk_functions(spark, sf):
    return _chunk_columns(chunking.chunk_files(document_files(spark, sf)))


def chunk_preamble(spark, sf):
    chunks = chunking.chunk_files(document_files(spark, sf), keep_preamble=True)
    return _chunk_columns(chunks).drop("content")


def function_boundaries(spark, sf):
    files = document_files(spark, sf).select(
        "path", "lang", F.array_join(text.split_lines(F.col("content")), "\n").alias("body")
    )
    starts = chunking.function_starts(F.col("body"), F.col("lang"))
    return files.select("path", F.explode(starts).alias("start")).select("path", (F.col("start") + 1).alias("line"))


def hits_in_chunk(spark, sf):
    chunks = chunking.chunk_files(document_files(spark, sf)).drop("content")
    hits = audit.static_hits(document_sources(spark, sf))
    return chunking.hits_in_chunks(hits, chunks).select("path", "chunk_id", "start_line", "line", "rule")


def prompt_hits(spark, sf):
    chunks = prompting.chunk_hits(document_files(spark, sf), CATALOGUE)
    return chunks.select(
        "path", "chunk_id", prompting.hit_list(F.col("hits"), F.col("start_line")).alias("hit_list")
    )


def prompt_hits_file_lines(spark, sf):
    chunks = chunking.chunk_files(document_files(spark, sf)).drop("content")
    joined = chunking.hits_in_chunks(audit.static_hits(document_sources(spark, sf)), chunks)
    return prompting.hit_lists(joined, relative=False)


def prompts(spark, sf):
    return audit.build_prompts(document_sources(spark, sf))


# --- review -----------------------------------------------------------------------------------


def responses(spark, sf):
    return document_responses(spark, sf).select("path", "chunk_id", "response")


def response_status(spark, sf):
    decoded = decode_responses(document_responses(spark, sf))
    return decoded.select("path", "chunk_id", "parse_status", F.size("answer").alias("findings"))


def _parsed(spark, sf, status):
    found = parse_responses(document_responses(spark, sf)).where(F.col("parse_status") == status)
    return found.drop("lang", "start_line", "parse_status")


def response_strict(spark, sf):
    return _parsed(spark, sf, "strict")


def response_recovered(spark, sf):
    return _parsed(spark, sf, "recovered")


def parse_errors(spark, sf):
    return _parsed(spark, sf, "failed")


def coverage(spark, sf):
    chunks = chunking.chunk_files(document_files(spark, sf)).drop("content")
    answers = chunks.where("start_line % 2 = 1").withColumn("response", F.lit("[]"))
    counted = response_coverage(chunks, answers)
    return counted.groupBy("status").agg(F.count(F.lit(1)).alias("chunks"))


def near_hits(spark, sf):
    near = near_lines(audit.static_hits(document_sources(spark, sf), fields=("rule_ord",)))
    return near.groupBy("path").agg(F.count(F.lit(1)).alias("near_lines"))


def correlated(spark, sf):
    return document_review(spark, sf).drop("explanation", "parse_status")


def high_confidence(spark, sf):
    found = document_review(spark, sf, minimum="high")
    return found.groupBy("lang", "category", "severity").agg(F.count(F.lit(1)).alias("findings"))


def min_confidence_levels(spark, sf):
    found = document_review(spark, sf).drop("confidence").withColumnRenamed("raw_confidence", "confidence")
    return min_confidence(found, "medium").groupBy("confidence").agg(F.count(F.lit(1)).alias("findings"))


def reviewed_files(spark, sf):
    return report.reviewed_summary(document_files(spark, sf), document_review(spark, sf))


def _stored(df: DataFrame, name: str) -> DataFrame:
    """A table for what is read more than once."""
    folder = work_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _stored_review(spark, sf):
    """The reviewed findings as a table, for reports that read them more than once."""
    return _stored(document_review(spark, sf), "reviewed")


def reviewed_json(spark, sf):
    """One JSON document per file, as a fragment per finding."""
    return documents.reviewed_json_fragments(document_files(spark, sf), _stored_review(spark, sf))


def reviewed_sarif_documents(spark, sf):
    """One SARIF log per file, as fragments."""
    return documents.sarif_fragments(document_files(spark, sf), _stored_review(spark, sf))


def reviewed_report(spark, sf):
    """The text sections of all files, where every third chunk has no answer."""
    chunks = chunking.chunk_files(document_files(spark, sf)).drop("content")
    answers = _stored(document_responses(spark, sf).where("start_line % 3 <> 0"), "answers")
    found = _stored(audit.review(answers, audit.static_hits(document_sources(spark, sf), fields=_COUNTED)), "reviewed")
    missing = _stored(unreviewed_lines(chunks, answers), "missing")
    return documents.report_fragments(document_files(spark, sf).select("path", "lang"), found, missing)


def json_index(spark, sf):
    """Where the JSON document of each file stands among all documents."""
    results = audit.static_results(document_sources(spark, sf))
    return documents.document_index(documents.json_fragments(results))


def chunk_line_table(spark, sf):
    """Chunks packed from a table of lines by the parallel scan."""
    lines = explode_lines(with_language(text_sources(spark, sf)))
    return _chunk_columns(long_chunks.line_chunks(lines, block=64, fan=8))


def chunk_function_table(spark, sf):
    """Chunks of the files with several functions, packed from a table of lines and one of function starts."""
    files = document_files(spark, sf).where(F.octet_length("content") > chunking.CHUNK_BYTES)
    folder = work_folder(spark, "starts")
    long_chunks.starts_of_pieces(files.withColumn("first_line", F.lit(1).cast("bigint"))).write.parquet(folder)
    chunks = long_chunks.function_chunks(explode_lines(files), spark.read.parquet(folder), block=64, fan=8)
    return _chunk_columns(chunks)


def reviewed_missing(spark, sf):
    """Line ranges of files that no answer covers."""
    chunks = chunking.chunk_files(document_files(spark, sf)).drop("content")
    return unreviewed_lines(chunks, document_responses(spark, sf).where("start_line % 2 = 1"))


def reviewed_sarif(spark, sf):
    return report.sarif_results(document_review(spark, sf))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        static_scan_counts, document_scan_counts, rule_scan_counts, extension_counts, overrides, hits_by_line, matched_text, multi_rule_lines, rule_join_scan, user_rules,
        lang_detect, lang_override, line_split, line_totals, static_findings, critical_only, severity_summary, run_totals,
        rule_ids, findings_per_file, json_documents, file_report, sarif_results, sarif_rules, sarif_documents, sarif_log, cwe_rollup,
        cwe_mentions, suppressed, incremental_scan, incremental_changes, chunk_small, chunk_lines, chunk_pages, chunk_functions, chunk_preamble, function_boundaries,
        hits_in_chunk, prompt_hits, prompt_hits_file_lines, prompts, responses, response_status, response_strict,
        response_recovered, parse_errors, coverage, near_hits, correlated, high_confidence, min_confidence_levels,
        reviewed_files, reviewed_json, reviewed_sarif, reviewed_sarif_documents, reviewed_missing, reviewed_report, json_index, chunk_line_table,
        chunk_function_table,
    )
}
