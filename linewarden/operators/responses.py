"""Reviewer answers -> findings: strict JSON first, then recovery field by field, else one error row.

All steps are expressions on the row of an answer; nothing shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewarden.functions.columns import settled
from linewarden.functions.json_text import field, first_array, object_spans, object_texts, object_tokens, unsigned32
from linewarden.operators.findings import FINDING_FIELDS

# --- fixed values: keys of a finding, synonyms, defaults and the error row ----------------------
REQUIRED_TEXTS = ("severity", "category", "pattern", "explanation", "suggestion")
SYNONYMS = {"category": ("type",), "explanation": ("risk", "description"), "suggestion": ("fix",)}
DEFAULT_SEVERITY = "MEDIUM"
DEFAULT_CATEGORY = "unknown"
ERROR_SEVERITY = "INFO"
ERROR_CATEGORY = "parse-error"
ERROR_TEXT = "Model response could not be parsed as JSON. Raw output: "
ERROR_SUGGESTION = "Re-run or inspect the file manually."
ERROR_EXCERPT = 400

STRICT, RECOVERED, FAILED = "strict", "recovered", "failed"


def _strict_ok(item: Column) -> Column:
    def kind(key):
        return F.schema_of_variant(F.variant_get(item, f"$.{key}", "variant"))

    ok = F.lit(True)
    for key in REQUIRED_TEXTS:
        ok = ok & (kind(key) == "STRING")
    line = F.try_variant_get(item, "$.line", "bigint")
    line_ok = kind("line").isNull() | (kind("line") == "VOID") | ((kind("line") == "BIGINT") & line.between(0, 4294967295))
    confidence = F.try_variant_get(item, "$.confidence", "string")
    confidence_ok = kind("confidence").isNull() | ((kind("confidence") == "STRING") & confidence.isin("LOW", "MEDIUM", "HIGH"))
    return F.coalesce(ok & line_ok & confidence_ok, F.lit(False))


def _finding(line, severity, category, pattern, explanation, suggestion, confidence) -> Column:
    values = (line, severity, category, pattern, explanation, suggestion, confidence)
    return F.struct(*[v.alias(n) for v, n in zip(values, FINDING_FIELDS)])


def _strict_finding(item: Column) -> Column:
    def text(key):
        return F.variant_get(item, f"$.{key}", "string")

    return _finding(
        F.variant_get(item, "$.line", "bigint"),
        *[text(key) for key in REQUIRED_TEXTS],
        F.coalesce(text("confidence"), F.lit("LOW")),
    )


def _first_field(obj: Column, key: str) -> Column:
    return F.coalesce(*[field(obj, name) for name in (key, *SYNONYMS.get(key, ()))])


def _recovered_finding(obj: Column) -> Column:
    bare_line = F.regexp_extract(obj, r'(?U)(?:line|Line)"?\s*[:=]?\s*(\d+)', 1)
    return _finding(
        F.coalesce(unsigned32(field(obj, "line")), unsigned32(bare_line)),
        F.coalesce(_first_field(obj, "severity"), F.lit(DEFAULT_SEVERITY)),
        F.coalesce(_first_field(obj, "category"), F.lit(DEFAULT_CATEGORY)),
        F.coalesce(_first_field(obj, "pattern"), F.lit("")),
        F.coalesce(_first_field(obj, "explanation"), F.lit("")),
        F.coalesce(_first_field(obj, "suggestion"), F.lit("")),
        F.lit("MEDIUM"),
    )


def _error_finding(response: Column) -> Column:
    return _finding(
        F.lit(None).cast("bigint"),
        F.lit(ERROR_SEVERITY),
        F.lit(ERROR_CATEGORY),
        F.lit(""),
        F.concat(F.lit(ERROR_TEXT), F.left(response, F.lit(ERROR_EXCERPT))),
        F.lit(ERROR_SUGGESTION),
        F.lit("LOW"),
    )


def decode_responses(responses: DataFrame) -> DataFrame:
    """Add ``parse_status`` and ``answer`` (array of findings) to rows that have a ``response``."""
    keys = [c for c in responses.columns if c != "response"]
    # Settled one by one: tokens, spans and objects are read once for every object of an answer.
    staged = settled(responses.where(F.col("response").isNotNull()), body=first_array(F.col("response")))
    parsed = staged.withColumn("items", F.try_variant_get(F.try_parse_json("body"), "$", "array<variant>"))
    strict = settled(parsed, is_strict=F.col("items").isNotNull() & F.forall("items", _strict_ok))
    strict = settled(strict, tokens=F.when(~F.col("is_strict"), object_tokens(F.col("body"))))
    strict = settled(strict, spans=object_spans(F.col("tokens")))
    strict = settled(strict, objects=object_texts(F.col("tokens"), F.col("spans")))
    recovered = settled(
        strict,
        recovered=F.when(
            ~F.col("is_strict"),
            F.filter(
                F.transform("objects", _recovered_finding),
                lambda f: ~((f["category"] == DEFAULT_CATEGORY) & (f["pattern"] == "") & (f["explanation"] == "")),
            ),
        ),
    )
    some = F.size("recovered") > 0
    return settled(
        recovered,
        parse_status=F.when(F.col("is_strict"), STRICT).when(some, RECOVERED).otherwise(FAILED),
        answer=F.when(F.col("is_strict"), F.transform("items", _strict_finding))
        .when(some, F.col("recovered"))
        .otherwise(F.array(_error_finding(F.col("response")))),
    ).select(*keys, "parse_status", "answer")


def parse_responses(responses: DataFrame) -> DataFrame:
    """One row per finding, with its position ``seq`` in the answer and chunk-relative lines."""
    decoded = decode_responses(responses)
    keys = [c for c in decoded.columns if c != "answer"]
    return (
        decoded.select(*keys, F.posexplode_outer("answer").alias("seq", "f"))
        .where(F.col("f").isNotNull())
        .select(*keys, "seq", *[f"f.{c}" for c in FINDING_FIELDS])
    )


def rebase_lines(findings: DataFrame) -> DataFrame:
    """Chunk-relative line -> file line, by the start line of the chunk."""
    return findings.withColumn("line", F.col("line") + F.greatest(F.col("start_line") - 1, F.lit(0)))


def response_coverage(chunks: DataFrame, responses: DataFrame) -> DataFrame:
    """``status`` per chunk: answered or missing.  Only keys travel."""
    answered = responses.where(F.col("response").isNotNull()).select("path", "chunk_id", F.lit("answered").alias("status"))
    return chunks.select("path", "chunk_id").join(answered, ["path", "chunk_id"], "left").withColumn(
        "status", F.coalesce("status", F.lit("missing"))
    )


def unreviewed_lines(chunks: DataFrame, responses: DataFrame) -> DataFrame:
    """``path, first_line, last_line, status`` of the lines that no answered chunk covers, as few ranges as possible.

    ``status`` is "unreviewed" where no chunk of the file is answered, else "partly reviewed".  A range begins at a
    missing chunk whose predecessor is not missing; the windows of a file hold positions of chunks only.
    """
    covered = response_coverage(chunks, responses).groupBy("path", "chunk_id").agg(F.min("status").alias("status"))
    placed = chunks.where("line_count > 0").select(
        "path", "chunk_id", "start_line", (F.col("start_line") + F.col("line_count") - 1).alias("last_line")
    ).join(covered, ["path", "chunk_id"])
    file = Window.partitionBy("path")
    missing = F.col("status") == "missing"
    before = F.lag(missing, 1, False).over(file.orderBy("start_line"))
    begun = F.sum((missing & ~before).cast("int")).over(file.orderBy("start_line"))
    none = F.min(missing).over(file)
    ranged = placed.withColumn("range", begun).withColumn("none", none).where(missing)
    return ranged.groupBy("path", "range", "none").agg(F.min("start_line").alias("first_line"), F.max("last_line").alias("last_line")).select(
        "path", "first_line", "last_line", F.when(F.col("none"), "unreviewed").otherwise("partly reviewed").alias("status")
    )
