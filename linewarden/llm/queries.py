"""One query per operator over its whole table, with production parameters, and the same in DuckDB SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewarden.llm import decontaminate, manifest, mixture, nearjoin, packing, quality, repeats, runs, templates, tokens, toolcalls, toxicity, urlrules

#: The folder of vocabularies, and the one that is used.
TOKENIZERS = os.environ.get("LINEWARDEN_TOKENIZERS", "")
VOCABULARY = "byte_bpe_50k.json"
#: (host, path, verdict) of the rules that pages are judged by.
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_path() -> str:
    if TOKENIZERS:
        return os.path.join(TOKENIZERS, VOCABULARY)
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_remove_repeats(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return repeats.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.find_items(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "item_id", "n_shingles", "n_common")


def op3_tool_calls(spark: SparkSession, sf: str) -> DataFrame:
    calls, results = toolcalls.calls_of_conversations(table(spark, sf, "conversations"))
    schemas = spark.createDataFrame(toolcalls.SCHEMAS, "tool string, field string, type string, required boolean")
    return toolcalls.link_tool_calls(calls, results, schemas)


def op4_extract_text(spark: SparkSession, sf: str) -> DataFrame:
    return templates.extract(table(spark, sf, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def crc32_of_id() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


def held_out() -> F.Column:
    return F.coalesce(crc32_of_id() % 3 == 1, F.lit(False))


def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf, "labels").where(~held_out()))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op6_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.round_trip(table(spark, sf, "documents"), tokenizer_path())


def op7_url_rules(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, sf, "pages").select("page_id", "url")
    return urlrules.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op8_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    return mixture.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op9_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality.judge(table(spark, sf, "documents").select("doc_id", "text"))
    names = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", "n_words", *names, "base_failed", "kept")


def op10_near_components(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return nearjoin.near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


def op11_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(*manifest.FIELDS)
    lowered = F.translate("text", urlrules.UPPER, urlrules.LOWER)
    tampered = {"text": F.when(crc32_of_id() % 3 == 0, lowered).otherwise(F.col("text"))}
    return manifest.manifest(docs, changed=tampered)


def planted_period(seed: int | None, n: int) -> tuple[int, int] | None:
    """Of every tenth seed: the word from which on the words repeat, and the period."""
    if seed is None or seed % 10 or not n:
        return None
    g = seed // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def op12_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = runs.periodic_runs(docs, seed=crc32_of_id(), rewrite=planted_period)
    line = F.transform("runs", lambda x: F.concat_ws(",", *[x[k].cast("string") for k in ("start", "length", "period")]))
    best = found.withColumn("best", runs.strongest(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{k}").alias(k) for k in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_pack_sequences(spark: SparkSession, sf: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf, "documents").select("doc_id", "text"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_remove_repeats,
        op2_decontaminate,
        op3_tool_calls,
        op4_extract_text,
        op5_toxicity,
        op6_token_files,
        op7_url_rules,
        op8_mix_sources,
        op9_quality_rules,
        op10_near_components,
        op11_merkle_manifest,
        op12_periodic_runs,
        op13_pack_sequences,
    )
}

_UPPER, _LOWER = urlrules.UPPER, urlrules.LOWER
_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWERED = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+')"




def _half_byte(value: int) -> int:
    """Four steps of the reflected polynomial of CRC-32."""
    for _ in range(4):
        value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
    return value


def _crc32(text: str) -> str:
    """SQL of the CRC-32 of an ASCII text."""
    table = [_half_byte(v) for v in range(16)]
    half = f"xor(c >> 4, ({table}::BIGINT[])[(c & 15) + 1])"
    halves = f"list_concat([4294967295::BIGINT], flatten(list_transform(string_split({text}, ''), lambda x: [ascii(x)::BIGINT, -1])))"
    # A byte is mixed in before its first half; the mark -1 asks for the second half alone.
    return f"xor(list_reduce({halves}, lambda s, b: list_transform([xor(s, CASE WHEN b < 0 THEN 0 ELSE b END)], lambda c: {half})[1]), 4294967295)"


def _tree(name: str, source: str) -> str:
    """CTEs: nodes of all levels of the trees in ``source`` (tree, pos, digest, n), and what stands beside each."""
    return f"""
{name} AS (
  SELECT tree, 0 AS level, pos, digest, n FROM {source}
  UNION ALL
  SELECT tree, level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (n + 7) // 8 FROM {name} WHERE n > 1
  GROUP BY tree, level, pos // 8, n
),
{name}_beside AS (
  SELECT tree, level, pos,
         coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
         coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt
  FROM {name} WHERE n > 1 WINDOW w AS (PARTITION BY tree, level, pos // 8 ORDER BY pos)
)"""


def _fold(name: str, start: str, beside: str) -> str:
    """CTEs: rows (doc_id, tree, pos, node, told) climb to the top; ``told`` gathers the siblings."""
    return f"""
{name} AS (
  SELECT doc_id, tree, 0 AS level, pos, node, told FROM {start}
  UNION ALL
  SELECT f.doc_id, f.tree, f.level + 1, f.pos // 8, sha256(lft || node || rgt), told || lft || rgt
  FROM {name} f JOIN {beside} b ON b.tree = f.tree AND b.level = f.level AND b.pos = f.pos
),
{name}_end AS (SELECT doc_id, arg_max(node, level) AS node, arg_max(told, level) AS told FROM {name} GROUP BY doc_id)"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _missed(t: quality.Threshold) -> str:
    ratio = {
        "word_length": "word_chars / n_words",
        "symbol": "n_symbols / n_words",
        "stop": "n_stop / n_words",
        "dup_line": "n_dup_lines / n_lines",
        "stutter": "n_stutter / n_words",
    }[t.ratio]
    below = ratio.rsplit(" ", 1)[1]
    return f"(n_words >= {t.words} AND NOT (CASE WHEN {below} > 0 THEN {ratio} ELSE 0 END) BETWEEN {t.low} AND {t.high})"


def _shingled(name: str, source: str, key: str) -> str:
    """CTEs with the distinct shingles of a table."""
    return rf"""
{name}_words AS (SELECT {key}, {_LOWERED} AS w FROM {source}),
{name} AS (
  SELECT DISTINCT {key}, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT {key}, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM {name}_words WHERE len(w) > 0)
)"""


ORACLES: dict[str, str] = {
    "op2_decontaminate": f"""
WITH {_shingled("d", "documents", "doc_id")}, {_shingled("b", "benchmark", "item_id")},
sizes AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, count(*) AS n_common
FROM d JOIN b USING (g) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, n_shingles HAVING 100 * count(*) >= 75 * n_shingles""",
    "op3_tool_calls": r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, 'call_' || conv_id || '_' || turn AS call_id, text, (conv_id + turn) % 3 AS kind,
         CASE WHEN turn > 2 AND (conv_id + turn) % 9 <> 0 THEN 'call_' || conv_id || '_' || (turn - 2) END AS after
  FROM conversations WHERE role = 'assistant'
),
known AS (SELECT c.*, p.call_id AS up FROM c LEFT JOIN c AS p ON p.conv_id = c.conv_id AND p.call_id = c.after),
levels AS (
  SELECT conv_id, call_id, 0 AS level FROM known WHERE up IS NULL
  UNION ALL
  SELECT k.conv_id, k.call_id, l.level + 1 FROM known k JOIN levels l ON l.conv_id = k.conv_id AND l.call_id = k.up
),
r AS (SELECT conv_id, turn, 'call_' || conv_id || '_' || (turn - 1) AS call_id, text AS content FROM conversations WHERE role <> 'assistant'),
linked AS (
  SELECT c.*, l.level, r.turn AS result_turn, r.content FROM c JOIN levels l USING (conv_id, call_id) LEFT JOIN r USING (conv_id, call_id)
)
SELECT conv_id, turn, call_id, level, CASE WHEN result_turn IS NULL THEN 'missing' ELSE 'linked' END AS status,
       CASE WHEN kind = 1 THEN 'type limit' ELSE '' END AS errors,
       '{"arguments":' ||
       CASE kind WHEN 0 THEN '{"limit":' || turn || ',"query":' || to_json(text)::VARCHAR || '}'
                 WHEN 1 THEN '{"limit":"' || turn || '","text":' || to_json(text)::VARCHAR || '}'
                 ELSE '{"strict":' || (turn % 2 = 0)::VARCHAR || ',"text":' || to_json(text)::VARCHAR || '}' END
       || ',"id":"' || call_id || '","name":"' || ['search', 'count', 'check'][kind + 1] || '","result":'
       || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS json
FROM linked
UNION ALL
SELECT conv_id, turn, call_id, NULL, 'orphan', '', 'null' FROM r ANTI JOIN c USING (conv_id, call_id)""",
    "op7_url_rules": f"""
WITH rules(h, p, v) AS (VALUES {_RULES}),
u AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
hp AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
),
best AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM hp JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM hp LEFT JOIN best USING (page_id)""",
    "op9_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
cover AS (
  SELECT doc_id, sum(least(8, coalesce(next - i, 8))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM twice) GROUP BY doc_id
),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
counted AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: list_contains([{", ".join(repr(w) for w in quality.STOP_WORDS)}], lower(x)))) AS n_stop,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutter
  FROM d JOIN lines USING (doc_id) LEFT JOIN cover USING (doc_id)
),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({" OR ".join(_missed(t) for t in quality.THRESHOLDS)}) AS kept
FROM judged""",
    "op10_near_components": f"""
WITH RECURSIVE {_shingled("s", "documents", "doc_id")},
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN sizes USING (doc_id)""",
    "op11_merkle_manifest": f"""
WITH RECURSIVE d AS (
  SELECT *, CASE WHEN {_crc32("doc_id::VARCHAR")} % 3 = 0 THEN translate(text, '{_UPPER}', '{_LOWER}') ELSE text END AS later FROM documents
),
leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {" || ".join(f"{_field(c)} AS leaf" if c == "text" else _field(c) for c in manifest.FIELDS)},
         {" || ".join(_field(c) for c in (*manifest.FIELDS[:-1], "later"))} AS now
  FROM d
),
hashed AS (
  SELECT doc_id, tree, sha256(leaf) AS digest, sha256(now) AS now,
         row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n
  FROM leaves
), {_tree("nodes", "hashed")},
tops AS (
  SELECT '' AS tree, tree AS of, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), {_tree("upper", "tops")},
begun AS (SELECT doc_id, tree, pos, now AS node, '' AS told FROM hashed), {_fold("inside", "begun", "nodes_beside")},
risen AS (
  SELECT doc_id, '' AS tree, t.pos, e.node, e.told FROM inside_end e JOIN hashed USING (doc_id) JOIN tops t ON t.of = hashed.tree
), {_fold("above", "risen", "upper_beside")}
SELECT doc_id, h.digest AS leaf, t.digest AS subroot, r.digest AS root, sha256(a.told) AS proof_sha256, a.node AS folded_root,
       a.node = r.digest AS verified
FROM hashed h JOIN tops t ON t.of = h.tree JOIN above_end a USING (doc_id), (SELECT digest FROM upper WHERE n = 1) r""",
}
