"""The queries again as DuckDB SQL, written without the shortcuts of the Spark side.

Rules run one by one over all lines of their language, chunks are packed by a recursive query, and
answers are decoded with JSON functions.
"""

from __future__ import annotations

from linewarden.operators import prompts as prompting
from linewarden.operators import report
from linewarden.operators import responses as reviewing
from linewarden.operators.chunks import CHUNK_BYTES, FUNCTION_STARTS
from linewarden.operators.report import SARIF_SCHEMA, SARIF_VERSION, TOOL
from linewarden.plans.queries import CATALOGUE, USER_RULES
from linewarden.sources import corpus
from linewarden.sources.rules import EXTENSIONS, OVERRIDES

# RE2 has ASCII classes; these are the Unicode ones.
_WORD = r"\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}"
_SPACE = r"\s\x{0b}\x{85}\p{Z}"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _unicode(regex: str) -> str:
    out, depth = "", 0
    i = 0
    while i < len(regex):
        two = regex[i : i + 2]
        if two in (r"\w", r"\s"):
            inner = _WORD if two == r"\w" else _SPACE
            out += inner if depth else f"[{inner}]"
            i += 2
        elif two.startswith("\\"):
            out += two
            i += 2
        else:
            depth += {"[": 1, "]": -1}.get(regex[i], 0)
            out += regex[i]
            i += 1
    return out


def _pick(values, index: str) -> str:
    return f"([{', '.join(map(q, values))}])[({index}) % {len(values)} + 1]"


def _path(prefix: str, key: str) -> str:
    return f"{q(prefix)} || {key} || {_pick(corpus.EXTENSION_CYCLE, key)}"


ORDER_SOURCES = f"""SELECT {_path('src/f', 'o_orderkey')} AS path,
    array_to_string(list_transform(generate_series(1, o_custkey % 7 + 1),
        lambda i: {_pick(corpus.ORDER_FRAGMENTS, 'o_custkey * 7 + o_orderkey * 3 + i * 5')}), chr(10)) AS content
    FROM orders"""
DOCUMENT_SOURCES = f"""SELECT {_path('doc/d', 'doc_id')} AS path,
    array_to_string(list_transform(string_split(text, '. '),
        lambda s, i: {_pick(corpus.DOCUMENT_FRAGMENTS, 'doc_id * 7 + (i - 1) * 5 + length(s)')} || ' // ' || s), chr(10)) AS content
    FROM documents"""
def _part_sources() -> str:
    """The files of parts: the same SQL, but for names of functions, the dialect's lambda and integer division."""
    sql = corpus.part_file_sql("list_transform", "array_to_string")

    def told(text: str) -> str:
        text = text.replace("i -> ", "lambda i: ").replace("sequence(", "generate_series(").replace(" div ", " // ").replace("element_at(array(", "list_extract(list_value(")
        return text

    return f"SELECT {told(sql['path'])} AS path, {told(sql['content'])} AS content FROM part"


PART_SOURCES = _part_sources()
TEXT_SOURCES = f"SELECT {_path('txt/d', 'doc_id')} AS path, text AS content FROM documents"
PAGE_SOURCES = f"SELECT {_path('web/p', 'page_id')} AS path, html AS content FROM pages"

_DETECT = "CASE regexp_extract(path, '[^/][.]([^./]+)$', 1) " + " ".join(
    f"WHEN {q(ext)} THEN {q(lang)}" for ext, lang in EXTENSIONS.items()
) + " END"

_SPLIT = "CASE WHEN content = '' THEN [] ELSE string_split(regexp_replace(replace(content, chr(13) || chr(10), chr(10)), '\\n\\z', ''), chr(10)) END"


def _files(sources: str, override: str | None = None) -> str:
    lang = q(override) if override else _DETECT
    return f"""sources AS ({sources}),
    files AS MATERIALIZED (SELECT path, {lang} AS lang, content, {_SPLIT} AS lines FROM sources WHERE {lang} IS NOT NULL),
    code AS MATERIALIZED (SELECT path, lang, unnest(lines) AS code, generate_subscripts(lines, 1) AS line FROM files)"""


def _hits(rules=None) -> str:
    branches = [
        f"""SELECT path, lang, CAST(line AS INTEGER) AS line, {r.rule_ord} AS rule_ord, {q(r.name)} AS rule,
        {q(r.severity)} AS severity, {q(r.description)} AS description,
        regexp_replace(regexp_extract(code, {q(r.regex)}, 0), '^\\s+|\\s+$', '', 'g') AS matched_text
        FROM code WHERE lang = {q(r.lang)} AND regexp_matches(code, {q(r.regex)})"""
        for r in (CATALOGUE.rules if rules is None else rules)
    ]
    return "hits AS MATERIALIZED (" + " UNION ALL ".join(branches) + ")"


ORDERS = f"WITH {_files(ORDER_SOURCES)}, {_hits()}"
PARTS = f"WITH {_files(PART_SOURCES)}, {_hits()}"
DOCUMENTS = f"WITH RECURSIVE {_files(DOCUMENT_SOURCES)}, {_hits()}"

_FINDING = """line::BIGINT AS line, severity, rule AS category, matched_text AS pattern, description AS explanation,
    '' AS suggestion, 'MEDIUM' AS confidence"""


# --- chunks -----------------------------------------------------------------------------------


def _chunks(preamble: bool = False, by_line: bool = False) -> str:
    marks = " ".join(
        f"WHEN {q(lang)} THEN regexp_replace(array_to_string(lines, chr(10)), {q(_unicode(regex))}, chr(1) || '\\0', 'g')"
        for lang, regex in FUNCTION_STARTS.items()
    )
    first = "CASE WHEN list_contains(found, 0) THEN found ELSE list_prepend(0, found) END" if preamble else "found"
    several = "false" if by_line else "len(found) > 1"
    least = -1 if by_line else CHUNK_BYTES
    return f"""big AS MATERIALIZED (SELECT path, lines, string_split(CASE lang {marks} END, chr(10)) AS marked
        FROM files WHERE strlen(content) > {least}),
    starts AS (SELECT path, lines, list_filter(list_transform(marked,
        lambda s, i: CASE WHEN starts_with(s, chr(1)) THEN i - 1 END), lambda x: x IS NOT NULL) AS found FROM big),
    modes AS MATERIALIZED (SELECT path, lines, {several} AS functions,
        CASE WHEN {several} THEN {first} ELSE range(len(lines)) END AS pos FROM starts),
    items AS MATERIALIZED (SELECT path, functions, generate_subscripts(pos, 1) AS k, unnest(pos) AS pos,
        unnest(list_transform(pos, lambda p, i: strlen(array_to_string(
            lines[p + 1 : coalesce(pos[i + 1], len(lines))], chr(10))))) AS bytes FROM modes),
    pack AS (
        SELECT path, 0::BIGINT AS k, 0::BIGINT AS start, -1::BIGINT AS first, 0::BIGINT AS used,
            NULL::BIGINT AS done_start, NULL::BIGINT AS done_first, NULL::BIGINT AS done_last FROM modes
        UNION ALL
        SELECT p.path, i.k,
            CASE WHEN flush OR (functions AND p.used = 0) THEN i.pos ELSE p.start END,
            CASE WHEN flush OR p.used = 0 THEN (CASE WHEN i.bytes > 0 THEN i.pos ELSE -1 END) ELSE p.first END,
            CASE WHEN flush OR p.used = 0 THEN i.bytes ELSE p.used + 1 + i.bytes END,
            CASE WHEN flush THEN p.start END, CASE WHEN flush THEN p.first END, CASE WHEN flush THEN i.pos - 1 END
        FROM pack p JOIN items i ON i.path = p.path AND i.k = p.k + 1,
            LATERAL (SELECT p.used > 0 AND p.used + i.bytes + (CASE WHEN functions THEN 0 ELSE 1 END) > {CHUNK_BYTES} AS flush)
    ),
    spans AS (
        SELECT path, done_start AS start, done_first AS first, done_last AS last FROM pack WHERE done_start IS NOT NULL
        UNION ALL
        SELECT path, start, first, len(lines) - 1 FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY k DESC) AS r FROM pack)
            JOIN modes USING (path) WHERE r = 1 AND used > 0
    ),
    chunks AS MATERIALIZED (
        SELECT path, lang, 0 AS chunk_id, 1 AS start_line, len(lines)::INTEGER AS line_count, content
            FROM files WHERE strlen(content) <= {least}
        UNION ALL
        SELECT path, lang, (row_number() OVER (PARTITION BY path ORDER BY start) - 1)::INTEGER, (start + 1)::INTEGER,
            (last - first + 1 - (lines[last + 1] = '')::INTEGER)::INTEGER, array_to_string(lines[first + 1 : last + 1], chr(10))
            FROM spans JOIN files USING (path)
    )"""


CHUNKS = _chunks()
_LIST = "{'line': line, 'rule_ord': rule_ord, 'rule': rule, 'severity': severity, 'description': description, 'matched_text': matched_text}"
CHUNK_HITS = f"""chunk_hits AS MATERIALIZED (
    SELECT c.path, c.lang, c.chunk_id, c.start_line, c.line_count, c.content,
        coalesce(list({_LIST} ORDER BY line, rule_ord) FILTER (line IS NOT NULL), []) AS hits
    FROM chunks c LEFT JOIN (SELECT path, line, rule_ord, rule, severity, description, matched_text FROM hits) h
        ON h.path = c.path AND h.line >= c.start_line AND h.line < c.start_line + c.line_count
    GROUP BY ALL)"""


def _hit_list(shift: str) -> str:
    return f"""array_to_string(list_transform(hits, lambda h: '  - Line ' || (h.line - {shift}) || ': [' || h.severity || '] `' ||
        h.rule || '` matched `' || h.matched_text || '` — ' || h.description), chr(10))"""


_PROMPT_HITS = f"CASE WHEN len(hits) = 0 THEN {q(prompting.NO_HITS)} ELSE {_hit_list('(start_line - 1)')} END"


def _prompt() -> str:
    parts = prompting.INSTRUCTIONS
    pieces = []
    for name, value in (("{lang}", "lang"), ("{hits}", _PROMPT_HITS), ("{code}", "content")):
        before, parts = parts.split(name)
        pieces += [q(before), value]
    return " || ".join([*pieces, q(parts)])


# --- review -----------------------------------------------------------------------------------


def _responses() -> str:
    sql = corpus.response_sql("list_transform", "array_to_string", "len")
    response = sql["response"].replace("(h, i) ->", "lambda h, i:").replace("(h.line + i) % 5", "(h.line + i - 1) % 5")
    return f"""answers AS MATERIALIZED (SELECT path, lang, chunk_id, start_line, shape, {response} AS response
        FROM (SELECT *, {sql['shape']} AS shape FROM chunk_hits))"""


REVIEW_INPUT = f"{DOCUMENTS}, {CHUNKS}, {CHUNK_HITS}, {_responses()}"

# The made-up answers are simple enough for a regex to find the array: from the first "[" to the "]"
# that ends it, which is the last one but for the shape with prose behind it.
_BODY = """CASE WHEN shape = 1 THEN regexp_extract(response, '(?s)^[^\\[]*(\\[.*\\]) and nothing else', 1)
    WHEN contains(response, '[') THEN regexp_replace(response, '(?s)^[^\\[]*', '') ELSE response END"""
_OK = " AND ".join(f"json_type(x, '$.{k}') IS NOT DISTINCT FROM 'VARCHAR'" for k in reviewing.REQUIRED_TEXTS)


def _field(*names: str) -> str:
    found = [rf"""nullif(replace(replace(regexp_extract(o, '"?{n}"?\s*[:=]\s*"((?:\\"|[^"])*)"', 1), '\"', '"'), '\\', '\'), '')""" for n in names]
    return f"coalesce({', '.join(found)})"


PARSED = f"""bodies AS (SELECT path, lang, chunk_id, start_line, response, {_BODY} AS body FROM answers),
    elements AS MATERIALIZED (SELECT path, chunk_id, unnest(list) AS x, generate_subscripts(list, 1) - 1 AS seq FROM (
        SELECT path, chunk_id, CASE WHEN json_valid(body) THEN json_extract(body, '$[*]') END AS list FROM bodies) WHERE list IS NOT NULL),
    strictness AS MATERIALIZED (SELECT path, chunk_id, any_value(json_valid(body)) AND bool_and(x IS NULL OR ({_OK})) AS strict
        FROM bodies LEFT JOIN elements USING (path, chunk_id) GROUP BY ALL),
    strict_rows AS (SELECT path, chunk_id, seq::INTEGER AS seq, CAST(x->>'$.line' AS BIGINT) AS line, x->>'$.severity' AS severity,
        x->>'$.category' AS category, x->>'$.pattern' AS pattern, x->>'$.explanation' AS explanation,
        x->>'$.suggestion' AS suggestion, coalesce(x->>'$.confidence', 'LOW') AS confidence, 'strict' AS parse_status
        FROM elements JOIN strictness USING (path, chunk_id) WHERE strict),
    pieces AS (SELECT path, chunk_id, unnest(list) AS o, generate_subscripts(list, 1) - 1 AS seq FROM (
        SELECT path, chunk_id, regexp_extract_all(body, '(?s)\\{{(?:[^{{}}"\\\\]|\\\\.|"(?:[^"\\\\]|\\\\.)*")*(?:\\}}|("(?:[^"\\\\]|\\\\.)*)?$)') AS list
        FROM bodies JOIN strictness USING (path, chunk_id) WHERE NOT strict)),
    recovered_rows AS (SELECT path, chunk_id, seq::INTEGER AS seq,
        coalesce(TRY_CAST({_field('line')} AS BIGINT), TRY_CAST(regexp_extract(o, '(?:line|Line)"?\\s*[:=]?\\s*(\\d+)', 1) AS BIGINT)) AS line,
        coalesce({_field('severity')}, 'MEDIUM') AS severity, coalesce({_field('category', 'type')}, 'unknown') AS category,
        coalesce({_field('pattern')}, '') AS pattern, coalesce({_field('explanation', 'risk', 'description')}, '') AS explanation,
        coalesce({_field('suggestion', 'fix')}, '') AS suggestion, 'MEDIUM' AS confidence, 'recovered' AS parse_status FROM pieces),
    kept AS (SELECT * FROM recovered_rows WHERE NOT (category = 'unknown' AND pattern = '' AND explanation = '')),
    failed_rows AS (SELECT path, chunk_id, 0 AS seq, NULL::BIGINT AS line, 'INFO' AS severity, 'parse-error' AS category,
        '' AS pattern, {q(reviewing.ERROR_TEXT)} || left(response, {reviewing.ERROR_EXCERPT}) AS explanation,
        {q(reviewing.ERROR_SUGGESTION)} AS suggestion, 'LOW' AS confidence, 'failed' AS parse_status
        FROM bodies JOIN strictness USING (path, chunk_id)
        WHERE NOT strict AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.path = bodies.path AND k.chunk_id = bodies.chunk_id)),
    parsed AS MATERIALIZED (SELECT * FROM strict_rows UNION ALL SELECT * FROM kept UNION ALL SELECT * FROM failed_rows)"""

REVIEW = f"""{REVIEW_INPUT}, {PARSED},
    placed AS (SELECT p.* EXCLUDE (line, confidence), lang, p.line + start_line - 1 AS line, p.confidence AS raw_confidence
        FROM parsed p JOIN answers USING (path, chunk_id)),
    reviewed AS MATERIALIZED (SELECT p.*, CASE WHEN raw_confidence = 'HIGH' OR EXISTS (
        SELECT 1 FROM hits h WHERE h.path = p.path AND abs(h.line - p.line) <= 2) THEN 'HIGH' ELSE 'MEDIUM' END AS confidence
        FROM placed p)"""

_COLUMNS = "line, severity, category, pattern, explanation, suggestion, confidence"
_LEVEL = "CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'error' WHEN severity = 'MEDIUM' THEN 'warning' ELSE 'note' END"
_RANK = "CASE confidence WHEN 'LOW' THEN 25.0::DOUBLE WHEN 'MEDIUM' THEN 60.0::DOUBLE ELSE 90.0::DOUBLE END"
_PASCAL = "array_to_string(list_transform(string_split({0}, '-'), lambda p: upper(p[1:1]) || p[2:]), '')"


def _json(text: str) -> str:
    return f"to_json({text})::VARCHAR"


_FINDING_JSON = f"""'{{"line":' || coalesce(line::VARCHAR, 'null') || ',"severity":' || {_json('severity')} || ',"category":' || {_json('category')}
    || ',"pattern":' || {_json('pattern')} || ',"explanation":' || {_json('explanation')} || ',"suggestion":' || {_json('suggestion')}
    || ',"confidence":' || {_json('confidence')} || '}}'"""


def _json_files(findings: str, order: str) -> str:
    return f"""SELECT f.path AS file, '{{"file":' || {_json('f.path')} || ',"language":' || {_json('f.lang')} || ',"findings":[' ||
        coalesce(string_agg(body, ',' ORDER BY {order}), '') || ']}}' AS document
        FROM files f LEFT JOIN (SELECT *, {_FINDING_JSON} AS body FROM {findings}) x ON x.path = f.path GROUP BY f.path, f.lang"""


def _commas(body: str, part: int, keys: str, order: str, source: str) -> str:
    """Fragments of a part, with a comma before all but the first of a file."""
    comma = f"CASE WHEN row_number() OVER (PARTITION BY path ORDER BY {order}) = 1 THEN '' ELSE ',' END"
    return f"SELECT path AS file, {part} AS part, {keys}, {comma} || {body} AS text FROM {source}"


_ENTRY = """chr(10) || '  [' || severity || '] ' || category || ' ' || CASE WHEN line IS NULL THEN '—' ELSE 'line ' || line END || ' [' ||
    lower(confidence) || ']' || chr(10) || CASE WHEN pattern = '' THEN '' ELSE '  Pattern   : ' || pattern || chr(10) END ||
    '  Risk      : ' || explanation || chr(10) || '  Fix       : ' || suggestion"""
_NO_KEYS = "NULL AS name, NULL AS major, NULL AS minor"
_ROW_KEYS = "NULL AS name, chunk_id::BIGINT AS major, seq::BIGINT AS minor"

_STATIC = f"(SELECT path, rule_ord, {_FINDING} FROM hits)"
_SUMMARY = """count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high,
    count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low"""

_SARIF_RULE = f"""'{{"id":' || {_json('category')} || ',"name":' || {_json(_PASCAL.format('category'))} ||
    ',"shortDescription":{{"text":' || {_json("'Security vulnerability: ' || replace(category, '-', ' ')")} ||
    '}},"properties":{{"tags":["security"],"precision":"medium"}}}}'"""
_SARIF_RESULT = f"""'{{"ruleId":' || {_json('category')} || ',"level":"' || {_LEVEL} || '","rank":' || {_RANK} || ',"message":{{"text":' ||
    {_json("explanation || ' — ' || suggestion")} || '}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":' || {_json('path')} ||
    ',"uriBaseId":"%SRCROOT%"}},"region":{{"startLine":' || coalesce(line, 1) || '}}}}}}]' ||
    CASE WHEN suggestion <> '' THEN ',"fixes":[{{"description":{{"text":' || {_json('suggestion')} || '}}}}]' ELSE '' END || '}}'"""
_SARIF_FLAT = f"""category AS rule_id, {_LEVEL} AS level, {_RANK} AS rank, explanation || ' — ' || suggestion AS message, path AS uri,
    coalesce(line, 1)::BIGINT AS start_line, nullif(suggestion, '') AS fix"""

_USER = [r for r in USER_RULES if r["name"] != "broken"]


def _user_hits() -> str:
    branches = [
        f"""SELECT lang, {q(r['name'])} AS rule, {q(r['severity'])} AS severity, trim(regexp_extract(code, {q(r['regex'])}, 0)) AS matched_text
        FROM code WHERE lang = {q(r['lang'])} AND regexp_matches(code, {q(r['regex'])})"""
        for r in _USER
    ]
    return " UNION ALL ".join(branches)


_FIRST_ORDERS = """FROM (SELECT o_orderkey, o_custkey + CASE WHEN o_orderkey % 7 = 0 THEN 3 ELSE 0 END AS o_custkey
    FROM orders WHERE o_orderkey % 5 <> 0)"""
_OVERRIDE_C = f"WITH {_files(ORDER_SOURCES, 'C')}, {_hits(CATALOGUE.of('C'))}"
_CWE = "(VALUES " + ", ".join(f"({q(r.lang)}, {q(r.name)}, {q(r.cwe) if r.cwe else 'NULL'})" for r in CATALOGUE.rules) + ") AS c(lang, rule, cwe)"
_CHUNK_COLUMNS = "path, lang, chunk_id, start_line, line_count, content"
_LONG_COLUMNS = "path, lang, chunk_id, start_line::BIGINT AS start_line, line_count, content"
_PARSED_COLUMNS = "path, chunk_id, seq, " + _COLUMNS

ORACLES: dict[str, str] = {
    "static_scan_counts": f"{ORDERS} SELECT lang, rule, severity, count(*) AS hits FROM hits GROUP BY ALL",
    "document_scan_counts": f"{DOCUMENTS} SELECT lang, rule, severity, count(*) AS hits FROM hits GROUP BY ALL",
    "rule_scan_counts": f"{PARTS} SELECT lang, rule, severity, count(*) AS hits FROM hits GROUP BY ALL",
    "extension_counts": f"""WITH {_files(PART_SOURCES)} SELECT lang, regexp_extract(path, '[^/][.]([^./]+)$', 1) AS ext, count(DISTINCT path) AS files,
        count(*) AS lines FROM code GROUP BY ALL""",
    "overrides": " UNION ALL ".join(
        f"SELECT * FROM (WITH {_files(ORDER_SOURCES, lang)}, {_hits(CATALOGUE.of(lang))} SELECT lang, rule, count(*) AS hits FROM hits GROUP BY ALL)"
        for lang in sorted(OVERRIDES.values())
    ),
    "hits_by_line": f"{ORDERS} SELECT path, lang, line, rule_ord, rule, severity FROM hits ORDER BY path, line, rule_ord",
    "matched_text": f"{DOCUMENTS} SELECT path, line, rule, matched_text FROM hits",
    "multi_rule_lines": f"{ORDERS} SELECT path, line, count(*) AS rules FROM hits GROUP BY ALL HAVING count(*) > 1",
    "rule_join_scan": f"{ORDERS} SELECT lang, rule, count(*) AS hits, sum(length(matched_text))::BIGINT AS matched_chars FROM hits GROUP BY ALL",
    "user_rules": f"WITH {_files(ORDER_SOURCES)} SELECT lang, rule, severity, matched_text, count(*) AS hits FROM ({_user_hits()}) GROUP BY ALL",
    "lang_detect": f"""WITH {_files(DOCUMENT_SOURCES)} SELECT lang, regexp_extract(path, '[^/][.]([^./]+)$', 1) AS ext, count(*) AS files
        FROM files GROUP BY ALL""",
    "lang_override": f"{_OVERRIDE_C} SELECT lang, rule AS category, count(*) AS findings FROM hits GROUP BY ALL",
    "line_split": f"WITH {_files(DOCUMENT_SOURCES)} SELECT path, line::INTEGER AS line, code FROM code",
    "line_totals": f"""WITH {_files(TEXT_SOURCES)} SELECT path, max(line)::INTEGER AS lines, sum(strlen(code))::BIGINT AS bytes,
        max(length(code))::INTEGER AS longest FROM code GROUP BY path""",
    "static_findings": f"{DOCUMENTS} SELECT path, lang, {_FINDING} FROM hits",
    "critical_only": f"{ORDERS} SELECT path, line::BIGINT AS line, rule AS category, matched_text AS pattern FROM hits WHERE severity = 'CRITICAL'",
    "severity_summary": f"{ORDERS} SELECT {_SUMMARY} FROM hits",
    "run_totals": f"{DOCUMENTS} SELECT (SELECT count(*) FROM files) AS files, count(*) AS findings, {_SUMMARY} FROM hits",
    "rule_ids": f"{ORDERS} SELECT DISTINCT rule AS rule_id FROM hits ORDER BY 1",
    "findings_per_file": f"""{DOCUMENTS} SELECT f.path AS file, f.lang AS language, count(line)::INTEGER AS finding_count,
        arg_min(h.line, (h.line, rule_ord))::BIGINT AS first_line, arg_min(rule, (h.line, rule_ord)) AS first_category,
        coalesce(string_agg(h.line || ':' || rule, ',' ORDER BY h.line, rule_ord), '') AS finding_list
        FROM files f LEFT JOIN hits h ON h.path = f.path GROUP BY f.path, f.lang""",
    "json_documents": f"{DOCUMENTS} {_json_files(_STATIC, 'line, rule_ord')}",
    "file_report": f"""{DOCUMENTS} SELECT f.path AS file, f.lang AS language, count(line)::INTEGER AS finding_count,
        '[' || f.lang || '] ' || f.path || chr(10) || CASE WHEN count(line) = 0 THEN '  No findings' ELSE
        string_agg(chr(10) || '  [' || severity || '] ' || category || ' line ' || line || ' [' || lower(confidence) || ']' || chr(10) ||
        '  Pattern   : ' || pattern || chr(10) || '  Risk      : ' || explanation || chr(10) || '  Fix       : ' || suggestion, chr(10)
        ORDER BY line, rule_ord) END AS section
        FROM files f LEFT JOIN {_STATIC} x ON x.path = f.path GROUP BY f.path, f.lang""",
    "sarif_results": f"{DOCUMENTS} SELECT {_SARIF_FLAT} FROM {_STATIC}",
    "sarif_rules": f"""{ORDERS} SELECT DISTINCT rule AS rule_id, {_PASCAL.format('rule')} AS name,
        'Security vulnerability: ' || replace(rule, '-', ' ') AS short_description, 'security' AS tags, 'medium' AS precision FROM hits""",
    "sarif_documents": f"""{DOCUMENTS}, results AS (SELECT path, string_agg({_SARIF_RESULT}, ',' ORDER BY line, rule_ord) AS body FROM {_STATIC} GROUP BY path),
        rules AS (SELECT path, string_agg({_SARIF_RULE}, ',' ORDER BY category) AS body FROM (SELECT DISTINCT path, category FROM {_STATIC}) GROUP BY path)
        SELECT f.path AS file, '{{"$schema":"{SARIF_SCHEMA}","version":"{SARIF_VERSION}","runs":[{{"tool":{{"driver":{{"name":"{TOOL['name']}","version":"{TOOL['version']}","rules":['
        || coalesce(rules.body, '') || ']}}}},"results":[' || coalesce(results.body, '') || ']}}]}}' AS document
        FROM files f LEFT JOIN results ON results.path = f.path LEFT JOIN rules ON rules.path = f.path""",
    "sarif_log": f"""{ORDERS} SELECT 0 AS part, {q(report.SARIF_HEAD)} AS text
        UNION ALL SELECT 1, CASE WHEN row_number() OVER (ORDER BY category) = 1 THEN '' ELSE ',' END || {_SARIF_RULE}
            FROM (SELECT DISTINCT category FROM {_STATIC})
        UNION ALL SELECT 2, {q(report.SARIF_MIDDLE)}
        UNION ALL SELECT 3, CASE WHEN row_number() OVER (ORDER BY path, line, rule_ord) = 1 THEN '' ELSE ',' END || {_SARIF_RESULT} FROM {_STATIC}
        UNION ALL SELECT 4, {q(report.SARIF_TAIL)}""",
    "incremental_scan": f"{ORDERS} SELECT lang, rule AS category, 'MEDIUM' AS confidence, count(*) AS findings FROM hits GROUP BY ALL",
    "incremental_changes": f"""WITH {_files(ORDER_SOURCES.replace('FROM orders', _FIRST_ORDERS))}, {_hits()},
        old AS MATERIALIZED (SELECT h.*, content FROM hits h JOIN files USING (path)), had AS MATERIALIZED (SELECT path, content FROM files),
        next AS ({ORDER_SOURCES} WHERE o_orderkey % 11 <> 0),
        gone AS (SELECT 'retracted' AS change, lang, rule FROM old LEFT JOIN next USING (path, content) WHERE next.path IS NULL),
        later AS (SELECT next.path, {_DETECT.replace('path', 'next.path')} AS lang, next.content FROM next LEFT JOIN had USING (path, content) WHERE had.path IS NULL),
        lines AS MATERIALIZED (SELECT lang, unnest(string_split(content, chr(10))) AS code FROM later),
        came AS ({' UNION ALL '.join(f"SELECT 'added' AS change, lang, {q(r.name)} AS rule FROM lines WHERE lang = {q(r.lang)} AND regexp_matches(code, {q(r.regex)})" for r in CATALOGUE.rules)})
        SELECT change, lang, rule AS category, count(*) AS findings FROM (SELECT * FROM gone UNION ALL SELECT * FROM came) GROUP BY ALL""",
    "cwe_rollup": f"{DOCUMENTS} SELECT cwe, count(*) AS hits FROM hits JOIN {_CWE} USING (lang, rule) GROUP BY cwe",
    "cwe_mentions": f"""{DOCUMENTS} SELECT rule, sum(len(regexp_extract_all(description || ' ' || matched_text, '(CWE-[0-9]+)', 1)))::BIGINT AS mentions
        FROM hits GROUP BY rule""",
    "suppressed": f"""{ORDERS} SELECT lang, rule AS category, count(*) AS findings FROM hits WHERE NOT (rule = 'gets' AND path IN (
        SELECT {_path('src/f', 'o_orderkey')} FROM orders WHERE o_orderstatus = 'F')) GROUP BY ALL""",
    "chunk_small": f"""WITH {_files(TEXT_SOURCES)} SELECT path, lang, 0 AS chunk_id, 1 AS start_line, len(lines)::INTEGER AS line_count, content
        FROM files WHERE strlen(content) <= {CHUNK_BYTES}""",
    "chunk_lines": f"WITH RECURSIVE {_files(TEXT_SOURCES)}, {CHUNKS} SELECT {_CHUNK_COLUMNS} FROM chunks",
    "chunk_pages": f"WITH RECURSIVE {_files(PAGE_SOURCES)}, {CHUNKS} SELECT {_CHUNK_COLUMNS} FROM chunks",
    "chunk_functions": f"WITH RECURSIVE {_files(DOCUMENT_SOURCES)}, {CHUNKS} SELECT {_CHUNK_COLUMNS} FROM chunks",
    "chunk_preamble": f"""WITH RECURSIVE {_files(DOCUMENT_SOURCES)}, {_chunks(preamble=True)}
        SELECT path, lang, chunk_id, start_line, line_count FROM chunks""",
    "function_boundaries": f"""WITH {_files(DOCUMENT_SOURCES)}, marked AS (SELECT path, string_split(CASE lang {' '.join(
        f"WHEN {q(lang)} THEN regexp_replace(array_to_string(lines, chr(10)), {q(_unicode(regex))}, chr(1) || '{chr(92)}0', 'g')"
        for lang, regex in FUNCTION_STARTS.items())} END, chr(10)) AS m FROM files)
        SELECT path, line::INTEGER AS line FROM (SELECT path, unnest(m) AS s, generate_subscripts(m, 1) AS line FROM marked)
        WHERE starts_with(s, chr(1))""",
    "hits_in_chunk": f"""{DOCUMENTS}, {CHUNKS} SELECT c.path, c.chunk_id, c.start_line, h.line, h.rule FROM chunks c JOIN hits h
        ON h.path = c.path AND h.line >= c.start_line AND h.line < c.start_line + c.line_count""",
    "prompt_hits": f"{DOCUMENTS}, {CHUNKS}, {CHUNK_HITS} SELECT path, chunk_id, {_PROMPT_HITS} AS hit_list FROM chunk_hits",
    "prompt_hits_file_lines": f"{DOCUMENTS}, {CHUNKS}, {CHUNK_HITS} SELECT path, chunk_id, {_hit_list('0')} AS hit_list FROM chunk_hits WHERE len(hits) > 0",
    "prompts": f"""{DOCUMENTS}, {CHUNKS}, {CHUNK_HITS} SELECT path, lang, chunk_id, start_line, line_count, len(hits)::INTEGER AS hit_count,
        {_prompt()} AS prompt FROM chunk_hits""",
    "responses": f"{REVIEW_INPUT} SELECT path, chunk_id, response FROM answers",
    "response_status": f"""{REVIEW_INPUT}, {PARSED} SELECT a.path, a.chunk_id, coalesce(any_value(parse_status), 'strict') AS parse_status,
        count(p.seq)::INTEGER AS findings FROM answers a LEFT JOIN parsed p ON p.path = a.path AND p.chunk_id = a.chunk_id GROUP BY a.path, a.chunk_id""",
    "response_strict": f"{REVIEW_INPUT}, {PARSED} SELECT {_PARSED_COLUMNS} FROM strict_rows",
    "response_recovered": f"{REVIEW_INPUT}, {PARSED} SELECT {_PARSED_COLUMNS} FROM kept",
    "parse_errors": f"{REVIEW_INPUT}, {PARSED} SELECT {_PARSED_COLUMNS} FROM failed_rows",
    "coverage": f"""WITH RECURSIVE {_files(DOCUMENT_SOURCES)}, {CHUNKS}
        SELECT CASE WHEN start_line % 2 = 1 THEN 'answered' ELSE 'missing' END AS status, count(*) AS chunks FROM chunks GROUP BY ALL""",
    "near_hits": f"""{DOCUMENTS} SELECT path, count(DISTINCT near) AS near_lines FROM (
        SELECT path, unnest(range(line - 2, line + 3)) AS near FROM hits) GROUP BY path""",
    "correlated": f"""{REVIEW} SELECT path, lang, chunk_id, seq, line, severity, category, pattern, suggestion, confidence, raw_confidence FROM reviewed""",
    "high_confidence": f"{REVIEW} SELECT lang, category, severity, count(*) AS findings FROM reviewed WHERE confidence = 'HIGH' GROUP BY ALL",
    "min_confidence_levels": f"""{REVIEW} SELECT raw_confidence AS confidence, count(*) AS findings FROM reviewed
        WHERE raw_confidence IN ('MEDIUM', 'HIGH') GROUP BY ALL""",
    "reviewed_files": f"{REVIEW} SELECT (SELECT count(*) FROM files) AS files, count(*) AS findings, {_SUMMARY} FROM reviewed",
    "reviewed_json": f"""{REVIEW} SELECT path AS file, 0 AS part, {_NO_KEYS}, '{{"file":' || {_json('path')} || ',"language":' || {_json('lang')} ||
        ',"findings":[' AS text FROM files UNION ALL SELECT path, 2, {_NO_KEYS}, ']}}' FROM files
        UNION ALL {_commas(_FINDING_JSON, 1, _ROW_KEYS, 'chunk_id, seq', 'reviewed')}""",
    "reviewed_sarif_documents": f"""{REVIEW} SELECT path AS file, part, {_NO_KEYS}, text FROM files, (VALUES (0, '{{"$schema":"{SARIF_SCHEMA}","version":"{SARIF_VERSION}",'
        || '"runs":[{{"tool":{{"driver":{{"name":"{TOOL['name']}","version":"{TOOL['version']}","rules":['), (2, ']}}}},"results":['), (4, ']}}]}}')) t(part, text)
        UNION ALL {_commas(_SARIF_RULE, 1, "category AS name, NULL AS major, NULL AS minor", 'category', '(SELECT DISTINCT path, category FROM reviewed)')}
        UNION ALL {_commas(_SARIF_RESULT, 3, _ROW_KEYS, 'chunk_id, seq', 'reviewed')}""",
    "reviewed_report": f"""{REVIEW}, covered AS (SELECT path, start_line, start_line + line_count - 1 AS last_line, start_line % 3 = 0 AS missing
            FROM chunks WHERE line_count > 0),
        ranged AS (SELECT *, sum(CASE WHEN missing AND NOT before THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY start_line) AS k FROM (
            SELECT *, coalesce(lag(missing) OVER (PARTITION BY path ORDER BY start_line), false) AS before FROM covered)),
        gaps AS (SELECT path, min(start_line) AS a, max(last_line) AS b FROM ranged WHERE missing GROUP BY path, k),
        told AS (SELECT * FROM reviewed SEMI JOIN (SELECT path, chunk_id FROM answers WHERE start_line % 3 <> 0) USING (path, chunk_id))
        SELECT path AS file, 0 AS part, {_NO_KEYS}, '[' || lang || '] ' || path AS text FROM files
        UNION ALL SELECT path, 1, {_ROW_KEYS}, {_ENTRY} FROM told
        UNION ALL SELECT path, 2, NULL, a, NULL, '  Not reviewed: lines ' || a || ' to ' || b FROM gaps
        UNION ALL SELECT path, 3, {_NO_KEYS}, '  No findings' FROM files WHERE path NOT IN (SELECT path FROM told) AND path NOT IN (SELECT path FROM gaps)""",
    "json_index": f"""{DOCUMENTS}, docs AS (SELECT f.path AS file, strlen('{{"file":' || {_json('f.path')} || ',"language":' || {_json('f.lang')} || ',"findings":[')
        + 3 + coalesce(sum(strlen(body) + 1), 0) + count(body) - (count(body) > 0)::INT + 1 AS bytes
        FROM files f LEFT JOIN (SELECT *, {_FINDING_JSON} AS body FROM {_STATIC}) x ON x.path = f.path GROUP BY f.path, f.lang)
        SELECT file, (sum(bytes) OVER (ORDER BY file) - bytes)::BIGINT AS start, bytes::BIGINT AS bytes FROM docs""",
    "chunk_line_table": f"""WITH RECURSIVE {_files(TEXT_SOURCES)}, {_chunks(by_line=True)} SELECT {_LONG_COLUMNS} FROM chunks""",
    "chunk_function_table": f"""WITH RECURSIVE {_files(DOCUMENT_SOURCES)}, {CHUNKS} SELECT {_LONG_COLUMNS} FROM chunks
        WHERE path IN (SELECT path FROM modes WHERE functions)""",
    "reviewed_missing": f"""WITH RECURSIVE {_files(DOCUMENT_SOURCES)}, {CHUNKS},
        marked AS (SELECT path, start_line, start_line + line_count - 1 AS last_line, start_line % 2 <> 1 AS missing FROM chunks WHERE line_count > 0),
        ranged AS (SELECT *, sum(CASE WHEN missing AND NOT before THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY start_line) AS k,
            bool_and(missing) OVER (PARTITION BY path) AS none FROM (SELECT *,
            coalesce(lag(missing) OVER (PARTITION BY path ORDER BY start_line), false) AS before FROM marked))
        SELECT path, min(start_line)::INTEGER AS first_line, max(last_line)::INTEGER AS last_line,
            CASE WHEN none THEN 'unreviewed' ELSE 'partly reviewed' END AS status FROM ranged WHERE missing GROUP BY path, k, none""",
    "reviewed_sarif": f"{REVIEW} SELECT {_SARIF_FLAT} FROM reviewed",
}
