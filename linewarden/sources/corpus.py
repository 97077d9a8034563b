"""Code corpora that Spark derives from data tables that hold no source code.

Both builders are row-local: one table row becomes one source file, so the corpus grows with the
table and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewarden.functions.columns import settled
from linewarden.functions.text import sql_text
from linewarden.sources.rules import EXTENSIONS
from linewarden.sources.samples import FINDS

EXTENSION_CYCLE = (".c", ".cpp", ".cs", ".rs")

ORDER_FRAGMENTS = (
    "gets(buf);",
    "strcpy(dst, src);",
    "int x = 1;",
    "printf(user_input);",
    "system(cmd);",
    "unsafe { *raw = 1; }",
    "let v = f().unwrap();",
    "var bf = new BinaryFormatter();",
    'string pwd = "hunter2secret";',
    "return 0;",
    "auto p = reinterpret_cast<char*>(q);",
    "int* a = new int[n * m];",
    "// ok",
)

DOCUMENT_FRAGMENTS = (
    "int handle_request(char *buf, int n) {",
    "  memcpy(dst, buf, n);",
    "pub async fn step_one(x: u32) -> u32 {",
    "    public string Render(string name)",
    "  total = total + 1;",
    "  let size = len as usize;",
    "}",
    "  char *home = getenv(name); strcat(path, home);",
    '  cmd.ExecuteReader("select * from t where id=" + id);',
    "",
    "static void *reset(struct pool *p)\n{",
    "  delete item; throw_away(*(base + offset));",
    "  fn helper(&self) {",
    "    private int Count(List<int> xs)",
    '  const API_TOKEN: &str = "abc";',
    "  var md5 = MD5.Create();",
    "  rand();",
    "  aes.Mode = CipherMode.ECB;",
    "  chroot(dir);",
)


def _pick(fragments: tuple[str, ...], index: Column) -> Column:
    literals = F.expr(f"array({', '.join(map(sql_text, fragments))})")
    return F.element_at(literals, (index % len(fragments) + 1).cast("int"))


def _path(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), key.cast("string"), _pick(EXTENSION_CYCLE, key))


def sources_from_orders(orders: DataFrame) -> DataFrame:
    """One small file (1 to 7 lines) per order."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    lines = F.transform(
        F.sequence(F.lit(1), (cust % 7 + 1).cast("int")),
        lambda i: _pick(ORDER_FRAGMENTS, cust * 7 + key * 3 + i * 5),
    )
    return orders.select(_path("src/f", key).alias("path"), F.array_join(lines, "\n").alias("content"))


def sources_from_documents(documents: DataFrame) -> DataFrame:
    """One file per document: every sentence of the whole text follows a code fragment as a comment."""
    key = F.col("doc_id")
    lines = F.transform(
        F.split("text", r"\. ", -1),
        lambda s, i: F.concat(_pick(DOCUMENT_FRAGMENTS, key * 7 + i * 5 + F.char_length(s)), F.lit(" // "), s),
    )
    return documents.select(_path("doc/d", key).alias("path"), F.array_join(lines, "\n").alias("content"))


def sources_from_texts(documents: DataFrame) -> DataFrame:
    """The document texts themselves, unchanged, under code file names."""
    return documents.select(_path("txt/d", F.col("doc_id")).alias("path"), F.col("text").alias("content"))


def sources_from_pages(pages: DataFrame) -> DataFrame:
    """Web pages as files of few and very long lines."""
    return pages.select(_path("web/p", F.col("page_id")).alias("path"), F.col("html").alias("content"))


#: Extensions of one language stand at the same place as its lines.
_LANGUAGE_EXTENSIONS = tuple((lang, tuple(e for e, name in EXTENSIONS.items() if name == lang)) for lang in FINDS)


def part_file_sql(array_fn: str, join_fn: str) -> dict[str, str]:
    """Path and content of a file per part as SQL, the same in every dialect but for the names of two array functions.

    Languages and their extensions take turns; each of the seven lines shows what one rule of the language finds.
    """

    def quoted(text: str) -> str:
        return "concat(" + ", chr(92), ".join(f"'{x}'" for x in text.replace("'", "''").split("\\")) + ")"

    def pick(values, index: str) -> str:
        return f"element_at(array({', '.join(map(quoted, values))}), cast({index} % {len(values)} + 1 AS int))"

    n = len(_LANGUAGE_EXTENSIONS)
    paths = " ".join(f"WHEN {k} THEN {pick(exts, f'(p_partkey div {n})')}" for k, (_, exts) in enumerate(_LANGUAGE_EXTENSIONS))
    codes = " ".join(
        f"WHEN {k} THEN {join_fn}({array_fn}(sequence(0, 6), i -> {pick(FINDS[lang].values(), f'(p_partkey div {n} * 7 + i)')}), chr(10))"
        for k, (lang, _) in enumerate(_LANGUAGE_EXTENSIONS)
    )
    return {
        "path": f"concat('part/p', cast(p_partkey AS string), '.', CASE p_partkey % {n} {paths} END)",
        "content": f"CASE p_partkey % {n} {codes} END",
    }


def sources_from_parts(parts: DataFrame) -> DataFrame:
    """One file of seven lines per part, in all languages, extensions and rules."""
    sql = part_file_sql("transform", "array_join")
    # SQL text in the other dialect doubles a quote where Spark's escapes it
    return parts.select(*[F.expr(sql[c].replace("''", "\\'")).alias(c) for c in ("path", "content")])


# Shapes of an answer, chosen per chunk: clean arrays, arrays in prose, arrays with a confidence or
# with foreign keys, unquoted keys, a missing key, a cut array, an empty array and plain prose.
RESPONSE_SHAPES = 9


def response_sql(array_fn: str, join_fn: str, length_fn: str) -> dict[str, str]:
    """The answer of a made-up reviewer as SQL over ``hits``, ``chunk_id`` and ``start_line``.

    The text is the same in every SQL dialect but for the names of three array functions.
    """

    def items(body: str) -> str:
        return f"{join_fn}({array_fn}(hits, (h, i) -> {body}), ', ')"

    def escaped(text: str) -> str:
        return rf"replace(replace({text}, chr(92), concat(chr(92), chr(92))), chr(34), concat(chr(92), chr(34)))"

    line = "cast(h.line - start_line + 1 + (h.line + i) % 5 AS string)"
    common = f"""', "severity": "', h.severity, '", "category": "', h.rule, '", "pattern": "', {escaped('h.matched_text')},
        '", "explanation": "', {escaped('h.description')}, '"'"""
    clean = f"""concat('{{"line": ', {line}, {common}, ', "suggestion": "fix ', h.rule, '"}}')"""
    sure = f"""concat('{{"line": ', CASE WHEN h.line % 4 = 0 THEN 'null' ELSE {line} END, {common},
        ', "suggestion": "", "confidence": "', CASE h.line % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END,
        '", "extra": {{"deep": [1, 2]}}}}')"""
    bare = f"""concat('{{line: ', {line}, ' severity: "', h.severity, '" type: "', h.rule, '" risk: "', h.rule, ' here"}}')"""
    missing = f"""concat('{{"line": "', {line}, '"', {common}, ', "fix": "drop ', h.rule, '"}}')"""
    return {
        "shape": f"(chunk_id * 2 + start_line * 3 + {length_fn}(hits)) % {RESPONSE_SHAPES}",
        "response": f"""CASE shape
            WHEN 0 THEN concat('[', {items(clean)}, ']')
            WHEN 1 THEN concat('I found [', {items(clean)}, '] and nothing else [sic].')
            WHEN 2 THEN concat('[', {items(sure)}, ']')
            WHEN 3 THEN concat('[', {items(bare)}, ']')
            WHEN 4 THEN concat('[', {items(missing)}, ']')
            WHEN 5 THEN concat('[', {items(clean)}, ', {{"line": 1, "severity": "LOW", "category": "cut off')
            WHEN 6 THEN '[]'
            WHEN 7 THEN concat('No problem in the ', cast({length_fn}(hits) AS string), ' matches of chunk ', cast(chunk_id AS string), '.')
            ELSE concat('[', {items(sure)}, ']') END""",
    }


def responses_from_chunks(chunks: DataFrame) -> DataFrame:
    """From ``chunk_hits``: answers keyed by (path, chunk_id), made inside the row of a chunk."""
    sql = response_sql("transform", "array_join", "size")
    shaped = chunks.withColumn("shape", F.expr(sql["shape"]))
    return settled(shaped, response=F.expr(sql["response"])).select("path", "lang", "chunk_id", "start_line", "response")
