"""Cut files into chunks of about 6,000 bytes, at function starts where there are any.

Chunking happens inside the row of a file, so it needs no shuffle and no grouping.  A file is one
value (Spark's limit is 2 GB), as function starts depend on the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewarden.functions.columns import settled
from linewarden.functions.text import DIALECT, split_lines
from linewarden.sources.rules import CPP, DOTNET, RUST, C

# --- fixed values: chunk budget in bytes, and what starts a function in each language -----------
CHUNK_BYTES = 6_000
FUNCTION_STARTS = {
    C: r"(?m)^[a-zA-Z_][\w\s\*:<>]*\w\s*\([^;]*\)\s*(const\s*)?(noexcept\s*)?\{",
    CPP: r"(?m)^[a-zA-Z_][\w\s\*:<>]*\w\s*\([^;]*\)\s*(const\s*)?(noexcept\s*)?\{",
    DOTNET: r"(?m)^\s+(public|private|protected|internal|static|override|virtual|async)\s+[\w<>\[\]]+\s+\w+\s*\(",
    RUST: r"(?m)^\s*(pub(\s*\(\s*crate\s*\))?\s+)?(async\s+)?fn\s+\w+",
}

_MARK, _MARK_STAND_IN = "\u0001", "\u0002"

_SPANS = "array<struct<start:int,first:int,last:int>>"


# The same starts found without walking back over long texts.  No match of any language holds a semicolon, and one of
# C or C++ runs on to the last brace behind a parameter list, so each stretch between semicolons has at most one:
# the first line start in a run of name characters before a parenthesis that is above the stretch's last such brace.
_RUN = r"[\w\s\*:<>]"
_BODY_ABOVE = r"(?s)^(.*)\)\s*(?:const\s*)?(?:noexcept\s*)?\{"
_IN_RUN = rf"(?<!{_RUN})(?={_RUN}*\w\s*+\(){_RUN}*?\n"
_HEAD = rf"([a-zA-Z_]{_RUN}*\w\s*\((?s:.*))"
# Elsewhere a match begins at the first line start in a run of white space, or at the text's start.
_LINE_START = r"(\A|(?<!\s)[^\S\n]*+\n)"
_LINEAR_STARTS = {
    DOTNET: _LINE_START
    + r"(\s++(?:public|private|protected|internal|static|override|virtual|async)\s++[\w<>\[\]]++\s++\w++\s*+\()",
    RUST: _LINE_START + r"(\s*+(?:pub(?:\s*+\(\s*+crate\s*+\))?+\s++)?+(?:async\s++)?+fn\s++\w++)",
}


def _marked_stretch(stretch: Column, i: Column) -> Column:
    """A stretch without semicolons, with a mark before the line at which its function starts."""
    above = F.regexp_extract(stretch, DIALECT + _BODY_ABOVE, 1)
    first = F.regexp_replace(above, rf"{DIALECT}(\A|{_IN_RUN}){_HEAD}", f"$1{_MARK}$2")
    later = F.regexp_replace(above, rf"{DIALECT}({_IN_RUN}){_HEAD}", f"$1{_MARK}$2")
    marked = F.when(i == 0, first).otherwise(later)
    # Without a brace nothing is above it, and the whole stretch follows.
    return F.concat(marked, F.substr(stretch, F.char_length(above) + 1))


def function_starts(text: Column, lang: Column) -> Column:
    """0-based numbers of the lines at which a function starts, from the whole text (LF line ends).

    The patterns may span lines, so they run on the text and mark each match; every match begins at a
    line start, so the marked lines are the boundaries.
    """
    clean = F.translate(text, _MARK, _MARK_STAND_IN)
    by_stretch = F.array_join(F.transform(F.split(clean, ";", -1), _marked_stretch), ";")
    marked = F.when(lang.isin(C, CPP), by_stretch)
    for name, regex in _LINEAR_STARTS.items():
        marked = marked.when(lang == name, F.regexp_replace(clean, DIALECT + regex, f"$1{_MARK}$2"))
    flagged = F.transform(F.split(marked, "\n", -1), lambda s, i: F.when(F.startswith(s, F.lit(_MARK)), i))
    return F.filter(flagged, lambda i: i.isNotNull())


def _segments(starts: Column, sizes: Column) -> Column:
    """Stretches from each function start to the next as ``(pos, bytes)``; lines above the first are left out."""
    total = F.size(sizes)

    def segment(start, i):
        end = F.coalesce(F.get(starts, i + 1), total)
        size = F.aggregate(F.slice(sizes, start + 1, end - start), F.lit(0).cast("bigint"), lambda a, x: a + x + 1)
        return F.struct(start.alias("pos"), (size - 1).alias("bytes"))

    return F.transform(starts, segment)


def _pack(items: Column, total: Column, slack: int, restart: bool) -> Column:
    """Greedy packing of ``(pos, bytes)`` items: a sum with reset, kept as the spans of full buffers.

    ``start`` is the line the chunk is said to begin at, ``first`` the first line of its text: empty
    items in front of the text are not kept.  ``restart`` moves ``start`` along with an empty buffer.
    """
    none = F.lit(-1)
    start_state = F.struct(
        F.lit(0).alias("start"),
        none.alias("first"),
        F.lit(0).cast("bigint").alias("used"),
        F.array().cast(_SPANS).alias("done"),
    )

    def span(state, end):
        return F.struct(state["start"].alias("start"), state["first"].alias("first"), end.alias("last"))

    def step(state, item):
        empty = state["used"] == 0
        flush = ~empty & (state["used"] + item["bytes"] + slack > CHUNK_BYTES)
        fresh = empty | flush
        moved = fresh if restart else flush
        return F.struct(
            F.when(moved, item["pos"]).otherwise(state["start"]).alias("start"),
            F.when(fresh, F.when(item["bytes"] > 0, item["pos"]).otherwise(none)).otherwise(state["first"]).alias("first"),
            F.when(fresh, item["bytes"]).otherwise(state["used"] + 1 + item["bytes"]).alias("used"),
            F.when(flush, F.array_append(state["done"], span(state, item["pos"] - 1)))
            .otherwise(state["done"])
            .alias("done"),
        )

    def finish(state):
        return F.when(
            state["used"] > 0, F.array_append(state["done"], span(state, total - 1))
        ).otherwise(state["done"])

    return F.aggregate(items, start_state, step, finish)


def chunk_files(files: DataFrame, keep_preamble: bool = False, with_lines: bool = False) -> DataFrame:
    """``path, lang, content`` -> ``path, lang, chunk_id, start_line, line_count, content``.

    A file within the budget is one unchanged chunk.  A larger one is packed from whole functions if
    it has more than one, else from lines.  A function above the budget is not cut.  Lines above the
    first function are not part of any chunk, unless ``keep_preamble`` asks for them.
    ``with_lines`` adds ``scan_lines``, the file lines the chunk stands for.
    """
    if "whole" in files.columns:
        told = F.raise_error(F.concat(F.col("path"), F.lit(" is in pieces: use chunks_from_files or prompts_from_files")))
        files = files.withColumn("content", F.when(F.col("whole"), F.col("content")).otherwise(told))
    small = F.octet_length("content") <= CHUNK_BYTES
    text = F.array_join("lines", "\n")
    staged = (
        files.select("path", "lang", "content", split_lines(F.col("content")).alias("lines"))
        .withColumn("starts", F.when(~small, function_starts(text, F.col("lang"))))
        .withColumn("sizes", F.when(~small, F.transform("lines", lambda s: F.octet_length(s))))
    )
    starts = F.col("starts")
    if keep_preamble:
        # settled, else it would be evaluated again for every function
        staged = settled(staged, cuts=F.array_distinct(F.concat(F.array(F.lit(0)), starts)))
        starts = F.col("cuts")
    total = F.size("lines")
    by_function = _pack(_segments(starts, F.col("sizes")), total, slack=0, restart=True)
    by_line = _pack(
        F.transform("sizes", lambda n, i: F.struct(i.alias("pos"), n.cast("bigint").alias("bytes"))),
        total,
        slack=1,
        restart=False,
    )
    spans = F.when(F.size("starts") > 1, by_function).otherwise(by_line)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("first"), (total - 1).alias("last")))
    spanned = staged.withColumn("spans", F.when(small, whole).otherwise(spans))

    def chunk(span):
        lines = F.slice(F.col("lines"), span["first"] + 1, span["last"] - span["first"] + 1)
        content = F.when(small, F.col("content")).otherwise(F.array_join(lines, "\n"))
        count = F.size(lines) - F.when(~small & (F.element_at(lines, -1) == ""), 1).otherwise(0)
        fields = [
            (span["start"] + 1).alias("start_line"),
            count.alias("line_count"),
            content.alias("content"),
        ]
        if with_lines:
            fields.append(F.slice(F.col("lines"), span["start"] + 1, count).alias("scan_lines"))
        return F.struct(*fields)

    names = ["start_line", "line_count", "content"] + (["scan_lines"] if with_lines else [])
    return (
        spanned.select("path", "lang", F.posexplode_outer(F.transform("spans", chunk)).alias("chunk_id", "chunk"))
        .where(F.col("chunk").isNotNull())
        .select("path", "lang", "chunk_id", *[f"chunk.{n}" for n in names])
    )


def hits_in_chunks(hits: DataFrame, chunks: DataFrame, block: int = 256) -> DataFrame:
    """Interval join: the hits whose line lies in a chunk of the same file, with the chunk's id and start.

    Both sides are cut into blocks of lines, so the join key is (path, block) and a file with very many
    hits or chunks is spread over many tasks.  Only chunk positions travel, never their text.
    """
    last = F.col("start_line") + F.col("line_count") - 1
    blocks = chunks.where(F.col("line_count") > 0).select(
        "path",
        "chunk_id",
        "start_line",
        last.alias("end_line"),
        F.explode(F.sequence(F.floor((F.col("start_line") - 1) / block), F.floor((last - 1) / block))).alias("block"),
    )
    keyed = hits.withColumn("block", F.floor((F.col("line") - 1) / block))
    return (
        keyed.join(blocks, ["path", "block"])
        .where(F.col("line").between(F.col("start_line"), F.col("end_line")))
        .drop("block", "end_line")
    )
