"""Chunks of files of any size, packed from a line table by a parallel scan.

Greedy packing is a sum with reset: how many bytes the open chunk has used is all that one line hands on to the
next, and beyond the budget the exact number no longer matters.  So a block of lines is a function from the bytes
used before it to the bytes used behind it, and functions of consecutive blocks compose.  All numbers of bytes for which
the same item closes the open chunk have the same effect, so a function is a few pieces: as many as there are items in
a chunk, however many blocks it stands for.  Blocks make their pieces in parallel; rounds of composition, ``FAN``
functions at a time, lead to one function per file; on the way back every block learns what is used, and how many
chunks are full, before it; then every block packs its own lines.  No task walks through a file, and files of one
block need no functions.

Function starts come from pieces that begin behind a line with a semicolon: no start pattern matches across
one, so pieces have the starts of the whole text.  Files with more than one start are packed from whole functions
by the same scan.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewarden.functions.text import split_lines
from linewarden.operators.chunks import CHUNK_BYTES, function_starts, hits_in_chunks
from linewarden.operators.totals import running_total
from linewarden.session import work_folder

#: Items of a block, and functions that are composed at a time.
BLOCK, FAN = 4_096, 64
#: Bytes used: none, up to the budget, and beyond it.
STATES = CHUNK_BYTES + 2
#: Numbers that go from a task at a time.
BATCH = 1 << 16

_PIECES = "begin array<int>, used array<int>, full array<bigint>, rises int"


def _walk(sizes: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every item: bytes used behind the block, and chunks filled after it, if a chunk is opened by the item.

    The last array has the item that closes a chunk opened by each item; the block's length if none does.
    """
    n = len(sizes)
    before = np.concatenate([[0], np.cumsum(sizes + 1)])
    # An item closes the chunk that began at f if the bytes from f on, with a byte between items, pass the budget.
    reach = np.maximum.accumulate(before[:-1] + sizes + slack) if n else before[:0]
    closes = np.maximum(np.searchsorted(reach, before[:-1] + CHUNK_BYTES + 1, "right"), np.arange(n) + 1)
    used, full = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    opened = n  # the next item with bytes
    for i in range(n - 1, -1, -1):
        if sizes[i] == 0:
            # An empty buffer: what the next item with bytes opens is what stands behind the block.
            used[i], full[i], closes[i] = (used[opened], full[opened], closes[opened]) if opened < n else (0, 0, n)
        else:
            opened, c = i, closes[i]
            if c < n:
                used[i], full[i] = used[c], full[c] + 1
            else:
                used[i] = min(before[n] - before[i] - 1, STATES - 1)
    return used, full, closes


class Pieces(NamedTuple):
    """Bytes used behind a block, and chunks filled in it, for all bytes used before it.

    From ``begin`` on they are ``used`` and ``full``.  In the piece ``rises`` (-1: none) no chunk is closed, so
    there the bytes used behind the block rise with those before it.
    """

    begin: list[int]
    used: list[int]
    full: list[int]
    rises: int

    def at(self, state: int) -> tuple[int, int]:
        i = bisect_right(self.begin, state) - 1
        return self.used[i] + (state - self.begin[i] if i == self.rises else 0), self.full[i]


def block_pieces(sizes: np.ndarray, slack: int) -> Pieces:
    """The function of a block."""
    sizes = np.asarray(sizes, np.int64)
    used, full, _ = _walk(sizes, slack)
    before = np.concatenate([[0], np.cumsum(sizes + 1)])
    reach = np.maximum.accumulate(before[:-1] + sizes + slack)
    # With so many bytes used an item closes the open chunk, if no earlier item does.
    least = np.maximum(CHUNK_BYTES + 1 - reach, 1)
    closers = np.flatnonzero(least < np.concatenate([[STATES], least[:-1]]))[::-1]
    # Nothing used before: the first item opens the buffer, or leaves it empty.
    start = [[0, used[0], full[0]]]
    if least[-1] > 1:
        start.append([1, 1 + before[-1], 0])
    rises = len(start) - 1 or -1
    each = np.concatenate([start, np.stack([least[closers], used[closers], full[closers] + 1], 1)])
    same = (each[1:, 1:] == each[:-1, 1:]).all(1)
    same[: rises + 1] = False
    return Pieces(*each[np.concatenate([[True], ~same])].T.tolist(), rises)


def composed(first: Pieces, second: Pieces) -> Pieces:
    """The function of two consecutive stretches."""
    begin, used, full, rises = [], [], [], -1

    def add(at: int, state: int, filled: int, rising: bool = False) -> None:
        nonlocal rises
        plain = not rising and begin and rises != len(begin) - 1
        if plain and used[-1] == state and full[-1] == filled:
            return
        begin.append(at), used.append(state), full.append(filled)
        rises = len(begin) - 1 if rising else rises

    for i, (b, u, f) in enumerate(zip(first.begin, first.used, first.full, strict=True)):
        if i != first.rises:
            state, more = second.at(u)
            add(b, state, f + more)
            continue
        end = u + (first.begin[i + 1] if i + 1 < len(first.begin) else STATES) - b
        for j in range(bisect_right(second.begin, u) - 1, len(second.begin)):
            if second.begin[j] >= end:
                break
            low = max(second.begin[j], u)
            state, more = second.at(low)
            add(b + low - u, state, f + more, j == second.rises)
    return Pieces(begin, used, full, rises)


def packed(sizes: np.ndarray, slack: int, used: int, full: int) -> tuple[np.ndarray, np.ndarray]:
    """The chunk of every item, and whether it is in its text, given what is used and full before the block."""
    sizes = np.asarray(sizes, np.int64)
    n = len(sizes)
    _, _, closes = _walk(sizes, slack)
    flush = np.zeros(n, np.int64)
    if used:
        before = np.cumsum(sizes + 1) - 1
        over = np.flatnonzero(used + before + slack > CHUNK_BYTES)
        at = int(over[0]) if len(over) else n
    else:
        at = int(closes[0]) if n else 0
    while at < n:
        flush[at] = 1
        at = int(closes[at])
    chunk = full + np.cumsum(flush)
    # Empty items in front of a chunk's first bytes are not in its text.
    place = np.arange(n)
    filled = np.maximum.accumulate(np.where(sizes > 0, place, -1))
    begun = np.maximum.accumulate(np.where(flush > 0, place, -1))
    kept = filled >= np.maximum(begun, 0)
    if used:
        kept |= begun < 0
    return chunk, kept


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one, as a whole batch of them would be large as Python objects."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _gathered(rows: Iterator[tuple[int, dict]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows with their sizes as batches."""
    waiting, size = [], 0
    for n, row in rows:
        waiting.append(row)
        size += n
        if size >= BATCH:
            yield pa.RecordBatch.from_pylist(waiting, schema)
            waiting, size = [], 0
    if waiting:
        yield pa.RecordBatch.from_pylist(waiting, schema)


def _batch(paths: list[str], parts: list[tuple[np.ndarray, ...]], schema: pa.Schema) -> pa.RecordBatch:
    columns = map(np.concatenate, zip(*parts, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), *map(pa.array, columns)], schema=schema)


_PIECES_SCHEMA = pa.schema(
    [("path", pa.string()), ("at", pa.int64()), ("begin", pa.list_(pa.int32())), ("used", pa.list_(pa.int32())), ("full", pa.list_(pa.int64())), ("rises", pa.int32())]
)


def _sized(row: dict, found: Pieces) -> tuple[int, dict]:
    return 3 * len(found.begin) + 1, {"path": row["path"], "at": row["at"], **found._asdict()}


def _pieces(row: dict) -> Pieces:
    return Pieces(row["begin"], row["used"], row["full"], row["rises"])


def _of_blocks(slack: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    return lambda batches: _gathered((_sized(row, block_pieces(np.array(row["sizes"], np.int64), slack)) for row in _rows(batches)), _PIECES_SCHEMA)


def _of_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive functions of a group as one."""
    return _gathered((_sized(row, reduce(composed, map(_pieces, row["blocks"]))) for row in _rows(batches)), _PIECES_SCHEMA)


def _handed_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is used and full before every block of a group, from what is before the group."""
    schema = pa.schema([("path", pa.string()), ("at", pa.int64()), ("before_used", pa.int32()), ("before_full", pa.int64())])

    def each() -> Iterator[tuple[int, dict]]:
        for row in _rows(batches):
            used, full = row["before_used"], row["before_full"]
            for block in row["blocks"]:
                yield 4, {"path": row["path"], "at": block["at"], "before_used": used, "before_full": full}
                used, more = _pieces(block).at(used)
                full += more

    return _gathered(each(), schema)


def _stored(df: DataFrame, name: str) -> DataFrame:
    folder = work_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def entries(blocks: DataFrame, slack: int, fan: int = FAN) -> DataFrame:
    """``path, at, before_used, before_full`` for blocks ``path, at, sizes`` of the files that have more than the first."""
    schema = f"path string, at bigint, {_PIECES}"
    several = blocks.where("at > 0").select("path").distinct()
    levels = [_stored(blocks.join(several, "path", "left_semi").mapInArrow(_of_blocks(slack), schema), "pieces")]
    while True:
        level = levels[-1]
        group = F.floor(F.col("at") / fan).cast("bigint").alias("at")
        block = F.struct("at", "begin", "used", "full", "rises")
        grouped = level.groupBy("path", group).agg(F.array_sort(F.collect_list(block)).alias("blocks"))
        grouped = _stored(grouped, "groups")
        levels[-1] = grouped
        if not (level.agg(F.max("at")).first()[0] or 0) >= fan:
            break
        levels.append(_stored(grouped.mapInArrow(_of_groups, schema), "pieces"))
    handed = "path string, at bigint, before_used int, before_full bigint"
    known = levels[-1].select("path", "at", F.lit(0).alias("before_used"), F.lit(0).cast("bigint").alias("before_full"))
    for grouped in reversed(levels):
        known = grouped.join(known, ["path", "at"]).mapInArrow(_handed_on, handed)
    return known


def pack_items(items: DataFrame, slack: int, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """Items ``path, number, bytes`` (numbers from 0 without gaps) with ``chunk_id`` and ``kept``."""
    at = F.floor(F.col("number") / block).cast("bigint").alias("at")
    blocks = items.where("path IS NOT NULL").groupBy("path", at).agg(F.array_sort(F.collect_list(F.struct("number", "bytes"))).alias("items"))
    blocks = _stored(blocks.select("path", "at", F.transform("items", lambda x: x["bytes"]).alias("sizes")), "blocks")
    schema = pa.schema([("path", pa.string()), ("number", pa.int64()), ("chunk_id", pa.int64()), ("kept", pa.bool_())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, parts = [], []
        for row in _rows(batches):
            # Nothing is used before the only block of a file.
            chunk, kept = packed(np.array(row["sizes"], np.int64), slack, row["before_used"] or 0, row["before_full"] or 0)
            paths += [row["path"]] * len(chunk)
            parts.append((row["at"] * block + np.arange(len(chunk)), chunk, kept))
            if len(paths) >= BATCH:
                yield _batch(paths, parts, schema)
                paths, parts = [], []
        if parts:
            yield _batch(paths, parts, schema)

    entered = blocks.join(entries(blocks, slack, fan), ["path", "at"], "left")
    return entered.mapInArrow(place, "path string, number bigint, chunk_id bigint, kept boolean")


# --- chunks -----------------------------------------------------------------------------------


def line_chunks(lines: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """``path, lang, line, code`` -> chunks packed from lines: ``path, lang, chunk_id, start_line, line_count, content``.

    ``lines`` is read twice: for the sizes and for the text.
    """
    number = (F.col("line") - 1).cast("bigint")
    placed = pack_items(lines.select("path", number.alias("number"), F.octet_length("code").cast("bigint").alias("bytes")), 1, block, fan)
    texts = lines.select("path", "lang", number.alias("number"), "code").join(placed, ["path", "number"])
    return _joined(texts, F.min(F.col("number") + 1))


def _joined(texts: DataFrame, start: F.Column) -> DataFrame:
    """Lines ``path, lang, number, code, chunk_id, kept`` as chunks; a chunk's lines are within the budget but for one item."""
    row = F.when(F.col("kept"), F.struct("number", "code"))
    grouped = texts.groupBy("path", "chunk_id").agg(
        F.first("lang").alias("lang"), start.alias("start_line"), F.array_sort(F.collect_list(row)).alias("rows")
    )
    lines = F.transform("rows", lambda x: x["code"])
    count = F.size("rows") - F.when(F.element_at("rows", -1)["code"] == "", 1).otherwise(0)
    return grouped.where(F.size("rows") > 0).select(
        "path", "lang", F.col("chunk_id").cast("int").alias("chunk_id"), "start_line", count.alias("line_count"),
        F.array_join(lines, "\n").alias("content"),
    )


def starts_of_pieces(pieces: DataFrame) -> DataFrame:
    """``path, line`` of function starts, from pieces ``path, lang, first_line, content`` that begin behind semicolons."""
    text = F.array_join(split_lines(F.col("content")), "\n")
    each = pieces.select("path", "first_line", F.explode(function_starts(text, F.col("lang"))).alias("start"))
    return each.select("path", (F.col("first_line") + F.col("start")).alias("line"))


def function_chunks(lines: DataFrame, starts: DataFrame, block: int = BLOCK, fan: int = FAN, keep_preamble: bool = False) -> DataFrame:
    """Chunks of whole functions for the files with more than one start; lines above the first are in no chunk.

    ``starts`` is a stored table ``path, line``.
    """
    ranked = running_total(starts.withColumn("one", F.lit(1).cast("bigint")), "one", "rank", "path", "line")
    least = ranked.groupBy("path").agg(F.min("rank").alias("least"), F.min("line").alias("top"), F.count(F.lit(1)).alias("n"))
    least = least.where("n > 1")
    extra = (F.col("top") > 1).cast("bigint") if keep_preamble else F.lit(0).cast("bigint")
    least = least.withColumn("extra", extra)
    segments = ranked.join(least, "path").select("path", (F.col("rank") - F.col("least") + F.col("extra")).alias("number"), "line")
    if keep_preamble:
        tops = least.where("extra = 1").select("path", F.lit(0).cast("bigint").alias("number"), F.lit(1).cast("bigint").alias("line"))
        segments = segments.unionByName(tops)
    segments = _stored(segments, "segments")
    owned = _stored(_owners(lines, segments, block), "owned")
    sizes = owned.groupBy("path", "segment").agg((F.sum(F.col("bytes") + 1) - 1).alias("bytes"))
    placed = pack_items(sizes.select("path", F.col("segment").alias("number"), "bytes"), 0, block, fan)
    placed = placed.select("path", F.col("number").alias("segment"), "chunk_id", "kept")
    texts = lines.select("path", "lang", (F.col("line") - 1).cast("bigint").alias("number"), "code")
    texts = texts.join(owned.select("path", "number", "segment"), ["path", "number"]).join(placed, ["path", "segment"])
    # An empty segment in front of a chunk moves its start along.
    return _joined(texts, F.min(F.when(F.col("kept"), F.col("number") + 1)))


def long_file_chunks(
    lines: DataFrame, marked_pieces: DataFrame, block: int = BLOCK, fan: int = FAN, keep_preamble: bool = False
) -> DataFrame:
    """Chunks of files from their lines, and pieces of them that begin behind semicolons: as ``chunk_files`` has them."""
    starts = _stored(starts_of_pieces(marked_pieces), "starts")
    several = starts.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("path")
    by_function = function_chunks(lines.join(several, "path", "left_semi"), starts, block, fan, keep_preamble)
    return by_function.unionByName(line_chunks(lines.join(several, "path", "left_anti"), block, fan))


def with_hits(chunks: DataFrame, hits: DataFrame) -> DataFrame:
    """Chunks with the array of their hits, by the interval join: the group of a chunk is bound by its lines and rules."""
    row = F.struct("line", "rule_ord", "rule", "severity", "description", "matched_text")
    found = hits_in_chunks(hits, chunks.select("path", "chunk_id", "start_line", "line_count"))
    grouped = found.groupBy("path", "chunk_id").agg(F.array_sort(F.collect_list(row)).alias("hits"))
    none = F.array().cast(grouped.schema["hits"].dataType)
    return chunks.join(grouped, ["path", "chunk_id"], "left").withColumn("hits", F.coalesce("hits", none))


def _owners(lines: DataFrame, segments: DataFrame, block: int) -> DataFrame:
    """``path, number, bytes, segment``: the segment that each line is in, block by block of lines.

    A block needs the segments that begin in it, and how many begin before: a running total over blocks.
    """
    at = lambda c: F.floor(F.col(c) / block).cast("bigint")
    begins = segments.select("path", (F.col("line") - 1).cast("bigint").alias("begin"))
    inside = begins.groupBy("path", at("begin").alias("at")).agg(F.array_sort(F.collect_list("begin")).alias("begins"))
    sizes = lines.select("path", (F.col("line") - 1).cast("bigint").alias("number"), F.octet_length("code").cast("bigint").alias("bytes"))
    blocks = sizes.groupBy("path", at("number").alias("at")).agg(F.array_sort(F.collect_list(F.struct("number", "bytes"))).alias("rows"))
    blocks = blocks.select("path", "at", F.transform("rows", lambda x: x["bytes"]).alias("sizes")).join(inside, ["path", "at"], "left")
    blocks = running_total(blocks.withColumn("new", F.when(F.col("begins").isNull(), 0).otherwise(F.size("begins")).cast("bigint")), "new", "before", "path", "at")
    first = blocks.groupBy("path").agg(F.min("before").alias("least"))
    schema = pa.schema([("path", pa.string()), ("number", pa.int64()), ("bytes", pa.int64()), ("segment", pa.int64())])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, parts = [], []
        for row in _rows(batches):
            number = row["at"] * block + np.arange(len(row["sizes"]))
            segment = row["before"] - row["least"] - 1 + np.searchsorted(np.array(row["begins"] or [], np.int64), number, "right")
            some = segment >= 0
            paths += [row["path"]] * int(some.sum())
            parts.append((number[some], np.array(row["sizes"], np.int64)[some], segment[some]))
            if len(paths) >= BATCH:
                yield _batch(paths, parts, schema)
                paths, parts = [], []
        if parts:
            yield _batch(paths, parts, schema)

    each = blocks.join(first, "path").select("path", "at", "sizes", "begins", "before", "least")
    return each.mapInArrow(own, "path string, number bigint, bytes bigint, segment bigint")
