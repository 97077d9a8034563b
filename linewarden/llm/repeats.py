"""Removal of long repeated byte strings by merged suffix structures.

Every 200-byte window has one anchor: the 100-byte string in it whose hash is least.  Equal windows have equal
anchors at the same place, so suffixes that begin at anchors stand for all windows.  Contexts of 100 bytes on
both sides of an anchor are what windows around it can differ in; contexts that are equal as a whole repeat.
For anchors with different contexts, each shard's suffixes are sorted once.  The shards' suffix orders
(sparse Burrows-Wheeler transforms: the order and the bytes before each suffix) are merged by interleave
refinement: one block at first, refined by the next eight bytes of the right context a round, which yields the
common prefix of each suffix with its neighbour without sorting suffixes anew.  Then the transform is followed to the left a
byte a round: suffixes keep their order within equal left bytes, so those that share j bytes to the left and
200 - j from the anchor on form the repeated intervals of windows j bytes before the anchor.

Defined results: NULL and empty texts keep nothing and remove nothing; texts below 200 bytes keep all.  Rows
that repeat a text remove all of it if it has 200 bytes.  An empty table gives an empty result; columns named
like a result column are replaced, others pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewarden.llm.words import _BYTES, Bytes, byte_chunks, mix, powers
from linewarden.session import work_folder

WINDOW = 200
ANCHOR = WINDOW // 2
#: Anchor starts in a window, and bytes on each side of an anchor that windows may reach.
STARTS = WINDOW - ANCHOR + 1
SIDE = WINDOW - ANCHOR
#: Anchors of a task that are looked through for equal contexts before they travel.
HELD = 1_000_000
#: Suffixes of a shard, and the bits of the map of documents that have something to do.
SHARD, SLOTS = 4_096, 1 << 20

_U = np.uint64
SPAN, ASK, KNOWN = 0, 1, 2
ROWS = "key long, context long, row long, place long, kind int"
_SCHEMA = pa.schema([("key", pa.int64()), ("context", pa.int64()), ("row", pa.int64()), ("place", pa.int64()), ("kind", pa.int32())])


def _stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    folder = work_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.parquet(folder)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values, by running minima of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(part: Bytes) -> tuple[np.ndarray, ...]:
    """(row, place in the row, first and last window as distances before the anchor, anchor hash, context hash)."""
    data, offsets = part.data, part.offsets
    none = np.zeros(0, np.int64)
    if len(data) < WINDOW:
        return none, none, none, none, none, none
    up, down = powers(len(data))
    totals = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[:-1], out=totals[1:])
    hashes = mix((totals[ANCHOR:] - totals[:-ANCHOR]) * down[: len(data) - ANCHOR + 1])
    # Least by hash, then by place: high bits of the hash, and the place below them.
    bits = max(20, int(len(data)).bit_length())
    ranked = (hashes >> _U(bits) << _U(bits)) | np.arange(len(hashes), dtype=np.uint64)
    at = (_least(ranked, STARTS) & _U((1 << bits) - 1)).astype(np.int64)
    starts = np.arange(len(at))
    row = np.searchsorted(offsets, starts, "right") - 1
    inside = starts + WINDOW <= offsets[row + 1]
    starts, at, row = starts[inside], at[inside], row[inside]
    if not len(starts):
        return none, none, none, none, none, none
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])]))
    last = np.concatenate([new[1:], [len(at)]]) - 1
    place, row, far, near = at[new], row[new], at[new] - starts[new], at[last] - starts[last]
    left = np.maximum(offsets[row], place - SIDE)
    right = np.minimum(offsets[row + 1], place + ANCHOR + SIDE)
    context = mix((totals[right] - totals[left]) * down[left]) + mix(((place - left) * 256 + (right - place)).astype(np.uint64))
    return row, place - offsets[row], near, far, hashes[place].view(np.int64), mix(context).view(np.int64)


def _batch(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SCHEMA.types, strict=True)], schema=_SCHEMA)


def _spans(row: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Runs of repeated windows as (start, end) in ``context`` and ``place``; the key spreads them."""
    at, near, far = place >> 16, (place >> 8) & 255, place & 255
    n = len(row)
    return _batch(row, at - far, row, at - near + WINDOW, np.full(n, SPAN, np.int32))


def _classes(key: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by key and context; starts of classes in it; their sizes; whether a class's key has others."""
    order = np.lexsort((context, key))
    k, c = key[order], context[order]
    new_key = np.concatenate([[True], k[1:] != k[:-1]])
    starts = np.flatnonzero(new_key | np.concatenate([[True], c[1:] != c[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(k)]]))
    group = np.cumsum(new_key[starts]) - 1
    several = np.bincount(group)[group] > 1
    return order, starts, sizes, several


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of all texts; equal contexts in a task are found there, and one of them travels as known."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0

    def flush() -> Iterator[pa.RecordBatch]:
        key, context, row, place = (np.concatenate(c) for c in zip(*held, strict=True))
        order, starts, sizes, _ = _classes(key, context)
        again = np.repeat(sizes > 1, sizes)
        if again.any():
            yield _spans(row[order[again]], place[order[again]])
        first = order[starts]
        kind = np.where(sizes > 1, KNOWN, ASK).astype(np.int32)
        for k in range(0, len(first), 100_000):
            f = first[k : k + 100_000]
            yield _batch(key[f], context[f], row[f], place[f], kind[k : k + 100_000])

    for batch in batches:
        names = np.asarray(batch.column(0))
        for part in byte_chunks(batch.column(1)):
            row, place, near, far, key, context = anchors(part)
            if len(row):
                held.append((key, context, names[part.first + row], (place << 16) | (near << 8) | far))
                n += len(row)
            if n >= HELD:
                yield from flush()
                held, n = [], 0
    if n:
        yield from flush()


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of contexts that repeat, and one question for each context of an anchor that has several."""
    got: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [np.asarray(c) for c in batch.columns]
        spans = columns[4] == SPAN
        if spans.any():
            yield _batch(*[c[spans] for c in columns])
        got.append([c[~spans] for c in columns])
    if not got:
        return
    key, context, row, place, kind = (np.concatenate(c) for c in zip(*got, strict=True))
    del got
    if not len(key):
        return
    # Most anchors occur once.
    order = np.argsort(key)
    k = key[order]
    twice = np.zeros(len(k), bool)
    twice[1:] |= k[1:] == k[:-1]
    twice[:-1] |= k[1:] == k[:-1]
    order = order[twice]
    if not len(order):
        return
    key, context, row, place, kind = key[order], context[order], row[order], place[order], kind[order]
    order, starts, sizes, several = _classes(key, context)
    each = np.repeat(np.arange(len(starts)), sizes)
    solved = (sizes[each] > 1) & (kind[order] == ASK)
    if solved.any():
        yield _spans(row[order[solved]], place[order[solved]])
    known = (sizes > 1) | np.logical_or.reduceat(kind[order] == KNOWN, starts)
    ask = order[starts[several]]
    kinds = np.where(known[several], KNOWN, ASK).astype(np.int32)
    if len(ask):
        yield _batch(key[ask], context[ask], row[ask], place[ask], kinds)


def _wanted(slots) -> object:
    """Rows of (row, text) whose slot is set; the map has a fixed size."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(slots.value, np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            rows = np.asarray(batch.column(0)).astype(np.uint64)
            keep = bits[(mix(rows + _U(1)) % _U(SLOTS)).astype(np.int64)]
            if keep.any():
                yield batch.filter(pa.array(keep))

    return made


def _only(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Documents (row, text) that occur in ``rows``, and some others."""
    spark = docs.sparkSession
    schema = pa.schema([("slot", pa.int64())])

    def slot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.unique(mix(np.asarray(batch.column(0)).astype(np.uint64) + _U(1)) % _U(SLOTS)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found)], schema=schema)

    used = rows.select("row").mapInArrow(slot, "slot long").distinct().collect()
    bits = np.zeros(SLOTS, np.uint8)
    bits[[r[0] for r in used]] = 1
    slots = spark.sparkContext.broadcast(np.packbits(bits, bitorder="little").tobytes())
    return docs.select("row", "text").mapInArrow(_wanted(slots), "row long, text string")


CONTEXTS = "key long, row long, place long, kind int, left binary, right binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around the anchors that were asked for: nearest first on the left, in order on the right."""
    schema = pa.schema(
        [("key", pa.int64()), ("row", pa.int64()), ("place", pa.int64()), ("kind", pa.int32()), ("left", pa.binary()), ("right", pa.binary())]
    )
    for batch in batches:
        out: list[list] = [[] for _ in schema]
        texts = batch.column(1).cast(pa.large_binary())
        for row, text, asked in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist(), strict=True):
            data = memoryview(text.as_buffer())
            for x in asked:
                at = x["place"] >> 16
                left = bytes(data[max(0, at - SIDE) : at])[::-1]
                values = (x["key"], row, x["place"], x["kind"], left, bytes(data[at + ANCHOR : at + ANCHOR + SIDE]))
                for column, v in zip(out, values, strict=True):
                    column.append(v)
            if len(out[0]) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types, strict=True)], schema=schema)
                out = [[] for _ in schema]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types, strict=True)], schema=schema)


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of SIDE bytes, and their lengths."""
    column = column.cast(pa.large_binary())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    values = column.buffers()[2]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    length = np.diff(offsets)
    matrix = np.zeros((n, SIDE), np.uint8)
    column_of = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    matrix[np.repeat(np.arange(n), length), column_of] = data[offsets[0] : offsets[-1]]
    return matrix, length


def _words8(matrix: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(matrix), -(-SIDE // 8) * 8), np.uint8)
    wide[:, :SIDE] = matrix
    return wide.view(">u8").astype(np.uint64)


def shard_order(key: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A shard's suffixes in order: by anchor, then by the bytes that follow, an ended text before others."""
    words = _words8(right)
    return np.lexsort((length, *[words[:, k] for k in range(words.shape[1] - 1, -1, -1)], key))


def merge_shards(key: np.ndarray, right: np.ndarray, length: np.ndarray, shards: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, common) of all suffixes from the orders of the shards.

    ``common`` is the number of bytes after the anchor that a suffix shares with the one before it, -1 for the
    first of an anchor.  The interleave begins as the shards one after the other.  Round 0 refines it by anchor,
    round h by the h-th eight bytes; within a block the interleave of the shards stays as it is, and blocks of
    one suffix are finished.  A boundary that appears in round h gives the common prefix.
    """
    order = np.concatenate(shards) if shards else np.zeros(0, np.int64)
    n = len(order)
    common = np.full(n, SIDE, np.int64)
    if not n:
        return order, common
    words = _words8(right)
    _, dense = np.unique(key, return_inverse=True)
    order = order[np.argsort(dense[order], kind="stable")]
    block = dense[order]
    common[np.concatenate([[True], block[1:] != block[:-1]])] = -1
    live = np.arange(n)
    for h in range(words.shape[1]):
        bounds = common[live] < SIDE  # live blocks are whole, so their first suffix is a boundary
        ids = np.cumsum(bounds)
        sizes = np.bincount(ids)
        live = live[sizes[ids] > 1]
        if not len(live):
            break
        bounds = common[live] < SIDE
        ids = np.cumsum(bounds)
        w = words[order[live], h]
        moved = np.lexsort((w, ids))  # stable: ties keep the interleave
        order[live] = order[live[moved]]
        w = w[moved]
        split = np.flatnonzero((w[1:] != w[:-1]) & (ids[1:] == ids[:-1])) + 1
        differ = w[split] ^ w[split - 1]
        # Bytes that agree at the head of two words.
        agree = np.zeros(len(split), np.int64)
        for k in range(1, 8):
            agree += (differ >> _U(64 - 8 * k) == 0).astype(np.int64)
        common[live[split]] = np.minimum(8 * h + agree, SIDE)
    # What is still together is equal but for where texts end.
    if len(live):
        order[live] = order[live[np.lexsort((length[order[live]], np.cumsum(common[live] < SIDE)))]]
    # A text may end within its context: nothing is shared beyond the shorter of the two.
    shorter = np.minimum(length[order][1:], length[order][:-1])
    common[1:] = np.where(common[1:] >= 0, np.minimum(common[1:], shorter), -1)
    return order, common


def repeated_windows(
    key: np.ndarray, left: np.ndarray, left_length: np.ndarray, near: np.ndarray, far: np.ndarray, order: np.ndarray, common: np.ndarray, right_length: np.ndarray
) -> Iterator[tuple[int, np.ndarray]]:
    """(j, suffixes) whose windows j bytes before the anchor occur elsewhere.

    Blocks are suffixes of an anchor with equal left bytes; following the transform one byte to the left splits them.
    Windows are equal where the left blocks agree and the right contexts share SIDE - j bytes.
    """
    n = len(order)
    block = np.cumsum(common < 0)  # in suffix order; anchors to begin with
    letters, lengths = left[order], left_length[order]
    near, far, rights = near[order], far[order], right_length[order]
    alive = np.ones(n, bool)
    for j in range(SIDE + 1):
        if j:
            alive &= lengths >= j
            rows = np.flatnonzero(alive)
            if len(rows) < 2:
                return
            value = block[rows] * 256 + letters[rows, j - 1]
            block[rows] = np.unique(value, return_inverse=True)[1]
        need = SIDE - j
        able = alive & (rights >= need)
        # Suffixes between boundaries share what the window needs on the right.
        interval = np.cumsum(common < need)
        rows = np.flatnonzero(able)
        if not len(rows):
            continue
        value = interval[rows] * (int(block.max()) + 1) + block[rows]
        sort = np.argsort(value, kind="stable")
        v = value[sort]
        same = np.zeros(len(v), bool)
        same[1:] |= v[1:] == v[:-1]
        same[:-1] |= v[1:] == v[:-1]
        rows = rows[sort[same]]
        rows = rows[(near[rows] <= j) & (far[rows] >= j)]
        if len(rows):
            yield j, order[rows]
        if j:
            # A suffix alone with its left bytes in its anchor can never match further left.
            counts = np.bincount(block[alive], minlength=int(block.max()) + 1)
            alive &= counts[block] > 1


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows of the suffixes of a partition, as spans (row, start, end)."""
    schema = pa.schema([("row", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    table = pa.Table.from_batches(got).combine_chunks()
    key, row, place, kind = (np.asarray(table.column(k)) for k in range(4))
    left, left_length = _matrix(table.column(4).combine_chunks())
    right, right_length = _matrix(table.column(5).combine_chunks())
    shards = [k + shard_order(key[k : k + SHARD], right[k : k + SHARD], right_length[k : k + SHARD]) for k in range(0, len(key), SHARD)]
    order, common = merge_shards(key, right, right_length, shards)
    at, near, far = place >> 16, (place >> 8) & 255, place & 255
    for j, found in repeated_windows(key, left, left_length, near, far, order, common, right_length):
        found = found[kind[found] == ASK]
        if len(found):
            start = at[found] - j
            yield pa.RecordBatch.from_arrays([pa.array(row[found]), pa.array(start), pa.array(start + WINDOW)], schema=schema)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, removed bytes, removed runs, digest of the rest) of texts with spans."""
    schema = pa.schema([("row", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    for batch in batches:
        out: list[tuple] = []
        texts = batch.column(1).cast(pa.large_binary())
        for row, text, spans in zip(batch.column(0).to_pylist(), texts, batch.column(2), strict=True):
            data = memoryview(text.as_buffer())
            pairs = spans.values
            start, end = np.asarray(pairs.field(0)), np.asarray(pairs.field(1))
            order = np.argsort(start, kind="stable")
            start, reach = start[order], np.maximum.accumulate(end[order])
            new = np.concatenate([[True], start[1:] > reach[:-1]])
            first, last = start[new], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(reach) - 1]])]
            digest, at = hashlib.sha256(), 0
            for a, b in zip(first.tolist(), last.tolist(), strict=True):
                digest.update(data[at:a])
                at = b
            digest.update(data[at:])
            out.append((row, int((last - first).sum()), len(first), digest.hexdigest()))
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(row, start, end) of runs of repeated windows in ``docs`` (row, text); they may overlap and touch."""
    spark = docs.sparkSession
    found = docs.select("row", "text").mapInArrow(_anchored, ROWS).repartition(F.col("key")).mapInArrow(_found, ROWS)
    found = _stored(spark, found, "anchors")
    direct = found.where(F.col("kind") == SPAN).select("row", F.col("context").alias("start"), F.col("place").alias("end"))
    asked = found.where(F.col("kind") != SPAN)
    asked = asked.groupBy("row").agg(F.collect_list(F.struct("key", "place", "kind")).alias("asked"))
    around = _only(docs, found.where(F.col("kind") != SPAN)).join(asked, "row").select("row", "text", "asked")
    merged = around.mapInArrow(_contexts, CONTEXTS).repartition(F.col("key")).mapInArrow(_merged, "row long, start long, end long")
    return _stored(spark, direct.union(merged), "spans")


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents without their text, with n_bytes, n_removed, n_spans and kept_sha256.

    ``docs`` must be a stored table: its rows are read several times and named by their place.
    """
    named = docs.withColumn("__row", F.monotonically_increasing_id())
    texts = named.select(F.col("__row").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spans = repeated_spans(texts)
    listed = spans.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    touched = _only(texts, spans).join(listed, "row").select("row", "text", "spans")
    touched = touched.mapInArrow(_kept, "row long, n_removed long, n_spans long, kept_sha256 string")
    results = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    kept = [c for c in docs.columns if c != text and c not in results]
    whole = F.coalesce(F.col(text), F.lit("")).cast("binary")
    base = named.select(*kept, "__row", F.octet_length(whole).cast("long").alias("n_bytes"), F.sha2(whole, 256).alias("__whole"))
    joined = base.join(touched.withColumnRenamed("row", "__row"), "__row", "left")
    return joined.select(
        *kept,
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "__whole").alias("kept_sha256"),
    )
