"""Packing of tokenized examples into sequences as vector bins, by the dot-product heuristic.

A sequence is a bin with three limits: tokens, segments (pieces of examples) and loss-bearing tokens.  An open
sequence takes, of all examples that fit whole, the one whose vector of shares of the limits has the greatest
dot product with the sequence's free shares.  If none fits, or the last segment would leave a gap, the
example that gives the longest piece within the limits is cut.  A sequence that cannot be filled ends at the
greatest power of two, where no padding is due, and hands back what lies beyond.  So no sequence has padding.

The texts are encoded, packed, cut and digested in the task that reads them: no ids are shuffled, and a task that
is lost repeats its own rows only.  A task holds a pool of about ``POOL`` tokens; examples longer than a sequence
fill sequences of their own first.  What is left of the pool at the end of a task goes into sequences of powers
of two.  Sequence ids are unique over all tasks, and the same in each run over the same partitions of the input.

Defined results: a NULL or empty text is its end id alone; repeated rows are packed each for itself; an empty table
gives an empty result; a NULL doc_id stays NULL.  Texts of any length are encoded whole.  Other columns are not
returned, so their names cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewarden.llm.tokens import encoder

END_ID = 1
#: Tokens of the pool that sequences are filled from, and tokens that stay in it for the next rows of the task.
POOL, RESERVE = 1 << 19, 1 << 16
#: Pieces of a returned batch.
ROWS = 1 << 13
FIELDS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, n_loss long"


class Limits(NamedTuple):
    """Of one sequence: tokens (a power of two), segments, and tokens that bear loss."""

    tokens: int = 2048
    segments: int = 64
    loss: int = 2048


class Example(NamedTuple):
    """A tokenized example: ids up to ``silent`` bear no loss."""

    doc_id: int | None
    ids: np.ndarray
    silent: int


class Piece(NamedTuple):
    example: Example
    start: int
    length: int


class Pool:
    """Examples, or what is left of them, that wait for a sequence; their sizes stand in arrays."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.examples: list[Example] = []
        self.start = np.zeros(1024, np.int64)
        self.silent = np.zeros(1024, np.int64)
        self.size = np.zeros(1024, np.int64)
        self.tokens = 0

    def add(self, example: Example, start: int) -> None:
        k = len(self.examples)
        if k == len(self.size):
            for name in ("start", "silent", "size"):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros(k, np.int64)]))
        self.examples.append(example)
        self.start[k], self.size[k] = start, len(example.ids) - start
        self.silent[k] = max(0, example.silent - start)
        self.tokens += int(self.size[k])

    def take(self, k: int, length: int) -> Piece:
        """The first tokens of a waiting example; without a rest it leaves the pool."""
        piece = Piece(self.examples[k], int(self.start[k]), length)
        self.tokens -= length
        if length < self.size[k]:
            self.start[k] += length
            self.size[k] -= length
            self.silent[k] = max(0, self.silent[k] - length)
        else:
            last = self.examples.pop()
            if k < len(self.examples):
                self.examples[k] = last
                for a in (self.start, self.silent, self.size):
                    a[k] = a[len(self.examples)]
        return piece

    def full(self, k: int) -> int:
        """The length of a piece that fills a sequence by itself, or 0."""
        whole = min(int(self.silent[k]) + self.limits.loss, int(self.size[k])) >= self.limits.tokens
        return self.limits.tokens if whole else 0

    def sequence(self) -> list[Piece]:
        """Pieces of the next sequence."""
        limits, pieces = self.limits, []
        tokens, segments, loss = limits
        while tokens and segments and self.examples:
            n = len(self.examples)
            size, silent = self.size[:n], self.silent[:n]
            bearing = np.maximum(size - silent, 0)
            fits = (size <= tokens) & (bearing <= loss)
            # One segment each: its share is the same for all, so it does not change the greatest product.
            product = size * (tokens / limits.tokens**2) + bearing * (loss / limits.loss**2)
            k = int(np.argmax(np.where(fits, product, -1.0)))
            if fits[k] and (segments > 1 or size[k] == tokens):
                length = int(size[k])
            else:
                reach = np.minimum(np.minimum(size, tokens), silent + loss)
                # The longest piece; of equal ones the example with the greatest product.
                longest = np.flatnonzero(reach == reach.max())
                k = int(longest[np.argmax(product[longest])])
                length = int(reach[k])
                if not length:
                    break
            piece = self.take(k, length)
            pieces.append(piece)
            tokens -= length
            segments -= 1
            loss -= bearing_tokens(piece)
        self.hand_back(pieces, limits.tokens - tokens)
        return pieces

    def hand_back(self, pieces: list[Piece], n: int) -> None:
        """Cut the pieces, n tokens in all, to the greatest power of two; the rest waits again."""
        beyond = n - (1 << (n.bit_length() - 1)) if n else 0
        while beyond:
            last = pieces.pop()
            cut = min(beyond, last.length)
            beyond -= cut
            if cut < last.length:
                pieces.append(Piece(last.example, last.start, last.length - cut))
            self.give(last.example, last.start + last.length - cut, cut)

    def give(self, example: Example, start: int, length: int) -> None:
        """Put tokens back: before the rest of the example that still waits, or as a new rest."""
        for k, waiting in enumerate(self.examples):
            if waiting is example and self.start[k] == start + length:
                self.start[k] = start
                self.size[k] += length
                self.silent[k] = max(0, example.silent - start)
                self.tokens += length
                return
        self.add(example, start)


def bearing_tokens(piece: Piece) -> int:
    return max(0, piece.start + piece.length - max(piece.start, piece.example.silent))


def sequences(examples: Iterator[Example], limits: Limits) -> Iterator[list[Piece]]:
    """All examples as sequences, in the order in which they are filled."""
    if min(limits) < 1 or limits.tokens & (limits.tokens - 1):
        raise ValueError("limits must be positive, and the tokens of a sequence a power of two")
    pool = Pool(limits)
    for example in examples:
        pool.add(example, 0)
        k = len(pool.examples) - 1
        while (n := pool.full(k)) and n < pool.size[k]:
            yield [pool.take(k, n)]
        if pool.tokens >= POOL:
            while pool.tokens > RESERVE:
                yield pool.sequence()
    while pool.examples:
        yield pool.sequence()


def _examples(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int) -> Iterator[Example]:
    code, end = encoder(tokenizer), np.array([end_id], np.uint32)
    for batch in batches:
        silent = code.encode(batch.column(2)) if batch.num_columns > 2 else None
        for doc_id, ids in zip(batch.column(0).to_pylist(), code.encode(batch.column(1)), strict=True):
            before = next(silent) if silent is not None else end[:0]
            yield Example(doc_id, np.concatenate([before, ids, end]).astype("<u4"), len(before))


def _packed(tokenizer: str, limits: Limits, end_id: int, with_ids: bool, kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "n_loss")
    fields = [(n, kind if n == "doc_id" else pa.int64()) for n in names] + [("ids", pa.list_(pa.int64()))] * with_ids
    schema = pa.schema(fields)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        for number, pieces in enumerate(sequences(_examples(batches, tokenizer, end_id), limits)):
            offset = 0
            for piece in pieces:
                example, start, length = piece
                ids = example.ids[start : start + length]
                row = (example.doc_id, start, length, zlib.crc32(ids), len(example.ids), first + number, offset, bearing_tokens(piece))
                rows.append((*row, ids.astype(np.int64)) if with_ids else row)
                offset += length
            if len(rows) >= ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return pack


def pack(
    docs: DataFrame,
    tokenizer: str,
    text: str = "text",
    doc_id: str = "doc_id",
    prompt: str | None = None,
    limits: Limits = Limits(),
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all examples: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, n_loss, and ids on request.

    An example is the ids of its prompt, if a column is named for it, which bear no loss, those of its text, and the
    end id.  ``start`` counts the example's ids before the piece, ``offset`` the sequence's.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    columns = [F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")]
    if prompt is not None:
        columns.append(F.col(prompt).cast("string").alias("prompt"))
    rows = docs.select(*columns)
    kind = rows.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, {FIELDS}" + ", ids array<long>" * with_ids
    return rows.mapInArrow(_packed(tokenizer, limits, end_id, with_ids, to_arrow_type(kind)), schema)
