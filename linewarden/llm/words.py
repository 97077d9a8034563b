"""Words and word shingles of Arrow text columns as 64-bit hashes, in whole-batch numpy passes.

Words are runs of bytes other than ASCII white space; A-Z count as a-z.  A shingle is a run of five words; a
text with fewer words has one shingle, the whole sequence.  NULL and blank texts have none.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SHINGLE = 5
#: Bytes that are hashed at a time; one longer text makes a chunk of its own.
CHUNK = 1 << 22

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, up to n."""
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][: n + 1], _powers["down"][: n + 1]


def give_back() -> None:
    """Return freed memory to the system."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.pythonapi, "malloc_trim", None)  # of glibc alone
    if trim is not None:
        trim(0)


def freeing(made: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of a task, which gives back at its end what it took.

    Workers outlive their stages, so what they keep lies beside the memory of all stages that come after.
    """

    @wraps(made)
    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from made(batches)
        give_back()

    return freed


class Bytes(NamedTuple):
    """Rows first..last of a column: their bytes and the offsets of each row in them."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


def byte_chunks(column: pa.Array, chunk: int = CHUNK) -> Iterator[Bytes]:
    """The rows of a text column in order, about ``chunk`` bytes at a time; a NULL is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, index, values = column.buffers()
    offsets = np.frombuffer(index, np.int64)[column.offset : column.offset + n + 1]
    lengths = np.diff(offsets)
    if column.null_count:
        lengths = np.where(np.asarray(column.is_valid()), lengths, 0)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    ends = np.cumsum(lengths)
    i = 0
    while i < n:
        done = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, done + chunk, "right")))
        if column.null_count:
            part = np.concatenate([data[offsets[k] : offsets[k] + lengths[k]] for k in range(i, j)])
        else:
            part = data[offsets[i] : offsets[j]]
        yield Bytes(i, j, part, np.concatenate([[0], ends[i:j] - done]))
        i = j


class Words(NamedTuple):
    """Words of a chunk: hashes, byte spans, and for every row (and the end) the index of its first word."""

    hashes: np.ndarray
    begin: np.ndarray
    close: np.ndarray
    first: np.ndarray
    totals: np.ndarray

    def prefixes(self, n: int) -> np.ndarray:
        """Hashes of the first n bytes of every word, as the word of these bytes has it; 0 for shorter words."""
        _, down = powers(len(self.totals))
        stop = np.minimum(self.begin + n, self.close)
        hashes = mix((self.totals[stop] - self.totals[self.begin]) * down[self.begin])
        return np.where(self.close - self.begin >= n, hashes, _U(0))


def words_of(part: Bytes, inside_bytes: np.ndarray = ~_SPACE, codes: np.ndarray = _FOLDED) -> Words:
    """Words as runs of the given bytes; they end where a row ends.  With ``_BYTES`` as codes A-Z are not folded."""
    data, offsets = part.data, part.offsets
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64), np.zeros(1, np.uint64))
    inside = inside_bytes[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    begin, close = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    up, down = powers(len(data))
    totals = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * up[:-1], out=totals[1:])
    hashes = mix((totals[close] - totals[begin]) * down[begin])
    return Words(hashes, begin, close, np.searchsorted(begin, offsets), totals)


def word_hashes(part: Bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for every row (and the end) the index of its first word."""
    words = words_of(part)
    return words.hashes, words.first


_SLOTS = mix(np.arange(1, 64, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; shorter runs never equal longer ones but by chance."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(count, n, np.uint64) * _SLOTS[40]
    for k in range(n):
        h = h + words[k : k + count] * _SLOTS[k]
    return mix(h)


def shingle_sets(column: pa.Array, n: int = SHINGLE, chunk: int = CHUNK) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row."""
    for part in byte_chunks(column, chunk):
        words, first = word_hashes(part)
        grams = gram_hashes(words, n)
        for k in range(part.last - part.first):
            a, b = int(first[k]), int(first[k + 1])
            if b - a >= n:
                own = grams[a : b - n + 1]
            elif b > a:
                own = gram_hashes(words[a:b], b - a)
            else:
                own = grams[:0]
            yield part.first + k, np.unique(own)
