"""Periodic runs of words by the branching tandem test on an enhanced suffix array.

The words of many documents stand in one array, each document closed by an end mark of its own; suffixes are
sorted by document first, so nothing is shared between documents.  Prefix doubling sorts them, and keeps for
every power of two the classes of equal stretches of that length.  From these classes come the common prefixes
of neighbours, and from the next smaller values to both sides the LCP intervals: no tree is built.

For an interval of depth d every suffix i outside the largest child is tested: if suffix i + d (or i - d) stands
in the same interval, by its place in the inverse suffix array, words i.. (or i - d..) are a square of period d;
it is a branching one if the words after its two halves differ.  A branching square is the right end of exactly
one run; rotations to the left, by the classes in steps of powers of two, lead to the run's first word.  Squares
of a multiple of a run's period lead to the same stretch, of which the least period stays.

A run of exponent x and period q puts x suffixes into its interval of depth q, so smaller intervals, and depths
above the x-th part of a document, are left out.

Defined results: NULL, empty and blank texts have no words and no runs, and collapse to an empty text; repeated
rows are treated row by row; an empty table gives an empty result.  Texts of any length are worked whole, and one
long text is hashed in windows cut at white space.  Other columns of the input are not returned, so their names
cannot clash.  Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewarden.llm.words import _BYTES, _SPACE, Bytes, byte_chunks, words_of

#: Bytes of texts whose suffixes are sorted together; one longer text is sorted by itself.
CHUNK = 1 << 20
#: Suffixes that are tested at a time.
TESTED = 1 << 21
RUNS = "array<struct<start: long, length: long, period: long>>"

#: (seed of a row, number of its words) -> (a, p): from word a on the words repeat with period p; or None.
Rewrite = Callable[[int | None, int], tuple[int, int] | None]


class Runs(NamedTuple):
    """Runs as parallel arrays, ordered by start and period: first word, words, period."""

    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def _spans(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of the given sizes: the group of each member, and its number in the group."""
    group = np.repeat(np.arange(len(sizes)), sizes)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Suffixes:
    """Sorted suffixes of an array of symbols in which the last symbol of every document is unique."""

    def __init__(self, symbols: np.ndarray):
        n = self.n = len(symbols)
        self.order = np.argsort(symbols, kind="stable")
        place = np.arange(n)
        fresh = np.ones(n, bool)
        fresh[1:] = symbols[self.order[1:]] != symbols[self.order[:-1]]
        #: Of every suffix the first place of its class; in the end its place.
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.maximum.accumulate(np.where(fresh, place, 0))
        #: For every power of two: suffixes that still had company before, and their classes.
        self.classes = [(np.arange(n), self.place.astype(np.int32 if n < 1 << 31 else np.int64))]
        #: For every place: the number of the power at which it left the suffix before; -1 if they share no symbol.
        left_at = np.where(fresh, -1, np.iinfo(np.int32).max)
        step = 1
        while True:
            alone = fresh.copy()
            alone[:-1] &= fresh[1:]
            slots = np.flatnonzero(~alone)
            if not len(slots):
                break
            members = self.order[slots]
            key = self.place[members] * n + self.place[members + step]
            by = np.argsort(key, kind="stable")
            members, key = members[by], key[by]
            self.order[slots] = members
            new = np.ones(len(slots), bool)
            new[1:] = key[1:] != key[:-1]
            left_at[slots[new & ~fresh[slots]]] = len(self.classes) - 1
            fresh[slots] = new
            self.place[members] = np.maximum.accumulate(np.where(new, slots, 0))
            at = np.argsort(members)
            where = members[at]
            self.classes.append((where, self.place[where].astype(self.classes[0][1].dtype)))
            step *= 2
        self.common = self._common(left_at)

    def same(self, power: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether 2 ** power symbols from a and from b on are equal, for a <> b."""
        where, cls = self.classes[power]
        if power == 0:
            return cls[a] == cls[b]
        if not len(where):
            return np.zeros(len(a), bool)
        last = len(where) - 1
        x, y = (np.minimum(np.searchsorted(where, v), last) for v in (a, b))
        return (where[x] == a) & (where[y] == b) & (cls[x] == cls[y])

    def _common(self, left_at: np.ndarray) -> np.ndarray:
        """Length of the common prefix of every suffix in order with the one before."""
        common = np.where(left_at >= 0, 1 << np.maximum(left_at, 0), 0)
        for power in range(int(left_at.max(initial=0)) - 1, -1, -1):
            some = np.flatnonzero(left_at > power)
            reach = common[some]
            equal = self.same(power, self.order[some - 1] + reach, self.order[some] + reach)
            common[some] += equal.astype(np.int64) << power
        return common

    def intervals(self, least: int, most_depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """LCP intervals of ``least`` members as (first place, end, depth), and the places where their children begin.

        The last array holds, ordered by interval, the places inside an interval where a new child begins, and the
        first array has a row for each of them.  ``most_depth`` bounds the depth by the suffix at a place.
        """
        depth = np.append(self.common, 0)
        inner = np.flatnonzero(depth)
        low, high = np.arange(self.n + 1) - 1, np.arange(self.n + 1) + 1
        for nearest in (low, high):
            open_ = inner
            while len(open_):
                open_ = open_[depth[nearest[open_]] >= depth[open_]]
                nearest[open_] = nearest[nearest[open_]]
        kept = inner[(high[inner] - low[inner] >= least) & (depth[inner] <= most_depth[self.order[inner]])]
        kept = kept[np.argsort(low[kept] * (self.n + 2) + high[kept], kind="stable")]
        return low[kept], high[kept], depth[kept], kept


def _tandems(suffixes: Suffixes, first: np.ndarray, least: int, most_depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Branching squares as (start, period), found from the smaller children of every LCP interval."""
    low, high, depth, begins = suffixes.intervals(least, most_depth)
    if not len(low):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    opens = np.ones(len(low), bool)
    opens[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    owner = np.cumsum(opens) - 1
    low, high, depth = low[opens], high[opens], depth[opens]
    # An interval with k begins has k + 1 children.
    at = np.flatnonzero(opens) + np.arange(len(low))
    child_low = np.empty(len(begins) + len(low), np.int64)
    inner = np.ones(len(child_low), bool)
    inner[at] = False
    child_low[at], child_low[inner] = low, begins
    child_high = np.empty_like(child_low)
    last = np.append(at[1:], len(child_low)) - 1
    inner = np.ones(len(child_low), bool)
    inner[last] = False
    child_high[last], child_high[inner] = high, begins
    of = np.zeros(len(child_low), np.int64)
    of[at[1:]] = 1
    of = np.cumsum(of)
    sizes = child_high - child_low
    largest = np.flatnonzero(sizes == np.maximum.reduceat(sizes, at)[of])
    largest = largest[np.concatenate([[True], of[largest[1:]] != of[largest[:-1]]])]
    sizes[largest] = 0

    order, place = suffixes.order, suffixes.place
    starts, periods = [], []
    ends = np.cumsum(sizes)
    i = 0
    while i < len(sizes):
        done = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, done + TESTED, "right")))
        child, number = _spans(sizes[i:j])
        child += i
        suffix, iv = order[child_low[child] + number], of[child]
        d = depth[iv]
        for square, partner in ((suffix, suffix + d), (suffix - d, suffix - d)):
            ok = (partner >= 0) & (partner < suffixes.n)
            slot = place[np.where(ok, partner, 0)]
            ok &= (slot >= low[iv]) & (slot < high[iv])
            s, p = square[ok], d[ok]
            branching = first[s + p] != first[s + 2 * p]
            starts.append(s[branching])
            periods.append(p[branching])
        i = j
    return np.concatenate(starts), np.concatenate(periods)


def find_runs(words: np.ndarray, ends: np.ndarray, exponent: int = 4, least: int = 6) -> Runs:
    """Runs of words (any codes) of documents that end before the given places, with places in the whole array."""
    n = len(words)
    if not n:
        return Runs(*[np.zeros(0, np.int64)] * 3)
    sizes = np.diff(ends, prepend=0)
    doc, _ = _spans(sizes)
    known, code = np.unique(words, return_inverse=True)
    # The end mark of a document stands behind its words.
    symbols = np.empty(n + len(ends), np.int64)
    mark = ends + np.arange(len(ends))
    inner = np.ones(len(symbols), bool)
    inner[mark] = False
    symbols[inner] = doc * (len(known) + 1) + code
    symbols[mark] = np.arange(len(ends)) * (len(known) + 1) + len(known)
    suffixes = Suffixes(symbols)
    most_depth = np.repeat(sizes // exponent, sizes + 1)
    start, period = _tandems(suffixes, symbols, exponent, most_depth)
    end = start + 2 * period
    for power in range(len(suffixes.classes) - 1, -1, -1):
        back = start - (1 << power)
        some = np.flatnonzero(back >= 0)
        equal = suffixes.same(power, back[some], back[some] + period[some])
        start[some[equal]] -= 1 << power
    some = end - start >= np.maximum(least, exponent * period)
    start, end, period = start[some], end[some], period[some]
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[fresh], end[fresh], period[fresh]
    by = np.lexsort((period, start))
    start, end, period = start[by], end[by], period[by]
    # Places without the end marks of the documents before.
    return Runs(start - np.searchsorted(mark, start), end - start, period)


def _windows(part: Bytes) -> Iterator[Bytes]:
    """A chunk as it is, or, if it is one long text, windows of it that end at white space."""
    data, n = part.data, len(part.data)
    if n <= 2 * CHUNK:
        yield part
        return
    begin = 0
    while begin < n:
        stop = min(n, begin + CHUNK)
        while stop < n and not _SPACE[data[stop]]:
            ahead = np.flatnonzero(_SPACE[data[stop : stop + CHUNK]])
            stop = stop + int(ahead[0]) if len(ahead) else min(n, stop + CHUNK)
        yield Bytes(part.first, part.last, data[begin:stop], np.array([0, stop - begin]))
        begin = stop


def _word_codes(part: Bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a chunk, and for every row (and the end) the number of its first word."""
    windows = [words_of(w, codes=_BYTES) for w in _windows(part)]
    if len(windows) == 1:
        return windows[0].hashes, windows[0].first
    hashes = np.concatenate([w.hashes for w in windows])
    return hashes, np.array([0, len(hashes)])


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run repeats; runs are (start, length, period)."""
    out, at = [], 0
    for begin, stop in sorted((s + q, s + n) for s, n, q in runs):
        out += words[at:begin]
        at = max(at, stop)
    return b" ".join(out + words[at:])


def _worked(rewrite: Rewrite | None, exponent: int, least: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = batch.column(2)
            for part in byte_chunks(batch.column(1), CHUNK):
                codes, first = _word_codes(part)
                counts = np.diff(first)
                changed = {}
                if rewrite is not None:
                    for k, seed in enumerate(seeds.slice(part.first, part.last - part.first).to_pylist()):
                        new = rewrite(seed, int(counts[k]))
                        if new:
                            (a, p), begin = new, int(first[k])
                            codes[begin + a : first[k + 1]] = codes[begin + a + np.arange(counts[k] - a) % p]
                            changed[k] = new
                found = find_runs(codes, first[1:].astype(np.int64), exponent, least)
                row = np.searchsorted(first[1:], found.start, "right")
                edges = np.searchsorted(row, np.arange(len(counts) + 1))
                texts, runs = [], []
                for k in range(len(counts)):
                    own = slice(edges[k], edges[k + 1])
                    listed = list(zip((found.start[own] - first[k]).tolist(), found.length[own].tolist(), found.period[own].tolist(), strict=True))
                    words = part.data[part.offsets[k] : part.offsets[k + 1]].tobytes().split()
                    if k in changed:
                        a, p = changed[k]
                        words[a:] = (words[a : a + p] * ((len(words) - a) // p + 1))[: len(words) - a]
                    texts.append(_collapsed(words, listed) if listed else b" ".join(words))
                    runs.append([dict(zip(("start", "length", "period"), x, strict=True)) for x in listed])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.first, part.last - part.first),
                        pa.array(counts.astype(np.int64)),
                        pa.array(runs, schema.field("runs").type),
                        pa.array(texts, pa.binary()).cast(pa.string()),
                    ],
                    schema=schema,
                )

    return work


def periodic_runs(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    seed: F.Column | None = None,
    rewrite: Rewrite | None = None,
    exponent: int = 4,
    least: int = 6,
) -> DataFrame:
    """Per row: doc_id, n_words, its runs by start and period, and ``collapsed``, the text without repeated words.

    A run is a longest stretch with a least period of which it holds ``exponent`` times the words, and ``least``
    words.  In ``collapsed`` the first period of each run stays, and single blanks stand between words.  With
    ``rewrite`` words are replaced before, by a function of the row's seed and number of words.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), (F.lit(None) if seed is None else seed).cast("long").alias("seed")
    )
    schema = pa.schema(
        [
            ("doc_id", to_arrow_type(rows.schema["doc_id"].dataType)),
            ("n_words", pa.int64()),
            ("runs", to_arrow_type(_parse_datatype_string(RUNS))),
            ("collapsed", pa.string()),
        ]
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_worked(rewrite, exponent, least, schema), f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string")


def strongest(runs: F.Column) -> F.Column:
    """The run of the greatest exact length / period; the first of equal ones in the order of the array."""
    better = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    return F.aggregate(runs, F.try_element_at(runs, F.lit(1)), lambda best, x: F.when(better(x, best), x).otherwise(best))
