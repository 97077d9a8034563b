"""Exact Jaccard join of shingle sets: regions around pivots, replicated boundaries, recursion.

Distance is 1 - Jaccard, a metric.  Two documents within the radius of each other share a shingle among the
first ``a`` of each, where shingles stand in one fixed order from rare to frequent and ``a`` is what a set may
miss, plus one.  So every such shingle is a region; a document belongs to the region of its first shingle and
is replicated to those that a partner within the radius could have as first common one.  Regions with the same
members are one.  Within regions, pivots are documents: the exact distance to a pivot links a member to it or
not, and the triangle inequality splits the region into a near cell (up to twice the radius) and a far cell
(beyond the radius), which overlap in the window between and are joined recursively with new pivots; small
cells are joined pair by pair.  Pairs that are linked through others already are not compared again, as only
components are asked for.  No pair of different sets within the radius is lost to components.

Documents with the same set are one member, so large groups of copies cost no pairs.  Set identities and
shingles are 64-bit hashes.

Defined results: NULL and blank texts have an empty set and are components of their own.  Texts of fewer than
five words are one shingle.  Repeated rows are linked; a component's id is the smallest doc_id in it (of
non-NULL ones; NULL if it has none).  An empty table gives an empty result.  Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewarden.llm.words import freeing, mix, shingle_sets
from linewarden.session import work_folder

#: Jaccard similarity of a link, in percent, and radius of a link as a distance.
PERCENT = 75
#: Counters that estimate how frequent a shingle is; the number is fixed, so what is sent to tasks is bounded.
COUNTERS, BLOCK = 1 << 20, 1 << 16
#: Bits of the map of documents whose sets are compared.
SLOTS = 1 << 22
#: Parts of the counters that are added up in one group.
FAN_IN = 64
#: Cells up to this size are joined pair by pair; larger ones get so many pivots a round (the first round one),
#: for so many rounds; what is left then is joined pair by pair.
SMALL_CELL, PIVOTS, ROUNDS = 8, 2, 3
#: Bytes of texts that are hashed at a time.
CHUNK = 1 << 20
#: Tasks that the cells of one main component are dealt into.
SPREAD = 2
#: Cells with at most so many pairs between components for each member are joined pair by pair, too; and all cells
#: are, as soon as all of them together have no more.
CROSSING = 4_096
#: Partners of a member that are compared first where all that is left is joined pair by pair: most links of a
#: group are found through them, so that few pairs stand between components when all others are compared.
FIRST_PARTNERS = 1

#: Words of the folded bitmap of a set.
FOLD = tuple(f"w{k}" for k in range(8))

_U = np.uint64


def _stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    folder = work_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.parquet(folder)


def _set_id(hashes: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(mix(hashes + _U(11)).sum(dtype=np.uint64) + _U(len(hashes))).view(np.int64)) if len(hashes) else 0


def _folded(hashes: np.ndarray) -> np.ndarray:
    """The words of ``FOLD``: a bitmap of fixed size like that of ``_parity``."""
    size = 64 * len(FOLD)
    bits = np.bincount((mix(hashes + _U(5)) % _U(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(bool), bitorder="little").view(np.int64)


def _parity(hashes: np.ndarray) -> bytes:
    """A set as a bitmap of two to four bits an element, each the parity of the elements that fall on it.

    The bits in which two sets differ are the parities of what stands in one set only, so no more than that; and the
    two halves of a bitmap, one upon the other, are the bitmap of half the size.
    """
    size = max(64 * len(FOLD), 1 << int(2 * len(hashes) - 1).bit_length())
    bits = np.bincount((mix(hashes + _U(5)) % _U(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(bool), bitorder="little").tobytes()


SETS = f"place long, sid long, n int, part int, block int, counts binary, parity binary, {', '.join(f'{w} long' for w in FOLD)}"


@freeing
def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Identity and size of every document's set, and at the end this task's counts of shingles."""
    from pyspark import TaskContext

    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * len(FOLD)]
    schema = pa.schema(list(zip(("place", "sid", "n", "part", "block", "counts", "parity", *FOLD), types, strict=True)))
    part = TaskContext.get().partitionId()
    counters = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        sid, n = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int32)
        folded = np.zeros((batch.num_rows, len(FOLD)), np.int64)
        parity: list[bytes | None] = [None] * batch.num_rows
        waiting: list[np.ndarray] = []
        held = 0
        for row, hashes in shingle_sets(batch.column(1), chunk=CHUNK):
            sid[row], n[row], folded[row] = _set_id(hashes), len(hashes), _folded(hashes)
            parity[row] = _parity(hashes) if len(hashes) else None
            waiting.append((hashes & _U(COUNTERS - 1)).astype(np.int64))
            held += len(hashes)
            if held >= COUNTERS:
                counters += np.bincount(np.concatenate(waiting), minlength=COUNTERS)
                waiting, held = [], 0
        if held:
            counters += np.bincount(np.concatenate(waiting), minlength=COUNTERS)
        none = pa.nulls(batch.num_rows, pa.int32())
        columns = [batch.column(0), pa.array(sid), pa.array(n), none, none, pa.nulls(batch.num_rows, pa.binary()), pa.array(parity, pa.binary())]
        columns += [pa.array(folded[:, k]) for k in range(len(FOLD))]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)
    if counters.any():
        small = np.minimum(counters, (1 << 32) - 1).astype("<u4").reshape(-1, BLOCK)
        k = len(small)
        none = pa.nulls(k, pa.int64())
        columns = [none, none, pa.nulls(k, pa.int32()), pa.array(np.full(k, part, np.int32))]
        columns += [pa.array(np.arange(k), pa.int32()), pa.array([x.tobytes() for x in small], pa.binary()), pa.nulls(k, pa.binary()), *[none] * len(FOLD)]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _added(group: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(BLOCK, np.uint64)
    for counts in group["counts"]:
        total += np.frombuffer(counts, "<u4")
    counts = np.minimum(total, (1 << 32) - 1).astype("<u4").tobytes()
    return pd.DataFrame({"part": [int(group["part"].iloc[0])], "block": [int(group["block"].iloc[0])], "counts": [counts]})


def _frequencies(spark: SparkSession, counts: DataFrame) -> np.ndarray:
    """Counters of the whole corpus, added up in groups of a bounded number of parts."""
    while (counts.agg(F.max("part")).first()[0] or 0) > 0:
        grouped = counts.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("block", "part")
        counts = _stored(spark, grouped.applyInPandas(_added, "part int, block int, counts binary"), "counters")
    total = np.zeros(COUNTERS, np.uint32)
    for r in counts.select("block", "counts").collect():
        total[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.counts, "<u4")
    return total


def _window(hashes: np.ndarray, frequency: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles in the order from rare to frequent: as many as a partner may miss, plus one."""
    n = len(hashes)
    kept = n - -(-percent * n // 100) + 1
    # Frequency in the high bits, scrambled identity in the low ones; the same order for every document.
    rank = np.minimum(frequency[(hashes & _U(COUNTERS - 1)).astype(np.int64)], (1 << 24) - 1).astype(np.uint64)
    order = (rank << _U(40)) | (mix(hashes) >> _U(24))
    if kept < n:
        # Ties at the cut are all kept, so that no order among them matters.
        cut = np.partition(order, kept - 1)[kept - 1]
        return hashes[order <= cut]
    return hashes


def _regions(frequency, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("shingle", pa.int64()), ("sid", pa.int64()), ("n", pa.int32())])

    @freeing
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            shingles: list[np.ndarray] = []
            sids, sizes, lengths = [], [], []
            for _, hashes in shingle_sets(batch.column(0), chunk=CHUNK):
                if not len(hashes):
                    continue
                sid = _set_id(hashes)
                if sid in seen:  # copies within a task are the same member
                    continue
                if len(seen) < 1_000_000:
                    seen.add(sid)
                own = _window(hashes, frequency.value, percent)
                shingles.append(own)
                sids.append(sid)
                sizes.append(len(hashes))
                lengths.append(len(own))
            if shingles:
                columns = [np.concatenate(shingles).view(np.int64), np.repeat(np.array(sids, np.int64), lengths)]
                columns.append(np.repeat(np.array(sizes, np.int32), lengths))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    return made


@freeing
def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Regions of a partition with two members or more, each set of members once under its signature."""
    schema = pa.schema([("region", pa.int64()), ("sid", pa.int64()), ("n", pa.int32())])
    got = [[np.asarray(c) for c in b.columns] for b in batches if b.num_rows]
    if not got:
        return
    shingle, sid, n = (np.concatenate(c) for c in zip(*got, strict=True))
    del got
    order = np.argsort(shingle)
    shingle = shingle[order]
    new = np.concatenate([[True], shingle[1:] != shingle[:-1]])
    sizes = np.diff(np.concatenate([np.flatnonzero(new), [len(shingle)]]))
    order = order[np.repeat(sizes > 1, sizes)]
    if not len(order):
        return
    shingle, sid, n = shingle[np.repeat(sizes > 1, sizes)], sid[order], n[order]
    order = np.lexsort((sid, shingle))
    shingle, sid, n = shingle[order], sid[order], n[order]
    once = np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (sid[1:] != sid[:-1])])
    shingle, sid, n = shingle[once], sid[once], n[once]
    starts = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(shingle)]]))
    with np.errstate(over="ignore"):
        signature = mix(np.add.reduceat(mix(sid.view(np.uint64) + _U(3)), starts) + sizes.astype(np.uint64))
    _, first = np.unique(signature, return_index=True)
    good = np.zeros(len(starts), bool)
    good[first] = True
    good &= sizes > 1
    rows = np.repeat(good, sizes)
    columns = [np.repeat(signature, sizes)[rows].view(np.int64), sid[rows], n[rows]]
    for k in range(0, len(columns[0]), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 100_000]) for c in columns], schema=schema)


def _slot(places: np.ndarray) -> np.ndarray:
    return (mix(places.astype(np.uint64) + _U(7)) % _U(SLOTS)).astype(np.int64)


@freeing
def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("slot", pa.int64())])
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(_slot(np.asarray(batch.column(0)))))], schema=schema)


def _sets(needed) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(sid, sorted hashes) of the documents whose place is in a bitmap of fixed size."""
    schema = pa.schema([("sid", pa.int64()), ("hashes", pa.binary())])

    @freeing
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(needed.value, np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            texts = batch.column(1).filter(pa.array(bits[_slot(np.asarray(batch.column(0)))]))
            sids, sets = [], []
            for _, hashes in shingle_sets(texts, chunk=CHUNK):
                if len(hashes):
                    sids.append(_set_id(hashes))
                    sets.append(hashes.tobytes())
                if len(sets) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(sets, pa.binary())], schema=schema)
                    sids, sets = [], []
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(sets, pa.binary())], schema=schema)

    return made


def _hashes(placed: DataFrame, sets: DataFrame, asked: DataFrame) -> DataFrame:
    """Stored sets of the members of the pairs, one document for each, and of a few others."""
    spark = placed.sparkSession
    members = asked.select(F.col("a").alias("sid")).union(asked.select("b")).distinct()
    first = sets.where("n > 0").groupBy("sid").agg(F.min("place").alias("place"))
    places = members.join(first, "sid").select("place").mapInArrow(_slots, "slot long").distinct()
    bits = np.zeros(SLOTS, np.uint8)
    bits[[r[0] for r in places.collect()]] = 1
    needed = spark.sparkContext.broadcast(np.packbits(bits, bitorder="little").tobytes())
    return _stored(spark, placed.mapInArrow(_sets(needed), "sid long, hashes binary"), "hashes")


@freeing
def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, shingles in common) of pairs with both sets beside them."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("common", pa.int32()), ("total", pa.int32())])
    for batch in batches:
        common, total = [], []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            w = np.concatenate([u, v])
            w.sort(kind="stable")  # two sorted runs: a merge
            both = int((w[1:] == w[:-1]).sum())
            common.append(both)
            total.append(len(w) - both)
        columns = [batch.column(0), batch.column(1), pa.array(common, pa.int32()), pa.array(total, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


@freeing
def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, most elements in common, that beside the rest) of pairs with sizes and both parity bitmaps beside them."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("common", pa.int32()), ("total", pa.int32())])
    for batch in batches:
        common, total = [], []
        for n, m, x, y in zip(*(batch.column(k) for k in range(2, 6)), strict=True):
            u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            while len(u) > len(v):
                u = u[: len(u) // 2] ^ u[len(u) // 2 :]
            while len(v) > len(u):
                v = v[: len(v) // 2] ^ v[len(v) // 2 :]
            apart, both = int(np.bitwise_count(u ^ v).sum()), n.as_py() + m.as_py()
            common.append(both - apart)
            total.append(both + apart)
        columns = [batch.column(0), batch.column(1), pa.array(common, pa.int32()), pa.array(total, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _judged(placed: DataFrame, sets: DataFrame, parities: DataFrame, asked: DataFrame, percent: int) -> DataFrame:
    """Stored (a, b, common, total) of the asked pairs.

    Bitmaps in proportion to the sets go first; pairs that they hold apart keep the greatest similarity that they allow,
    which is no link, and their sets never travel.
    """
    spark = placed.sparkSession
    one = asked.join(parities.toDF("a", "n", "x"), "a").join(parities.toDF("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y")
    bound = _stored(spark, one.mapInArrow(_bounded, "a long, b long, common int, total int"), "bounds")
    may_link = 100 * F.col("common") >= percent * F.col("total")
    apart = bound.where(~may_link)
    asked = bound.where(may_link).select("a", "b")
    hashed = _hashes(placed, sets, asked)
    with_a = asked.join(hashed.withColumnRenamed("sid", "a").withColumnRenamed("hashes", "x"), "a")
    with_b = with_a.join(hashed.withColumnRenamed("sid", "b").withColumnRenamed("hashes", "y"), "b")
    judged = with_b.select("a", "b", "x", "y").mapInArrow(_common, "a long, b long, common int, total int")
    # A copy beside the document that stands for its set gives the same distance again.
    return _stored(spark, judged.distinct().union(apart), "distances")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(sid, comp) of every end of an edge (a, b) that reaches a smaller sid, with the smallest it reaches.

    Every round links each node's neighbours to its least one, first the larger ones, then all, so the depth
    halves; rounds end when the edges are stars.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _stored(spark, large.where("a <> b").distinct(), "edges")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b")))
        edges = _stored(spark, small.where("a <> b").distinct(), "edges")
        # In stars no node has two lower ends, and none that has one is a lower end itself.
        ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("down"), F.lit(0).alias("up"))
        ends = ends.union(edges.select(F.col("b").alias("v"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        loose = ends.groupBy("v").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 OR down = 1 AND up = 1")
        if loose.isEmpty():
            return edges.select(F.col("a").alias("sid"), F.col("b").alias("comp"))


def _crossing(percent: int, most: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(a, b) of pairs within cells whose components differ and whose sizes and bitmaps allow a link, each pair once.

    With ``most``, of each member outside the main component only the partners that its bitmap puts nearest.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    @freeing
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[np.asarray(c) for c in b.columns] for b in batches if b.num_rows]
        if not got:
            return
        main, region, sid, n, comp, *words = (np.concatenate(c) for c in zip(*got, strict=True))
        order = np.argsort(region, kind="stable")
        main, region, sid, n, comp = main[order], region[order], sid[order], n[order].astype(np.int64), comp[order]
        words = np.stack([w[order] for w in words], 1).view(np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1], [True]]))
        held: list[np.ndarray] = []
        count = 0
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            outside = a + np.flatnonzero(comp[a:b] != main[a])
            # Every pair between components has a member outside the main one; a block of them at a time.
            step = max(1, (1 << 18) // (b - a))
            for k in range(0, len(outside), step):
                left = np.repeat(outside[k : k + step], b - a)
                right = np.tile(np.arange(a, b), len(outside[k : k + step]))
                less, more = np.minimum(n[left], n[right]), np.maximum(n[left], n[right])
                good = (comp[left] != comp[right]) & (100 * less >= percent * more)
                left, right = left[good], right[good]
                both = n[left] + n[right]
                apart = np.bitwise_count(words[left] ^ words[right]).sum(1, dtype=np.int64)
                good = 100 * (both - apart) >= percent * (both + apart)
                left, right = left[good], right[good]
                if most is not None and len(left):
                    order = np.lexsort((sid[right], (apart / both)[good], left))
                    left, right = left[order], right[order]
                    begins = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]]))
                    place = np.arange(len(left)) - np.repeat(begins, np.diff(np.append(begins, len(left))))
                    left, right = left[place < most], right[place < most]
                x, y = sid[left], sid[right]
                held.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))
                count += len(x)
                if count > 2_000_000:
                    held = [np.unique(np.concatenate(held), axis=0)]
                    count = len(held[0])
                    if count > 1_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0][:, 0]), pa.array(held[0][:, 1])], schema=schema)
                        held, count = [], 0
        if count:
            pairs = np.unique(np.concatenate(held), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    return made


def _live(cells: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members of the cells with two components or more, beside the size of their cell, the sum of the squares of
    its components' sizes, and its largest component."""
    if labels is None:
        named = cells.withColumn("comp", F.col("sid"))
    else:
        named = cells.join(labels, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    by_component = named.groupBy("region", "comp").agg(F.count(F.lit(1)).alias("k"))
    most = F.max(F.struct("k", "comp")).alias("most")
    shape = by_component.groupBy("region").agg(F.sum("k").alias("size"), F.sum(F.col("k") * F.col("k")).alias("inner"), most)
    shape = shape.where("size * size > inner").select("region", "size", "inner", F.col("most.comp").alias("main"))
    return named.join(shape, "region")


def _few_crossing(live: DataFrame) -> bool:
    """Whether all cells together have few pairs between components for their members."""
    of_member = (F.col("size") * F.col("size") - F.col("inner")) / F.col("size")
    pairs, members = live.agg(F.sum(of_member), F.count(F.lit(1))).first()
    return members > 0 and pairs <= 2 * CROSSING * members


def _pairs(live: DataFrame, percent: int, first: bool, last: bool, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(a, b) to compare now, and the pivots of the other cells: (region, a, b) with pivot b.

    A cell is joined pair by pair if it is small, or if few of its pairs stand between different components, so
    that their number stays in proportion to its size.
    """
    both = F.col("n") + F.col("m")
    fits = (100 * F.least("n", "m") >= percent * F.greatest("n", "m")) & (100 * (both - F.col("apart")) >= percent * (both + F.col("apart")))
    direct = F.lit(True) if last else (F.col("size") <= SMALL_CELL)
    if not first:
        direct = direct | (F.col("size") * F.col("size") - F.col("inner") <= 2 * CROSSING * F.col("size"))
    # Cells of one group of copies have the same main component; dealt by it, into a few tasks, most of their pairs
    # meet before they leave.
    few = live.where(direct).select("main", "region", "sid", "n", "comp", *FOLD).repartition(F.col("main"), F.pmod("region", F.lit(SPREAD)))
    small = few.mapInArrow(_crossing(percent, most), "a long, b long")
    large = live.where(~direct)
    ranked = F.struct((-F.col("degree")).alias("k"), F.col("sid").alias("b"), F.col("n").alias("m"), F.col("comp").alias("c"), *[F.col(w).alias(f"p{w}") for w in FOLD])
    slot = F.lit(0) if first else F.pmod(F.xxhash64("sid", F.lit(1)), F.lit(PIVOTS))
    pivots = large.groupBy("region", slot.alias("slot")).agg(F.min(ranked).alias("p")).select("region", "p.b", "p.m", "p.c", (-F.col("p.k")).alias("pivot_degree"), *[f"p.p{w}" for w in FOLD])
    apart = F.expr(" + ".join(f"bit_count({w} ^ p{w})" for w in FOLD)).alias("apart")
    star = large.join(pivots, "region").where("sid <> b")
    star = star.select("region", F.col("sid").alias("a"), "b", "n", "m", "degree", "pivot_degree", "comp", "c", apart)
    return small, star.withColumn("compare", (F.col("comp") != F.col("c")) & fits)


def _nearest_pivots(star: DataFrame) -> DataFrame:
    """(a, b) of every member to compare and the pivot that its bitmap puts nearest, over all its cells.

    The pairs with other pivots stay untested: their members stay in the cells of the next round.
    """
    by_bits = (F.col("apart") / (F.col("n") + F.col("m"))).alias("by_bits")
    best = star.where("compare").groupBy("a").agg(F.min(F.struct(by_bits, "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _next_cells(star: DataFrame, tested: DataFrame, percent: int) -> DataFrame:
    """The larger cells as near cells of each pivot and one far cell.

    If one of two linked members was measured within the radius of a pivot, both lie within twice the radius, and
    it is in the pivot's component from now on; the other one matters only if it was not.  So a near cell takes no
    members of its pivot's component, and the far cell all that were not measured within the radius of a pivot.
    Distances that were not measured are bounded by the sizes and by the bits in which the bitmaps differ.
    """
    radius = (100 - percent) / 100
    d = (1 - F.col("common") / F.col("total")).alias("d")
    measured = tested.select(F.col("a").alias("ta"), F.col("b").alias("tb"), d)
    pairs = star.select("*", F.least("a", "b").alias("ta"), F.greatest("a", "b").alias("tb"))
    known = pairs.join(measured, ["ta", "tb"], "left").withColumn("d", F.when(F.col("comp") != F.col("c"), F.col("d")))
    by_bits = 2 * F.col("apart") / (F.col("n") + F.col("m") + F.col("apart"))
    least = F.coalesce("d", F.greatest(1 - F.least("n", "m") / F.greatest("n", "m"), by_bits))
    member = [F.col("a").alias("sid"), F.col("n"), F.col("degree")]
    near = known.where((F.col("comp") != F.col("c")) & (least <= 2 * radius + 1e-9)).select(F.xxhash64("region", "b").alias("region"), *member)
    nearest = known.groupBy("region", "a", "n", "degree").agg(F.min(F.coalesce("d", F.lit(2.0))).alias("d"))
    far = nearest.where(F.col("d") > radius - 1e-9)
    # A pivot stays in its near cell beside the members that were not measured against it.
    waiting = known.where("compare AND d IS NULL").select(
        F.xxhash64("region", "b").alias("region"), F.col("b").alias("sid"), F.col("m").alias("n"), F.col("pivot_degree").alias("degree")
    )
    return near.union(far.select(F.xxhash64("region", F.lit("far")).alias("region"), *member)).union(waiting.distinct())


def link_components(docs: DataFrame, text: str = "text", percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(place, sid, n) of every document, and (sid, comp) of sets linked with one of a smaller sid.

    ``docs`` must be a stored table: its rows are read several times and named by their place.
    """
    spark = docs.sparkSession
    placed = docs.select(F.monotonically_increasing_id().alias("place"), F.col(text).cast("string").alias("text"))
    survey = _stored(spark, placed.mapInArrow(_survey, SETS), "sets")
    sets = survey.where("place IS NOT NULL").select("place", "sid", "n")
    frequency = spark.sparkContext.broadcast(_frequencies(spark, survey.where("block IS NOT NULL").select("part", "block", "counts")))
    postings = placed.select("text").mapInArrow(_regions(frequency, percent), "shingle long, sid long, n int")
    merged = postings.repartition(F.col("shingle")).mapInArrow(_merged, "region long, sid long, n int")
    cells = _stored(spark, merged.distinct(), "regions")
    # A document that lies in many regions is close to many others and makes a good pivot.
    degree = cells.groupBy("sid").agg(F.count(F.lit(1)).alias("degree"))
    bitmaps = survey.where("n > 0").groupBy("sid").agg(*[F.min(w).alias(w) for w in FOLD])
    parities = survey.where("n > 0").groupBy("sid").agg(F.min("n").alias("n"), F.min("parity").alias("parity"))
    labels: DataFrame | None = None
    tested: DataFrame | None = None
    number, rest = 0, False
    while True:
        live = _live(cells, labels).join(bitmaps, "sid")
        live = _stored(spark, live.join(degree, "sid") if number == 0 else live, "cells")
        if live.isEmpty():
            break
        last = rest or number == ROUNDS or number > 0 and _few_crossing(live)
        # At last members are compared with their nearest partners, and then with all that are still apart.
        asked, star = _pairs(live, percent, number == 0, last, FIRST_PARTNERS if last and not rest else None)
        if not last:
            star = _stored(spark, star, "stars")
            asked = asked.union(_nearest_pivots(star))
        asked = asked.distinct()
        if tested is not None:
            asked = asked.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        asked = _stored(spark, asked, "asked")
        judged = _judged(placed, sets, parities, asked, percent)
        tested = judged if tested is None else tested.union(judged)
        links = judged.where(100 * F.col("common") >= percent * F.col("total")).select("a", "b")
        # The components so far are stars already, so only the new links have to be worked in.
        if labels is None:
            labels = components(spark, links)
        elif not links.isEmpty():
            labels = components(spark, labels.select(F.col("sid").alias("a"), F.col("comp").alias("b")).union(links))
        if rest or not last and star.isEmpty():
            break
        if not last:
            cells = _stored(spark, _next_cells(star, tested, percent), "regions")
        rest, number = last, number + 1
    if labels is None:
        labels = spark.createDataFrame([], "sid long, comp long")
    return sets, labels


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """The documents without their text, with ``n_shingles`` and ``component_id``."""
    spark = docs.sparkSession
    sets, labels = link_components(docs, text, percent)
    kept = [c for c in docs.columns if c not in (text, "n_shingles", "component_id")]
    named = docs.select(*kept, F.monotonically_increasing_id().alias("__place"), F.col(doc_id).alias("__id"))
    # Own names, so that the columns that pass through cannot clash.
    sets = sets.select(F.col("place").alias("__place"), F.col("sid").alias("__sid"), F.col("n").alias("__n"))
    labels = labels.select(F.col("sid").alias("__sid"), F.col("comp").alias("__comp"))
    joined = named.join(sets, "__place").join(labels, "__sid", "left")
    # An empty set is linked with nothing, so it groups by its own row.
    group = F.when(F.col("__n") > 0, F.coalesce("__comp", "__sid"))
    joined = _stored(spark, joined.withColumn("__group", group), "grouped")
    first = joined.where("__group IS NOT NULL").groupBy("__group").agg(F.min("__id").alias("component_id"))
    linked = joined.where("__group IS NOT NULL").join(first, "__group")
    alone = joined.where("__group IS NULL").withColumn("component_id", F.col("__id"))
    out = linked.unionByName(alone)
    return out.select(*kept, F.col("__n").cast("long").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """One document of each component, the one with the least doc_id and place, with all its columns."""
    sets, labels = link_components(docs, text, percent)
    placed = docs.withColumn("__place", F.monotonically_increasing_id())
    joined = sets.join(labels, "sid", "left").where("n > 0").withColumn("group", F.coalesce("comp", "sid"))
    ids = placed.select("__place", F.col(doc_id).alias("id"))
    named = joined.join(ids.withColumnRenamed("__place", "place"), "place")
    key = F.struct(F.col("id").isNull().alias("missing"), "id", "place")
    first = named.groupBy("group").agg(F.min(key).alias("first")).select(F.col("first.place").alias("__place"))
    empty = sets.where("n = 0").select(F.col("place").alias("__place"))
    return placed.join(first.union(empty), "__place", "left_semi").drop("__place")
