"""Merkle manifest of a table: a root over one hash tree per group, and the proof of every row.

Leaves ascend by doc_id within their group.  Their places come from bitmaps instead of a sort: an aggregate merges
the doc_ids of a group into words of 64 bits, of which only those with rows are kept; directories of their
counts lead from stretches of ids to words; and a rank query, the count before the word plus the bits below the own
one, gives the place of a leaf.  Eight neighbours form a parent.  Nodes fill slot arrays keyed by (group, place / 512),
so one shuffle reduces three levels; the paths come back down the same arrays.

Words that hold more rows than bits have rows with equal doc_ids.  Their rows are numbered by a distributed sort by
doc_id and leaf.

Defined results: a NULL field is hashed as `-`; NULL doc_ids are the first leaves of their group, rows with equal
doc_ids are ordered by leaf, and rows that are equal in all fields may take each other's place.  The NULL group is
the first tree.  A lone leaf is its own subroot.  An empty table gives an empty result.  Columns that are not
named have no part in the result, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewarden.session import work_folder

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node.
FAN = 8
#: Levels, and so leaves, that one slot array holds.
DEPTH = 3
SLOTS = FAN**DEPTH
#: Bits of doc_id below a word, and below the stretches of each directory over the one before.
WORD_BITS = 6
STRETCH_BITS = (16, 31, 46)
#: The word of NULL doc_ids, below that of the least number.
NULL_WORD = -(1 << (63 - WORD_BITS)) - 1


def leaf(fields: dict[str, Column]) -> Column:
    """The hash of fields in order, each with its length in bytes."""
    told = []
    for value in fields.values():
        text = value.cast("string")
        told.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*told), 256)


def _stored(df: DataFrame, name: str) -> DataFrame:
    folder = work_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def numbered(df: DataFrame, number: str, *order: str) -> DataFrame:
    """Number rows from 0 in the given order by a distributed sort; ``df`` must be a stored table."""
    spread = df.withColumn("__salt", F.xxhash64(F.monotonically_increasing_id()))
    placed = spread.repartitionByRange(*order, "__salt").sortWithinPartitions(*order, "__salt")
    placed = _stored(placed.withColumn("__at", F.monotonically_increasing_id()).drop("__salt"), "numbered")
    part = F.shiftright("__at", 33)
    parts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))  # a row for each partition
    local = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    numbers = placed.join(parts, part == F.col("__part")).withColumn(number, F.col("__before") + local)
    return numbers.drop("__at", "__part", "__before")


def directory(leaves: DataFrame) -> DataFrame:
    """The bitmap of every tree as words with the number of leaves before each: tree, word, bits, n, before."""
    words = _stored(
        leaves.groupBy("tree", "word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"), F.count(F.lit(1)).alias("n")), "bitmap"
    )
    before = F.lit(0).cast("long")
    level = words.select("tree", F.col("word").alias("at0"), "n")
    levels = [level]
    shift = WORD_BITS
    for k, bits in enumerate(STRETCH_BITS, 1):
        level = level.groupBy("tree", F.shiftright(f"at{k - 1}", bits - shift).alias(f"at{k}")).agg(F.sum("n").alias("n"))
        levels.append(level)
        shift = bits
    # A window holds the stretches of one stretch above, or the few that 64 bits leave at the top.
    placed = None
    for k in range(len(levels) - 1, -1, -1):
        level, inside = levels[k], ["tree"]
        if k < len(levels) - 1:
            bits = STRETCH_BITS[k] - (STRETCH_BITS[k - 1] if k else WORD_BITS)
            level = level.withColumn(f"at{k + 1}", F.shiftright(f"at{k}", bits))
            inside.append(f"at{k + 1}")
        window = Window.partitionBy(*inside).orderBy(f"at{k}").rowsBetween(Window.unboundedPreceding, -1)
        level = level.withColumn(f"before{k}", F.coalesce(F.sum("n").over(window), F.lit(0))).drop("n")
        before = before + F.col(f"before{k}")
        placed = level if placed is None else level.join(placed, inside)
    found = placed.select("tree", F.col("at0").alias("word"), before.alias("before"))
    return words.join(found, ["tree", "word"])


def ranked(leaves: DataFrame) -> DataFrame:
    """Stored leaves with ``place``, their number in their tree."""
    words = _stored(directory(leaves), "directory")
    below = F.expr("bit_count(bits & ~shiftleft(-1L, bit))")
    crowded = F.col("n") > F.expr("bit_count(bits)")
    names = leaves.columns
    single = leaves.join(words.where(~crowded), ["tree", "word"]).select(*names, (F.col("before") + below).alias("place"))
    full = words.where(crowded)
    if full.isEmpty():
        return single
    many = _stored(leaves.join(full.select("tree", "word", "before"), ["tree", "word"]), "crowded")
    many = _stored(numbered(many, "__number", "tree", "word", "bit", "leaf"), "crowded")
    least = many.groupBy("tree", "word").agg(F.min("__number").alias("__least"))
    many = many.join(least, ["tree", "word"])
    return single.unionByName(many.select(*names, (F.col("before") + F.col("__number") - F.col("__least")).alias("place")))


def _parents(nodes: str) -> str:
    last = f"cast((size({nodes}) - 1) div {FAN} AS int)"
    return f"transform(sequence(0, {last}), i -> sha2(array_join(slice({nodes}, i * {FAN} + 1, {FAN}), ''), 256))"


def _siblings(nodes: str, slot: str) -> str:
    """What stands to the left and to the right of a node in its run of eight."""
    run = f"shiftright({slot}, 3) * {FAN}"
    left = f"array_join(slice({nodes}, {run} + 1, {slot} - {run}), '')"
    right = f"array_join(slice({nodes}, {slot} + 2, {run} + {FAN - 1} - {slot}), '')"
    return f"named_struct('left', {left}, 'right', {right})"


def _path(slot: str) -> str:
    """The path of a slot up to the top of its array, as far as the tree has levels."""
    steps = [f"if(n > {FAN**k}, {_siblings(f'l{k}', f'shiftright({slot}, {3 * k})')}, null)" for k in range(DEPTH)]
    return f"array_compact(array({', '.join(steps)}))"


def _folded(start: str, path: str) -> str:
    return f"aggregate({path}, {start}, (node, x) -> sha2(concat(x.left, node, x.right), 256))"


def _told(path: str) -> str:
    return f"array_join(transform({path}, x -> concat(x.left, x.right)), '')"


def _arrays(nodes: DataFrame, *payload: str) -> DataFrame:
    """Slot arrays of nodes (tree, place, digest, number n of nodes of the tree): their levels, and the node on top.

    ``payload`` columns stay with the slots as structs in ``carried``.
    """
    slots = F.array_sort(F.collect_list(F.struct(F.pmod("place", F.lit(SLOTS)).alias("slot"), "digest", *payload)))
    block = F.shiftright("place", 3 * DEPTH).alias("block")
    full = nodes.groupBy("tree", block).agg(F.first("n").alias("n"), slots.alias("carried"))
    # Lambdas evaluate what they enclose once an element, so each level is made, by a generator, before the next.
    full = full.selectExpr("*", "explode(array(transform(carried, x -> x.digest))) AS l0")
    for k in range(DEPTH):
        full = full.selectExpr("*", f"explode(array(if(n > {FAN**k}, {_parents(f'l{k}')}, l{k}))) AS l{k + 1}")
    return full.selectExpr("tree", "block", "n", "carried", *[f"l{k}" for k in range(DEPTH)], f"l{DEPTH}[0] AS top")


def _climb(nodes: DataFrame, most: int, *payload: str) -> tuple[list[DataFrame], DataFrame]:
    """Slot arrays of all rounds, and the root of every tree (tree, top); nodes have tree, place, digest and n."""
    rounds = []
    while True:
        rounds.append(_stored(_arrays(nodes, *(payload if not rounds else ())), "arrays"))
        most = -(-most // SLOTS)
        if most <= 1:
            return rounds, rounds[-1].select("tree", "top")
        above = F.shiftright(F.col("n") + (SLOTS - 1), 3 * DEPTH)
        nodes = rounds[-1].select("tree", F.col("block").alias("place"), F.col("top").alias("digest"), above.alias("n"))


def _descend(rounds: list[DataFrame], ends: DataFrame) -> DataFrame:
    """Paths of the arrays of the first round; ``ends`` has the path above the root of every tree, and more columns."""
    rest = [c for c in ends.columns if c not in ("tree", "path")]
    paths = ends.withColumn("block", F.lit(0).cast("long"))
    for arrays in reversed(rounds[1:]):
        # Each array meets the one row of its path.
        each = arrays.drop("top").join(paths, ["tree", "block"])
        below = f"transform(carried, (x, s) -> named_struct('block', block * {SLOTS} + s, 'path', concat({_path('s')}, path)))"
        paths = each.selectExpr("tree", *rest, f"inline({below}) AS (block, path)")
    return paths


def manifest(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", doc_id: str = "doc_id", changed: dict[str, Column] | None = None
) -> DataFrame:
    """Leaves, roots and proofs of all rows: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``changed`` replaces fields by columns, as a later state of the table has them: ``folded_root`` is computed from
    the leaf of that state and the siblings of this one, and ``verified`` says whether it is the root.
    """
    original = {f: F.col(f) for f in fields}
    key = F.col(doc_id).cast("long")
    leaves = _stored(
        docs.select(
            F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree"),
            F.coalesce(F.shiftright(key, WORD_BITS), F.lit(NULL_WORD)).alias("word"),
            F.coalesce(key.bitwiseAND(F.lit((1 << WORD_BITS) - 1)), F.lit(0)).cast("int").alias("bit"),
            key.alias("doc_id"),
            leaf(original).alias("leaf"),
            leaf(original | (changed or {})).alias("now"),
        ),
        "leaves",
    )
    sizes = _stored(leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), "trees")
    most, trees = sizes.agg(F.max("n"), F.count(F.lit(1))).first()
    result = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if not trees:
        return docs.sparkSession.createDataFrame([], result)
    nodes = ranked(leaves).join(sizes, "tree").select("tree", "place", F.col("leaf").alias("digest"), "n", "doc_id", "now")
    rounds, subroots = _climb(nodes, most, "doc_id", "now")

    tops = numbered(subroots, "place", "tree").select(
        F.lit("").alias("tree"), "place", F.col("top").alias("digest"), F.lit(trees).cast("long").alias("n"), F.col("tree").alias("of")
    )
    upper, root = _climb(tops, trees, "of")
    nothing = F.array().cast("array<struct<left: string, right: string>>")
    above = _descend(upper, root.select("tree", F.col("top").alias("root"), nothing.alias("path")))
    each = upper[0].drop("top").join(above, ["tree", "block"])
    of = f"transform(carried, (x, s) -> named_struct('tree', x.of, 'subroot', x.digest, 'path', concat({_path('s')}, path)))"
    ends = each.selectExpr("root", f"inline({of}) AS (tree, subroot, path)")

    # What all leaves of an array share is joined once.
    arrays = rounds[0].drop("top").join(_descend(rounds, ends), ["tree", "block"]).selectExpr("*", f"explode(array({_told('path')})) AS shared")
    row = f"""named_struct('doc_id', x.doc_id, 'leaf', x.digest, 'proof_sha256', sha2(concat({_told(_path("s"))}, shared), 256),
                           'folded_root', {_folded(_folded("x.now", _path("s")), "path")})"""
    out = arrays.selectExpr("subroot", "root", f"inline(transform(carried, (x, s) -> {row})) AS (doc_id, leaf, proof_sha256, folded_root)")
    return out.selectExpr("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "folded_root = root AS verified")
