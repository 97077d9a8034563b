"""Mixing sources to target weights by apportioned blocks.

Every source's documents are dealt to shards by a seeded hash and laid end to end; a shard is cut into equal
blocks of words, smaller ones for small sources.  Sainte-Laguë apportionment allots blocks to the sources that share a
block size, and within a source to bundles of shards and to shards, by highest quotients, so that quotas are whole numbers; a seeded order says which blocks of a shard are taken.
What is taken of a document is the sum of its overlaps with taken blocks.

Defined results: NULL and blank texts have size 0 and take nothing; a NULL source is a source of its own, the
last.  Documents that repeat share one seeded place each; where ids and texts tie, their rows are alike.  An
empty table gives an empty mix, and a corpus without words takes nothing.  Columns named like a result column
are replaced, others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewarden.session import work_folder

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Words of a block, and about how many words a shard holds.
BLOCK, SHARD = 256, 32_768
#: Blocks that a source has at least, where it has as many words; and shards of a bundle.
BLOCKS_OF_SOURCE, BUNDLE = 64, 4_096
#: Documents of a run of like sizes in which whole copies are dealt out, and a document's part as whole numbers.
RUN, WHOLE_BITS = 1_000, 30
#: Tables of sources up to this many rows are sent to every task; larger ones are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def targets(sizes: DataFrame, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS, most: float = 2.0) -> DataFrame:
    """(__source, source_size) with ``target``: ``share`` of all words by weight, at most ``most`` times a source.

    Sources that stop at their limit hand on their excess by weight.  In the order of limit to weight, a first
    part of the sources is at the limit and the rest shares what is left, so running sums find the cut.
    """
    by_code = Window.orderBy(F.col("__source.missing"), F.col("__source.name"))
    place = (F.row_number().over(by_code) - 1) % len(weights)
    weighed = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    weighed = weighed.withColumn("limit", most * F.col("source_size")).withColumn("at", F.col("limit") / F.col("w"))
    order = Window.orderBy("at", "__source.missing", "__source.name")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    total = share * F.sum("source_size").over(everything)
    left = total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    still = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    level = F.max(F.when(left / still <= F.col("at"), left / still)).over(everything)
    cut = weighed.withColumn("level", level)
    target = F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("level") * F.col("w")))
    return cut.select("__source", "source_size", target.cast("double").alias("target"))


def apportion(
    parties: DataFrame, votes: Column, seats: Column, party: tuple[str, ...], keys: tuple[str, ...] = ()
) -> DataFrame:
    """Adds ``quota``: ``seats`` whole seats within each group of ``keys``, by highest quotients of votes.

    Rounding each party's share is the Sainte-Laguë result for about as many seats.  What is missing goes to
    the highest quotients votes/(2q+1), what is over is taken from the lowest quotients votes/(2q-1); so the
    result is the same as dealing out every seat by highest quotients.  ``party`` names a row; ties go by it.
    """
    names = [c for c in parties.columns]
    group = Window.partitionBy(*keys)
    v = parties.withColumn("__v", votes.cast("double")).withColumn("__s", seats.cast("long"))
    v = v.withColumn("__all", F.sum("__v").over(group)).withColumn("__n", F.count(F.lit(1)).over(group))
    first = F.when(F.col("__all") > 0, F.floor(F.col("__v") / F.col("__all") * F.col("__s") + 0.5)).otherwise(F.lit(0))
    v = v.withColumn("__q", first.cast("long"))
    v = v.withColumn("__gap", F.col("__s") - F.sum("__q").over(group))
    # As many quotients of a party as it can gain or lose, in proportion to its votes.
    steps = F.ceil(F.col("__v") / F.col("__all") * (F.abs("__gap") + F.col("__n"))) + 1
    steps = F.when((F.col("__gap") == 0) | (F.col("__all") <= 0), F.lit(0)).otherwise(steps).cast("int")
    up = F.col("__gap") > 0
    quotient = F.when(up, F.col("__v") / (2 * (F.col("__q") + F.col("__k")) - 1)).otherwise(
        F.when(F.col("__q") - F.col("__k") >= 0, -F.col("__v") / (2 * (F.col("__q") - F.col("__k")) + 1))
    )
    stepped = v.where((F.col("__gap") != 0) & (F.col("__all") > 0))
    stepped = stepped.withColumn("__k", F.explode(F.sequence(F.lit(1), F.greatest(steps, F.lit(1)))))
    ranked = stepped.withColumn("__quotient", quotient).where("__quotient IS NOT NULL")
    ranked = ranked.withColumn("__rank", F.row_number().over(group.orderBy(F.desc("__quotient"), *party)))
    moved = ranked.where("__rank <= abs(__gap)").groupBy(*party)
    joined = v.join(moved.agg(F.sum(F.signum("__gap")).cast("long").alias("__moved")), list(party), "left")
    return joined.select(*names, (F.col("__q") + F.coalesce("__moved", F.lit(0))).alias("quota"))


def _placed(sized: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Documents with their shard and where their words begin in it."""
    few = F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources
    placed = sized.join(few, "__source")
    shard = F.pmod(F.xxhash64(F.lit(seed), "__key"), F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD)))
    placed = placed.withColumn("__shard", shard)
    order = Window.partitionBy("__source", "__shard").orderBy(F.xxhash64("__key", F.lit(seed + 1)), "__key", "__place")
    start = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return placed.withColumn("__start", start)


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    share: float = 1.5,
    weights: tuple[int, ...] = WEIGHTS,
    most: float = 2.0,
    seed: int = 17,
    block: int = BLOCK,
) -> DataFrame:
    """The documents with ``size``, ``source_size``, ``target`` and ``taken`` in words; the text is left out.

    Only a narrow table of sizes is shuffled, never a text; groups of a window are shards of bounded size,
    so a hot source is spread over many.
    """
    kept = [c for c in docs.columns if c not in (text, "size", "source_size", "target", "taken")]
    out = _mixed(docs, kept, kept, text, source, share, weights, most, seed, block)
    return out.select(*kept, "size", "source_size", "target", "taken")


def _mixed(
    docs: DataFrame, kept: list[str], named: list[str], text: str, source: str, share: float, weights: tuple[int, ...], most: float, seed: int, block: int
) -> DataFrame:
    """The ``kept`` columns with the mix and its own names; ``named`` columns and the text say where a document lies."""
    spark = docs.sparkSession
    name = F.struct(F.col(source).isNull().alias("missing"), F.coalesce(F.col(source), F.lit("")).alias("name"))
    folder = work_folder(spark, "mixture-sizes")
    docs.select(
        *kept,
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        name.alias("__source"),
        F.monotonically_increasing_id().alias("__place"),
        F.xxhash64(*named, F.xxhash64(F.col(text))).alias("__key"),
    ).write.parquet(folder)
    sized = spark.read.parquet(folder)
    by_source = sized.groupBy("__source").agg(F.sum("size").alias("source_size"))
    folder = work_folder(spark, "mixture-sources")
    aimed = targets(by_source, share, weights, most)
    # Sources of like sizes share equal blocks; a small source has blocks of about a 64th of its words.
    least = F.floor(F.pow(F.lit(2.0), F.floor(F.log2(F.greatest("source_size", F.lit(1))))) / BLOCKS_OF_SOURCE)
    aimed = aimed.withColumn("__block_words", F.least(F.lit(block), F.greatest(F.lit(1), least)).cast("long"))
    wanted = F.round(F.sum("target").over(Window.partitionBy("__block_words")) / F.col("__block_words"))
    apportion(aimed.withColumn("seats", wanted), F.col("target"), F.col("seats"), ("__source",), ("__block_words",)).drop(
        "seats"
    ).withColumnRenamed("quota", "__blocks").write.parquet(folder)
    sources = spark.read.parquet(folder)

    placed = _placed(sized, sources, seed)
    bundle = F.floor(F.col("__shard") / BUNDLE).alias("__bundle")
    shards = placed.groupBy("__source", "__shard", bundle, "__blocks", "__block_words").agg(F.sum("size").alias("__words"))
    # A source's blocks go to bundles of shards first, so no window holds all shards of a hot source.
    bundles = shards.groupBy("__source", "__bundle", "__blocks").agg(F.sum("__words").alias("__words"))
    bundles = apportion(bundles, F.col("__words"), F.col("__blocks"), ("__source", "__bundle"), ("__source",))
    shards = shards.drop("__blocks").join(bundles.select("__source", "__bundle", F.col("quota").alias("__blocks")), ["__source", "__bundle"])
    shards = apportion(shards, F.col("__words"), F.col("__blocks"), ("__source", "__shard"), ("__source", "__bundle"))
    n = F.greatest(F.lit(1), F.round(F.col("__words") / F.col("__block_words")).cast("long"))
    shards = shards.withColumn("__n", n).withColumn("quota", F.least("quota", F.lit(int(most)) * F.col("__n")))
    shards = shards.select("__source", "__shard", "__words", F.col("quota").alias("__quota"), "__n")

    # Documents meet the blocks they overlap; a block's place in the seeded order says how often it is taken.
    blocks = shards.where("__words > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("__block"))
    order = Window.partitionBy("__source", "__shard").orderBy(F.xxhash64(F.lit(seed + 2), "__shard", "__block"), "__block")
    times = F.floor(F.col("__quota") / F.col("__n")) + (F.row_number().over(order) <= F.col("__quota") % F.col("__n")).cast("long")
    blocks = blocks.withColumn("__times", times).select("__source", "__shard", "__block", "__times")
    cut = placed.where("size > 0").join(shards, ["__source", "__shard"])
    first = F.floor(F.col("__start") * F.col("__n") / F.col("__words")).cast("long")
    last = F.floor((F.col("__start") + F.col("size") - 1) * F.col("__n") / F.col("__words")).cast("long")
    near = F.explode(F.sequence(F.greatest(F.lit(0), first - 1), F.least(F.col("__n") - 1, last + 1)))
    begin = F.floor(F.col("__block") * F.col("__words") / F.col("__n")).cast("long")
    end = F.floor((F.col("__block") + 1) * F.col("__words") / F.col("__n")).cast("long")
    overlap = F.greatest(F.lit(0), F.least(end, F.col("__start") + F.col("size")) - F.greatest(begin, F.col("__start")))
    parts = cut.select("__source", "__shard", "__place", "size", "__start", "__words", "__n", near.alias("__block"))
    parts = parts.withColumn("__overlap", overlap).where("__overlap > 0")
    taken = (
        parts.join(blocks, ["__source", "__shard", "__block"])
        .groupBy("__place")
        .agg(F.sum(F.col("__overlap") * F.col("__times")).cast("long").alias("taken"))
    )
    out = placed.join(taken, "__place", "left")
    names = ("__place", "__key", "__source", "size", "source_size", "target")
    return out.select(*kept, *names, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def whole_times(mixed: DataFrame, seed: int = 17) -> DataFrame:
    """(__place, __times): how often each document stands in the mix, as a whole number: taken/size or next to it.

    The parts of documents that blocks cut are laid end to end in the order of size, and a document that holds a
    whole number, shifted by a seeded start, stands once more.  So of the documents above any size as many are
    added as their parts sum up to, give or take one, and a source's words miss those taken by no more than its
    longest document.  Sums go by runs of like sizes, so a hot source is spread over many tasks; in runs that
    hold a slice of a large class the order is by size within the run only.
    """
    spark = mixed.sparkSession
    times = F.floor(F.col("taken") / F.col("size")).cast("long")
    part = F.round((F.col("taken") - F.col("__times") * F.col("size")) * F.lit(float(1 << WHOLE_BITS)) / F.col("size")).cast("long")
    docs = mixed.where("taken > 0").withColumn("__times", times).withColumn("__part", part)
    docs = docs.withColumn("__class", F.floor(4 * F.log2("size")).cast("int"))
    classes = docs.groupBy("__source", "__class").agg(F.ceil(F.count(F.lit(1)) / RUN).alias("__runs"))
    folder = work_folder(spark, "mixture-classes")
    classes.write.parquet(folder)
    classes = spark.read.parquet(folder)
    few = F.broadcast(classes) if classes.count() <= BROADCAST_SOURCES else classes
    docs = docs.join(few, ["__source", "__class"]).withColumn("__run", F.pmod(F.xxhash64(F.lit(seed + 3), "__key"), "__runs"))
    run = ["__source", "__class", "__run"]
    sums = docs.groupBy(*run).agg(F.sum("__part").alias("__sum"))
    before = Window.partitionBy("__source").orderBy("__class", "__run").rowsBetween(Window.unboundedPreceding, 0)
    begin = F.pmod(F.xxhash64(F.lit(seed + 4), "__source"), F.lit(1 << WHOLE_BITS)) + F.sum("__sum").over(before) - F.col("__sum")
    order = Window.partitionBy(*run).orderBy("size", F.xxhash64("__key", F.lit(seed + 5)), "__key", "__place")
    at = F.sum("__part").over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = docs.withColumn("__at", at).join(sums.select(*run, begin.alias("__begin")), run)
    whole = F.shiftright(F.col("__begin") + F.col("__at"), WHOLE_BITS) - F.shiftright(F.col("__begin") + F.col("__at") - F.col("__part"), WHOLE_BITS)
    return placed.select("__place", (F.col("__times") + whole).cast("int").alias("__times"))


def repeat_documents(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    share: float = 1.5,
    weights: tuple[int, ...] = WEIGHTS,
    most: float = 2.0,
    seed: int = 17,
    block: int = BLOCK,
) -> DataFrame:
    """The documents with all their columns, each as often as the mix takes it in whole (0, 1 or 2 times).

    ``docs`` must be a stored table: its rows are read twice and joined by their place; what is chosen follows from
    ``key``, source and text alone.
    """
    spark = docs.sparkSession
    named = docs.withColumn("__row", F.monotonically_increasing_id())
    narrow = named.select("__row", F.col(key).alias("__id"), F.col(text).alias("text"), F.col(source).alias("source"))
    folder = work_folder(spark, "mixture-taken")
    mixed = _mixed(narrow, ["__row"], ["__id", "source"], "text", "source", share, weights, most, seed, block)
    # The table's own rows are the places from here on.
    mixed.drop("__place").withColumnRenamed("__row", "__place").write.parquet(folder)
    often = whole_times(spark.read.parquet(folder), seed).where("__times > 0").withColumnRenamed("__place", "__row")
    repeated = named.join(often, "__row").withColumn("__time", F.explode(F.sequence(F.lit(1), "__times")))
    return repeated.select(*docs.columns)
