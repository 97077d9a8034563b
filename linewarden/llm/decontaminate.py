"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Test items are partitioned by their number of shingles.  An item's signature is the set of its smallest
shingle hashes, as many as the largest item of its partition may miss, plus one: a document that contains the
asked share of an item contains at least one of them, so the search loses nothing.  Documents are searched
whole: their shingles pass a bitmap of fixed size and meet signatures in an equi-join; each candidate pair is
then verified by the exact share of the item's distinct shingles in the document.

Defined results: documents and items that are NULL or blank match nothing.  Items with fewer than five words
are one shingle, looked for as a run of words anywhere.  Equal items and repeated documents each give their own
pairs; rows that repeat in id and text give one.  Empty tables give no pairs.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewarden.llm.words import SHINGLE, byte_chunks, freeing, gram_hashes, word_hashes
from linewarden.session import work_folder

#: Bits of the bitmap that shingles pass before the join: 2 MB, whatever the number of items.
BITMAP_BITS = 1 << 24
PERCENT = 75
#: Bytes of texts that are hashed at a time.
CHUNK = 1 << 20
GRAMS = "row long, hash long, words int"


def _grams(lengths: tuple[int, ...], bitmap: bytes | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(row key, shingle, words in it) of every text; with a bitmap, of every run of one of the lengths that it has."""
    schema = pa.schema([("row", pa.int64()), ("hash", pa.int64()), ("words", pa.int32())])
    bits = None if bitmap is None else np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little")

    @freeing
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column(0))
            for part in byte_chunks(batch.column(1), CHUNK):
                words, first = word_hashes(part)
                counts = np.diff(first)
                for n in lengths:
                    grams = gram_hashes(words, n)
                    if not len(grams):
                        continue
                    # The row of the word that a run begins with; runs that leave the row are dropped.
                    if bits is None:
                        begin = np.arange(len(grams))
                    else:
                        begin = np.flatnonzero(bits[(grams & np.uint64(BITMAP_BITS - 1)).astype(np.int64)])
                    row = np.searchsorted(first, begin, "right") - 1
                    good = begin + n <= first[row + 1]
                    if bits is None and n < SHINGLE:
                        good &= counts[row] == n
                    begin, row = begin[good], row[good]
                    if len(begin):
                        found = np.unique(np.stack([row.astype(np.uint64), grams[begin]], 1), axis=0)
                        row, hashes = found[:, 0].astype(np.int64), found[:, 1].view(np.int64)
                        columns = [keys[part.first + row], hashes, np.full(len(row), n, np.int32)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    return made


def index_items(items: DataFrame, text: str = "text", item_id: str = "item_id", percent: int = PERCENT) -> DataFrame:
    """Stored shingles of the items: row, item_id, hash, words, n_shingles, and whether it is in the signature."""
    spark = items.sparkSession
    folder = work_folder(spark, "items")
    keyed = items.select(
        F.xxhash64(item_id, text).alias("row"), F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("text")
    ).dropDuplicates(["row"])
    grams = keyed.select("row", "text").mapInArrow(_grams(tuple(range(1, SHINGLE + 1)), None), GRAMS)
    sizes = grams.groupBy("row").agg(F.count(F.lit(1)).alias("n_shingles"))
    # Partitions double in size; the largest item of a partition sets how many hashes a signature has.
    part = F.floor(F.log2("n_shingles")).cast("int")
    sizes = sizes.withColumn("part", part)
    upper = sizes.groupBy("part").agg(F.max("n_shingles").alias("upper"))
    kept = F.floor(F.col("upper") * (100 - percent) / 100) + 1
    ranked = grams.join(sizes.join(upper, "part").withColumn("kept", kept.cast("int")), "row")
    smallest = ranked.groupBy("row", "kept").agg(F.array_sort(F.collect_list("hash")).alias("all"))
    smallest = smallest.select("row", F.explode(F.slice("all", F.lit(1), F.col("kept"))).alias("hash"), F.lit(True).alias("signed"))
    out = ranked.select("row", "hash", "words", "n_shingles").join(smallest, ["row", "hash"], "left")
    out.join(keyed.select("row", "item_id"), "row").fillna(False, ["signed"]).write.parquet(folder)
    return spark.read.parquet(folder)


def find_items(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    item_text: str = "text",
    item_id: str = "item_id",
    percent: int = PERCENT,
) -> DataFrame:
    """Pairs (doc_id, doc_key, item_id, n_shingles, n_common) with ``percent`` of an item's shingles in a document.

    ``doc_key`` is a hash of id and text, for documents whose ids repeat.
    """
    spark = docs.sparkSession
    index = index_items(items, item_text, item_id, percent)
    lengths = tuple(sorted(r.words for r in index.select("words").distinct().collect()))
    # The bitmap has a fixed size, so what is collected and sent to tasks is bounded.
    slots = [r[0] for r in index.select(F.col("hash").bitwiseAND(BITMAP_BITS - 1)).distinct().collect()]
    bits = np.zeros(BITMAP_BITS, np.uint8)
    bits[slots] = 1
    keyed = docs.select(
        F.xxhash64(doc_id, text).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")
    )
    folder = work_folder(spark, "item-hits")
    bitmap = np.packbits(bits, bitorder="little").tobytes()
    keyed.select("row", "text").mapInArrow(_grams(lengths, bitmap), GRAMS).distinct().write.parquet(folder)
    hits = spark.read.parquet(folder).withColumnRenamed("row", "doc_key")
    signatures = index.where("signed").select(F.col("row").alias("item"), "hash", "words")
    candidates = hits.join(signatures, ["hash", "words"]).select("doc_key", "item").distinct()
    shingles = index.select(F.col("row").alias("item"), "item_id", "hash", "words", "n_shingles")
    common = (
        hits.join(shingles, ["hash", "words"])
        .join(candidates, ["doc_key", "item"], "left_semi")
        .groupBy("doc_key", "item", "item_id", "n_shingles")
        .agg(F.count(F.lit(1)).alias("n_common"))
        .where(100 * F.col("n_common") >= percent * F.col("n_shingles"))
    )
    names = keyed.select(F.col("row").alias("doc_key"), "doc_id").distinct()
    return common.join(names, "doc_key").select("doc_id", "doc_key", "item_id", "n_shingles", "n_common")


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", **names: str) -> DataFrame:
    """The documents that contain no item."""
    found = find_items(docs, items, text, doc_id, **names).select(F.col("doc_key").alias("__key")).distinct()
    keyed = docs.withColumn("__key", F.xxhash64(doc_id, text))
    return keyed.join(found, "__key", "left_anti").drop("__key")
