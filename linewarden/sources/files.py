"""Source files as a DataFrame ``path, first_line, whole, content``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linewarden.functions.text import override_language
from linewarden.sources.ranges import RANGE_BYTES, is_single_file, list_files, open_store, read_pieces
from linewarden.sources.rules import EXTENSIONS

MAX_BROADCAST_BYTES = 8 << 20
_BLOCK_ROW_BYTES = 512

EXTENSION_GLOB = "*.{" + ",".join(EXTENSIONS) + "}"

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def only_spark_opens(path: str) -> bool:
    """Whether the path lies in a store that tasks cannot open by themselves."""
    from pyarrow import ArrowException

    try:
        open_store(path)
    except (ArrowException, OSError, ImportError):
        return True
    return False


def read_files(spark: SparkSession, *paths: str, override: str | None = None) -> DataFrame:
    """All files that Spark's own listing shows, as ``path, length, content`` (bytes)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if override is None:
        reader = reader.option("pathGlobFilter", EXTENSION_GLOB)
    else:
        override_language(override)
    return reader.load(list(paths)).select("path", "length", "content")


def decode_files(raw: DataFrame) -> DataFrame:
    """Raw files -> ``path, content``; files that are not UTF-8 are left out."""
    text = F.col("content").cast("string")
    return raw.where(F.is_valid_utf8(text)).select("path", text.alias("content"))


def sources_from_files(spark: SparkSession, *paths: str, override: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``path, first_line, whole, content`` of all readable source files; an error if a folder has no supported file.

    A file of up to ``range_bytes`` is one row, a longer one a row for each stretch of its lines, of which
    ``first_line`` is the number of the first.  A single file of an unknown extension gives an empty result.  In stores
    that only Spark opens a file is always one row, which Spark's limit of 2 GB a value bounds with an error;
    ``lines_from_files`` has no such bound.
    """
    if any(map(only_spark_opens, paths)):
        raw = read_files(spark, *paths, override=override)
        if raw.select("path").isEmpty():
            raise ValueError(f"no supported source files at {', '.join(paths)}")
        return decode_files(raw).select("path", F.lit(1).cast("bigint").alias("first_line"), F.lit(True).alias("whole"), "content")
    files = list_files(spark, *paths, override=override)
    if files.isEmpty() and not is_single_file(paths):
        raise ValueError(f"no supported source files at {', '.join(paths)}")
    return read_pieces(files, range_bytes)


def rejected_files(spark: SparkSession, *paths: str, override: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``path, length, reason`` of the listed files that an audit skips: those that are not UTF-8."""
    files = list_files(spark, *paths, override=override)
    read = read_pieces(files, range_bytes).select("path").distinct()
    return files.join(read, "path", "left_anti").select("path", "length", F.lit("not UTF-8").alias("reason"))


def lines_from_files(spark: SparkSession, *paths: str, override: str | None = None) -> DataFrame:
    """``path, line, code`` read as split text, for files of any size: no file is ever one value.

    For stores that only Spark opens; it does not list hidden names.  Spark cuts a long file into blocks that many tasks read.  A line's number is its place within the
    block plus the lines of the blocks before it; only the line counts per block are summed up.  The
    lines themselves move only if the table of blocks is too long to be sent to every task.  As
    elsewhere, files that are not UTF-8 are left out whole, and a CR goes only along with an LF.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n")
    if override is None:
        reader = reader.option("pathGlobFilter", EXTENSION_GLOB)
    else:
        override_language(override)
    text = reader.text(list(paths))
    rows = text.select(
        # the metadata column holds an encoded URI; elsewhere paths are plain
        F.regexp_replace(
            F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/"
        ).alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"),
        F.monotonically_increasing_id().alias("id"),
        "value",
    )
    blocks = rows.groupBy("path", "block").agg(
        F.count(F.lit(1)).alias("lines"),
        F.min("id").alias("first_id"),
        F.bool_and(F.is_valid_utf8("value")).alias("valid"),
        F.sum(F.octet_length("value") + 1).alias("bytes"),
        F.min("size").alias("size"),
    )
    file = Window.partitionBy("path")
    offsets = blocks.withColumn("earlier", F.sum("lines").over(file.orderBy("block")) - F.col("lines")).withColumn(
        "valid", F.min("valid").over(file)
    )
    # Lines and their LFs are one byte more than the file if the last line has no LF; a byte order mark of
    # three bytes is not part of the lines.
    surplus = F.sum("bytes").over(file) - F.col("size")
    offsets = offsets.withColumn("open_line", F.when(surplus.isin(1, -2), F.sum("lines").over(file)))
    places = offsets.where("valid").select("path", "block", "first_id", "earlier", "open_line")
    if (len(text.inputFiles()) + text.rdd.getNumPartitions()) * _BLOCK_ROW_BYTES <= MAX_BROADCAST_BYTES:
        places = F.broadcast(places)  # every block is a task of the scan or the rest of a file in one
    placed = rows.join(places, ["path", "block"])
    line = F.col("id") - F.col("first_id") + F.col("earlier") + 1
    code = F.when(line.eqNullSafe(F.col("open_line")), F.col("value")).otherwise(F.regexp_replace("value", r"\r\z", ""))
    return placed.select("path", line.alias("line"), code.alias("code"))
