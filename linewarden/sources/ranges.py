"""Files of every size as pieces of text: a listing, byte ranges dealt evenly to tasks, and a reader of ranges.

A piece is ``path, first_line, whole, content``: the lines that start in one byte range of a file, with the number of
the first of them, and whether they are the whole file.  The range that holds the start of a line reads on to its end, so no line is cut and no
character is split.  Most files are one range and one piece; they are checked and read in one go.  The ranges of
a longer file are counted first, as later ones need the number of lines before them, and then read.

Listing goes in rounds: tasks list what is below the folders of a round, up to a number of entries, and write it; the
folders that are left make up the next round.  Symbolic links are not followed, so there are no cycles; hidden and empty files are listed like all
others.  Nothing is gathered on the driver.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linewarden.functions.text import detect_language, override_language
from linewarden.operators.totals import running_total
from linewarden.session import work_folder

#: Bytes of a range; a piece is as long, and its last line may reach beyond.
RANGE_BYTES = 8 << 20
#: Entries that a task lists below one folder before it hands on the folders that are left.
LISTED = 1_000
#: Bytes of a task; less where the whole input has fewer for each core.
TASK_BYTES = 128 << 20
#: Bytes that the start of another file counts in the packing of tasks.
OPEN_BYTES = 64 << 10
#: Bytes that are read at a time to find the end of a line.
STEP = 1 << 16
PIECES = "path string, first_line bigint, whole boolean, content string"
RANGES = ("path", "start", "stop", "length")


def open_store(path: str):
    """The file system of a path and the path in it."""
    from pyarrow import fs

    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    local = path[len("file:") :] if path.startswith("file:") else path
    return fs.LocalFileSystem(), os.path.abspath("/" + local.lstrip("/") if local.startswith("/") else local)


def _scheme(path: str) -> str:
    return path.split("://")[0] + "://" if "://" in path and not path.startswith("file:") else "file:"


# --- listing ----------------------------------------------------------------------------------


_LISTING = "path string, length bigint, modified bigint, folder boolean"


def _entries(path: str) -> Iterator[tuple[str, int, int, bool]]:
    """(path, length, time of change in microseconds, is a folder) of what a folder holds; links are left out."""
    from pyarrow import fs

    system, place = open_store(path)
    scheme = _scheme(path)
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(place) as found:
            for e in found:
                if e.is_dir(follow_symlinks=False):
                    yield scheme + e.path, 0, 0, True
                elif e.is_file(follow_symlinks=False):
                    info = e.stat(follow_symlinks=False)
                    yield scheme + e.path, info.st_size, info.st_mtime_ns // 1000, False
        return
    for e in system.get_file_info(fs.FileSelector(place, allow_not_found=True)):
        if e.type in (fs.FileType.File, fs.FileType.Directory):
            yield scheme + e.path, e.size or 0, (e.mtime_ns or 0) // 1000, e.type == fs.FileType.Directory


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries below each folder; after ``LISTED`` of them the folders that are left go to the next round."""
    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("modified", pa.int64()), ("folder", pa.bool_())])
    for batch in batches:
        for top in batch.column(0).to_pylist():
            waiting, n = [top], 0
            while waiting and n < LISTED:
                try:
                    rows = list(_entries(waiting.pop()))
                except PermissionError:
                    continue  # like an entry that cannot be read
                n += len(rows)
                waiting += [r[0] for r in rows if r[3]]
                files = [r for r in rows if not r[3]]
                if files:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*files, strict=True)], schema=schema)
            if waiting:
                rows = [(path, 0, 0, True) for path in waiting]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], schema=schema)


def _top(path: str) -> tuple[str, int, int, bool]:
    from pyarrow import fs

    system, place = open_store(path)
    info = system.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return _scheme(path) + place, info.size or 0, (info.mtime_ns or 0) // 1000, info.type == fs.FileType.Directory


def expand(spark: SparkSession, path: str) -> list[str]:
    """The paths that a glob pattern names, hidden ones included; other paths as they are."""
    if not any(c in path for c in "*?{["):
        return [path]
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().toString() for s in store.globStatus(pattern) or ()]


def list_files(spark: SparkSession, *paths: str, override: str | None = None) -> DataFrame:
    """``path, length, modified`` of the files below folders, and of single files; without an override of known extensions only."""
    if override is not None:
        override_language(override)
    tops = [_top(p) for path in paths for p in expand(spark, path)]
    folder, levels = work_folder(spark, "listing"), []
    spark.createDataFrame(tops, _LISTING).write.parquet(f"{folder}/0")
    while True:
        levels.append(f"{folder}/{len(levels)}")
        found = spark.read.parquet(levels[-1]).where("folder").select("path")
        n = found.count()
        if not n:
            break
        tasks = min(n, 4 * spark.sparkContext.defaultParallelism)
        found.repartition(tasks).mapInArrow(_listed, _LISTING).write.parquet(f"{folder}/{len(levels)}")
    files = spark.read.parquet(*levels).where("NOT folder").select("path", "length", "modified")
    if len(tops) > 1:
        files = files.dropDuplicates(["path"])
    return files if override is not None else files.where(detect_language(F.col("path")).isNotNull())


# --- ranges -----------------------------------------------------------------------------------


def ranges_of(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``path, start, stop, length``: every file cut into ranges; an empty file is one empty range."""
    steps = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("bigint"))
    cut = files.select("path", F.explode(steps).alias("start"), "length")
    return cut.select("path", "start", F.least(F.col("start") + range_bytes, F.col("length")).alias("stop"), "length")


def with_tasks(ranges: DataFrame, task_bytes: int = TASK_BYTES) -> tuple[DataFrame, int]:
    """Ranges with ``task``, so that consecutive ranges fill tasks of equal bytes; and the number of tasks.

    The bytes before a range are prefix sums over the listing alone, before any content is read.
    """
    spark = ranges.sparkSession
    cost = F.col("stop") - F.col("start") + F.when(F.col("start") == 0, OPEN_BYTES).otherwise(0)
    running = running_total(ranges.withColumn("cost", cost), "cost", "before")
    total = running.agg(F.coalesce(F.sum("cost"), F.lit(0))).first()[0]
    task_bytes = max(1, min(task_bytes, -(-total // spark.sparkContext.defaultParallelism)))
    task = F.floor(F.col("before") / task_bytes).cast("int")
    return running.withColumn("task", task).drop("cost", "before"), max(1, -(-total // task_bytes))


def dealt(ranges: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Ranges, each in the partition of its task."""
    placed, n = with_tasks(ranges, task_bytes)
    return placed.repartitionById(n, F.col("task")).drop("task")


# --- reading ----------------------------------------------------------------------------------


class _Lines:
    """One open file; finds the places where pieces may begin."""

    def __init__(self, path: str, length: int, mark: bytes):
        system, place = open_store(path)
        self.path, self.length, self.mark = path, length, mark
        self.file = system.open_input_file(place)

    def read(self, start: int, stop: int) -> bytes:
        self.file.seek(start)
        return self.file.read(max(0, stop - start))

    def _line_start(self, at: int) -> int:
        """Where the line of a byte begins."""
        stop = at
        while stop > 0:
            begin = max(0, stop - STEP)
            found = self.read(begin, stop).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            stop = begin
        return 0

    def border(self, at: int) -> int:
        """The first line start from ``at`` on behind a line that holds the mark; the file's end if there is none."""
        if at <= 0 or at >= self.length:
            return min(max(at, 0), self.length)
        pos, seen = (self._line_start(at - 1), False) if self.mark else (at - 1, True)
        while pos < self.length:
            data = self.read(pos, min(self.length, pos + STEP))
            if not data:
                raise OSError(f"{self.path} has become shorter")
            i = 0
            while True:
                if not seen:
                    i = data.find(self.mark, i)
                    if i < 0:
                        break
                    seen = True
                end = data.find(b"\n", i)
                if end < 0:
                    break
                if pos + end + 1 >= at:
                    return pos + end + 1
                i, seen = end + 1, not self.mark
            pos += len(data)
        return self.length

    def piece(self, start: int, stop: int) -> bytes:
        return self.read(self.border(start), self.border(stop))


def _is_text(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


def _contents(batches: Iterator[pa.RecordBatch], mark: bytes) -> Iterator[tuple[dict, bytes]]:
    held = None
    for batch in batches:
        for row in batch.to_pylist():
            if held is None or held.path != row["path"]:
                held = _Lines(row["path"], row["length"], mark)
            yield row, held.piece(row["start"], row["stop"])


def _count(batches: Iterator[pa.RecordBatch], mark: bytes) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("lines", pa.int64()), ("valid", pa.bool_())])
    for row, data in _contents(batches, mark):
        lines = data.count(b"\n") + (len(data) > 0 and not data.endswith(b"\n"))
        yield pa.RecordBatch.from_pylist([{"path": row["path"], "start": row["start"], "lines": lines, "valid": _is_text(data)}], schema)


def _pieces(batches: Iterator[pa.RecordBatch], mark: bytes) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), ("first_line", pa.int64()), ("whole", pa.bool_()), ("content", pa.string())])
    rows, size = [], 0

    def batch() -> pa.RecordBatch:
        path, first, whole, data = zip(*rows, strict=True)
        columns = [pa.array(path), pa.array(first, pa.int64()), pa.array(whole), pa.array(data, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for row, data in _contents(batches, mark):
        whole = row["start"] == 0 and row["stop"] == row["length"]
        # A range without a line start gives no piece; an empty file gives an empty one.
        if _is_text(data) if whole else data:
            rows.append((row["path"], row["first_line"], whole, data))
            size += len(data)
        if size >= STEP or len(rows) >= 1000:
            if rows:
                yield batch()
            rows, size = [], 0
    if rows:
        yield batch()


def long_ranges(files: DataFrame, range_bytes: int, mark: str = "", task_bytes: int = TASK_BYTES) -> DataFrame:
    """Ranges of the files longer than one, with ``lines``, ``earlier`` lines, and whether the file is ``valid`` UTF-8."""
    spark = files.sparkSession
    long = dealt(ranges_of(files.where(F.col("length") > range_bytes), range_bytes), task_bytes)
    schema = "path string, start bigint, lines bigint, valid boolean"
    folder = work_folder(spark, "counted")
    long.mapInArrow(lambda batches: _count(batches, mark.encode()), schema).write.parquet(folder)
    file = Window.partitionBy("path")
    before = F.sum("lines").over(file.orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    counted = spark.read.schema(schema).parquet(folder).select(
        "path", "start", "lines", F.coalesce(before, F.lit(0)).alias("earlier"), F.min("valid").over(file).alias("valid")
    )
    return ranges_of(files.where(F.col("length") > range_bytes), range_bytes).join(counted, ["path", "start"])


def read_pieces(files: DataFrame, range_bytes: int = RANGE_BYTES, mark: str = "", task_bytes: int = TASK_BYTES) -> DataFrame:
    """Pieces of listed files that are UTF-8: ``path, first_line, whole, content``.

    With a mark pieces begin only behind a line that holds it.  A line, or with a mark a stretch between such lines,
    must fit into one value.
    """
    short = ranges_of(files.where(F.col("length") <= range_bytes), range_bytes).withColumn("first_line", F.lit(1).cast("bigint"))
    long = long_ranges(files, range_bytes, mark, task_bytes).where("valid AND lines > 0")
    every = short.unionByName(long.select(*RANGES, (F.col("earlier") + 1).alias("first_line")))
    return dealt(every, task_bytes).mapInArrow(lambda batches: _pieces(batches, mark.encode()), PIECES)


def is_single_file(paths: tuple[str, ...]) -> bool:
    return len(paths) == 1 and not any(c in paths[0] for c in "*?{[") and not _top(paths[0])[3]
