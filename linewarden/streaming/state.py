"""Findings of a changing corpus: only what has changed is scanned, and what it replaces is taken back.

The state is a folder with two tables in versions.  ``files`` has, in every version, all files with a mark of
their content and the version that scanned them last; ``findings`` has in a version the findings of the files
scanned then.  A finding stands as long as its file's row names its version: so a changed file replaces its
findings and a deleted one takes them along, without any rewriting of findings.  A version counts when its ``files``
table is whole, which is written last; a run that is lost before leaves nothing that counts, and the next one
writes the version anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewarden.plans.audit import static_audit
from linewarden.session import work_folder
from linewarden.sources.catalogue import Catalogue
from linewarden.sources.ranges import RANGE_BYTES, list_files, read_pieces

FILES = "path string, mark string, digest string, version int"


def latest_version(spark: SparkSession, state: str) -> int:
    """The last version whose files are written; 0 for a state without any."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = jvm.Path(f"{state}/files")
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return 0
    names = [s.getPath().getName() for s in store.listStatus(folder)]  # a folder for each version
    done = [int(n) for n in names if n.isdigit() and store.exists(jvm.Path(f"{state}/files/{n}/_SUCCESS"))]
    return max(done, default=0)


def known_files(spark: SparkSession, state: str, version: int | None = None) -> DataFrame:
    """``path, mark, digest, version`` of a version, else of the latest."""
    version = latest_version(spark, state) if version is None else version
    return spark.read.schema(FILES).parquet(f"{state}/files/{version}") if version else spark.createDataFrame([], FILES)


def current_findings(spark: SparkSession, state: str, version: int | None = None) -> DataFrame:
    """The findings that stand in a version, else in the latest."""
    version = latest_version(spark, state) if version is None else version
    if not version:
        raise ValueError(f"no findings at {state}: refresh it first")
    written = spark.read.parquet(*[f"{state}/findings/{n}" for n in range(1, version + 1)])
    return written.join(known_files(spark, state, version).select("path", "version"), ["path", "version"], "left_semi").drop("version")


def changes(spark: SparkSession, state: str, version: int | None = None) -> DataFrame:
    """The findings that a version, else the latest, has ``added`` and ``retracted``, in column ``change``."""
    version = latest_version(spark, state) if version is None else version
    added = spark.read.parquet(f"{state}/findings/{version}").drop("version").withColumn("change", F.lit("added"))
    if version == 1:
        return added
    stays = known_files(spark, state, version).where(F.col("version") < version).select("path")
    gone = current_findings(spark, state, version - 1).join(stays, "path", "left_anti")
    return added.unionByName(gone.withColumn("change", F.lit("retracted")))


def _advance(
    spark: SparkSession,
    state: str,
    seen: DataFrame,
    digests: Callable[[DataFrame], DataFrame],
    scan: Callable[[DataFrame], DataFrame],
) -> int:
    """Write the next version for files ``path, mark``.

    ``digests`` gives path and digest of the content of chosen paths, and ``scan`` their findings.
    """
    version = latest_version(spark, state) + 1
    known = known_files(spark, state).select("path", F.col("mark").alias("old_mark"), F.col("digest").alias("old"), F.col("version").alias("was"))
    folder = work_folder(spark, "seen")
    seen.join(known, "path", "left").write.parquet(f"{folder}/marked")
    marked = spark.read.parquet(f"{folder}/marked")
    # A file whose mark has changed is read; it is scanned if its content has changed too.
    touched = marked.where(~F.col("mark").eqNullSafe(F.col("old_mark")))
    digests(touched.select("path")).write.parquet(f"{folder}/digests")
    read = spark.read.schema("path string, digest string").parquet(f"{folder}/digests")
    same = marked.where(F.col("mark").eqNullSafe(F.col("old_mark"))).select("path", "mark", F.col("old").alias("digest"), "was")
    changed = touched.join(read, "path").select("path", "mark", "digest", F.when(F.col("digest").eqNullSafe(F.col("old")), F.col("was")).alias("was"))
    files = same.unionByName(changed).select("path", "mark", "digest", F.coalesce("was", F.lit(version)).alias("version"))
    files.write.parquet(f"{folder}/files")
    files = spark.read.schema(FILES).parquet(f"{folder}/files")
    found = scan(files.where(F.col("version") == version).select("path")).withColumn("version", F.lit(version))
    found.write.mode("overwrite").parquet(f"{state}/findings/{version}")
    files.write.mode("overwrite").parquet(f"{state}/files/{version}")
    return version


def _digest(pieces: DataFrame) -> DataFrame:
    """``path, digest``: the pieces' hashes, each with its place, added up."""
    first = F.col("first_line") if "first_line" in pieces.columns else F.lit(1)
    two = [F.sum(F.xxhash64(F.lit(k), first, "content").cast("decimal(38,0)")).cast("string") for k in (1, 2)]
    return pieces.groupBy("path").agg(F.concat_ws(":", *two).alias("digest"))


def refresh_sources(sources: DataFrame, state: str, catalogue: Catalogue | None = None, override: str | None = None) -> int:
    """Bring the state to a table ``path, content``, which is all there is now; gives the new version."""
    spark = sources.sparkSession

    def chosen(paths: DataFrame) -> DataFrame:
        return sources.join(paths, "path", "left_semi")

    seen = _digest(sources).withColumnRenamed("digest", "mark")
    return _advance(
        spark,
        state,
        seen,
        lambda paths: seen.join(paths, "path", "left_semi").select("path", F.col("mark").alias("digest")),
        lambda paths: static_audit(chosen(paths), catalogue, override),
    )


def refresh_files(
    spark: SparkSession,
    state: str,
    *paths: str,
    catalogue: Catalogue | None = None,
    override: str | None = None,
    range_bytes: int = RANGE_BYTES,
) -> int:
    """Bring the state to the files on disk: those whose length or time has changed are read; gives the new version.

    Files of every size, hidden and empty ones included; one that is no longer UTF-8 loses its findings.
    """
    files = list_files(spark, *paths, override=override)
    seen = files.select("path", F.concat_ws(":", "length", "modified").alias("mark"))

    def pieces(chosen: DataFrame) -> DataFrame:
        return read_pieces(files.join(chosen, "path", "left_semi"), range_bytes)

    return _advance(
        spark, state, seen, lambda chosen: _digest(pieces(chosen)), lambda chosen: static_audit(pieces(chosen), catalogue, override)
    )
