"""Parquet tables as inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The given columns of a table."""
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal the rows of a small input over all cores, where it would fill only a few tasks.

    Matters for one file of a single row group; an input that already has a task per core stays as it
    is, so large inputs are never shuffled by this.
    """
    wanted = partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df
