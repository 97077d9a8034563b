"""Running totals over a whole table without one task that sees it all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linewarden.session import work_folder


def running_total(df: DataFrame, value: str, total: str, *order: str) -> DataFrame:
    """Add ``total``, the sum of ``value`` over the rows before, in the given order or in that of the stored rows.

    Rows are sorted by ranges and written; then each partition sums up its own rows, and the sums of the
    partitions, a row each, are summed up over them.
    """
    spark = df.sparkSession
    folder = work_folder(spark, "totals")
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    placed = placed.withColumn("__at", F.monotonically_increasing_id())
    placed.write.parquet(folder)
    stored = spark.read.schema(placed.schema).parquet(folder).withColumn("__part", F.shiftright("__at", 33))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = stored.groupBy("__part").agg(F.sum(value).alias("__sum"))
    earlier = F.sum("__sum").over(before.orderBy("__part"))
    parts = parts.select("__part", F.coalesce(earlier, F.lit(0)).alias("__earlier"))
    inside = F.coalesce(F.sum(value).over(before.partitionBy("__part").orderBy("__at")), F.lit(0))
    summed = stored.withColumn("__inside", inside).join(F.broadcast(parts), "__part")  # a row for each partition
    return summed.withColumn(total, F.col("__earlier") + F.col("__inside")).drop("__at", "__part", "__earlier", "__inside")
