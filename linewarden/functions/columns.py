"""Helpers on plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns that are evaluated exactly once per row.

    The optimizer copies the expression of a projected column into every filter on that column.  Here
    the columns are the output of a generator over one element, and filters on them stay above it.
    """
    kept = [c for c in df.columns if c not in columns]
    if len(columns) == 1:
        [(name, value)] = columns.items()
        return df.select(*kept, F.explode_outer(F.array(value)).alias(name))
    value = F.struct(*[v.alias(k) for k, v in columns.items()])
    one = df.select(*kept, F.explode_outer(F.array(value)).alias("__settled"))
    return one.select(*kept, *[F.col(f"__settled.{k}").alias(k) for k in columns])
