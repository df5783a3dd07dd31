"""First-of-key selection with total orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str | Column], order: list[str | Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in a total order."""
    ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("__rn") <= n).drop("__rn")


def first_struct(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """As first_by with n = 1 and ascending order, by a partial minimum instead of a window: no key is ever sorted in one task."""
    rest = [c for c in df.columns if c not in keys]
    lead = [c for c in order if c in rest]
    packed = F.struct(*lead, *[c for c in rest if c not in lead])
    return df.groupBy(*keys).agg(F.min(packed).alias("__first")).select(*keys, *[F.col(f"__first.{c}").alias(c) for c in rest])
