"""Running sums and carried values along an order, in blocks: no series is ever one task.

Rows are dealt to ranges of (series, order). A range's total (or its last value) is one row; those are chained along each
series, and what stands before a range is joined to its rows. Inside a range a window does the rest. A series of any
length is so spread over as many tasks as its rows need.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from cairn.session import Staging


def ranges(rows: DataFrame, series: list[str], order: list[str], staging: Staging) -> DataFrame:
    """rows with `__part`: the number of their range of (series, order), ascending. Staged, so that all uses agree."""
    return staging.put(rows.repartitionByRange(*series, *order).withColumn("__part", F.spark_partition_id()), "ranges")


def _before(parts: DataFrame, series: list[str], made: Column, carried: Callable[[WindowSpec], Column]) -> DataFrame:
    """For each series and range what the ranges before it give: one row a range and series."""
    totals = parts.groupBy(*series, "__part").agg(made.alias("__made"))
    w = Window.partitionBy(*series).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*[F.col(s).alias(f"__s{i}") for i, s in enumerate(series)], F.col("__part").alias("__p"), carried(w).alias("__before"))


def _joined(parts: DataFrame, before: DataFrame, series: list[str]) -> DataFrame:
    same = F.col("__part") == F.col("__p")
    for i, s in enumerate(series):
        same = same & F.col(s).eqNullSafe(F.col(f"__s{i}"))
    return parts.join(before, same, "left").drop("__p", *[f"__s{i}" for i in range(len(series))])


def running_sums(rows: DataFrame, series: list[str], order: list[str], values: dict[str, str]) -> DataFrame:
    """rows with the sum of each column up to and with each row in its series; values: column -> name of its sum. The order must be total."""
    parts = ranges(rows, series, order, Staging())
    made = F.struct(*[F.sum(c).alias(c) for c in values])
    before = _before(parts, series, made, lambda w: F.struct(*[F.coalesce(F.sum(f"__made.{c}").over(w), F.lit(0)).alias(c) for c in values]))
    own = Window.partitionBy(*series, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = _joined(parts, before, series)
    return out.withColumns({name: F.col(f"__before.{c}") + F.coalesce(F.sum(c).over(own), F.lit(0)) for c, name in values.items()}).drop("__part", "__before")


def carry_last(rows: DataFrame, series: list[str], order: list[str], column: str) -> DataFrame:
    """rows with the last value of column that is not null, at or before each row in its series. The order must be total."""
    parts = ranges(rows, series, order, Staging())
    last = F.max(F.when(F.col(column).isNotNull(), F.struct(*order, F.col(column).alias("__value"))))["__value"]
    before = _before(parts, series, last, lambda w: F.last("__made", ignorenulls=True).over(w))
    own = Window.partitionBy(*series, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = _joined(parts, before, series)
    return out.withColumn(column, F.coalesce(F.last(column, ignorenulls=True).over(own), F.col("__before"))).drop("__part", "__before")
