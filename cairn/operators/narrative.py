"""Bounding a narrative to a token budget: whole sections give way in a fixed order, and the last one keeps its longest prefix that fits.

A series (one report) has items in dimensions; each item renders to `size` characters, and the rest of the report to
`base` ones. A dimension is emptied only if emptying those before it was not enough. The one that makes it fit is filled
again to the largest count of leading items that still does. What was dropped is told in one gap line, whose own length
counts: the check is on the text as it will be.

Sizes are added up in ranges (ordered.running_sums), so a report with very many items is many tasks. Items are taken by
`position`, which must be total within a dimension. Null sizes count nothing. A series without items keeps its base and
is not listed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.ordered import running_sums

#: Dimensions in the order in which they give way, what the gap line calls them, and how many items each keeps at least.
CLEARED = [("type_definitions", "type definition(s)", 0), ("symbols", "symbol(s)", 0), ("hotspots", "hotspot(s)", 1)]
# The gap line.
GAP_HEAD = "The narrative was bounded to fit the requested token budget: "
GAP_TAIL = " were omitted from this report. The analysis covered them; this rendering does not."


def gap_line(dropped: list[tuple[Column, Column, str]]) -> Column:
    """The gap line for (dropped, total, label) of each dimension; null if nothing was dropped."""
    parts = F.filter(F.array(*[F.when(d > 0, F.concat(d.cast("string"), F.lit(" of "), n.cast("string"), F.lit(f" {label}"))) for d, n, label in dropped]), lambda x: x.isNotNull())
    return F.when(F.size(parts) > 0, F.concat(F.lit(GAP_HEAD), F.array_join(parts, ", "), F.lit(GAP_TAIL)))


def _tokens(chars: Column) -> Column:
    return F.ceil(chars / 4).cast("long")


def bound_narrative(items: DataFrame, base: Column, budget: int, around_gap: int = 3) -> tuple[DataFrame, DataFrame]:
    """(report, kept) of items (series, dimension, position, size).

    report: series, tokens, truncated, gap and kept_<dimension> and total_<dimension> for each; kept: the items that stay.
    base: the report's other characters, a column of series. around_gap: characters that a rendered gap line takes beside
    its own (a list mark and a line break).
    """
    names = [d for d, _, _ in CLEARED]
    known = items.where(F.col("dimension").isin(names)).select("series", "dimension", "position", F.coalesce("size", F.lit(0)).cast("long").alias("size"))
    placed = running_sums(known.withColumn("one", F.lit(1).cast("long")), ["series", "dimension"], ["position"], {"size": "upto", "one": "nth"})
    of = lambda agg, d: F.coalesce(agg(F.when(F.col("dimension") == d, F.col("size"))), F.lit(0))
    totals = known.groupBy("series").agg(*[of(F.sum, d).alias(f"size_{d}") for d in names], *[of(F.count, d).alias(f"total_{d}") for d in names]).withColumn("base", base)

    def fits(kept: dict[str, Column], sizes: dict[str, Column]) -> Column:
        line = gap_line([(F.col(f"total_{d}") - kept[d], F.col(f"total_{d}"), label) for d, label, _ in CLEARED])
        chars = reduce(lambda a, b: a + b, sizes.values(), F.col("base")) + F.coalesce(F.length(line) + around_gap, F.lit(0))
        return _tokens(chars) <= budget

    count, size = {d: F.col(f"total_{d}") for d in names}, {d: F.col(f"size_{d}") for d in names}
    zero = F.lit(0).cast("long")
    emptied = [fits({d: zero if i <= n else count[d] for i, d in enumerate(names)}, {d: zero if i <= n else size[d] for i, d in enumerate(names)}) for n in range(len(names) - 1)]
    cut = F.when(fits(count, size), -1)
    for n, ok in enumerate(emptied):
        cut = cut.when(ok, n)
    totals = totals.withColumn("cut", cut.otherwise(len(names) - 1))
    # The largest count that fits, of the dimension that is cut: what fits is a prefix, since a longer one is a longer text.
    at = placed.join(totals, "series").where(F.col("cut") == reduce(lambda a, x: F.when(F.col("dimension") == x[1], x[0]).otherwise(a), enumerate(names), F.lit(-2)))
    holds = F.lit(False)
    for n, d in enumerate(names):
        kept = {x: zero if i < n else F.col("nth") if i == n else count[x] for i, x in enumerate(names)}
        sizes = {x: zero if i < n else F.col("upto") if i == n else size[x] for i, x in enumerate(names)}
        holds = F.when(F.col("cut") == n, fits(kept, sizes)).otherwise(holds)
    best = at.where(holds).groupBy("series").agg(F.max("nth").alias("largest"))
    done = totals.join(best, "series", "left")
    for n, (d, _, least) in enumerate(CLEARED):
        largest = F.least(count[d], F.greatest(F.coalesce("largest", zero), F.lit(least)))
        done = done.withColumn(f"kept_{d}", F.when(F.col("cut") > n, zero).when(F.col("cut") == n, largest).otherwise(count[d]))
    done = done.withColumn("gap", gap_line([(F.col(f"total_{d}") - F.col(f"kept_{d}"), F.col(f"total_{d}"), label) for d, label, _ in CLEARED]))
    limit = reduce(lambda a, d: F.when(F.col("dimension") == d, F.col(f"kept_{d}")).otherwise(a), names, zero)
    kept = placed.join(done.select("series", "base", *[f"kept_{d}" for d in names]), "series").where(F.col("nth") <= limit)
    sums = kept.groupBy("series").agg(F.sum("size").alias("kept_size"))
    report = done.join(sums, "series", "left").withColumn("tokens", _tokens(F.col("base") + F.coalesce("kept_size", zero) + F.coalesce(F.length("gap") + around_gap, zero)))
    report = report.select("series", "tokens", F.col("gap").isNotNull().alias("truncated"), "gap", *[f"kept_{d}" for d in names], *[f"total_{d}" for d in names])
    return report, kept.select("series", "dimension", "position", "nth", "size")
