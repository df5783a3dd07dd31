"""Hashes of row sets of any size: a tree of sorted hashes, built by grouped aggregation.

Equal lines are counted first, so that repeats travel once. A line's own hash places it in a leaf by its first LEAF hex
digits, and the leaf in a branch by its first BRANCH ones. A leaf's hash is over its lines' hashes in order, a branch's
over its leaves, the root's over its branches. The shape depends on the lines alone, so a set has one fingerprint wherever
and however it is partitioned; no task holds more than a leaf, a 16,777,216th of a set, or 4,096 hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAF, BRANCH = 6, 3


def fingerprints(rows: DataFrame, keys: list[str], line: Column, name: str = "fingerprint") -> DataFrame:
    """keys and one hash over all lines of each, whatever their order; a line that occurs n times counts n times, null as none."""
    counted = rows.select(*keys, line.alias("__line")).where("__line is not null").groupBy(*keys, "__line").agg(F.count("*").alias("__n"))
    hashed = counted.select(*keys, F.sha2(F.concat_ws("|", "__line", "__n"), 256).alias("__h"))
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ","), 256)
    leaves = hashed.groupBy(*keys, F.substring("__h", 1, LEAF).alias("__leaf")).agg(joined("__h").alias("__h"))
    placed = leaves.select(*keys, F.substring("__leaf", 1, BRANCH).alias("__branch"), F.concat_ws(":", "__leaf", "__h").alias("__h"))
    branches = placed.groupBy(*keys, "__branch").agg(joined("__h").alias("__h"))
    return branches.groupBy(*keys).agg(joined(F.concat_ws(":", "__branch", "__h")).alias(name))


def fingerprint_sql(rows: str, keys: str, line: str, name: str = "fingerprint") -> str:
    """The same tree in SQL over a table expression."""
    return f"""(WITH f1 AS (SELECT {keys}, sha256({line} || '|' || count(*)) AS h FROM {rows} WHERE {line} IS NOT NULL GROUP BY {keys}, {line}),
f2 AS (SELECT {keys}, substr(h, 1, {LEAF}) AS leaf, sha256(string_agg(h, ',' ORDER BY h)) AS h FROM f1 GROUP BY {keys}, leaf),
f3 AS (SELECT {keys}, substr(leaf, 1, {BRANCH}) AS branch, sha256(string_agg(leaf || ':' || h, ',' ORDER BY leaf)) AS h FROM f2 GROUP BY {keys}, branch)
SELECT {keys}, sha256(string_agg(branch || ':' || h, ',' ORDER BY branch)) AS {name} FROM f3 GROUP BY {keys})"""
