"""Connected components and block pairs, shared by the operators on pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import staged, unstage


def components(edges: DataFrame) -> DataFrame:
    """Staged (node, component) for every node of the edges (a, b): the smallest node that links reach.

    Alternating large-star and small-star steps over staged tables, until the edges form stars. Each step is a
    partial minimum by node and a join to it; neighbours of a node are never collected.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = staged(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        new = staged(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "small-star")
        unstage(now, large)
        now = new
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return staged(stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component")), "components")


def _stars(edges: DataFrame) -> bool:
    """Whether every u has one v and no v is a u, as when nothing is left to do."""
    many = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1")
    return not many.take(1) and not edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").take(1)


def block_pairs(rows: DataFrame, key: str, item: str, block: int) -> DataFrame:
    """Deal rows of each key to cells (i, j), i <= j, such that every two rows of a key meet in exactly one cell
    as (block i, block j), and no cell holds more than about two blocks of rows.

    Adds __cell (struct of i, j) and __side (own block). Keys of up to `block` rows stay one cell; larger ones
    are split by a hash of `item`, each row copied once for every block of its key.
    """
    sizes = rows.groupBy(key).agg(F.ceil(F.count("*") / block).cast("int").alias("__n")).where("__n > 1")
    joined = rows.join(sizes, key, "left").withColumn("__n", F.coalesce("__n", F.lit(1))).withColumn("__side", F.pmod(F.xxhash64(item), F.col("__n")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("__n") - 1), lambda o: F.struct(F.least(o, F.col("__side")).alias("i"), F.greatest(o, F.col("__side")).alias("j")))
    return joined.withColumn("__cell", F.explode(cells)).drop("__n")
