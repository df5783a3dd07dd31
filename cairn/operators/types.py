"""Merging the fragments of partial types into one definition each.

A fragment is one declaration: identity, file, line, attributes of the whole (kind, name, ...), and arrays. Scalars come from
the first fragment by (file, line). Modifiers have a fixed order; attributes, interfaces and declarations are distinct
and sorted; of members of one identity the first fragment's counts. Every array is exploded, made distinct by partial
aggregation, and gathered once per type: what a task holds is a merged type, however many fragments repeat it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The order of modifiers; others follow by name.
MODIFIERS = ["file", "new", "static", "abstract", "virtual", "override", "sealed", "readonly", "ref", "const", "required", "async", "extern", "unsafe", "partial"]


def ordered_modifiers(modifiers: Column) -> Column:
    """Distinct modifiers in the fixed order."""
    place = lambda m: F.coalesce(F.nullif(F.array_position(F.lit(MODIFIERS), m), F.lit(0)), F.lit(1 << 30))
    return F.transform(F.array_sort(F.transform(F.array_distinct(modifiers), lambda m: F.struct(place(m).alias("o"), m.alias("m")))), lambda x: x["m"])


def _gathered(fragments: DataFrame, array: str) -> DataFrame:
    """identity and the distinct elements of an array column over its fragments, sorted."""
    return fragments.select("identity", F.explode(array).alias("x")).distinct().groupBy("identity").agg(F.array_sort(F.collect_list("x")).alias(array))


def merge_partial_types(fragments: DataFrame) -> DataFrame:
    """One row for each identity of fragments.

    fragments: identity, file, line, modifiers (array of names), attributes (array of structs that begin with name and
    arguments), interfaces (array of names), members (array of structs with identity, file and line), end_line, and any
    scalars. Result: identity, the scalars, modifiers, attributes, interfaces, members, declarations (file, line, end_line).
    Null arrays are empty; two fragments at one place count as one declaration.
    """
    arrays = ["modifiers", "attributes", "interfaces", "members"]
    scalars = [c for c in fragments.columns if c not in ("identity", "file", "line", "end_line", *arrays)]
    first = fragments.groupBy("identity").agg(F.min(F.struct("file", "line", "end_line", *scalars)).alias("f"), F.array_sort(F.collect_set(F.struct("file", "line", "end_line"))).alias("declarations"), F.flatten(F.collect_set("modifiers")).alias("m"))
    members = fragments.select("identity", F.struct("file", "line").alias("at"), F.posexplode("members").alias("n", "x"))
    members = members.groupBy("identity", F.col("x.identity").alias("member")).agg(F.min(F.struct("at", "n", "x"))["x"].alias("x"))
    packed = F.struct(F.col("x.file").alias("f"), F.col("x.line").alias("l"), F.col("x.identity").alias("i"), F.col("x").alias("x"))
    members = members.groupBy("identity").agg(F.transform(F.array_sort(F.collect_list(packed)), lambda s: s["x"]).alias("members"))
    out = first.select("identity", *[F.col(f"f.{c}").alias(c) for c in scalars], ordered_modifiers(F.col("m")).alias("modifiers"), "declarations")
    for side in (_gathered(fragments, "attributes"), _gathered(fragments, "interfaces"), members):
        out = out.join(side, "identity", "left")
    empty = {c: F.coalesce(c, F.array().cast(fragments.schema[c].dataType)) for c in ("attributes", "interfaces", "members")}
    return out.withColumns(empty).select("identity", *scalars, *arrays, "declarations")
