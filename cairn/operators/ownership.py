"""Which project owns a path; suffix, interval and tiered-name lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import ancestors_of, directory_of, shared_input, suffixes_of
from cairn.operators.keys import first_by

#: In place of a project: all of them.
EVERY = "*"


def nearest_owner(paths: DataFrame, projects: DataFrame) -> DataFrame:
    """path, project: projects whose directory is the deepest that contains the path, all ties. Paths explode to their ancestors, so the join is an equi-join."""
    up = paths.select("path", F.explode(ancestors_of(F.col("path"))).alias("dir"))
    found = up.join(projects.select(F.col("path").alias("project"), directory_of(F.col("path")).alias("dir")), "dir")
    deepest = found.groupBy("path").agg(F.max(F.length("dir")).alias("n"))
    return found.join(deepest, "path").where(F.length("dir") == F.col("n")).select("path", "project")


def owners(paths: DataFrame, projects: DataFrame, items: DataFrame) -> DataFrame:
    """path, project, reason by tiers: listed item, else shared input of the projects below its directory, else nearest project.

    A shared input without a project below its directory belongs to every project: one row with project EVERY stands for all.
    """
    listed = paths.join(items.select(F.col("path"), "project"), "path").select("path", "project", F.lit("item").alias("reason")).distinct()
    rest = paths.join(listed.select("path"), "path", "left_anti")
    shared = rest.where(shared_input(F.col("path"))).select("path", directory_of(F.col("path")).alias("dir"))
    below = projects.select(F.col("path").alias("project"), F.explode(ancestors_of(F.col("path"))).alias("dir"))
    scoped = shared.join(below, "dir").select("path", "project", F.lit("shared").alias("reason"))
    everywhere = shared.join(below.select("dir").distinct(), "dir", "left_anti").select("path", F.lit(EVERY).alias("project"), F.lit("shared everywhere").alias("reason"))
    near = nearest_owner(rest.where(~shared_input(F.col("path"))), projects).withColumn("reason", F.lit("nearest"))
    return listed.union(scoped).union(everywhere).union(near)


def suffix_lookup(files: DataFrame, keys: DataFrame) -> DataFrame:
    """path, key: the key equal to the path, else the longest (then least) key that is a suffix of the path, or has it as one, at a segment."""
    a = files.select("path", F.explode(suffixes_of(F.col("path"))).alias("s")).join(keys.select(F.col("key").alias("s"), "key"), "s").select("path", "key")
    b = keys.select("key", F.explode(suffixes_of(F.col("key"))).alias("s")).join(files.select(F.col("path").alias("s"), "path"), "s").select("path", "key")
    both = a.union(b).distinct()
    return first_by(both, ["path"], [F.desc((F.col("path") == F.col("key")).cast("int")), F.desc(F.length("key")), "key"])


def span_blocks(spans: DataFrame, first: str, last: str) -> DataFrame:
    """spans with `level` and `number`: a row for each dyadic block that the lines first to last are made of, two a level at most.

    At level k the lines from ceil(first / 2^k) to floor((last + 1) / 2^k) are still to be covered, in blocks of 2^k; an odd
    block at either end belongs to no larger block inside and is taken. Levels end where no block fits into the span.
    """
    levels = F.length(F.bin(F.col(last) - F.col(first) + 1)) - 1
    dealt = spans.withColumn("level", F.explode(F.sequence(F.lit(0), levels)))
    dealt = dealt.withColumn("__low", F.expr(f"-shiftright(-{first}, level)")).withColumn("__high", F.expr(f"shiftright({last} + 1, level)")).where("__low < __high")
    left = F.when(F.pmod("__low", F.lit(2)) == 1, F.col("__low"))
    right = F.when((F.pmod("__high", F.lit(2)) == 1) & ((F.col("__low") < F.col("__high") - 1) | (F.pmod("__low", F.lit(2)) == 0)), F.col("__high") - 1)
    return dealt.withColumn("number", F.explode(F.array(left, right))).where("number is not null").drop("__low", "__high")


def containing_interval(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Each point (file, at) with the span (file, line, end_line, identity) around it that starts last, then is shortest, then of least identity.

    A span becomes the dyadic blocks that it is made of, a point those that hold it, so this is an equi-join whatever the
    spans' lengths: a span of n lines gives 2 log n rows at most, a point one for each level that any span has. Of the
    spans of one block only the first can be a point's answer there, so a block that many spans share is one row.
    """
    spans = spans.withColumn("end_line", F.coalesce("end_line", "line")).where("end_line >= line")
    rest = [c for c in spans.columns if c not in ("file", "line", "end_line", "identity")]
    order = F.struct((-F.col("line")).alias("o"), (F.col("end_line") - F.col("line")).alias("n"), "identity", "line", "end_line", *rest)
    blocks = span_blocks(spans, "line", "end_line").groupBy("file", "level", "number").agg(F.min(order).alias("__span"))
    longest = spans.agg(F.max(F.col("end_line") - F.col("line") + 1)).head()[0]  # one number
    levels = int(longest or 1).bit_length() - 1
    dealt = points.distinct().withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("number", F.expr("shiftright(at, level)"))
    best = dealt.join(blocks, ["file", "level", "number"]).groupBy(*points.columns).agg(F.min("__span").alias("__span"))
    return best.select(*points.columns, *[F.col(f"__span.{c}").alias(c) for c in ("line", "end_line", "identity", *rest)])


def resolve_names(targets: DataFrame, symbols: DataFrame) -> DataFrame:
    """target, identity, tier: symbols by semantic name (1), else by name (2), else by a dotted suffix (3); case is ignored."""
    t = targets.select("target", F.lower("target").alias("k")).distinct()
    dotted = F.split(F.lower("semantic_name"), r"\.")
    tails = symbols.select("identity", F.explode(F.transform(F.sequence(F.lit(1), F.size(dotted)), lambda n: F.struct(F.array_join(F.slice(dotted, n, F.size(dotted)), ".").alias("k"), (n > 1).alias("tail")))).alias("x"))
    keys = symbols.select("identity", F.lower("semantic_name").alias("k"), F.lit(1).alias("tier")).union(symbols.select("identity", F.lower("name"), F.lit(2))).union(tails.where("x.tail").select("identity", "x.k", F.lit(3)))
    found = t.join(keys, "k").groupBy("target", "identity").agg(F.min("tier").alias("tier"))
    best = found.groupBy("target").agg(F.min("tier").alias("best"))
    return found.join(best, "target").where("tier = best").select("target", "identity", F.col("tier").cast("long").alias("tier"))
