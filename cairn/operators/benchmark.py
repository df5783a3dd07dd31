"""Relationship expectations of benchmark cases, and a benchmark's summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import normal_path
from cairn.operators.keys import first_struct


def parsed_expectations(expected: DataFrame) -> DataFrame:
    """expected (case, expected) with kind, source and target in lower case; source and target are null where only a kind is expected.

    The grammar is `kind` or `kind: source file -> target file`; anything else behind a colon is an error.
    """
    text = F.col("expected")
    cut = F.instr(text, ":")
    ends = F.split(F.expr("substring(expected, instr(expected, ':') + 1)"), "->")
    bad = F.raise_error(F.concat(F.lit("an expected relationship is a kind, or `kind: source file -> target file`: "), text)).cast("string")
    end = lambda n: F.when(cut == 0, None).when(F.size(ends) != 2, bad).otherwise(F.lower(normal_path(F.trim(F.get(ends, F.lit(n))))))
    return expected.select("case", "expected", F.lower(F.trim(F.when(cut > 0, F.expr("substring(expected, 1, instr(expected, ':') - 1)")).otherwise(text))).alias("kind"), end(0).alias("source"), end(1).alias("target"))


def missing_relationships(expected: DataFrame, relationships: DataFrame, blocks: DataFrame) -> DataFrame:
    """case, expected: what no relationship of the case meets, once in any case.

    expected (case, expected); relationships (case, source_block, target_block, relationship); blocks (case, block, file).
    A kind alone needs no files; with files both blocks must be known. Both forms are equi-joins.
    """
    wanted = parsed_expectations(expected)
    side = lambda end: blocks.select("case", F.col("block").alias(f"{end}_block"), F.lower(normal_path(F.col("file"))).alias(end))
    actual = relationships.select("case", "source_block", "target_block", F.lower("relationship").alias("kind"))
    bare = wanted.where("source is null").join(actual.select("case", "kind").distinct(), ["case", "kind"], "left_anti")
    placed = actual.join(side("source"), ["case", "source_block"]).join(side("target"), ["case", "target_block"]).select("case", "kind", "source", "target").distinct()
    full = wanted.where("source is not null").join(placed, ["case", "kind", "source", "target"], "left_anti")
    left = bare.select("case", "expected").union(full.select("case", "expected"))
    return first_struct(left.withColumn("low", F.lower("expected")), ["case", "low"], ["expected"]).select("case", "expected")


def benchmark_summary(results: DataFrame) -> DataFrame:
    """One row over case results (case, file_recall, file_precision, tokens, failures, advisory): means, total tokens, whether all passed
    (an advisory case always does), and how many advisory cases failed. Without cases the means are null and nothing failed.
    """
    failed = F.col("failures") > 0
    return results.agg(
        F.count("*").alias("cases"), F.avg("file_recall").alias("mean_recall"), F.avg("file_precision").alias("mean_precision"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("total_tokens"),
        F.coalesce(F.bool_and(~failed | F.col("advisory")), F.lit(True)).alias("passed"), F.count_if(failed & F.col("advisory")).alias("advisory_failures"),
    )
