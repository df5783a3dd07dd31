"""Snapshot deltas: new, resolved and existing rows, symmetric difference, provenance, regressions, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.keys import first_struct


def new_rows(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    return after.join(before.select(key), key, "left_anti")


def resolved_rows(before: DataFrame, after: DataFrame, key: str, executed: DataFrame | None = None, complete: bool = True) -> DataFrame:
    """Rows that are gone. Of an incomplete run only those count that were executed this time."""
    gone = before.join(after.select(key), key, "left_anti")
    return gone if complete or executed is None else gone.join(executed.select(key), key, "left_semi")


def existing_rows(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    return after.join(before.select(key), key, "left_semi")


def changed_keys(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys whose rows differ or are in one snapshot only."""
    same = F.lit(True)
    for c in before.columns:
        if c != key:
            same = same & F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}"))
    joined = before.withColumn("__in", F.lit(1)).alias("b").join(after.withColumn("__in", F.lit(1)).alias("a"), F.col(f"b.{key}") == F.col(f"a.{key}"), "full")
    return joined.where(F.col("b.__in").isNull() | F.col("a.__in").isNull() | ~same).select(F.coalesce(f"b.{key}", f"a.{key}").alias(key))


def provenance(committed: DataFrame, working: DataFrame, key: str) -> DataFrame:
    """key and Committed, WorkingTree or Both."""
    left, right = committed.select(key, F.lit(True).alias("__c")).distinct(), working.select(key, F.lit(True).alias("__w")).distinct()
    where = F.when(F.col("__c") & F.col("__w"), "Both").when(F.col("__c"), "Committed").otherwise("WorkingTree")
    return left.join(right, key, "full").select(key, where.alias("provenance"))


def regression(new: DataFrame, warnings_count: bool) -> DataFrame:
    """One row: whether new diagnostics (severity) regress, and how many there are of each kind."""
    errors, warnings = F.count_if(F.col("severity") == "error"), F.count_if(F.col("severity") == "warning")
    return new.agg(errors.alias("new_errors"), warnings.alias("new_warnings"), ((errors > 0) | (F.lit(warnings_count) & (warnings > 0))).alias("regressed"))


def merge_first(frames: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """Frames in order of preference, one row for each key: that of the first frame, then of the least order."""
    out = frames[0].withColumn("__from", F.lit(0))
    for i, df in enumerate(frames[1:], 1):
        out = out.unionByName(df.withColumn("__from", F.lit(i)))
    return first_struct(out, keys, ["__from", *order]).drop("__from")


def has_regressions(states: list[tuple[Column, Column]], new_errors: Column, new_warnings: Column, new_failures: Column, warnings_count: bool) -> Column:
    """Whether a run is worse than its baseline: a step (build, formatter, scanner: state before, state now) that succeeded and no longer
    does, a new error, a new warning where these count, or a newly failing test.
    """
    out = (F.coalesce(new_errors, F.lit(0)) > 0) | (F.coalesce(new_failures, F.lit(0)) > 0) | (F.lit(warnings_count) & (F.coalesce(new_warnings, F.lit(0)) > 0))
    for before, now in states:
        out = out | (before.eqNullSafe(F.lit("Succeeded")) & ~now.eqNullSafe(F.lit("Succeeded")))
    return out


def regressions(runs: DataFrame, diagnostics: DataFrame, failures: DataFrame, key: str, steps: list[str], warnings_count: bool) -> DataFrame:
    """runs (key, <step>_before, <step>_now for each step) with new_errors, new_warnings, new_failures and regressed.

    diagnostics (key, identity, severity, is_new) and failures (key, identity, is_new): new ones count, each identity once.
    """
    new = diagnostics.where("is_new").select(key, "identity", "severity").distinct().groupBy(key).agg(F.count_if(F.col("severity") == "error").alias("new_errors"), F.count_if(F.col("severity") == "warning").alias("new_warnings"))
    failed = failures.where("is_new").groupBy(key).agg(F.count_distinct("identity").alias("new_failures"))
    joined = runs.join(new, key, "left").join(failed, key, "left").fillna(0, ["new_errors", "new_warnings", "new_failures"])
    states = [(F.col(f"{s}_before"), F.col(f"{s}_now")) for s in steps]
    return joined.withColumn("regressed", has_regressions(states, F.col("new_errors"), F.col("new_warnings"), F.col("new_failures"), warnings_count))
