"""What a change set affects: symbols, projects, test projects and test names in one answer, each with how it was reached.

Closures start from many seeds at once and keep, for every row that they reach, the wave, the least seed of that wave and
the kind of path. Baseline and current tables are united first, so what was removed still counts. Waves are staged
tables; a wave joins its own rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.names import joined_name
from cairn.operators.keys import first_struct
from cairn.operators.ownership import EVERY, owners
from cairn.session import Staging


def seeded_closure(seeds: DataFrame, edges: DataFrame, staging: Staging) -> DataFrame:
    """id, seed, wave: all ids that edges (source, target) reach from seeds (id, seed); of several seeds of the first wave the least."""
    wave = staging.put(seeds.groupBy("id").agg(F.min("seed").alias("seed")).withColumn("wave", F.lit(0).cast("long")), "wave")
    waves = known = wave
    n = 0
    while wave.take(1):
        n += 1
        step = edges.join(wave.select(F.col("id").alias("source"), "seed"), "source").groupBy(F.col("target").alias("id")).agg(F.min("seed").alias("seed"))
        wave = staging.put(step.join(known.select("id"), "id", "left_anti").withColumn("wave", F.lit(n).cast("long")), "wave")
        waves = waves.unionByName(wave)
        known = waves
    return waves


def united(baseline: DataFrame, current: DataFrame, key: str | Column) -> DataFrame:
    """Rows of both tables, one for each key; the baseline's where both have it."""
    rows = baseline.withColumn("__from", F.lit(0)).unionByName(current.withColumn("__from", F.lit(1)))
    return first_struct(rows.withColumn("__key", F.col(key) if isinstance(key, str) else key), ["__key"], ["__from"]).drop("__from", "__key")


def test_name(namespace: Column, containing_type: Column, name: Column) -> Column:
    return joined_name(namespace, containing_type, name)


def affected(changed: DataFrame, symbols: DataFrame, references: DataFrame, projects: DataFrame, items: DataFrame, dependencies: DataFrame) -> DataFrame:
    """what, id, via, seed, wave.

    changed (path); symbols (identity, kind, name, namespace, containing_type, project, file), references (source, target,
    source_project), projects (path, is_test), items (path, project), dependencies (source depends on target): each the
    union of baseline and current, see united(). Paths and projects compare in any case.

    what is symbol (via changed or reference), project (via owner, reference or dependency: the first of these),
    test-project, or test-case (id is its full name). seed is the changed file or symbol that led there.
    """
    staging = Staging()
    low = changed.select(F.lower("path").alias("__f"), F.col("path").alias("file_seed")).groupBy("__f").agg(F.min("file_seed").alias("file_seed"))
    hit = symbols.join(low, F.lower("file") == F.col("__f")).select(F.col("identity").alias("id"), F.col("file_seed").alias("seed"))
    back = references.select(F.col("target").alias("source"), F.col("source").alias("target")).distinct()
    reached = staging.put(seeded_closure(hit, back, staging), "reached")
    symbol_rows = symbols.join(reached.withColumnRenamed("id", "identity"), "identity")
    symbols_out = symbol_rows.select(F.lit("symbol").alias("what"), F.col("identity").alias("id"), F.when(F.col("wave") == 0, "changed").otherwise("reference").alias("via"), "seed", "wave")

    lower_projects = projects.select("path", F.lower("path").alias("p"))
    owned = staging.put(owners(changed.select("path").distinct(), projects.select("path"), items), "owned")
    direct = owned.where(F.col("project") != EVERY).select(F.lower("project").alias("id"), F.col("path").alias("seed"))
    shared = owned.where(F.col("project") == EVERY).agg(F.min("path")).head()[0]  # one path
    if shared is not None:
        direct = direct.unionByName(lower_projects.select(F.col("p").alias("id"), F.lit(shared).alias("seed")))
    newly = reached.where("wave > 0").select(F.col("id").alias("source"), "seed")
    by_reference = references.join(reached.select(F.col("id").alias("target")), "target", "left_semi").join(newly, "source").select(F.lower("source_project").alias("id"), "seed")
    seeds = staging.put(direct.withColumn("via", F.lit(0)).unionByName(by_reference.withColumn("via", F.lit(1))).groupBy("id").agg(F.min(F.struct("via", "seed")).alias("s")).select("id", "s.via", "s.seed"), "seeds")
    upward = dependencies.select(F.lower("target").alias("source"), F.lower("source").alias("target")).distinct()
    spread = seeded_closure(seeds.select("id", "seed"), upward, staging).join(seeds.select("id", "via"), "id", "left")
    kind = F.when(F.col("via") == 0, "owner").when(F.col("via") == 1, "reference").otherwise("dependency")
    named = spread.join(lower_projects, F.col("id") == F.col("p"), "left").select(F.coalesce("path", "id").alias("id"), kind.alias("via"), "seed", "wave")
    named = staging.put(named, "projects")
    tests = named.join(projects.where("is_test").select(F.col("path").alias("id")), "id", "left_semi")
    cases = symbol_rows.where("kind = 'test'").join(tests.select(F.lower("id").alias("__t")).distinct(), F.lower("project") == F.col("__t"), "left_semi")
    cases = cases.withColumn("full", test_name(F.col("namespace"), F.col("containing_type"), F.col("name"))).where(F.trim("full") != "")
    cases = cases.groupBy("full").agg(F.min(F.struct("wave", "seed")).alias("s")).select(F.lit("test-case").alias("what"), F.col("full").alias("id"), F.when(F.col("s.wave") == 0, "changed").otherwise("reference").alias("via"), "s.seed", "s.wave")
    projects_out = named.select(F.lit("project").alias("what"), "id", "via", "seed", "wave")
    tests_out = tests.select(F.lit("test-project").alias("what"), "id", "via", "seed", "wave")
    return symbols_out.unionByName(projects_out).unionByName(tests_out).unionByName(cases)
