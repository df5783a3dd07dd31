"""Graph operators over edge tables: typed relations, bounded scored expansion, transitive closures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import staged, unstage

# What an edge kind contributes; any other kind counts OTHER.
EDGE_WEIGHTS = {
    "override": 130, "interface-implementation": 130, "call": 115, "method-call": 115, "construct": 115, "constructs": 115, "constructed-type": 115, "member-read": 115, "member-write": 115,
    "event-subscription": 105, "delegate-callback": 105, "inheritance": 95, "interface": 95, "generic-type-argument": 95, "typeof-reference": 90, "attribute": 85, "nameof-reference": 80,
    "dependency-injection": 85, "markup-binding": 85, "markup-event": 85, "component-use": 85,
}
OTHER, CEILING, SHARE, SHARE_CEILING, STEP = 70, 1000, 4, 200, 15
#: relation -> (end that is the given symbol, edge kinds; None: any)
RELATIONS = {
    "callers": ("target", ["method-call", "delegate-callback", "markup-event"]), "callees": ("source", ["method-call", "delegate-callback", "markup-event"]),
    "implementers": ("target", ["interface-implementation"]), "implementations": ("source", ["interface-implementation"]), "overrides": ("target", ["override"]), "subtypes": ("target", ["base-type", "interface"]),
    "constructors-of": ("target", ["constructed-type"]), "readers": ("target", ["member-read"]), "writers": ("target", ["member-write"]), "tests-covering": ("target", None), "injected-into": ("target", ["dependency-injection"]),
}


def relation(edges: DataFrame, given: DataFrame, name: str, kinds: DataFrame | None = None, symbols: DataFrame | None = None) -> DataFrame:
    """Distinct (source, target, relationship) of a relation for the symbols in given (id).

    tests-covering needs kinds (id, kind) and keeps sources of kind test. With symbols (id) both ends must be among them.
    """
    end, wanted = RELATIONS[name]
    found = edges if wanted is None else edges.where(F.col("relationship").isin(wanted))
    found = found.join(given.select(F.col("id").alias(end)).distinct(), end, "left_semi")
    if wanted is None:
        found = found.join(kinds.where("kind = 'test'").select(F.col("id").alias("source")).distinct(), "source", "left_semi")
    if symbols is not None:
        known = symbols.select("id").distinct()
        found = found.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi")
    return found.select("source", "target", "relationship").distinct()


def expand(seeds: DataFrame, edges: DataFrame, depth: int, known: DataFrame | None = None) -> DataFrame:
    """seeds (id, score) and what up to `depth` (3 at most) levels of edges reach from them: id, score, level, reasons.

    An edge row (source, target, relationship) gives each new neighbour, in either direction, at least 1 and
    weight + min(200, anchor's score div 4) - 15 * level; a neighbour sums its rows (use sites count one by one) up
    to 1,000. Levels see only what earlier levels found. With known (id) only these can be reached. reasons: the distinct
    `graph depth n: uses 'kind'` (the anchor is the source) and `used by`, in order; seeds have none. Equal edge rows
    are counted once before the first level and travel as one.
    """
    if not 0 <= depth <= 3:
        raise ValueError("depth is 0 to 3")
    weight = F.lit(OTHER)
    for kind, w in EDGE_WEIGHTS.items():
        weight = F.when(F.col("relationship") == kind, w).otherwise(weight)
    counted = edges.groupBy("source", "target", "relationship").agg(F.count("*").alias("n"))
    way = lambda a, b, verb: counted.select(F.col(a).alias("a"), F.col(b).alias("b"), weight.alias("w"), "n", F.concat(F.lit(f"{verb} '"), "relationship", F.lit("'")).alias("why"))
    both = staged(way("source", "target", "uses").union(way("target", "source", "used by")), "ways")
    found = seeds.select("id", F.col("score").cast("long").alias("score"), F.lit(0).cast("long").alias("level"), F.array().cast("array<string>").alias("reasons"))
    front = found
    for level in range(1, depth + 1):
        points = F.greatest(F.lit(1), F.col("w") + F.least(F.lit(SHARE_CEILING), F.expr(f"score div {SHARE}")) - STEP * level)
        near = both.join(front.select(F.col("id").alias("a"), "score"), "a").select(F.col("b").alias("id"), (points * F.col("n")).alias("p"), F.concat(F.lit(f"graph depth {level}: "), "why").alias("why"))
        near = near.groupBy("id").agg(F.least(F.sum("p"), F.lit(CEILING)).cast("long").alias("score"), F.array_sort(F.collect_set("why")).alias("reasons"))
        if known is not None:
            near = near.join(known.select("id").distinct(), "id", "left_semi")
        front = staged(near.join(found.select("id"), "id", "left_anti").select("id", "score", F.lit(level).cast("long").alias("level"), "reasons"), "level")
        found = found.union(front)
    return found


def closure(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """All ids that edges (source, target) reach from seeds (id), themselves included, with the wave that found them.

    Semi-naive: each round joins only the last wave and leaves out what is known; waves are staged tables, so no
    lineage grows and a lost executor costs one wave. Reverse the edges for a reverse closure.
    """
    wave = staged(seeds.select("id").distinct().withColumn("wave", F.lit(0).cast("long")), "wave")
    waves = [wave]
    while wave.take(1):
        known = waves[0].select("id")
        for w in waves[1:]:
            known = known.union(w.select("id"))
        step = edges.join(wave.select(F.col("id").alias("source")), "source").select(F.col("target").alias("id")).distinct()
        wave = staged(step.join(known, "id", "left_anti").withColumn("wave", F.lit(len(waves)).cast("long")), "wave")
        waves.append(wave)
    out = waves[0]
    for w in waves[1:-1]:
        out = out.union(w)
    if len(waves) > 1:
        unstage(waves[-1])
    return out
