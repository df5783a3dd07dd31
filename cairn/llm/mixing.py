"""Mixing sources to target weights by Poisson replication.

Each source has a target share of the output; its mean repetition rate is share * total size / own size. For
every document a uniform number is taken from a seeded hash of its id, and the Poisson distribution of that mean
is inverted at it: the count is the number of distribution steps at or below the number. A rate above LARGE_RATE
is the sum of several draws of equal rates up to it, each with its own hash, so every rate works. The document is
exploded by its count and all copies are dealt and sorted by a hash of (id, text, copy), a global shuffle.

Null source is a source of its own, null ids hash as the empty string, null text weighs nothing but its row is
replicated as any other. Repeated rows get equal counts. An empty table gives no rows. Columns called `copy`,
`rate` or `shuffle_key` in the input are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.session import scan_bytes, staged

#: A rate above this is dealt to several draws: its own distribution has no steps that double precision can add up from zero.
LARGE_RATE = 500.0
#: Sources up to this many are broadcast with their steps (under 10 MB); more are joined by a shuffle.
BROADCAST_SOURCES = 10_000


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from 52 bits of an MD5, the same in any SQL engine."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / float(1 << 52)


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = 0.7, source: str = "source", text: str = "text") -> DataFrame:
    """source, size (characters) and rate. weights: target share by source, in any scale; else size ** alpha.

    With `weights`, a source that they leave out gets rate 0.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(F.coalesce(F.length(text), F.lit(0))).cast("long").alias("size"), F.count("*").alias("n"))
    if weights is None:
        target = F.pow(F.col("size").cast("double"), F.lit(alpha))
    else:
        target = F.lit(0.0)
        for name, w in weights.items():
            target = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(target)
    sizes = staged(sizes.withColumn("target", target), "source-sizes")
    all_size, all_target = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("target"), F.lit(0.0))).head()
    share = F.col("target") / F.lit(float(all_target)) * F.lit(float(all_size)) / F.col("size")
    return sizes.select("source", "size", F.when((F.col("size") > 0) & F.lit(all_target > 0), share).otherwise(F.lit(1.0)).alias("rate"))


def replicate(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = 0.7, seed: int = 17, id_column: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """docs replicated to the target weights and shuffled, with rate, copy (1, 2, ...) and shuffle_key."""
    docs = docs.select(*[c for c in docs.columns if c not in ("copy", "rate", "shuffle_key")])
    rates = source_rates(docs, weights, alpha, source, text)
    # The distribution's steps as an array of (term, sum), each term from the one before.
    draws = F.greatest(F.ceil(F.col("rate") / LARGE_RATE), F.lit(1))
    rate = F.col("rate") / draws
    n = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    grow = lambda a, k: F.struct((a["term"] * rate / k).alias("term"), (a["sum"] + a["term"] * rate / k).alias("sum"), F.concat(a["all"], F.array(a["sum"] + a["term"] * rate / k)).alias("all"))
    first = F.exp(-rate)
    steps = F.aggregate(F.sequence(F.lit(1), n), F.struct(first.alias("term"), first.alias("sum"), F.array(first).alias("all")), grow, lambda a: a["all"])
    small = rates.select(F.col("source").alias("__source"), "rate", draws.cast("int").alias("__draws"), steps.alias("__steps"))
    if rates.count() <= BROADCAST_SOURCES:
        small = F.broadcast(small)
    joined = docs.join(small, F.col(source).eqNullSafe(F.col("__source")))
    key = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    joined = joined.withColumn("__u", uniform(key, seed))
    below = lambda u: F.size(F.filter("__steps", lambda s: s < u))
    more = F.aggregate(F.sequence(F.lit(2), F.col("__draws")), F.lit(0), lambda a, j: a + below(uniform(F.concat(key, F.lit(":"), j.cast("string")), seed)))
    count = below(F.col("__u")) + F.when(F.col("__draws") > 1, more).otherwise(F.lit(0))
    out = joined.withColumn("__n", count).where("__n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    out = out.withColumn("shuffle_key", F.xxhash64(F.lit(seed), key, F.coalesce(F.col(text), F.lit("")), "copy"))
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, scan_bytes(docs) // (8 << 20))
    return out.select(*docs.columns, "rate", "copy", "shuffle_key").repartition(int(parts), "shuffle_key").sortWithinPartitions("shuffle_key")
