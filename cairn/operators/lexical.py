"""Ranked lexical retrieval: document frequency, rarity, tiered scores, line scans."""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import identifier_words
from cairn.operators.metrics import evidence_decision


@dataclass(frozen=True)
class Weights:
    """Scores of the tiers; name and file words are scaled by rarity."""

    exact: int = 1000
    name_word: int = 180
    name_part: int = 45
    semantic_word: int = 70
    file_word: int = 55
    executable: int = 30


def with_words(symbols: DataFrame) -> DataFrame:
    """symbols (name, semantic_name, file, kind) with the word sets of the three fields."""
    return symbols.withColumns({"__name": identifier_words(F.col("name")), "__semantic": identifier_words(F.col("semantic_name")), "__file": identifier_words(F.regexp_extract(F.col("file"), r"([^/]*?)(?:\.[^./]*)?$", 1))})


def document_frequency(symbols: DataFrame, terms: list[str]) -> tuple[int, dict[str, int]]:
    """Number of symbols, and of those whose words hold each term: one pass, one row to the driver."""
    worded = with_words(symbols)
    has = lambda t: F.array_contains("__name", t) | F.array_contains("__semantic", t) | F.array_contains("__file", t)
    row = worded.agg(F.count("*"), *[F.coalesce(F.sum(has(t).cast("long")), F.lit(0)) for t in terms]).head()
    return row[0], dict(zip(terms, row[1:], strict=True))


def rarity(n: int, df: int) -> float:
    return 1 + log(1 + n / (1 + df))


def score(symbols: DataFrame, query: str, terms: list[str], weights: Weights = Weights(), seeds: Column | None = None) -> DataFrame:  # noqa: B008
    """symbols that score, with `score` and `reasons`. seeds restricts what may score, not what counts for rarity."""
    n, df = document_frequency(symbols, terms)
    worded = with_words(symbols if seeds is None else symbols.where(seeds))
    exact = (F.lower("name") == query.lower()) | (F.lower("semantic_name") == query.lower())
    total, why = F.when(exact, weights.exact).otherwise(0), [F.when(exact, "exact symbol match")]
    for t in terms:
        points = lambda w, t=t: F.lit(round(w * rarity(n, df[t])))  # noqa: E731  Python rounds half to even
        word, part, semantic, file = F.array_contains("__name", t), F.lower("name").contains(t), F.array_contains("__semantic", t), F.array_contains("__file", t)
        name = F.when(word, points(weights.name_word)).when(part, points(weights.name_part)).when(semantic, points(weights.semantic_word)).otherwise(0)
        total = total + name + F.when(file, points(weights.file_word)).otherwise(0)
        why += [F.when(word, f"symbol word matches '{t}'").when(part, f"symbol name contains '{t}'").when(semantic, f"semantic name matches word '{t}'"), F.when(file, f"file name matches '{t}'")]
    executable = F.col("kind").isin("method", "test")
    # A row's number is not deterministic, so the filter stays above this projection and the words are found once.
    scored = worded.withColumn("__m", F.struct(total.alias("score"), F.array_compact(F.array(*why, F.when(executable, "focused executable declaration"))).alias("why"), F.monotonically_increasing_id().alias("row"))).where("__m.score > 0")
    bonus = F.when(executable, weights.executable).otherwise(0)
    return scored.withColumn("score", (F.col("__m.score") + bonus).cast("long")).withColumn("reasons", F.col("__m.why")).drop("__m", "__name", "__semantic", "__file")


def rank(scored: DataFrame, k: int) -> DataFrame:
    """The k best by score, then file, line, identity."""
    return scored.orderBy(F.desc("score"), "file", "line", "identity").limit(k)


def scan_lines(files: DataFrame, terms: list[str], key: str, text: str, hits: int = 3) -> DataFrame:
    """Per file with any hit: file_score, best_line (1-based), distinct_terms.

    A line's weight is 40 for each term of 10 characters or more that it holds and 10 for each shorter one. The
    first `hits` lines of each term add to the file's score, and each distinct term adds 15. It stays in the row:
    no explode and no shuffle.
    """
    lines = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "\n")
    df = files.select(key, lines.alias("__lines"))
    weight = {t: 40 if len(t) >= 10 else 10 for t in terms}
    line_weight = lambda x: sum((F.when(x.contains(t), w).otherwise(0) for t, w in weight.items()), F.lit(0))
    holding = lambda t: F.size(F.filter("__lines", lambda x: x.contains(t)))
    df = df.withColumn("__weights", F.transform("__lines", line_weight)).withColumn("__counts", F.array(*map(holding, terms)).cast("array<int>"))
    count = [F.get("__counts", F.lit(i)) for i in range(len(terms))]
    distinct = sum((F.when(c > 0, 1).otherwise(0) for c in count), F.lit(0))
    total = sum((F.least(c, F.lit(hits)) * weight[t] for t, c in zip(terms, count, strict=True)), F.lit(0)) + 15 * distinct
    best = F.array_position("__weights", F.array_max("__weights"))
    # A row's number is not deterministic, so the filter stays above this projection and the lines are scanned once.
    made = F.struct(total.cast("long").alias("file_score"), best.cast("long").alias("best_line"), distinct.cast("long").alias("distinct_terms"), F.monotonically_increasing_id().alias("row"))
    return df.select(key, made.alias("__m")).where("__m.distinct_terms > 0").select(key, "__m.file_score", "__m.best_line", "__m.distinct_terms")


# What an answer says about what it did not look at.
UNSCANNED = "Scanned {} of {} candidate files for lexical evidence in path order; later paths were not examined."
OVERSIZED = "Skipped {} file(s) larger than indexing.maxEvidenceFileBytes when scanning for lexical evidence."
FILTERED = "Filtered queries search indexed declarations only; files with matching text but no matching declaration were not considered."


def scan_limited(files: DataFrame, terms: list[str], most_files: int, most_bytes: int, hits: int = 3) -> tuple[DataFrame, DataFrame]:
    """(found, gaps): scan_lines() over the first most_files files by path, and a gap row for each kind of file not looked at.

    files: path (once each), text, bytes, excluded (files shown already: they take a place, but are not read). The last
    path within the limit is found first, among the paths alone, so texts beyond it or over most_bytes are never read. The
    gaps are counted on paths and sizes in one row.
    """
    places = files.select("path", F.col("bytes") > most_bytes, "excluded").toDF("path", "large", "excluded")
    last = places.select("path").orderBy("path").limit(most_files).agg(F.max("path")).head()[0]  # one path
    inside = F.col("path") <= last if last is not None else F.lit(False)
    counted = places.agg(F.count("*").alias("all"), F.count_if(inside).alias("scanned"), F.count_if(inside & ~F.col("excluded") & F.col("large")).alias("large"))
    told = lambda text, *numbers: F.format_string(text.replace("{}", "%d"), *numbers)
    lines = F.array(F.when(F.col("all") > F.col("scanned"), told(UNSCANNED, F.col("scanned"), F.col("all"))), F.when(F.col("large") > 0, told(OVERSIZED, F.col("large"))))
    gaps = counted.select(F.explode(F.filter(lines, lambda x: x.isNotNull())).alias("gap"))
    found = scan_lines(files.where(inside & ~F.col("excluded") & (F.col("bytes") <= most_bytes)), terms, "path", "text", hits)
    return found, gaps


def scan_decision(found: DataFrame, gaps: DataFrame, filtered: bool = False) -> DataFrame:
    """One row: blocks, decision. A scan that left something out, or that filters confined to declarations, is at most Partial."""
    more = int(filtered)
    rows = found.select(F.lit(1).alias("block"), F.lit(None).cast("int").alias("gap")).union(gaps.select(F.lit(None).cast("int"), F.lit(1)))
    n = rows.agg(F.count("block").alias("blocks"), (F.count("gap") + more).alias("gaps"))
    no = F.lit(False)
    return n.select("blocks", evidence_decision(F.col("blocks"), no, F.col("gaps"), no, no, no, no).alias("decision"))


def filter_gaps(spark: SparkSession, filtered: bool) -> DataFrame:
    """The gap row of a query that filters confine to declarations."""
    return spark.createDataFrame([(FILTERED,)] if filtered else [], "gap string")
