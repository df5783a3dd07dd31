"""Coverage, history, fan-in and fan-out, hotspots, trends, evaluation, packing and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.keys import first_by
from cairn.operators.ordered import carry_last, running_sums

# Outcomes of test runs.
OUTCOMES = {"failed": ["failed", "error", "timeout", "aborted"], "passed": ["passed", "completed"], "skipped": ["notexecuted", "skipped", "inconclusive"]}


def merge_coverage(lines: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """file, coverage: share of lines (file, line, hits) hit in any report, in percent; files are the same in any case.

    A file that no report has lines of takes the mean of its rates (file, rate). Shown is the least spelling of a file.
    """
    low = F.lower(F.col("file").cast("string"))
    best = lines.groupBy(low.alias("__f"), "line").agg(F.max("hits").alias("hits"), F.min("file").alias("file"))
    out = best.groupBy("__f").agg(F.min("file").alias("file"), (F.count_if(F.col("hits") > 0) * 100.0 / F.count("*")).alias("coverage"))
    if rates is not None:
        mean = rates.groupBy(low.alias("__f")).agg(F.min("file").alias("file"), F.avg("rate").alias("coverage"))
        out = out.unionByName(mean.join(out.select("__f"), "__f", "left_anti"))
    return out.select("file", "coverage")


def churn(log: DataFrame) -> DataFrame:
    """file: commits, contributors (case ignored), last change and lines changed."""
    return log.groupBy("file").agg(F.count_distinct("commit").alias("commits"), F.count_distinct(F.lower("author")).alias("contributors"), F.max("at").alias("last_change"), F.coalesce(F.sum(F.coalesce("added", F.lit(0)) + F.coalesce("deleted", F.lit(0))), F.lit(0)).alias("churn"))


def carry_headers(rows: DataFrame, series: str, order: list[str], header: str) -> DataFrame:
    """rows with the last non-null header at or before them in their series; a long series is spread over ranges. The order must be total."""
    return carry_last(rows, [series], order, header)


def fan(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, fan_out) and (file, fan_in): distinct targets by source file, distinct sources by target file."""
    out = edges.groupBy(F.col("source_file").alias("file")).agg(F.count_distinct("target").alias("fan_out"))
    into = edges.groupBy(F.col("target_file").alias("file")).agg(F.count_distinct("source").alias("fan_in"))
    return out, into


def hotspot_inputs(files: DataFrame, diagnostics: DataFrame, edges: DataFrame, coverage: DataFrame, history: DataFrame) -> DataFrame:
    """What rank_hotspots() needs of each file (path, complexity, loc): diagnostics (path: one row each), edges (source, target,
    source_file, target_file), coverage (file, coverage), history (file, churn). What is missing counts 0; coverage stays null.
    """
    out, into = fan(edges)
    found = diagnostics.groupBy("path").agg(F.count("*").alias("diagnostics"))
    named = lambda df: df.withColumnRenamed("file", "path")
    joined = files
    for side in (found, named(out), named(into), named(coverage), named(history.select("file", "churn"))):
        joined = joined.join(side, "path", "left")
    return joined.fillna(0, ["diagnostics", "fan_in", "fan_out", "churn", "complexity", "loc"])


def type_metrics(methods: DataFrame, dependencies: DataFrame) -> DataFrame:
    """owner: methods, public_methods, mean_complexity (two decimals, half to even), max_complexity of methods (owner, is_public, complexity),
    and distinct dependencies of dependencies (owner, target).
    """
    mean = F.bround(F.avg("complexity").cast("decimal(18,6)"), 2).cast("double")
    own = methods.groupBy("owner").agg(F.count("*").alias("methods"), F.count_if("is_public").alias("public_methods"), mean.alias("mean_complexity"), F.max("complexity").cast("long").alias("max_complexity"))
    used = dependencies.groupBy("owner").agg(F.count_distinct("target").alias("dependencies"))
    return own.join(used, "owner", "left").fillna(0, ["dependencies"])


def diagnostic_summary(diagnostics: DataFrame, rules: int = 5, files: int = 10) -> DataFrame:
    """The `rules` commonest rules of diagnostics (rule, file): rule, n, and their first `files` files by name, joined by commas."""
    top = diagnostics.groupBy("rule").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule").limit(rules)
    # Distinct (rule, file) rows only; Spark keeps the first few of each rule in every task before it deals them out.
    named = first_by(diagnostics.join(F.broadcast(top.select("rule")), "rule", "left_semi").select("rule", "file").distinct(), ["rule"], ["file"], files)
    return top.join(named.groupBy("rule").agg(F.array_join(F.array_sort(F.collect_list("file")), ",").alias("files")), "rule").select("rule", "n", "files")


def trend_point(files: DataFrame, diagnostics: DataFrame, tests: DataFrame, by: list[str]) -> DataFrame:
    """A report's trend point for each `by`: hotspots, churn, files with coverage and their mean of files (by, churn, coverage), diagnostics
    and failing tests (outcome). What a report has none of counts 0; the mean is null.
    """
    hot = files.groupBy(*by).agg(F.count("*").alias("hotspots"), F.coalesce(F.sum("churn"), F.lit(0)).cast("long").alias("churn"), F.count("coverage").alias("with_coverage"), F.avg("coverage").alias("mean_coverage"))
    found = diagnostics.groupBy(*by).agg(F.count("*").alias("diagnostics"))
    failing = tests.groupBy(*by).agg(F.count_if(outcome_of(F.col("outcome")) == "failed").alias("failing_tests"))
    return hot.join(found, by, "full").join(failing, by, "full").fillna(0, ["hotspots", "churn", "with_coverage", "diagnostics", "failing_tests"])


def outcome_of(outcome: Column) -> Column:
    """failed, passed or skipped, in any case; null for other words."""
    out = F.lit(None).cast("string")
    for kind, words in OUTCOMES.items():
        out = F.when(F.lower(outcome).isin(words), kind).otherwise(out)
    return out


def test_counts(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Tests by outcome for each `by` of outcomes (by, outcome): total, failed, passed, skipped."""
    kind = outcome_of(F.col("outcome"))
    return outcomes.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(kind == k).alias(k) for k in OUTCOMES])


def rank_hotspots(files: DataFrame, k: int) -> DataFrame:
    """The k worst files with rank: diagnostics, complexity, fan, coverage (null last), churn, lines, path. Only k rows are numbered."""
    order = [F.desc("diagnostics"), F.desc("complexity"), F.desc(F.col("fan_in") + F.col("fan_out")), F.coalesce("coverage", F.lit(1e308)), F.desc("churn"), F.desc("loc"), F.asc("path")]
    top = files.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def trend_deltas(points: DataFrame, series: list[str], order: list[str], values: list[str]) -> DataFrame:
    """points with <value>_delta to the point before in the series; null where either is null or there is none."""
    w = Window.partitionBy(*series).orderBy(*order)
    return points.withColumns({f"{v}_delta": F.col(v) - F.lag(v).over(w) for v in values})


def recall_precision(expected: DataFrame, retrieved: DataFrame, case: str, item: str) -> DataFrame:
    """case: hits, recall, precision. Nothing expected is recall 1; nothing retrieved is precision 1 only if nothing was expected."""
    e, r = expected.select(case, item).distinct().withColumn("__e", F.lit(1)), retrieved.select(case, item).distinct().withColumn("__r", F.lit(1))
    sums = e.join(r, [case, item], "full").groupBy(case).agg(F.count("__e").alias("e"), F.count("__r").alias("r"), F.count_if(F.col("__e").isNotNull() & F.col("__r").isNotNull()).alias("hits"))
    recall = F.when(F.col("e") == 0, 1.0).otherwise(F.col("hits") / F.col("e"))
    precision = F.when(F.col("r") == 0, F.when(F.col("e") == 0, 1.0).otherwise(0.0)).otherwise(F.col("hits") / F.col("r"))
    return sums.select(case, "hits", recall.alias("recall"), precision.alias("precision"))


def block_excerpt(text: Column, line: Column, end_line: Column) -> Column:
    """A block's own lines of its file's text, 60 at most; without an end it goes twelve lines on."""
    lines = F.split(text, r"\r?\n")
    last = F.least(F.size(lines), F.coalesce(end_line, line + 12), line + 59)
    return F.array_join(F.slice(lines, F.greatest(line, F.lit(1)).cast("int"), F.greatest(F.lit(0), last - line + 1).cast("int")), "\n")


def pack_budget(ranked: DataFrame, max_tokens: int, max_results: int) -> DataFrame:
    """Greedy packing of ranked blocks (score, file, line, end_line, text, and an id for ties if there is one) into a token budget.

    text is the block's own text, see block_excerpt().

    The budget is max(64, max_tokens - 550). Blocks are taken by score, file, line; one that overlaps a chosen
    block of its file is passed over but uses a place. An excerpt has 60 lines at most and loses trailing lines, then characters,
    until it fits max(32, (left - 16) * 4) characters; it costs ceil(length / 4) + 16; packing ends below 32 left. One fold
    over at most max_results rows.
    """
    ties = ["id"] if "id" in ranked.columns else []
    top = ranked.orderBy(F.desc("score"), "file", "line", *ties).limit(max_results)
    rows = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "file", "line", *ties, "end_line", "text")))
    room = lambda left: F.greatest(F.lit(32), (left - 16) * 4)

    def excerpt(text: Column, left: Column) -> Column:
        lines = F.slice(F.split(text, "\n"), 1, 60)
        sizes = F.transform(F.sequence(F.lit(1), F.size(lines)), lambda n: F.array_join(F.slice(lines, F.lit(1), n), "\n"))
        fits = F.filter(sizes, lambda s: F.length(s) <= room(left))
        return F.when(F.size(fits) > 0, F.element_at(fits, -1)).otherwise(F.substring(F.element_at(sizes, 1), F.lit(1), room(left).cast("int")))

    empty = F.array().cast("array<struct<file:string,line:bigint,end_line:bigint,text:string,cost:bigint>>")

    def step(a: Column, x: Column) -> Column:
        clash = F.exists(a["chosen"], lambda c: (F.lower(c["file"]) == F.lower(x["file"])) & (c["line"] <= x["end_line"]) & (x["line"] <= c["end_line"]))
        cut = excerpt(x["text"], a["left"])
        cost = (F.ceil(F.length(cut) / 4) + 16).cast("long")
        block = F.struct(x["file"].alias("file"), x["line"].alias("line"), x["end_line"].alias("end_line"), cut.alias("text"), cost.alias("cost"))
        take = (a["left"] >= 32) & ~clash & (cost <= a["left"])
        return F.struct(F.when(take, a["left"] - cost).otherwise(a["left"]).alias("left"), F.when(take, F.concat(a["chosen"], F.array(block))).otherwise(a["chosen"]).alias("chosen"))

    packed = top.agg(F.aggregate(rows, F.struct(F.lit(max(64, max_tokens - 550)).cast("long").alias("left"), empty.alias("chosen")), step).alias("p"))
    return packed.select(F.posexplode("p.chosen").alias("position", "b")).select(F.col("position").cast("long").alias("position"), "b.file", "b.line", "b.text", "b.cost")


def prefix_within(rows: DataFrame, series: str, order: str, size: str, budget: int) -> DataFrame:
    """The longest prefix of each series whose sizes add up to the budget at most; sums run in blocks. The order must be total."""
    return running_sums(rows, [series], [order], {size: "used"}).where(F.col("used") <= budget)


def completeness(loaded: Column, total: Column, gaps: Column) -> Column:
    return F.when((total > 0) & (loaded == 0), "Failed").when(gaps == 0, "Complete").otherwise("Partial")


def evidence_decision(blocks: Column, truncated: Column, gaps: Column, incomplete: Column, all_lexical: Column, all_weak: Column, diff_incomplete: Column) -> Column:
    """Insufficient without blocks or with an incomplete comparison; Partial with any reservation; else Sufficient."""
    doubt = truncated | (gaps > 0) | incomplete | all_lexical | all_weak
    return F.when((blocks == 0) | diff_incomplete, "Insufficient").when(doubt, "Partial").otherwise("Sufficient")


def reference_decision(resolved: Column, matches: Column, truncated: Column, incomplete: Column) -> Column:
    """Insufficient if the name is unknown or ambiguous, or nothing is found in an incomplete index; Partial if cut or incomplete; Sufficient else, with no match as proof of absence."""
    return F.when((resolved != 1) | ((matches == 0) & incomplete), "Insufficient").when(truncated | incomplete, "Partial").otherwise("Sufficient")
