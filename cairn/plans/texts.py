"""Queries over words, lines, paths and markup in the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.operators import lexical, markup, metrics, ownership
from cairn.operators.fingerprint import fingerprint_sql, fingerprints
from cairn.operators.keys import first_struct
from cairn.plans.registry import query
from cairn.session import table

QUERY = "smallRing Widget red"
TERMS = X.query_terms(QUERY)


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.concat(F.lit("p"), "p_partkey").alias("identity"), F.col("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_name").alias("semantic_name"), F.concat(F.lit("src/"), F.lower("p_type"), F.lit(".cs")).alias("file"),
        F.when(F.col("p_size") % 2 == 0, "method").otherwise("class").alias("kind"), F.col("p_size").cast("long").alias("line"),
    )


def _words_sql(x: str) -> str:
    """The identifier words of an expression; RE2 has no look-ahead, so a space is put before the last capital of a run."""
    whole = rf"regexp_extract_all({x}, '[A-Za-z_][A-Za-z0-9_./-]*')"
    parts = rf"regexp_extract_all(regexp_replace(array_to_string({whole}, ' '), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+')"
    stop = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
    return f"list_distinct(list_filter(list_transform(list_concat({whole}, {parts}), lambda w: lower(w)), lambda w: length(w) >= 2 AND w NOT IN ({stop})))"


SYMBOLS = f"""s AS (SELECT 'p' || p_partkey AS identity, p_name AS name, p_brand || '.' || p_name AS semantic_name, 'src/' || lower(p_type) || '.cs' AS file, CASE WHEN p_size % 2 = 0 THEN 'method' ELSE 'class' END AS kind, p_size::BIGINT AS line FROM part),
w AS (SELECT *, {_words_sql('name')} AS nw, {_words_sql('semantic_name')} AS sw, {_words_sql("regexp_extract(file, '([^/]*)[.]cs$', 1)")} AS fw FROM s),
t AS (SELECT unnest([{', '.join(repr(t) for t in TERMS)}]) AS term),
df AS (SELECT term, (SELECT count(*) FROM w WHERE list_contains(nw, term) OR list_contains(sw, term) OR list_contains(fw, term)) AS df FROM t)"""


def _rank_sql(seeds: str, k: int) -> str:
    points = lambda w: f"round_even({w} * (1 + ln(1 + (SELECT count(*) FROM w) / (1 + df))), 0)"
    return f"""WITH {SYMBOLS},
p AS (SELECT identity, sum(CASE WHEN list_contains(nw, term) THEN {points(180)} WHEN contains(lower(name), term) THEN {points(45)} WHEN list_contains(sw, term) THEN {points(70)} ELSE 0 END + CASE WHEN list_contains(fw, term) THEN {points(55)} ELSE 0 END) AS p FROM w, df GROUP BY identity),
r AS (SELECT w.identity, file, line, kind, p + CASE WHEN lower(name) = '{QUERY.lower()}' OR lower(semantic_name) = '{QUERY.lower()}' THEN 1000 ELSE 0 END AS base FROM w JOIN p USING (identity) WHERE {seeds})
SELECT identity, file, line, (base + CASE WHEN kind IN ('method', 'test') THEN 30 ELSE 0 END)::BIGINT AS score FROM r WHERE base > 0 ORDER BY score DESC, file, line, identity LIMIT {k}"""


@query(f"WITH {SYMBOLS} SELECT term, df FROM df")
def lexical_df(spark: SparkSession, d: str) -> DataFrame:
    _, df = lexical.document_frequency(_symbols(spark, d), TERMS)
    return spark.createDataFrame(list(df.items()), "term string, df bigint")


@query(_rank_sql("true", 20))
def lexical_rank(spark: SparkSession, d: str) -> DataFrame:
    return lexical.rank(lexical.score(_symbols(spark, d), QUERY, TERMS), 20).select("identity", "file", "line", "score")


def _reasons_sql() -> str:
    quoted, why = (lambda text, t: f"'{text} ' || chr(39) || '{t}' || chr(39)"), []
    for t in TERMS:
        why.append(f"CASE WHEN list_contains(nw, '{t}') THEN {quoted('symbol word matches', t)} WHEN contains(lower(name), '{t}') THEN {quoted('symbol name contains', t)} WHEN list_contains(sw, '{t}') THEN {quoted('semantic name matches word', t)} END")
        why.append(f"CASE WHEN list_contains(fw, '{t}') THEN {quoted('file name matches', t)} END")
    exact = f"CASE WHEN lower(name) = '{QUERY.lower()}' OR lower(semantic_name) = '{QUERY.lower()}' THEN 'exact symbol match' END"
    return f"""WITH {SYMBOLS}, r AS (SELECT identity, kind, list_filter([{", ".join([exact, *why])}], lambda x: x IS NOT NULL) AS why FROM w)
SELECT identity, array_to_string(list_concat(why, CASE WHEN kind IN ('method', 'test') THEN ['focused executable declaration'] ELSE [] END), '; ') AS reasons FROM r WHERE len(why) > 0"""


@query(_reasons_sql())
def lexical_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why each symbol that scores does so."""
    return lexical.score(_symbols(spark, d), QUERY, TERMS).select("identity", F.array_join("reasons", "; ").alias("reasons"))


@query(_rank_sql("line <= 10", 20))
def lexical_rank_changed_seed(spark: SparkSession, d: str) -> DataFrame:
    return lexical.rank(lexical.score(_symbols(spark, d), QUERY, TERMS, seeds=F.col("line") <= 10), 20).select("identity", "file", "line", "score")


@query(f"SELECT doc_id, array_to_string(list_sort({_words_sql('text')}), ' ') AS words FROM documents WHERE text IS NOT NULL")
def camel_tokenize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(F.array_sort(X.identifier_words(F.col("text"))), " ").alias("words"))


SCAN = ["the", "license", "thatation", "international", "und"]


def _line_scan_sql() -> str:
    weight = {t: 40 if len(t) >= 10 else 10 for t in SCAN}
    lw = " + ".join(f"(CASE WHEN contains(x, '{t}') THEN {w} ELSE 0 END)" for t, w in weight.items())
    counts = ", ".join(f"len(list_filter(lines, lambda x: contains(x, '{t}'))) AS c{i}" for i, t in enumerate(SCAN))
    total = " + ".join(f"least(c{i}, 3) * {w}" for i, w in enumerate(weight.values()))
    distinct = " + ".join(f"(c{i} > 0)::INT" for i in range(len(SCAN)))
    return f"""WITH l AS (SELECT doc_id, string_split(lower(coalesce(text, '')), chr(10)) AS lines FROM documents),
c AS (SELECT doc_id, list_transform(lines, lambda x: {lw}) AS ws, {counts} FROM l)
SELECT doc_id, ({total} + 15 * ({distinct}))::BIGINT AS file_score, list_position(ws, list_max(ws))::BIGINT AS best_line, ({distinct})::BIGINT AS distinct_terms FROM c WHERE {distinct} > 0"""


@query(_line_scan_sql())
def doc_line_scan(spark: SparkSession, d: str) -> DataFrame:
    return lexical.scan_lines(table(spark, d, "documents"), SCAN, "doc_id", "text")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(lower(text), chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents),
h AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS n FROM l WHERE contains(x, 'the')) SELECT doc_id, line FROM h WHERE n <= 3""")
def doc_term_cap3(spark: SparkSession, d: str) -> DataFrame:
    lines = F.split(F.lower("text"), "\n")
    hits = F.filter(F.transform(lines, lambda x, i: F.when(x.contains("the"), (i + 1).cast("bigint"))), lambda i: i.isNotNull())
    return table(spark, d, "documents").select("doc_id", F.explode(F.slice(hits, 1, 3)).alias("line"))


PATHS = "p AS (SELECT page_id, regexp_replace(regexp_extract(url, '://[^/]+/(.*)$', 1), '[?#].*$', '') AS path FROM pages)"


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_extract("url", "://[^/]+/(.*)$", 1), "[?#].*$", "").alias("path"))


SHARED_PATHS = ["fr/Directory.Build.props", "fr/My.sln", "fr/x.SLNX", "fr/.globalconfig", "fr/team.editorconfig", "fr/Global.json", "xx/NuGet.Config", "fr/a.ruleset", "fr/my.targets", "fr/json"]
PROJECT_ROWS = [("en/en.csproj",), ("fr/fr.csproj",), ("fr/fr2.csproj",), ("root.csproj",)]


@query(f"""WITH {PATHS}, u AS (SELECT DISTINCT path FROM p), pr(project, dir) AS (VALUES ('en/en.csproj', 'en'), ('fr/fr.csproj', 'fr'), ('fr/fr2.csproj', 'fr'), ('root.csproj', '')),
j AS (SELECT path, project, rank() OVER (PARTITION BY path ORDER BY length(dir) DESC) AS r FROM u JOIN pr ON dir = '' OR starts_with(path, dir || '/')) SELECT path, project FROM j WHERE r = 1""")
def ownership_nearest(spark: SparkSession, d: str) -> DataFrame:
    return ownership.nearest_owner(_paths(spark, d).select("path").distinct(), spark.createDataFrame(PROJECT_ROWS, "path string"))


@query(f"""WITH {PATHS}, u AS (SELECT DISTINCT path FROM p UNION SELECT unnest(['fr/Directory.Build.props', 'fr/My.sln', 'fr/x.SLNX', 'fr/.globalconfig', 'fr/team.editorconfig', 'fr/Global.json', 'xx/NuGet.Config', 'fr/a.ruleset', 'fr/my.targets', 'fr/json'])), pr(project, dir) AS (VALUES ('en/en.csproj', 'en'), ('fr/fr.csproj', 'fr'), ('fr/fr2.csproj', 'fr'), ('root.csproj', '')),
i AS (SELECT path, 'root.csproj' AS project FROM u WHERE path LIKE 'de/%'),
sh AS (SELECT path FROM u WHERE path NOT IN (SELECT path FROM i) AND (regexp_matches(lower(path), '(^|/)(global[.]json|nuget[.]config)$') OR regexp_matches(lower(path), '([.]props|[.]targets|[.]sln|[.]slnx|[.]ruleset|[.]editorconfig|[.]globalconfig)$'))),
j AS (SELECT path, project, rank() OVER (PARTITION BY path ORDER BY length(dir) DESC) AS r FROM u JOIN pr ON dir = '' OR starts_with(path, dir || '/') WHERE path NOT IN (SELECT path FROM i) AND path NOT IN (SELECT path FROM sh))
SELECT path, project, 'item' AS reason FROM i UNION ALL SELECT path, project, 'shared' FROM sh JOIN pr ON starts_with(path, 'fr/') AND starts_with(project, 'fr/') UNION ALL SELECT path, '*', 'shared everywhere' FROM sh WHERE NOT starts_with(path, 'fr/') UNION ALL SELECT path, project, 'nearest' FROM j WHERE r = 1""")
def ownership_tiers(spark: SparkSession, d: str) -> DataFrame:
    paths = _paths(spark, d).select("path").distinct().union(spark.createDataFrame([(p,) for p in SHARED_PATHS], "path string"))
    items = paths.where("path like 'de/%'").select("path", F.lit("root.csproj").alias("project"))
    return ownership.owners(paths, spark.createDataFrame(PROJECT_ROWS, "path string"), items)


@query(f"WITH {PATHS} SELECT page_id, path FROM p WHERE NOT regexp_matches(path, '^(?:.*/)?[^/]*[.]html(?:/.*)?$') AND NOT regexp_matches(path, '^fr/.*(?:/.*)?$')")
def glob_filter(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).where(~X.glob_match(F.col("path"), ["*.html", "./fr/**"]))


@query(f"""WITH {PATHS}, u AS (SELECT DISTINCT path FROM p WHERE path <> ''), k(key) AS (SELECT DISTINCT 'build/' || path FROM u WHERE path LIKE 'en/%' UNION SELECT DISTINCT regexp_extract(path, '([^/]*)$', 1) FROM u),
j AS (SELECT path, key, row_number() OVER (PARTITION BY path ORDER BY (path = key)::INT DESC, length(key) DESC, key) AS n FROM u JOIN k ON path = key OR ends_with(path, '/' || key) OR ends_with(key, '/' || path)) SELECT path, key FROM j WHERE n = 1""")
def suffix_coverage_lookup(spark: SparkSession, d: str) -> DataFrame:
    paths = _paths(spark, d).select("path").where("path <> ''").distinct()
    keys = paths.where("path like 'en/%'").select(F.concat(F.lit("build/"), "path").alias("key")).union(paths.select(F.regexp_extract("path", "([^/]*)$", 1).alias("key"))).distinct()
    return ownership.suffix_lookup(paths, keys)


@query("SELECT 'd' AS kind, doc_id AS id, ceil(length(text) / 4.0)::BIGINT AS tokens FROM documents UNION ALL SELECT 'c', conv_id * 1000 + turn, ceil(length(text) / 4.0)::BIGINT FROM conversations")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), X.token_estimate(F.col("text")).alias("tokens"))
    return docs.union(table(spark, d, "conversations").select(F.lit("c"), F.col("conv_id") * 1000 + F.col("turn"), X.token_estimate(F.col("text"))))


@query(r"SELECT doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '[\r\n]+'), lambda x: trim(x) <> ''))::BIGINT AS loc FROM documents")
def nonblank_loc(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.nonblank_lines(F.col("text")).alias("loc"))


@query(f"""SELECT * FROM {fingerprint_sql("documents", "source, lang", "doc_id || '|' || sha256(coalesce(text, ''))")}""")
def content_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return fingerprints(table(spark, d, "documents"), ["source", "lang"], F.concat_ws("|", "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256)))


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedupe_first_ordered(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.sha2("text", 256).alias("h"), "doc_id", "source")
    return first_struct(rows, ["h"], ["doc_id"]).select("doc_id", "source")


@query("SELECT source, array_to_string(list_sort(list_distinct(list(lang))), ',') AS modifiers, count(DISTINCT doc_id) AS members, min(doc_id) AS first_id FROM documents GROUP BY source")
def partial_merge(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("modifiers"), F.count_distinct("doc_id").alias("members"), F.min("doc_id").alias("first_id"))


@query("SELECT event_id, (json_extract_string(props, '$.k'))::BIGINT AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS target FROM pages) SELECT page_id, target, count(*) AS uses FROM m GROUP BY ALL""")
def markup_refs(spark: SparkSession, d: str) -> DataFrame:
    found = markup.positions(table(spark, d, "pages"), ["page_id"], "html", {}, {0: ('<a href="([^"]*)"', 1)})
    return found.groupBy("page_id", F.col("first").alias("target")).agg(F.count("*").alias("uses"))


@query("""SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<p>'))::BIGINT AS paragraphs FROM pages""")
def xml_like_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("lang"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<p>")).cast("bigint").alias("paragraphs"))


@query("""SELECT source, doc_id, used FROM (SELECT source, doc_id, (sum(ceil(length(text) / 4.0)) OVER (PARTITION BY source ORDER BY doc_id))::BIGINT AS used FROM documents) WHERE used <= 8000""")
def narrative_prefix_bound(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("source", "doc_id", X.token_estimate(F.col("text")).alias("tokens"))
    return metrics.prefix_within(rows, "source", "doc_id", "tokens", 8000).select("source", "doc_id", "used")


def _pack_sql() -> str:
    return f"""WITH RECURSIVE found AS ({_line_scan_sql()}),
top AS (SELECT file_score AS score, source AS file, best_line AS line, best_line + 12 AS end_line, doc_id AS id, string_split_regex(text, '\\r?\\n') AS ls FROM found JOIN documents USING (doc_id) ORDER BY score DESC, file, line, id LIMIT 20),
n AS (SELECT row_number() OVER (ORDER BY score DESC, file, line, id) AS i, file, line, end_line, ls[line:least(len(ls), end_line)] AS ls FROM top),
sized AS (SELECT i, file, line, end_line, list_transform(range(1, len(ls) + 1), lambda k: array_to_string(ls[1:k], chr(10))) AS sizes FROM n),
walk(i, rem, chosen) AS (
  SELECT 0::BIGINT, {max(64, 3000 - 550)}::BIGINT, []::STRUCT(file VARCHAR, line BIGINT, end_line BIGINT, text VARCHAR, cost BIGINT)[]
  UNION ALL
  SELECT i, CASE WHEN take THEN rem - cost ELSE rem END, CASE WHEN take THEN list_append(chosen, {{'file': file, 'line': line, 'end_line': end_line, 'text': cut, 'cost': cost}}) ELSE chosen END FROM (
    SELECT *, rem >= 32 AND cost <= rem AND len(list_filter(chosen, lambda c: lower(c.file) = lower(file) AND c.line <= end_line AND line <= c.end_line)) = 0 AS take FROM (
      SELECT *, (ceil(length(cut) / 4.0) + 16)::BIGINT AS cost FROM (
        SELECT s.*, rem, chosen, coalesce(list_filter(sizes, lambda x: length(x) <= greatest(32, (rem - 16) * 4))[-1], substr(sizes[1], 1, greatest(32, (rem - 16) * 4))) AS cut FROM walk JOIN sized s ON s.i = walk.i + 1)))
),
done AS (SELECT chosen FROM walk ORDER BY i DESC LIMIT 1)
SELECT p - 1 AS position, chosen[p].file AS file, chosen[p].line AS line, chosen[p].text AS text, chosen[p].cost AS cost FROM (SELECT chosen, unnest(range(1, len(chosen) + 1)) AS p FROM done)"""


@query(_pack_sql())
def budget_pack(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of the best documents packed into a budget; SQL walks the twenty ranked rows one by one."""
    docs = table(spark, d, "documents")
    found = lexical.scan_lines(docs.select("doc_id", "text", "source"), SCAN, "doc_id", "text").join(docs.select("doc_id", "source"), "doc_id")
    # Ids are ranked first: only the 20 texts that can be packed are fetched.
    top = F.broadcast(found.select(F.col("file_score").alias("score"), F.col("source").alias("file"), F.col("best_line").alias("line"), F.col("doc_id").alias("id")).orderBy(F.desc("score"), "file", "line", "id").limit(20))
    ranked = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("body")).join(top, "id").withColumn("end_line", F.col("line") + 12)
    return metrics.pack_budget(ranked.withColumn("text", metrics.block_excerpt(F.col("body"), F.col("line"), F.col("end_line"))).drop("body"), 3000, 20)
