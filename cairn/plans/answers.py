"""Queries over whole answers: bounded narratives, merged types, affected sets, scan limits, expectations, inventories."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import affected as affected_sets_of
from cairn.operators import benchmark, inventory, lexical, narrative, types
from cairn.plans.registry import query
from cairn.session import table

BUDGET = 20_000
ITEMS = "i AS (SELECT source AS series, CASE lang WHEN 'en' THEN 'type_definitions' WHEN 'fr' THEN 'symbols' ELSE 'hotspots' END AS dimension, doc_id AS position, coalesce(length(text), 0) AS size FROM documents)"


def _narrative_sql(rest: str) -> str:
    def line(kept: dict[str, str]) -> str:
        parts = ", ".join(f"CASE WHEN total_{d} - {kept[d]} > 0 THEN (total_{d} - {kept[d]})::VARCHAR || ' of ' || total_{d} || ' {label}' END" for d, label, _ in narrative.CLEARED)
        return f"(SELECT CASE WHEN len(p) > 0 THEN '{narrative.GAP_HEAD}' || array_to_string(p, ', ') || '{narrative.GAP_TAIL}' END FROM (SELECT list_filter([{parts}], lambda x: x IS NOT NULL) AS p))"

    def fits(kept: dict[str, str], sizes: dict[str, str]) -> str:
        return f"ceil((500 + {' + '.join(sizes.values())} + coalesce(length({line(kept)}) + 3, 0)) / 4.0) <= {BUDGET}"

    names = [d for d, _, _ in narrative.CLEARED]
    count, size = {d: f"total_{d}" for d in names}, {d: f"size_{d}" for d in names}
    cleared = lambda n, own: {d: "0" if i <= n else own[d] for i, d in enumerate(names)}
    at = lambda n, own, now: {d: "0" if i < n else now if i == n else own[d] for i, d in enumerate(names)}
    holds = " ".join(f"WHEN cut = {n} THEN dimension = '{d}' AND {fits(at(n, count, 'nth'), at(n, size, 'upto'))}" for n, d in enumerate(names))
    kept = ", ".join(f"CASE WHEN cut > {n} THEN 0 WHEN cut = {n} THEN least(total_{d}, greatest(coalesce(largest, 0), {least})) ELSE total_{d} END AS kept_{d}" for n, (d, _, least) in enumerate(narrative.CLEARED))
    return f"""WITH {ITEMS},
p AS (SELECT *, sum(size) OVER w AS upto, row_number() OVER w AS nth FROM i WINDOW w AS (PARTITION BY series, dimension ORDER BY position)),
t AS (SELECT series, {", ".join(f"coalesce(sum(size) FILTER (WHERE dimension = '{d}'), 0) AS size_{d}, count(*) FILTER (WHERE dimension = '{d}') AS total_{d}" for d in names)} FROM i GROUP BY series),
c AS (SELECT *, CASE WHEN {fits(count, size)} THEN -1 WHEN {fits(cleared(0, count), cleared(0, size))} THEN 0 WHEN {fits(cleared(1, count), cleared(1, size))} THEN 1 ELSE 2 END AS cut FROM t),
b AS (SELECT series, max(nth) AS largest FROM p JOIN c USING (series) WHERE CASE {holds} ELSE false END GROUP BY series),
k AS (SELECT c.*, {kept} FROM c LEFT JOIN b USING (series)),
g AS (SELECT *, {line({d: f"kept_{d}" for d in names})} AS gap FROM k),
items AS (SELECT p.* FROM p JOIN k USING (series) WHERE nth <= CASE dimension {" ".join(f"WHEN '{d}' THEN kept_{d}" for d in names)} END)
{rest}"""


def _narrative(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    dimension = F.when(F.col("lang") == "en", "type_definitions").when(F.col("lang") == "fr", "symbols").otherwise("hotspots")
    items = table(spark, d, "documents").select(F.col("source").alias("series"), dimension.alias("dimension"), F.col("doc_id").alias("position"), F.length("text").alias("size"))
    return narrative.bound_narrative(items, F.lit(500), BUDGET)


@query(_narrative_sql("SELECT series, ceil((500 + coalesce((SELECT sum(size) FROM items WHERE items.series = g.series), 0) + coalesce(length(gap) + 3, 0)) / 4.0)::BIGINT AS tokens, gap IS NOT NULL AS truncated, gap, kept_type_definitions::BIGINT AS kept_type_definitions, kept_symbols::BIGINT AS kept_symbols, kept_hotspots::BIGINT AS kept_hotspots, total_type_definitions, total_symbols, total_hotspots FROM g"))
def narrative_report(spark: SparkSession, d: str) -> DataFrame:
    """What each source's narrative keeps within its budget, and what it says it dropped."""
    return _narrative(spark, d)[0]


@query(_narrative_sql("SELECT series, dimension, position, nth, size FROM items"))
def narrative_items(spark: SparkSession, d: str) -> DataFrame:
    return _narrative(spark, d)[1]


# A type is a customer, a fragment an order, a member a line: lines of equal part and supplier are one member.
KIND_OF = "CASE {} % 6 WHEN 0 THEN 'partial' WHEN 1 THEN 'static' WHEN 2 THEN 'odd' WHEN 3 THEN 'abstract' WHEN 4 THEN 'alpha' ELSE 'sealed' END"


@query(f"""WITH fr AS (SELECT 't' || o_custkey AS id, concat('src/', o_orderkey % 7, '.cs') AS file, o_orderkey AS line, o_orderkey + 9 AS end_line, o_orderpriority AS kind, {KIND_OF.format("o_orderkey")} AS modifier, o_clerk AS interface, o_orderstatus AS attribute, o_orderkey FROM (SELECT *, 'I' || o_orderkey % 5 AS o_clerk FROM orders)),
ms AS (SELECT id, 'm' || l_partkey % 40 || '.' || l_suppkey % 3 AS member, l_linenumber % 3 AS file, l_quantity::BIGINT AS line, row_number() OVER (PARTITION BY id, 'm' || l_partkey % 40 || '.' || l_suppkey % 3 ORDER BY fr.file, fr.line, l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM fr JOIN lineitem ON l_orderkey = o_orderkey),
m AS (SELECT id, string_agg(member || '@' || file || ':' || line, ',' ORDER BY file, line, member) AS members FROM ms WHERE n = 1 GROUP BY id),
k AS (SELECT id, arg_min(kind, (file, line)) AS kind, string_agg(DISTINCT interface, ',' ORDER BY interface) AS interfaces, string_agg(DISTINCT attribute, ',' ORDER BY attribute) AS attributes, count(*) AS declarations FROM (SELECT id, kind, interface, attribute, file, line FROM fr) GROUP BY id),
o AS (SELECT DISTINCT id, modifier, list_position(['file', 'new', 'static', 'abstract', 'virtual', 'override', 'sealed', 'readonly', 'ref', 'const', 'required', 'async', 'extern', 'unsafe', 'partial'], modifier) AS p FROM fr)
SELECT k.id AS identity, kind, (SELECT string_agg(modifier, ',' ORDER BY CASE WHEN p IS NULL OR p = 0 THEN 99 ELSE p END, modifier) FROM o WHERE o.id = k.id) AS modifiers, attributes, interfaces, coalesce(members, '') AS members, declarations FROM k LEFT JOIN m USING (id)""")
def partial_types(spark: SparkSession, d: str) -> DataFrame:
    """Fragments of partial types merged into definitions."""
    line = table(spark, d, "lineitem")
    member = F.struct(F.expr("concat('m', l_partkey % 40, '.', l_suppkey % 3)").alias("identity"), F.expr("l_linenumber % 3").alias("file"), F.col("l_quantity").cast("bigint").alias("line"))
    members = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", member.alias("m")))), lambda x: x["m"]).alias("members"))
    orders = table(spark, d, "orders").join(members, "o_orderkey", "left")
    fragments = orders.select(
        F.concat(F.lit("t"), "o_custkey").alias("identity"), F.expr("concat('src/', o_orderkey % 7, '.cs')").alias("file"), F.col("o_orderkey").alias("line"), (F.col("o_orderkey") + 9).alias("end_line"), F.col("o_orderpriority").alias("kind"),
        F.array(F.expr(KIND_OF.format("o_orderkey"))).alias("modifiers"), F.array(F.struct(F.col("o_orderstatus").alias("name"), F.array().cast("array<string>").alias("arguments"))).alias("attributes"), F.array(F.expr("concat('I', o_orderkey % 5)")).alias("interfaces"), "members",
    )
    out = types.merge_partial_types(fragments)
    text = lambda c, f: F.array_join(F.transform(c, f), ",")
    return out.select("identity", "kind", F.array_join("modifiers", ",").alias("modifiers"), text("attributes", lambda a: a["name"]).alias("attributes"), F.array_join("interfaces", ",").alias("interfaces"),
                      text("members", lambda m: F.concat(m["identity"], F.lit("@"), m["file"].cast("string"), F.lit(":"), m["line"].cast("string"))).alias("members"), F.size("declarations").cast("bigint").alias("declarations"))


# Symbols of a change set: regions, nations, customers and suppliers use each other in this order; some customers are gone, some are new.
SYMBOL_SQL = {
    "region": "SELECT 'r' || r_regionkey AS identity, 'class' AS kind, 'R' || r_regionkey AS name, 'N' AS namespace, CAST(NULL AS STRING) AS containing_type, 'core/core.csproj' AS project, concat('core/r', r_regionkey, '.cs') AS file FROM region",
    "nation": "SELECT 'n' || n_nationkey, 'method', 'M' || n_nationkey, 'N', 'T', concat('lib', n_nationkey % 5, '/lib.csproj'), concat('lib', n_nationkey % 5, '/n', n_nationkey, '.cs') FROM nation",
    "customer": "SELECT 'c' || c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'test' ELSE 'method' END, 'case' || c_custkey % 30, 'T', concat('C', c_custkey % 10), concat('app', c_custkey % 8, '/app.csproj'), concat('app', c_custkey % 8, '/c', c_custkey % 50, '.cs') FROM customer",
    "supplier": "SELECT 's' || s_suppkey, 'method', 'S' || s_suppkey, 'N', 'U', concat('tool', s_suppkey % 3, '/tool.csproj'), concat('tool', s_suppkey % 3, '/s.cs') FROM supplier",
}
REFERENCE_SQL = """SELECT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target, concat('lib', n_nationkey % 5, '/lib.csproj') AS source_project FROM nation
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, concat('app', c_custkey % 8, '/app.csproj') FROM customer UNION ALL SELECT 's' || s_suppkey, 'c' || s_suppkey, concat('tool', s_suppkey % 3, '/tool.csproj') FROM supplier"""
PROJECTS = [("core/core.csproj", False), *[(f"lib{i}/lib.csproj", False) for i in range(5)], *[(f"app{i}/app.csproj", i % 2 == 0) for i in range(8)], *[(f"tool{i}/tool.csproj", False) for i in range(3)]]
DEPENDENCIES = [*[(f"app{i}/app.csproj", f"LIB{i % 5}/lib.csproj") for i in range(8)], *[(f"lib{i}/lib.csproj", "core/core.csproj") for i in range(2)], *[(f"tool{i}/tool.csproj", f"app{i}/app.csproj") for i in range(3)]]
CHANGED = ["core/r1.cs", "LIB2/n2.cs", "extra/x.cs", "lib3/Directory.Build.props", "docs/readme.md"]


def _layers(name: str, seeds: str, edges: str, depth: int) -> str:
    """CTEs of a closure's waves: name (id, seed, wave)."""
    out = [f"{name}0 AS (SELECT id, min(seed) AS seed FROM ({seeds}) GROUP BY id)"]
    for n in range(1, depth + 1):
        known = " UNION ALL ".join(f"SELECT id FROM {name}{i}" for i in range(n))
        out.append(f"{name}{n} AS (SELECT e.target AS id, min(seed) AS seed FROM {edges} e JOIN {name}{n - 1} ON e.source = id WHERE e.target NOT IN ({known}) GROUP BY e.target)")
    every = " UNION ALL ".join(f"SELECT *, {n}::BIGINT AS wave FROM {name}{n}" for n in range(depth + 1))
    return ", ".join([*out, f"{name} AS ({every})"])


def _affected_sql() -> str:
    rows = lambda values: ", ".join(f"({', '.join(repr(v) if isinstance(v, str) else str(v).lower() for v in r)})" for r in values)
    low = [(a.lower(), b.lower()) for a, b in DEPENDENCIES]
    return f"""WITH symbols AS ({" UNION ALL ".join(SYMBOL_SQL.values()).replace("CAST(NULL AS STRING)", "NULL::VARCHAR")}), sym AS (SELECT * FROM symbols WHERE NOT (starts_with(identity, 'c') AND substr(identity, 2)::INT % 15 = 0)),
refs AS ({REFERENCE_SQL}), changed(path) AS (VALUES {rows([(c,) for c in CHANGED])}), projects(path, is_test) AS (VALUES {rows(PROJECTS)}), back AS (SELECT DISTINCT target AS source, source AS target FROM refs), up(target, source) AS (VALUES {rows(low)}),
{_layers("reach", "SELECT identity AS id, path AS seed FROM sym JOIN changed ON lower(file) = lower(path)", "back", 5)},
owned(id, seed) AS (VALUES ('core/core.csproj', 'core/r1.cs'), ('tool1/tool.csproj', 'extra/x.cs'), ('lib3/lib.csproj', 'lib3/Directory.Build.props')),
byref AS (SELECT lower(source_project) AS id, seed FROM refs JOIN reach ON refs.source = reach.id AND wave > 0 WHERE refs.target IN (SELECT id FROM reach)),
seeds AS (SELECT id, min((via, seed)).via AS via, min((via, seed)).seed AS seed FROM (SELECT id, {{'via': 0, 'seed': seed}} AS s, 0 AS via, seed FROM owned UNION ALL SELECT id, {{'via': 1, 'seed': seed}}, 1, seed FROM byref) GROUP BY id),
{_layers("spread", "SELECT id, seed FROM seeds", "up", 5)},
hit AS (SELECT sym.*, reach.seed, reach.wave FROM sym JOIN reach ON sym.identity = reach.id),
pr AS (SELECT spread.id, CASE via WHEN 0 THEN 'owner' WHEN 1 THEN 'reference' ELSE 'dependency' END AS via, spread.seed, wave FROM spread LEFT JOIN seeds ON spread.id = seeds.id),
ts AS (SELECT pr.* FROM pr JOIN projects ON pr.id = path AND is_test),
cases AS (SELECT concat_ws('.', namespace, containing_type, name) AS id, wave, seed FROM hit WHERE kind = 'test' AND project IN (SELECT id FROM ts))
SELECT 'symbol' AS what, identity AS id, CASE WHEN wave = 0 THEN 'changed' ELSE 'reference' END AS via, seed, wave FROM hit UNION ALL SELECT 'project', id, via, seed, wave FROM pr UNION ALL SELECT 'test-project', id, via, seed, wave FROM ts
UNION ALL SELECT 'test-case', id, CASE WHEN min(wave) = 0 THEN 'changed' ELSE 'reference' END, arg_min(seed, (wave, seed)), min(wave) FROM cases GROUP BY id"""


@query(_affected_sql().replace("min((via, seed)).via AS via, min((via, seed)).seed AS seed", "min(via) AS via, arg_min(seed, (via, seed)) AS seed").replace("{'via': 0, 'seed': seed} AS s, ", "").replace("{'via': 1, 'seed': seed}, ", ""))
def affected_sets(spark: SparkSession, d: str) -> DataFrame:
    """Symbols, projects, test projects and test names that a change set affects, over what was and what is."""
    tables = {n: table(spark, d, n) for n in SYMBOL_SQL}
    run = lambda sql: spark.sql(re.sub(rf"FROM ({'|'.join(tables)})", r"FROM {\1}", sql), **{n: t for n, t in tables.items() if f"FROM {n}" in sql})
    symbols = run(" UNION ALL ".join(SYMBOL_SQL.values()))
    number = F.when(F.col("identity").startswith("c"), F.expr("cast(substring(identity, 2) AS int)")).otherwise(1)
    both = affected_sets_of.united(symbols.where(number % 3 != 0), symbols.where(number % 5 != 0), "identity")
    items = spark.createDataFrame([("extra/x.cs", "tool1/tool.csproj")], "path string, project string")
    return affected_sets_of.affected(spark.createDataFrame([(c,) for c in CHANGED], "path string"), both, run(REFERENCE_SQL), spark.createDataFrame(PROJECTS, "path string, is_test boolean"), items, spark.createDataFrame(DEPENDENCIES, "source string, target string"))


EXPECTED_FORMS = ["Override", " method-CALL ", "nothing", "override: s/1.cs -> p/1.cs", "Attribute: \\s/2.cs -> P/3.cs", "Attribute: s/2.cs -> p/3.cs", "method-call: s/77.cs -> p/0.cs", "call: s/1.cs -> p/1.cs"]


@query(f"""WITH rel AS (SELECT DISTINCT 'c' || l_linenumber AS "case", 's' || l_suppkey AS a, 'p' || l_partkey AS b, CASE WHEN l_returnflag = 'A' THEN 'override' WHEN l_returnflag = 'R' THEN 'method-call' ELSE 'attribute' END AS kind FROM lineitem WHERE l_linenumber <= 6),
bl AS (SELECT DISTINCT 'c' || l_linenumber AS "case", 's' || l_suppkey AS block, concat('s/', l_suppkey % 40, '.cs') AS file FROM lineitem UNION SELECT DISTINCT 'c' || l_linenumber, 'p' || l_partkey, concat('p/', l_partkey % 9, '.cs') FROM lineitem WHERE l_partkey % 2 = 0),
x(kind, a, b, expected) AS (VALUES ('override', NULL, NULL, 'Override'), ('method-call', NULL, NULL, ' method-CALL '), ('nothing', NULL, NULL, 'nothing'), ('override', 's/1.cs', 'p/1.cs', 'override: s/1.cs -> p/1.cs'), ('attribute', 's/2.cs', 'p/3.cs', 'Attribute: s/2.cs -> p/3.cs'),
  ('attribute', 's/2.cs', 'p/3.cs', chr(65) || 'ttribute: ' || chr(92) || 's/2.cs -> P/3.cs'), ('method-call', 's/77.cs', 'p/0.cs', 'method-call: s/77.cs -> p/0.cs'), ('call', 's/1.cs', 'p/1.cs', 'call: s/1.cs -> p/1.cs')),
pl AS (SELECT rel."case", kind, s.file AS a, p.file AS b FROM rel JOIN bl s ON rel."case" = s."case" AND rel.a = s.block JOIN bl p ON rel."case" = p."case" AND rel.b = p.block)
SELECT cs."case", expected FROM (SELECT DISTINCT "case" FROM bl) cs, x WHERE (x.a IS NULL AND NOT EXISTS (SELECT 1 FROM rel WHERE rel."case" = cs."case" AND rel.kind = x.kind)) OR (x.a IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pl WHERE pl."case" = cs."case" AND pl.kind = x.kind AND pl.a = x.a AND pl.b = x.b))""")
def missing_relationships(spark: SparkSession, d: str) -> DataFrame:
    """Expected relationships of every case (one for each line number) that nothing in it meets."""
    line = table(spark, d, "lineitem").withColumn("case", F.concat(F.lit("c"), "l_linenumber"))
    side = lambda letter, key, n: line.select("case", F.concat(F.lit(letter), key).alias("block"), F.concat(F.lit(f"{letter}/"), F.col(key) % n, F.lit(".cs")).alias("file"))
    blocks = side("s", "l_suppkey", 40).union(side("p", "l_partkey", 9).where("int(substring(block, 2)) % 2 = 0")).distinct()
    kind = F.when(F.col("l_returnflag") == "A", "override").when(F.col("l_returnflag") == "R", "method-call").otherwise("attribute")
    actual = line.where("l_linenumber <= 6").select("case", F.concat(F.lit("s"), "l_suppkey").alias("source_block"), F.concat(F.lit("p"), "l_partkey").alias("target_block"), kind.alias("relationship"))
    expected = blocks.select("case").distinct().select("case", F.explode(F.lit(EXPECTED_FORMS)).alias("expected"))
    return benchmark.missing_relationships(expected, actual, blocks)


@query("""WITH r AS (SELECT source, avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END) AS recall, avg(CASE WHEN toxic = 0 THEN 1.0 ELSE 0.0 END) AS precision, sum(ceil(n_chars / 4.0))::BIGINT AS tokens, count(*) FILTER (WHERE toxic = 1) AS failures, min(doc_id) % 2 = 0 AS advisory FROM documents JOIN labels USING (doc_id) GROUP BY source)
SELECT count(*) AS cases, round(avg(recall), 9) AS mean_recall, round(avg(precision), 9) AS mean_precision, sum(tokens)::BIGINT AS total_tokens, bool_and(failures = 0 OR advisory) AS passed, count(*) FILTER (WHERE failures > 0 AND advisory) AS advisory_failures FROM r""")
def benchmark_summary(spark: SparkSession, d: str) -> DataFrame:
    """A benchmark's summary with one case a source."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    cases = rows.groupBy(F.col("source").alias("case")).agg(share(F.col("quality") == 1).alias("file_recall"), share(F.col("toxic") == 0).alias("file_precision"), F.sum(F.ceil(F.col("n_chars") / 4)).alias("tokens"), F.count_if(F.col("toxic") == 1).alias("failures"), (F.min("doc_id") % 2 == 0).alias("advisory"))
    return benchmark.benchmark_summary(cases).withColumns({c: F.round(c, 9) for c in ("mean_recall", "mean_precision")})


IGNORE = [("# built files", ""), ("*.html", ""), ("!1*.html", ""), ("/fr/", ""), ("!fr/9", ""), ("2?", "en"), ("", ""), ("bin2/", ""), ("**/77[0-4]", ""), ("!774", "en")]


@query("""WITH u AS (SELECT DISTINCT regexp_replace(regexp_extract(url, '://[^/]+/(.*)$', 1), '[?#].*$', '') AS p FROM pages), f AS (SELECT DISTINCT path FROM (SELECT p AS path FROM u UNION ALL SELECT 'bin2/' || p FROM u UNION ALL SELECT p || '/bin/x' FROM u UNION ALL SELECT p || '/y.md' FROM u) WHERE path <> '')
SELECT path FROM f WHERE NOT regexp_matches(path, '(^|/)(bin|obj|[.]git|[.]idea|[.]dev-context)/') AND NOT regexp_matches(path, '(^|/)853(/|$)') AND NOT starts_with(path, 'fr/') AND NOT starts_with(path, 'bin2/')
AND NOT (regexp_matches(path, '(^|/)[^/]*[.]html(/|$)') AND NOT regexp_matches(path, '(^|/)1[^/]*[.]html(/|$)')) AND NOT regexp_matches(path, '^en/(.*/)?2[^/](/|$)') AND NOT (regexp_matches(path, '(^|/)77[0-4](/|$)') AND NOT regexp_matches(path, '^en/(.*/)?774(/|$)'))""")
def file_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Paths of pages, and made ones below them, that folders, globs and ignore rules leave."""
    p = table(spark, d, "pages").select(F.regexp_replace(F.regexp_extract("url", "://[^/]+/(.*)$", 1), "[?#].*$", "").alias("p"))
    files = p.select(F.explode(F.array(F.col("p"), F.concat(F.lit("./bin2/"), "p"), F.concat("p", F.lit("\\bin\\x")), F.concat("p", F.lit("/y.md")))).alias("path"))
    rules = [r for r in (inventory.compile_rule(line, folder) for line, folder in IGNORE) if r]
    return inventory.inventory(files, rules, ["853"])


LIMITS = {"most_files": 150, "most_bytes": 5000}
SCANNED = ["the", "license", "international"]


def _limited_sql(rest: str) -> str:
    weight = {t: 40 if len(t) >= 10 else 10 for t in SCANNED}
    lw = " + ".join(f"(CASE WHEN contains(x, '{t}') THEN {w} ELSE 0 END)" for t, w in weight.items())
    counts = ", ".join(f"len(list_filter(lines, lambda x: contains(x, '{t}'))) AS c{i}" for i, t in enumerate(SCANNED))
    total, distinct = " + ".join(f"least(c{i}, 3) * {w}" for i, w in enumerate(weight.values())), " + ".join(f"(c{i} > 0)::INT" for i in range(len(SCANNED)))
    return f"""WITH f AS (SELECT source || '/' || lpad(doc_id::VARCHAR, 9, '0') AS path, coalesce(text, '') AS text, strlen(coalesce(text, '')) AS bytes, lang = 'de' AS excluded FROM documents),
n AS (SELECT *, row_number() OVER (ORDER BY path) AS n FROM f),
s AS (SELECT path, string_split(lower(text), chr(10)) AS lines FROM n WHERE n <= {LIMITS["most_files"]} AND NOT excluded AND bytes <= {LIMITS["most_bytes"]}),
c AS (SELECT path, list_transform(lines, lambda x: {lw}) AS ws, {counts} FROM s),
h AS (SELECT path, ({total} + 15 * ({distinct}))::BIGINT AS file_score, list_position(ws, list_max(ws))::BIGINT AS best_line, ({distinct})::BIGINT AS distinct_terms FROM c WHERE {distinct} > 0)
{rest}"""


def _limited(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    text = F.coalesce("text", F.lit(""))
    files = table(spark, d, "documents").select(F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), text.alias("text"), F.octet_length(text).alias("bytes"), (F.col("lang") == "de").alias("excluded"))
    return lexical.scan_limited(files, SCANNED, **LIMITS)


@query(_limited_sql("SELECT * FROM h"))
def lexical_scan_limited(spark: SparkSession, d: str) -> DataFrame:
    """Hits of a line scan that stops after so many files by path and passes over large ones."""
    return _limited(spark, d)[0]


@query(_limited_sql(f"""SELECT unnest(list_filter([CASE WHEN (SELECT count(*) FROM f) > {LIMITS["most_files"]} THEN 'Scanned {LIMITS["most_files"]} of ' || (SELECT count(*) FROM f) || ' candidate files for lexical evidence in path order; later paths were not examined.' END,
CASE WHEN (SELECT count(*) FROM n WHERE n <= {LIMITS["most_files"]} AND NOT excluded AND bytes > {LIMITS["most_bytes"]}) > 0 THEN 'Skipped ' || (SELECT count(*) FROM n WHERE n <= {LIMITS["most_files"]} AND NOT excluded AND bytes > {LIMITS["most_bytes"]}) || ' file(s) larger than indexing.maxEvidenceFileBytes when scanning for lexical evidence.' END], lambda x: x IS NOT NULL)) AS gap"""))
def lexical_scan_gaps(spark: SparkSession, d: str) -> DataFrame:
    """What that scan did not look at."""
    return _limited(spark, d)[1]


@query(_limited_sql("SELECT count(*) AS blocks, CASE WHEN count(*) = 0 THEN 'Insufficient' ELSE 'Partial' END AS decision FROM h"))
def lexical_scan_decision(spark: SparkSession, d: str) -> DataFrame:
    """The decision over that scan: gaps make it partial, however many hits there are."""
    hits, gaps = _limited(spark, d)
    return lexical.scan_decision(hits, gaps)
