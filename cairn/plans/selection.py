"""Queries of selections, names, labels and decisions over analogues in the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import names as N
from cairn.operators import bundle, decisions, selection
from cairn.plans.registry import query
from cairn.session import table

KIND = "CASE p_size % 6 WHEN 0 THEN 'class' WHEN 1 THEN 'Method' WHEN 2 THEN 'interface' WHEN 3 THEN 'test' WHEN 4 THEN 'enum' ELSE 'property' END"
FILE = "concat('src/', p_type, '/', replace(p_name, ' ', '_'), '.cs')"
SYMBOLS = f"symbols AS (SELECT p_partkey AS id, {KIND} AS kind, p_name AS name, p_brand AS project, {FILE} AS file, CAST(p_size AS BIGINT) AS line FROM part)"
PROJECTS = "projects AS (SELECT concat('BRAND#', n_nationkey) AS path, n_name AS name, n_regionkey = 3 AS is_test FROM nation WHERE n_nationkey > 4)"
JOINED = f"{SYMBOLS}, {PROJECTS}, joined AS (SELECT s.*, p.name AS project_name, coalesce(is_test, false) AS is_test FROM symbols s LEFT JOIN projects p ON lower(s.project) = lower(p.path))"


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr("p_partkey AS id", f"{KIND} AS kind", "p_name AS name", "p_brand AS project", f"{FILE} AS file", "CAST(p_size AS BIGINT) AS line")


def _joined(spark: SparkSession, d: str) -> DataFrame:
    projects = table(spark, d, "nation").where("n_nationkey > 4").selectExpr("concat('BRAND#', n_nationkey) AS path", "n_name AS name", "n_regionkey = 3 AS is_test")
    return selection.with_project(_symbols(spark, d), projects)


@query(f"WITH {JOINED} SELECT id, project_name FROM joined WHERE NOT is_test")
def symbols_production(spark: SparkSession, d: str) -> DataFrame:
    return selection.production_only(_joined(spark, d)).select("id", "project_name")


@query(f"WITH {JOINED} SELECT id FROM joined WHERE contains(lower(project), 'tion_1') OR coalesce(contains(lower(project_name), 'tion_1'), false)")
def symbols_in_project(spark: SparkSession, d: str) -> DataFrame:
    return _joined(spark, d).where(selection.in_project("tion_1")).select("id")


@query(f"WITH {SYMBOLS} SELECT id, kind FROM symbols WHERE lower(kind) IN ('class', 'method')")
def symbols_of_kind(spark: SparkSession, d: str) -> DataFrame:
    return _symbols(spark, d).where(selection.of_kind(["CLASS", "method"])).select("id", "kind")


CHANGED = f"changed AS (SELECT DISTINCT upper({FILE}) AS path FROM part WHERE p_type = 'PROMO' AND p_size < 9 UNION SELECT 'docs/none.md')"


def _changed(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "part").where("p_type = 'PROMO' AND p_size < 9").selectExpr(f"upper({FILE}) AS path")
    return found.union(spark.range(1).select(F.lit("docs/none.md"))).distinct()


@query(f"WITH {SYMBOLS}, {CHANGED} SELECT id FROM symbols WHERE lower(file) IN (SELECT lower(path) FROM changed)")
def symbols_changed(spark: SparkSession, d: str) -> DataFrame:
    return selection.in_files(_symbols(spark, d), _changed(spark, d)).select("id")


def _owned(spark: SparkSession, d: str) -> DataFrame:
    return _joined(spark, d).select("project", "project_name", F.col("file").alias("path"))


@query(f"WITH {JOINED}, {CHANGED} SELECT DISTINCT j.project, c.path FROM changed c LEFT JOIN joined j ON lower(c.path) = lower(j.file)")
def scope_changed(spark: SparkSession, d: str) -> DataFrame:
    return selection.scope_files(_owned(spark, d), "changed", changed=_changed(spark, d))


@query(f"WITH {JOINED} SELECT DISTINCT project, file AS path FROM joined WHERE lower(project_name) = 'nation_7' OR lower(project) = 'nation_7'")
def scope_project(spark: SparkSession, d: str) -> DataFrame:
    return selection.scope_files(_owned(spark, d), "project", "Nation_7")


@query(f"WITH {JOINED} SELECT DISTINCT project, file AS path FROM joined WHERE lower(file) = 'src/promo' OR starts_with(lower(file), 'src/promo/')")
def scope_path(spark: SparkSession, d: str) -> DataFrame:
    return selection.scope_files(_owned(spark, d), "path", "SRC\\promo/")


DIAGNOSTICS = "diagnostics AS (SELECT event_id AS id, CASE WHEN event_type <> 'error' THEN concat('src/', event_type, '/', CAST(user_id % 10 AS VARCHAR(9)), '.cs') END AS file FROM events)"
IN_SCOPE = "files AS (SELECT concat('SRC/click/', CAST(n_nationkey AS VARCHAR(9)), '.cs') AS path FROM nation WHERE n_nationkey < 4)"


@query(f"WITH {DIAGNOSTICS}, {IN_SCOPE} SELECT id, file FROM diagnostics WHERE file IS NULL OR lower(file) IN (SELECT lower(path) FROM files)")
def diagnostics_in_scope(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "events").selectExpr("event_id AS id", "CASE WHEN event_type <> 'error' THEN concat('src/', event_type, '/', user_id % 10, '.cs') END AS file")
    files = table(spark, d, "nation").where("n_nationkey < 4").selectExpr("concat('SRC/click/', n_nationkey, '.cs') AS path")
    return selection.diagnostics_in_scope(found, files)


@query(f"WITH {SYMBOLS}, {CHANGED} SELECT id, file, line FROM symbols WHERE lower(file) IN (SELECT lower(path) FROM changed) AND kind IN ('class', 'record', 'struct', 'interface', 'enum') ORDER BY file, line, id LIMIT 40")
def symbol_selection(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report: the first 40 types."""
    return selection.select_symbols(_symbols(spark, d), _changed(spark, d), None, True, 40).select("id", "file", "line")


@query(f"""WITH {SYMBOLS}, {CHANGED}, spread AS (SELECT concat(project, '/', name) AS id, file, line FROM symbols),
firsts AS (SELECT id, min((file, line)) AS f FROM spread GROUP BY id)
SELECT id, f[1] AS file, f[2] AS line FROM firsts WHERE id IN (SELECT id FROM spread WHERE lower(file) IN (SELECT lower(path) FROM changed)) ORDER BY f[1], f[2], id LIMIT 40""")
def type_selection(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report: the first 40 types with a declaration in the changed files."""
    types = _symbols(spark, d).groupBy(F.concat_ws("/", "project", "name").alias("id")).agg(F.array_sort(F.collect_set(F.struct("file", "line"))).alias("declarations"))
    return selection.select_types(types, _changed(spark, d), 40).select("id", F.col("declarations")[0]["file"].alias("file"), F.col("declarations")[0]["line"].alias("line"))


BLOCK_KIND = "CASE l_returnflag WHEN 'A' THEN 'override' ELSE 'method-call' END"


@query(f"""WITH blocks AS (SELECT concat('E', p_partkey) AS block, p_partkey AS symbol FROM part WHERE p_partkey < 60),
edges AS (SELECT l_partkey AS source, l_suppkey AS target, {BLOCK_KIND} AS relationship FROM lineitem)
SELECT DISTINCT a.block AS source_block, b.block AS target_block, relationship FROM edges JOIN blocks a ON a.symbol = source JOIN blocks b ON b.symbol = target ORDER BY 1, 2, 3 LIMIT 40""")
def block_relationships(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report: 40 edges between the chosen blocks."""
    blocks = table(spark, d, "part").where("p_partkey < 60").selectExpr("concat('E', p_partkey) AS block", "p_partkey AS symbol")
    return selection.block_edges(table(spark, d, "lineitem").selectExpr("l_partkey AS source", "l_suppkey AS target", f"{BLOCK_KIND} AS relationship"), blocks)


@query(f"""WITH {SYMBOLS}, methods AS (SELECT file, line, name, line - 1 AS owner_line FROM symbols WHERE kind = 'test'),
own AS (SELECT file, line, name, min(id) AS symbol FROM symbols WHERE kind IN ('method', 'test') GROUP BY ALL),
types AS (SELECT file, line AS owner_line, min(id) AS owner FROM symbols WHERE kind IN ('class', 'record', 'struct', 'interface', 'enum') GROUP BY ALL)
SELECT DISTINCT symbol, owner FROM methods JOIN own USING (file, line, name) JOIN types USING (file, owner_line)""")
def method_owner(spark: SparkSession, d: str) -> DataFrame:
    symbols = _symbols(spark, d)
    methods = symbols.where("kind = 'test'").select("file", "line", "name", (F.col("line") - 1).alias("owner_line"))
    return selection.method_owners(methods, symbols).select("symbol", "owner").distinct()


@query("""SELECT count(*) AS projects, count(*) FILTER (WHERE n_regionkey <> 3) AS production, count(*) FILTER (WHERE n_regionkey = 3) AS tests,
(SELECT string_agg(f, ', ' ORDER BY f) FROM (SELECT DISTINCT unnest(['net' || n_regionkey, 'net' || (n_regionkey + 1)]) AS f FROM nation)) AS frameworks FROM nation""")
def project_counts(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "nation").selectExpr("n_regionkey = 3 AS is_test", "array(concat('net', n_regionkey), concat('net', n_regionkey + 1)) AS frameworks")
    return selection.project_counts(made)


NAME = "replace(p_name, ' ', '')"
RELATED = f"CASE p_size % 4 WHEN 0 THEN concat('global::Shop.', p_type, '.', {NAME}) WHEN 1 THEN {NAME} WHEN 2 THEN concat('Other.', {NAME}) ELSE concat('Other', {NAME}) END"
DEPENDENCIES = f"dependencies AS (SELECT p_partkey AS symbol, {RELATED} AS related, CASE p_size % 3 WHEN 0 THEN 'interface' WHEN 1 THEN 'base-type' ELSE 'attribute' END AS relationship FROM part)"
TYPES = f"types AS (SELECT p_partkey AS id, {NAME} AS name, concat('Shop.', p_type, '.', {NAME}) AS semantic_name FROM part WHERE p_retailprice < 905 AND p_size < 26)"


def _type_relation(spark: SparkSession, d: str, name: str) -> DataFrame:
    part = table(spark, d, "part")
    dependencies = part.selectExpr("p_partkey AS symbol", f"{RELATED} AS related", "CASE p_size % 3 WHEN 0 THEN 'interface' WHEN 1 THEN 'base-type' ELSE 'attribute' END AS relationship")
    types = part.where("p_retailprice < 905 AND p_size < 26").selectExpr("p_partkey AS id", f"{NAME} AS name", f"concat('Shop.', p_type, '.', {NAME}) AS semantic_name")
    edges = table(spark, d, "lineitem").selectExpr("l_partkey AS source", "l_suppkey AS target", "CASE l_returnflag WHEN 'A' THEN 'interface-implementation' WHEN 'R' THEN 'base-type' ELSE 'interface' END AS relationship")
    symbols = part.where("p_size > 2").select(F.col("p_partkey").alias("id")).union(types.select("id"))
    return selection.type_relation(edges, dependencies, types, symbols, types, name)


def _type_relation_sql(edge_kinds: str, kinds: str) -> str:
    return f"""WITH {DEPENDENCIES}, {TYPES}, symbols AS (SELECT p_partkey AS id FROM part WHERE p_size > 2 UNION SELECT id FROM types),
edges AS (SELECT l_partkey AS source, l_suppkey AS target, CASE l_returnflag WHEN 'A' THEN 'interface-implementation' WHEN 'R' THEN 'base-type' ELSE 'interface' END AS relationship FROM lineitem),
bare AS (SELECT symbol, replace(related, 'global::', '') AS r, relationship FROM dependencies WHERE relationship IN ({kinds})),
every AS (SELECT source, target, relationship FROM edges WHERE relationship IN ({edge_kinds}) AND target IN (SELECT id FROM types)
  UNION SELECT symbol, id, relationship FROM bare JOIN types ON r = name OR r = semantic_name OR ends_with(r, '.' || name))
SELECT * FROM every WHERE source IN (SELECT id FROM symbols) AND target IN (SELECT id FROM symbols)"""


@query(_type_relation_sql("'interface-implementation'", "'interface'"))
def relation_implementers(spark: SparkSession, d: str) -> DataFrame:
    return _type_relation(spark, d, "implementers")


@query(_type_relation_sql("'base-type', 'interface'", "'base-type', 'interface'"))
def relation_subtypes(spark: SparkSession, d: str) -> DataFrame:
    return _type_relation(spark, d, "subtypes")


def _absence(spark: SparkSession, d: str, outbound: bool) -> DataFrame:
    """Projects are customers, each depends on the one of a third of its key; asked for are the projects of the symbols (suppliers) in debt."""
    customer = table(spark, d, "customer")
    asked = table(spark, d, "supplier").where("s_acctbal < 0").select((F.col("s_suppkey") * 3).alias("id"))
    deps = customer.where("c_custkey > 0").select(F.col("c_custkey").alias("source"), F.expr("c_custkey div 3").alias("target"))
    return selection.absence_scope(asked, outbound, deps)


@query("WITH RECURSIVE deps AS (SELECT c_custkey AS source, c_custkey // 3 AS target FROM customer WHERE c_custkey > 0), hit(id) AS (SELECT s_suppkey * 3 FROM supplier WHERE s_acctbal < 0 UNION SELECT source FROM deps JOIN hit ON target = id) SELECT id FROM hit")
def absence_scope_inbound(spark: SparkSession, d: str) -> DataFrame:
    return _absence(spark, d, False)


@query("SELECT DISTINCT s_suppkey * 3 AS id FROM supplier WHERE s_acctbal < 0")
def absence_scope_outbound(spark: SparkSession, d: str) -> DataFrame:
    return _absence(spark, d, True)


@query("""SELECT o_orderkey, CASE WHEN b IS NULL THEN CASE WHEN h IS NULL THEN 'Comparable' ELSE 'BaselineCommitUnavailable' END WHEN h IS NULL THEN 'BaselineDiverged' WHEN b = h OR a THEN 'Comparable' ELSE 'BaselineDiverged' END AS state
FROM (SELECT o_orderkey, CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 5 END AS b, CASE WHEN o_custkey % 4 > 0 THEN o_custkey % 7 END AS h, o_orderstatus = 'F' AS a FROM orders)""")
def comparison_states(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").selectExpr("o_orderkey", "CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 5 END AS b", "CASE WHEN o_custkey % 4 > 0 THEN o_custkey % 7 END AS h", "o_orderstatus = 'F' AS a")
    return rows.select("o_orderkey", decisions.comparison_state(F.col("b"), F.col("h"), F.col("a")).alias("state"))


STATES = "CASE {x} % 5 WHEN 0 THEN 'Unavailable' WHEN 1 THEN 'TimedOut' WHEN 2 THEN 'Failed' ELSE 'Succeeded' END"
RUNS = f"SELECT o_orderkey, {STATES.format(x='o_orderkey')} AS build, {STATES.format(x='o_custkey')} AS tests, o_custkey % 2 AS outcomes, o_orderstatus = 'F' AS enabled, {STATES.format(x='(o_custkey + o_orderkey)')} AS provider, o_orderstatus <> 'P' AS complete FROM orders"


@query(f"""SELECT o_orderkey,
(build IN ('Unavailable', 'TimedOut') OR tests IN ('Unavailable', 'TimedOut') OR (tests = 'Failed' AND outcomes = 0) OR (enabled AND provider IN ('Failed', 'Unavailable', 'TimedOut')) OR NOT complete) AS failed,
(build = 'Unavailable' OR tests = 'Unavailable' OR (tests = 'Failed' AND outcomes = 0) OR (enabled AND provider IN ('Failed', 'Unavailable'))) AS review_failed FROM ({RUNS})""")
def execution_failures(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(RUNS.replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders"))
    state = lambda t: decisions.execution_failed(F.col("build"), F.col("tests"), F.col("outcomes"), [(F.col("enabled"), F.col("provider"))], F.col("complete"), t)
    return rows.select("o_orderkey", state(True).alias("failed"), state(False).alias("review_failed"))


@query("SELECT c_custkey FROM customer WHERE c_nationkey % 4 = 0 OR c_mktsegment IN ('MACHINERY', 'HOUSEHOLD')")
def gaps_in_scope(spark: SparkSession, d: str) -> DataFrame:
    gaps = table(spark, d, "customer").selectExpr("c_custkey", "CASE WHEN c_nationkey % 4 > 0 THEN c_mktsegment END AS project")
    return gaps.where(decisions.gaps_in_scope(F.col("project"), F.array(F.lit("machinery"), F.lit("Household")))).select("c_custkey")


PATHS = "concat(p_type, '/', CASE p_size % 4 WHEN 0 THEN 'Bin' WHEN 1 THEN 'src' WHEN 2 THEN '.tool' ELSE 'lib' END, '/', replace(p_name, ' ', CASE WHEN p_size % 5 = 0 THEN '.' ELSE '_' END), CASE p_size % 7 WHEN 0 THEN '.CS' WHEN 1 THEN '.md' WHEN 2 THEN '.ruleset' WHEN 3 THEN '' WHEN 4 THEN '.xaml' ELSE '.txt' END)"


@query(f"""WITH p AS (SELECT p_partkey, {PATHS} AS path FROM part), n AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name FROM p), e AS (SELECT *, lower(regexp_extract(name, '[.]([^.]+)$', 1)) AS ext FROM n)
SELECT p_partkey, ext IN ('cs', 'fs', 'vb', 'razor', 'xaml', 'md', 'json', 'csproj', 'fsproj', 'vbproj', 'props', 'targets') AS evidence,
ext IN ('cs', 'fs', 'vb', 'csproj', 'fsproj', 'vbproj', 'props', 'targets', 'sln', 'slnx', 'slnf', 'razor', 'cshtml', 'xaml', 'resx', 'editorconfig', 'globalconfig', 'ruleset') AS input,
len(list_filter(string_split(path, '/'), lambda s: lower(s) IN ('bin', 'obj', '.idea', '.tool'))) > 0 AS tool, regexp_replace(name, '[.][^.]*$', '') AS stem, starts_with(lower(path), 'promo/src/') AS within,
CASE ext WHEN 'xaml' THEN 'xml' WHEN 'md' THEN 'markdown' ELSE 'csharp' END AS fence FROM e""")
def path_predicates(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("path")
    return table(spark, d, "part").selectExpr("p_partkey", f"{PATHS} AS path").select(
        "p_partkey", N.is_evidence_file(path).alias("evidence"), N.is_repository_input(path).alias("input"), N.in_tool_folder(path, [".Tool"]).alias("tool"), N.stem_of(path).alias("stem"),
        N.is_within(path, F.lit("Promo/SRC/")).alias("within"), N.fence_language(path).alias("fence"),
    )


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN '  ' ELSE p_type END AS space, p_name AS own, concat('{"', p_type, '.', replace(p_name, ' ', ':'), '"}') AS expression, concat(p_name, '(', p_brand, ', a\\b)') AS test FROM part)
SELECT p_partkey, concat_ws('.', CASE WHEN trim(space) <> '' THEN space END, own) AS full_name, string_split(own, ' ')[-1] AS last, concat('FullyQualifiedName=', replace(replace(replace(replace(test, '\\', '\\\\'), '(', '\\('), ')', '\\)'), ',', '\\,')) AS filter FROM p""")
def name_formats(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(
        "p_partkey", F.expr("CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN '  ' ELSE p_type END AS space"), F.col("p_name").alias("own"),
        F.concat(F.lit('{"'), "p_type", F.lit("."), F.replace("p_name", F.lit(" "), F.lit(":")), F.lit('"}')).alias("expression"), F.concat("p_name", F.lit("("), "p_brand", F.lit(", a\\b)")).alias("test"),
    )
    return p.select("p_partkey", N.joined_name(F.col("space"), F.col("own")).alias("full_name"), N.last_identifier(F.col("expression")).alias("last"), N.test_filter(F.array("test")).alias("filter"))


@query("""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[\\r\\n]'), lambda x: regexp_replace(regexp_replace(x, '^[\\s]+', ''), '[\\s]+$', '')), lambda x: x <> '') AS lines FROM documents),
o AS (SELECT doc_id, array_to_string(lines, ' ') AS one FROM l) SELECT doc_id, CASE WHEN length(one) <= 500 THEN one ELSE concat(left(one, 497), '...') END AS message FROM o""")
def message_compaction(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", N.compact_message(F.col("text")).alias("message"))


@query("""WITH v AS (SELECT event_id, CASE WHEN user_id % 5 > 0 THEN user_id - 30 END AS x, CASE WHEN user_id % 7 > 0 THEN event_type END AS file, user_id % 3 AS col, CASE event_type WHEN 'error' THEN 'Both' WHEN 'click' THEN 'Committed' ELSE 'WorkingTree' END AS source FROM events)
SELECT event_id, CASE WHEN x IS NULL THEN '' WHEN x > 0 THEN concat(' (+', x, ')') ELSE concat(' (', x, ')') END AS delta,
CASE WHEN file IS NULL THEN '' ELSE concat('; ', file, ':7', CASE WHEN col > 0 THEN concat(':', col) ELSE '' END, CASE WHEN col <> 1 THEN '; net9' ELSE '' END) END AS place,
CASE source WHEN 'Both' THEN 'committed + working tree' WHEN 'Committed' THEN 'committed' ELSE 'working tree' END AS label FROM v""")
def evidence_labels(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "events").selectExpr("event_id", "CASE WHEN user_id % 5 > 0 THEN user_id - 30 END AS x", "CASE WHEN user_id % 7 > 0 THEN event_type END AS file", "user_id % 3 AS col", "CASE event_type WHEN 'error' THEN 'Both' WHEN 'click' THEN 'Committed' ELSE 'WorkingTree' END AS source")
    place = N.evidence_location(F.col("file"), F.lit(7), F.when(F.col("col") > 0, F.col("col")), F.when(F.col("col") != 1, "net9"))
    return v.select("event_id", N.signed_delta(F.col("x")).alias("delta"), place.alias("place"), N.change_label(F.col("source")).alias("label"))


@query("""WITH d AS (SELECT doc_id, text, strpos(text, 'the') AS pos FROM documents), b AS (SELECT doc_id, string_split(substr(text, 1, pos - 1), chr(10)) AS lines FROM d WHERE pos > 0)
SELECT doc_id, len(lines)::BIGINT AS line, (length(lines[-1]) + 1)::BIGINT AS col FROM b""")
def text_positions(spark: SparkSession, d: str) -> DataFrame:
    at = F.instr("text", "the")
    found = table(spark, d, "documents").where(at > 0).select("doc_id", N.position_of(F.col("text"), at).alias("p"))
    return found.select("doc_id", F.col("p.line").alias("line"), F.col("p.column").alias("col"))


@query("""WITH d AS (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS lines, 1 + doc_id % 9 AS best FROM documents WHERE text IS NOT NULL)
SELECT doc_id, coalesce(array_to_string(lines[greatest(1, best - 4):least(len(lines), best + 5)], chr(10)), '') AS excerpt FROM d""")
def wrapped_excerpts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", bundle.wrapped_excerpt(F.col("text"), 1 + F.col("doc_id") % 9).alias("excerpt"))


BLOCKS = "concat(CASE WHEN p_size % 2 = 0 THEN 'generated://' ELSE 'src/' END, CAST(p_partkey % 40 AS VARCHAR(9)))"


@query(f"""WITH blocks AS (SELECT p_partkey, {BLOCKS} AS file FROM part), generated AS (SELECT concat('generated://', n_nationkey) AS file, concat(n_name, chr(10), 'x') AS text FROM nation), files AS (SELECT concat('src/', s_suppkey) AS path, s_name AS text FROM supplier)
SELECT p_partkey, b.file, CASE WHEN starts_with(b.file, 'generated://') THEN g.text ELSE f.text END AS text FROM blocks b LEFT JOIN generated g ON b.file = g.file LEFT JOIN files f ON b.file = f.path
WHERE CASE WHEN starts_with(b.file, 'generated://') THEN g.text ELSE f.text END IS NOT NULL""")
def generated_text(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "part").select("p_partkey", F.expr(BLOCKS.replace("VARCHAR(9)", "STRING")).alias("file"))
    generated = table(spark, d, "nation").select(F.concat(F.lit("generated://"), "n_nationkey").alias("file"), F.concat("n_name", F.lit("\r\nx")).alias("text"))
    files = table(spark, d, "supplier").select(F.concat(F.lit("src/"), "s_suppkey").alias("path"), F.col("s_name").alias("text"))
    return selection.block_text(blocks, files, generated).select("p_partkey", "file", "text")
