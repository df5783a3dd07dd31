"""Queries over graph, snapshot and metric analogues in the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import delta, graph, metrics, ownership, selection, store
from cairn.operators.fingerprint import fingerprint_sql, fingerprints
from cairn.operators.keys import first_by
from cairn.plans.registry import query
from cairn.session import scratch_path, staged, table

KINDS = "CASE WHEN l_returnflag = 'A' THEN 'override' WHEN l_returnflag = 'R' THEN 'method-call' ELSE 'attribute' END"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """A multigraph: suppliers use parts, one row for each use."""
    return table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"), F.expr(KINDS).alias("relationship"))


EDGES = f"edges AS (SELECT 's' || l_suppkey AS source, 'p' || l_partkey AS target, {KINDS} AS relationship FROM lineitem)"


#: Every edge kind that has a weight of its own, and one that has none.
ALL_KINDS = [*graph.EDGE_WEIGHTS, "odd"]
KIND_AT = "element_at(array({}), CAST((l_partkey + 3 * l_suppkey + l_linenumber) % {} + 1 AS INT))".format(", ".join(f"'{k}'" for k in ALL_KINDS), len(ALL_KINDS))
ALL_EDGES = "edges AS (SELECT 's' || l_suppkey AS source, 'p' || l_partkey AS target, ([{}])[((l_partkey + 3 * l_suppkey + l_linenumber) % {} + 1)::INT] AS relationship FROM lineitem)".format(", ".join(f"'{k}'" for k in ALL_KINDS), len(ALL_KINDS))


def _expand_sql(depth: int) -> str:
    weights = " ".join(f"WHEN '{k}' THEN {w}" for k, w in graph.EDGE_WEIGHTS.items())
    points = f"greatest(1, (CASE relationship {weights} ELSE {graph.OTHER} END) + least(200, score // 4) - 15 * {{n}})"
    ctes = [ALL_EDGES, "both_ways AS (SELECT source AS a, target AS b, relationship, 'uses' AS verb FROM edges UNION ALL SELECT target, source, relationship, 'used by' FROM edges)", "l0 AS (SELECT 'p' || p_partkey AS id, 400 + p_partkey % 300 AS score, 0 AS level, '' AS reasons FROM part WHERE p_partkey % 70 = 1)"]
    for n in range(1, depth + 1):
        known = " UNION ALL ".join(f"SELECT id FROM l{i}" for i in range(n))
        why = f"'graph depth {n}: ' || verb || ' ' || chr(39) || relationship || chr(39)"
        ctes.append(f"l{n} AS (SELECT b AS id, least(1000, sum({points.format(n=n)})) AS score, {n} AS level, string_agg(DISTINCT {why}, '; ' ORDER BY {why}) AS reasons FROM both_ways JOIN l{n - 1} ON a = id WHERE b NOT IN ({known}) AND (starts_with(b, 's') OR substr(b, 2)::INT % 11 <> 0) GROUP BY b)")
    every = " UNION ALL ".join(f"SELECT * FROM l{n}" for n in range(depth + 1))
    return f"WITH {', '.join(ctes)} SELECT id, score::BIGINT AS score, level::BIGINT AS level, reasons FROM ({every})"


def _expand(spark: SparkSession, d: str, depth: int) -> DataFrame:
    """From every seventieth part over edges of all kinds; every eleventh part is not in the index."""
    part = table(spark, d, "part")
    name = F.concat(F.lit("p"), "p_partkey").alias("id")
    edges = table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"), F.expr(KIND_AT).alias("relationship"))
    known = part.where("p_partkey % 11 <> 0").select(name).union(table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey")))
    found = graph.expand(part.where("p_partkey % 70 = 1").select(name, (F.col("p_partkey") % 300 + 400).alias("score")), edges, depth, known)
    return found.withColumn("reasons", F.array_join("reasons", "; "))


@query(_expand_sql(1))
def graph_expand_d1(spark: SparkSession, d: str) -> DataFrame:
    return _expand(spark, d, 1)


@query(_expand_sql(2))
def graph_expand_d2(spark: SparkSession, d: str) -> DataFrame:
    return _expand(spark, d, 2)


def _given(spark: SparkSession, d: str, end: str) -> DataFrame:
    if end == "target":
        return table(spark, d, "part").where("p_size <= 5").select(F.concat(F.lit("p"), "p_partkey").alias("id"))
    return table(spark, d, "supplier").where("s_nationkey < 5").select(F.concat(F.lit("s"), "s_suppkey").alias("id"))


def _relation_sql(end: str, kind: str) -> str:
    given = "SELECT 'p' || p_partkey FROM part WHERE p_size <= 5" if end == "target" else "SELECT 's' || s_suppkey FROM supplier WHERE s_nationkey < 5"
    return f"WITH {EDGES} SELECT DISTINCT source, target, relationship FROM edges WHERE relationship = '{kind}' AND {end} IN ({given})"


def _known(spark: SparkSession, d: str) -> DataFrame:
    """The symbols of an index that lacks some suppliers."""
    return table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id")).union(table(spark, d, "supplier").where("s_suppkey % 7 <> 0").select(F.concat(F.lit("s"), "s_suppkey")))


@query(_relation_sql("target", "method-call") + " AND substr(source, 2)::INT % 7 <> 0")
def relation_callers(spark: SparkSession, d: str) -> DataFrame:
    return graph.relation(_edges(spark, d), _given(spark, d, "target"), "callers", symbols=_known(spark, d))


@query(_relation_sql("source", "method-call"))
def relation_callees(spark: SparkSession, d: str) -> DataFrame:
    return graph.relation(_edges(spark, d), _given(spark, d, "source"), "callees")


@query(_relation_sql("target", "override"))
def relation_overrides(spark: SparkSession, d: str) -> DataFrame:
    return graph.relation(_edges(spark, d), _given(spark, d, "target"), "overrides")


@query(f"""WITH {EDGES} SELECT DISTINCT source, target, relationship FROM edges
WHERE target IN (SELECT 'p' || p_partkey FROM part WHERE p_size <= 5) AND source IN (SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal < 0)""")
def relation_tests_covering(spark: SparkSession, d: str) -> DataFrame:
    kinds = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.when(F.col("s_acctbal") < 0, "test").otherwise("method").alias("kind"))
    return graph.relation(_edges(spark, d), _given(spark, d, "target"), "tests-covering", kinds)


def _projects(spark: SparkSession, d: str) -> DataFrame:
    """Referrers to what they reference: customers to nations, nations to regions."""
    nation, customer = table(spark, d, "nation"), table(spark, d, "customer")
    up = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("source"), F.concat(F.lit("r"), "n_regionkey").alias("target"))
    return up.union(customer.select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey")))


PROJECTS = "deps AS (SELECT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"


@query(f"WITH RECURSIVE {PROJECTS}, hit(id) AS (SELECT 'r1' UNION SELECT source FROM deps JOIN hit ON target = id) SELECT id FROM hit")
def project_closure_reverse(spark: SparkSession, d: str) -> DataFrame:
    back = _projects(spark, d).select(F.col("target").alias("source"), F.col("source").alias("target"))
    return graph.closure(spark.createDataFrame([("r1",)], "id string"), back).select("id")


@query(f"WITH RECURSIVE {PROJECTS}, hit(id) AS (SELECT 'c' || c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY' UNION SELECT target FROM deps JOIN hit ON source = id) SELECT id FROM hit")
def forward_closure(spark: SparkSession, d: str) -> DataFrame:
    seeds = table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.concat(F.lit("c"), "c_custkey").alias("id"))
    return graph.closure(seeds, _projects(spark, d)).select("id")


@query(f"""WITH RECURSIVE {PROJECTS}, waves(id, wave) AS (SELECT 'c1', 0 UNION SELECT target, wave + 1 FROM deps JOIN waves ON source = id)
SELECT id, min(wave)::BIGINT AS wave FROM waves GROUP BY id""")
def closure_waves(spark: SparkSession, d: str) -> DataFrame:
    return graph.closure(spark.createDataFrame([("c1",)], "id string"), _projects(spark, d))


@query("""WITH RECURSIVE uses AS (SELECT DISTINCT l_suppkey AS s, l_partkey + 1000000 AS p FROM lineitem), deps AS (SELECT s AS source, p AS target FROM uses UNION ALL SELECT p, s FROM uses),
hit(id) AS (SELECT 1000001 UNION SELECT target FROM deps JOIN hit ON source = id) SELECT id::BIGINT AS id FROM hit""")
def symbol_closure_affected(spark: SparkSession, d: str) -> DataFrame:
    """Everything that uses or is used by a part, over all edges in both directions."""
    uses = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") + 1000000).alias("target")).distinct()
    both = staged(uses.union(uses.select("target", "source")), "uses")
    return graph.closure(spark.createDataFrame([(1000001,)], "id bigint"), both).select("id")


CUSTOMER_LINE = "c_name || '|' || c_acctbal::DECIMAL(12,2)"


@query(f"""WITH RECURSIVE now AS (SELECT k, h FROM {fingerprint_sql("(SELECT *, c_nationkey AS k FROM customer)", "k", CUSTOMER_LINE, "h")}),
was AS (SELECT k, h FROM {fingerprint_sql("(SELECT *, c_nationkey AS k FROM customer WHERE c_custkey <> 7)", "k", CUSTOMER_LINE, "h")}),
deps AS (SELECT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target FROM nation),
hit(id) AS (SELECT 'n' || now.k FROM now LEFT JOIN was ON now.k = was.k WHERE was.h IS DISTINCT FROM now.h UNION SELECT target FROM deps JOIN hit ON source = id) SELECT id FROM hit""")
def incremental_invalidation(spark: SparkSession, d: str) -> DataFrame:
    customer = table(spark, d, "customer")
    line = F.concat_ws("|", "c_name", F.col("c_acctbal").cast("decimal(12,2)"))
    prints = lambda df: fingerprints(df.withColumn("id", F.concat(F.lit("n"), "c_nationkey")), ["id"], line, "h")
    changed = delta.changed_keys(prints(customer.where("c_custkey <> 7")), prints(customer), "id")
    up = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("source"), F.concat(F.lit("r"), "n_regionkey").alias("target"))
    return graph.closure(changed, up).select("id")


# Snapshots: orders before and after; the later one lacks old orders, has new ones and other statuses.
def _before(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderdate < '2000-01-01'").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("rule"))


def _after(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("o_orderkey") % 10 == 0, "X").otherwise(F.col("o_orderstatus"))
    return table(spark, d, "orders").where("o_orderdate >= '1997-01-01'").select(F.col("o_orderkey").alias("id"), state.alias("state"), F.col("o_orderpriority").alias("rule"))


SNAPSHOTS = """b AS (SELECT o_orderkey AS id, o_orderstatus AS state, o_orderpriority AS rule FROM orders WHERE o_orderdate < '2000-01-01'),
a AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS state, o_orderpriority AS rule FROM orders WHERE o_orderdate >= '1997-01-01')"""


@query(f"WITH {SNAPSHOTS} SELECT * FROM a WHERE id NOT IN (SELECT id FROM b)")
def delta_new(spark: SparkSession, d: str) -> DataFrame:
    return delta.new_rows(_before(spark, d), _after(spark, d), "id")


@query(f"WITH {SNAPSHOTS} SELECT * FROM b WHERE id NOT IN (SELECT id FROM a)")
def delta_resolved(spark: SparkSession, d: str) -> DataFrame:
    return delta.resolved_rows(_before(spark, d), _after(spark, d), "id")


@query(f"WITH {SNAPSHOTS} SELECT * FROM a WHERE id IN (SELECT id FROM b)")
def delta_existing(spark: SparkSession, d: str) -> DataFrame:
    return delta.existing_rows(_before(spark, d), _after(spark, d), "id")


@query(f"WITH {SNAPSHOTS} SELECT * FROM b WHERE id NOT IN (SELECT id FROM a) AND id IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')")
def delta_resolved_guarded(spark: SparkSession, d: str) -> DataFrame:
    executed = table(spark, d, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("id"))
    return delta.resolved_rows(_before(spark, d), _after(spark, d), "id", executed, complete=False)


@query(f"WITH {SNAPSHOTS} SELECT coalesce(b.id, a.id) AS id FROM b FULL JOIN a ON b.id = a.id WHERE b.id IS NULL OR a.id IS NULL OR b.state IS DISTINCT FROM a.state OR b.rule IS DISTINCT FROM a.rule")
def worktree_symdiff(spark: SparkSession, d: str) -> DataFrame:
    return delta.changed_keys(_before(spark, d), _after(spark, d), "id")


@query(f"WITH {SNAPSHOTS} SELECT coalesce(b.id, a.id) AS id, CASE WHEN b.id IS NOT NULL AND a.id IS NOT NULL THEN 'Both' WHEN b.id IS NOT NULL THEN 'Committed' ELSE 'WorkingTree' END AS provenance FROM b FULL JOIN a ON b.id = a.id")
def provenance_union(spark: SparkSession, d: str) -> DataFrame:
    return delta.provenance(_before(spark, d), _after(spark, d), "id")


@query(f"""WITH {SNAPSHOTS}, n AS (SELECT rule, CASE state WHEN 'F' THEN 'error' WHEN 'P' THEN 'warning' ELSE 'info' END AS severity FROM a WHERE id NOT IN (SELECT id FROM b))
SELECT count(*) FILTER (WHERE severity = 'error') AS new_errors, count(*) FILTER (WHERE severity = 'warning') AS new_warnings, bool_or(severity = 'error') AS regressed FROM n""")
def regression_flags(spark: SparkSession, d: str) -> DataFrame:
    new = delta.new_rows(_before(spark, d), _after(spark, d), "id").withColumn("severity", F.expr("CASE state WHEN 'F' THEN 'error' WHEN 'P' THEN 'warning' ELSE 'info' END"))
    return delta.regression(new, warnings_count=False)


@query(f"WITH {SNAPSHOTS} SELECT id, state, rule FROM a UNION ALL SELECT id, state, rule FROM b WHERE id NOT IN (SELECT id FROM a)")
def merge_indexes(spark: SparkSession, d: str) -> DataFrame:
    return delta.merge_first([_after(spark, d), _before(spark, d)], ["id"], ["state", "rule"])


@query("""WITH best AS (SELECT l_orderkey AS file, l_linenumber AS line, max(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS hits FROM lineitem GROUP BY ALL)
SELECT file, round(100.0 * count(*) FILTER (WHERE hits > 0) / count(*), 6) AS coverage FROM best GROUP BY file""")
def coverage_merge_max(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), (F.col("l_quantity") > 25).cast("int").alias("hits"))
    return metrics.merge_coverage(lines).withColumn("coverage", F.round("coverage", 6))


@query("""SELECT 'user' || user_id AS file, count(DISTINCT event_id) AS commits, count(DISTINCT event_type) AS contributors, epoch_us(max(ts)) AS last_change,
sum(CASE WHEN event_type = 'purchase' THEN floor(value)::BIGINT ELSE 0 END)::BIGINT AS churn FROM events GROUP BY ALL""")
def history_churn(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select(F.concat(F.lit("user"), "user_id").alias("file"), F.col("event_id").alias("commit"), F.col("event_type").alias("author"), "ts", F.when(F.col("event_type") == "purchase", F.floor("value")).alias("added"), F.lit(None).cast("bigint").alias("deleted"))
    return metrics.churn(log.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))))


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS header FROM events""")
def history_header_carry(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("header", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return metrics.carry_headers(rows, "user_id", ["ts", "event_id"], "header").select("event_id", "header")


@query("""SELECT file, sum(o)::BIGINT AS fan_out, sum(i)::BIGINT AS fan_in FROM (
SELECT 's' || l_suppkey AS file, count(DISTINCT l_partkey) AS o, 0 AS i FROM lineitem GROUP BY ALL UNION ALL SELECT 'p' || l_partkey, 0, count(DISTINCT l_suppkey) FROM lineitem GROUP BY ALL) GROUP BY file""")
def fan_in_out(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d).select("source", "target", F.col("source").alias("source_file"), F.col("target").alias("target_file"))
    out, into = metrics.fan(edges)
    return out.join(into, "file", "full").select("file", F.coalesce("fan_out", F.lit(0)).alias("fan_out"), F.coalesce("fan_in", F.lit(0)).alias("fan_in"))


@query("""WITH f AS (SELECT p_name || '#' || p_partkey AS path, p_partkey AS k, p_size AS complexity FROM part),
u AS (SELECT l_partkey AS k, count(DISTINCT l_suppkey) AS fan_in, count(*) AS loc, count(*) FILTER (WHERE l_returnflag = 'R') AS diagnostics, floor(sum(l_quantity))::BIGINT AS churn FROM lineitem GROUP BY k),
c AS (SELECT l_partkey AS k, round(100.0 * count(*) FILTER (WHERE l_linestatus = 'F') / count(*), 6) AS coverage FROM lineitem WHERE l_quantity > 10 GROUP BY k)
SELECT path, rank FROM (SELECT path, row_number() OVER (ORDER BY coalesce(diagnostics, 0) DESC, complexity DESC, coalesce(fan_in, 0) DESC, coalesce(coverage, 1e308), coalesce(churn, 0) DESC, coalesce(loc, 0) DESC, path) AS rank
FROM f LEFT JOIN u USING (k) LEFT JOIN c USING (k)) WHERE rank <= 25""")
def hotspot_rank(spark: SparkSession, d: str) -> DataFrame:
    """Files are parts, by key until the last step, which names them."""
    part, line = table(spark, d, "part"), table(spark, d, "lineitem")
    key = F.col("l_partkey")
    sized = line.groupBy(key.alias("path")).agg(F.count("*").alias("loc"))
    edges = line.select(F.col("l_suppkey").alias("source"), key.alias("target"), (-1 - F.col("l_suppkey")).alias("source_file"), key.alias("target_file"))
    cover = line.where("l_quantity > 10").groupBy(key.alias("file")).agg(F.round(F.count_if(F.col("l_linestatus") == "F") * 100.0 / F.count("*"), 6).alias("coverage"))
    history = line.groupBy(key.alias("file")).agg(F.floor(F.sum("l_quantity")).alias("churn"))
    files = part.select(F.col("p_partkey").alias("path"), F.concat("p_name", F.lit("#"), "p_partkey").alias("name"), F.col("p_size").alias("complexity")).join(sized, "path", "left")
    inputs = metrics.hotspot_inputs(files, line.where("l_returnflag = 'R'").select(key.alias("path")), edges, cover, history)
    return metrics.rank_hotspots(inputs.withColumn("path", F.col("name")), 25).select("path", "rank")


@query("""SELECT l_orderkey AS owner, count(*) AS methods, count(*) FILTER (WHERE l_returnflag = 'N') AS public_methods, count(DISTINCT l_partkey) AS dependencies, round_even(avg(l_quantity)::DECIMAL(18, 6), 2)::DOUBLE AS mean_complexity, max(l_quantity)::BIGINT AS max_complexity FROM lineitem GROUP BY owner""")
def type_metrics(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").withColumn("owner", F.col("l_orderkey"))
    methods = line.select("owner", (F.col("l_returnflag") == "N").alias("is_public"), F.col("l_quantity").alias("complexity"))
    return metrics.type_metrics(methods, line.select("owner", F.col("l_partkey").alias("target")))


@query("""WITH e AS (SELECT 'k' || (value::BIGINT % 7) AS rule, 'user' || user_id AS file FROM events WHERE event_type = 'error'),
n AS (SELECT rule, count(*) AS n FROM e GROUP BY rule)
SELECT rule, n, (SELECT string_agg(file, ',' ORDER BY file) FROM (SELECT DISTINCT file FROM e WHERE e.rule = n.rule ORDER BY file LIMIT 10)) AS files FROM n ORDER BY n DESC, rule LIMIT 5""")
def diagnostic_summary(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'error'").select(F.concat(F.lit("k"), F.bround("value", 0).cast("bigint") % 7).alias("rule"), F.concat(F.lit("user"), "user_id").alias("file"))
    return metrics.diagnostic_summary(e)


@query("""SELECT identity, event_id FROM (SELECT sha256(event_type || '|' || user_id || '|' || props) AS identity, event_id, row_number() OVER (PARTITION BY event_type, user_id, props ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def diagnostic_identity(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("identity", F.sha2(F.concat_ws("|", "event_type", "user_id", "props"), 256))
    return rows.groupBy("identity").agg(F.max(F.struct("ts", "event_id")).alias("last")).select("identity", "last.event_id")


TREND = "p AS (SELECT event_type AS scope, strftime(ts, '%Y-%m-%d') AS day, count(*) AS points, count(*) FILTER (WHERE value > 50) AS failing FROM events GROUP BY ALL)"


def _trend(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("scope"), F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("points"), F.count_if(F.col("value") > 50).alias("failing"))


@query(f"WITH {TREND} SELECT *, points - lag(points) OVER w AS points_delta, failing - lag(failing) OVER w AS failing_delta FROM p WINDOW w AS (PARTITION BY scope ORDER BY day)")
def trend_lag(spark: SparkSession, d: str) -> DataFrame:
    return metrics.trend_deltas(_trend(spark, d), ["scope"], ["day"], ["points", "failing"])


@query(f"WITH {TREND}, x AS (SELECT *, points - lag(points) OVER (PARTITION BY scope ORDER BY day) AS points_delta, row_number() OVER (PARTITION BY scope ORDER BY day DESC) AS n FROM p) SELECT scope, day, points, failing, points_delta FROM x WHERE n <= 5")
def trend_take_last(spark: SparkSession, d: str) -> DataFrame:
    return first_by(metrics.trend_deltas(_trend(spark, d), ["scope"], ["day"], ["points"]), ["scope"], [F.desc("day")], 5)


@query("""WITH e AS (SELECT DISTINCT source AS c, d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE quality = 1), r AS (SELECT DISTINCT source AS c, doc_id FROM documents WHERE n_chars > 500),
j AS (SELECT coalesce(e.c, r.c) AS c, e.doc_id AS e, r.doc_id AS r FROM e FULL JOIN r ON e.c = r.c AND e.doc_id = r.doc_id),
s AS (SELECT c, count(e) AS ne, count(r) AS nr, count(*) FILTER (WHERE e IS NOT NULL AND r IS NOT NULL) AS hits FROM j GROUP BY c)
SELECT c AS source, hits, round(CASE WHEN ne = 0 THEN 1 ELSE hits / ne END, 6) AS recall, round(CASE WHEN nr = 0 THEN CASE WHEN ne = 0 THEN 1 ELSE 0 END ELSE hits / nr END, 6) AS precision FROM s""")
def precision_recall(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    expected = docs.join(table(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi").select("source", "doc_id")
    out = metrics.recall_precision(expected, docs.where("n_chars > 500").select("source", "doc_id"), "source", "doc_id")
    return out.select("source", "hits", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


@query("""SELECT DISTINCT l_suppkey AS source, l_partkey AS target FROM lineitem WHERE l_quantity > 45 EXCEPT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_discount > 0.05""")
def relationship_expectations(spark: SparkSession, d: str) -> DataFrame:
    pair = [F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target")]
    line = table(spark, d, "lineitem")
    return line.where("l_quantity > 45").select(*pair).distinct().join(line.where("l_discount > 0.05").select(*pair).distinct(), ["source", "target"], "left_anti")


WORDS = "CASE o_orderkey % 11 WHEN 0 THEN 'Passed' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'Timeout' WHEN 3 THEN 'NotExecuted' WHEN 4 THEN 'completed' WHEN 5 THEN 'Inconclusive' WHEN 6 THEN 'aborted' WHEN 7 THEN 'Error' WHEN 8 THEN 'odd' WHEN 9 THEN 'skipped' END"


@query(f"""WITH o AS (SELECT o_orderpriority AS suite, lower({WORDS}) AS w FROM orders)
SELECT suite, count(*) AS total, count(*) FILTER (WHERE w IN ('failed', 'error', 'timeout', 'aborted')) AS failed, count(*) FILTER (WHERE w IN ('passed', 'completed')) AS passed, count(*) FILTER (WHERE w IN ('notexecuted', 'skipped', 'inconclusive')) AS skipped FROM o GROUP BY suite""")
def test_outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    return metrics.test_counts(table(spark, d, "orders").select(F.col("o_orderpriority").alias("suite"), F.expr(WORDS).alias("outcome")), ["suite"])


STATES = "CASE CAST(floor({}) AS INT) % 3 WHEN 0 THEN 'Succeeded' WHEN 1 THEN 'Failed' ELSE 'TimedOut' END"


@query(f"""WITH r AS (SELECT c_custkey AS run, {STATES.format("c_custkey / 5")} AS build_before, {STATES.format("c_custkey / 7")} AS build_now, {STATES.format("c_custkey / 3")} AS scan_before, {STATES.format("c_custkey / 2")} AS scan_now FROM customer),
n AS (SELECT o_custkey AS run, count(DISTINCT o_orderkey % 97) FILTER (WHERE o_orderstatus = 'F') AS new_errors, count(DISTINCT o_orderkey % 97) FILTER (WHERE o_orderstatus = 'P') AS new_warnings, count(DISTINCT o_orderkey % 5) FILTER (WHERE o_orderdate >= '2001-06-01') AS new_failures FROM orders WHERE o_orderdate >= '2000-06-01' GROUP BY run)
SELECT r.*, coalesce(new_errors, 0) AS new_errors, coalesce(new_warnings, 0) AS new_warnings, coalesce(new_failures, 0) AS new_failures,
  (build_before = 'Succeeded' AND build_now <> 'Succeeded') OR (scan_before = 'Succeeded' AND scan_now <> 'Succeeded') OR coalesce(new_errors, 0) > 0 OR coalesce(new_failures, 0) > 0 OR coalesce(new_warnings, 0) > 0 AS regressed FROM r LEFT JOIN n USING (run)""")
def regression_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Every customer's run against its baseline: states of build and scanner, new diagnostics, newly failing tests."""
    state = lambda n, name: F.expr(STATES.format(f"c_custkey / {n}")).alias(name)
    runs = table(spark, d, "customer").select(F.col("c_custkey").alias("run"), state(5, "build_before"), state(7, "build_now"), state(3, "scan_before"), state(2, "scan_now"))
    orders = table(spark, d, "orders").withColumn("run", F.col("o_custkey"))
    severity = F.when(F.col("o_orderstatus") == "F", "error").when(F.col("o_orderstatus") == "P", "warning").otherwise("info")
    found = orders.select("run", F.concat(F.col("o_orderkey") % 97, severity).alias("identity"), severity.alias("severity"), (F.col("o_orderdate") >= "2000-06-01").alias("is_new"))
    failures = orders.select("run", (F.col("o_orderkey") % 5).alias("identity"), (F.col("o_orderdate") >= "2001-06-01").alias("is_new"))
    return delta.regressions(runs, found, failures, "run", ["build", "scan"], warnings_count=True)


@query("""SELECT count(*) AS projects, count(*) FILTER (WHERE c_custkey % 3 > 0) AS production, count(*) FILTER (WHERE c_custkey % 3 = 0) AS tests, (SELECT string_agg(f, ', ' ORDER BY f) FROM (SELECT DISTINCT 'net' || n_regionkey AS f FROM customer JOIN nation ON c_nationkey = n_nationkey)) AS frameworks,
(SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS errors, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS warnings FROM customer""")
def health_counts(spark: SparkSession, d: str) -> DataFrame:
    """Projects, frameworks and diagnostics of a repository at a glance."""
    region = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.concat(F.lit("net"), "n_regionkey").alias("f"))
    projects = table(spark, d, "customer").join(region, "c_nationkey").select((F.col("c_custkey") % 3 == 0).alias("is_test"), F.array("f").alias("frameworks"))
    severity = F.when(F.col("o_orderstatus") == "F", "error").when(F.col("o_orderstatus") == "P", "warning").otherwise("info")
    return selection.project_counts(projects, table(spark, d, "orders").select(severity.alias("severity")))


@query("""WITH h AS (SELECT source, count(*) AS hotspots, sum(n_chars)::BIGINT AS churn, count(quality) AS with_coverage, round(avg(quality * 100.0), 6) AS mean_coverage FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source),
g AS (SELECT 'user' || user_id AS source, count(*) AS diagnostics FROM events WHERE event_type = 'error' GROUP BY ALL), t AS (SELECT source, count(*) AS failing_tests FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY source)
SELECT coalesce(h.source, g.source) AS source, coalesce(hotspots, 0) AS hotspots, coalesce(churn, 0) AS churn, coalesce(with_coverage, 0) AS with_coverage, mean_coverage, coalesce(diagnostics, 0) AS diagnostics, coalesce(failing_tests, 0) AS failing_tests FROM h FULL JOIN g ON h.source = g.source LEFT JOIN t ON h.source = t.source""")
def trend_points(spark: SparkSession, d: str) -> DataFrame:
    """A trend point for every source of documents and every user with errors."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    files = rows.select("source", F.col("n_chars").alias("churn"), (F.col("quality") * 100.0).alias("coverage"))
    tests = rows.where("toxic is not null").select("source", F.when(F.col("toxic") == 1, "Failed").otherwise("Passed").alias("outcome"))
    found = table(spark, d, "events").where("event_type = 'error'").select(F.concat(F.lit("user"), "user_id").alias("source"))
    return metrics.trend_point(files, found, tests, ["source"]).withColumn("mean_coverage", F.round("mean_coverage", 6))


@query("SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 2) + CASE WHEN c_nationkey = 3 THEN 1 ELSE 0 END AS c_acctbal, c_mktsegment, 11 AS schema_version FROM customer WHERE c_nationkey <> 4")
def published_slices(spark: SparkSession, d: str) -> DataFrame:
    """Customers published by nation; then nation 3 is published anew and nation 4 taken out; the version window holds on reading."""
    path, rows = scratch_path(spark, "published"), table(spark, d, "customer").withColumn("c_acctbal", F.round("c_acctbal", 2))
    store.publish_slices(rows, path, "c_nationkey")
    store.publish_slices(rows.where("c_nationkey = 3").withColumn("c_acctbal", F.col("c_acctbal") + 1), path, "c_nationkey", gone=["4"])
    return store.read_published(spark, path)


@query("""SELECT source, CASE WHEN count(*) > 0 AND count(l.doc_id) = 0 THEN 'Failed' WHEN count(*) = count(l.doc_id) THEN 'Complete' ELSE 'Partial' END AS state FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source""")
def completeness_state(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select("doc_id", F.lit(1).alias("loaded"))
    sums = table(spark, d, "documents").join(labels, "doc_id", "left").groupBy("source").agg(F.count("*").alias("total"), F.count("loaded").alias("loaded"))
    return sums.select("source", metrics.completeness(F.col("loaded"), F.col("total"), F.col("total") - F.col("loaded")).alias("state"))


@query("""WITH s AS (SELECT source, count(l.doc_id) AS blocks, count(*) FILTER (WHERE n_chars > 10000) AS cut, count(*) FILTER (WHERE quality = 0) AS gaps, bool_and(lang <> 'en') AS lexical FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source)
SELECT source, CASE WHEN blocks = 0 THEN 'Insufficient' WHEN cut > 2 OR gaps > 2 OR lexical THEN 'Partial' ELSE 'Sufficient' END AS decision FROM s""")
def sufficiency_decision(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "documents").join(table(spark, d, "labels").withColumn("l", F.lit(1)), "doc_id", "left")
    s = joined.groupBy("source").agg(F.count("l").alias("blocks"), F.count_if(F.col("n_chars") > 10000).alias("cut"), F.count_if(F.col("quality") == 0).alias("gaps"), F.bool_and(F.col("lang") != "en").alias("lexical"))
    no = F.lit(False)
    return s.select("source", metrics.evidence_decision(F.col("blocks"), F.col("cut") > 2, F.when(F.col("gaps") > 2, F.col("gaps")).otherwise(0), no, F.col("lexical"), no, no).alias("decision"))


@query("""WITH t(target) AS (VALUES ('red widget'), ('BRAND#1'), ('ECONOMY'), ('Brand#2.ECONOMY.3'), ('nothing')),
s AS (SELECT 'p' || p_partkey AS identity, lower(p_name) AS name, lower(p_brand || '.' || p_type || '.' || p_partkey) AS semantic_name FROM part),
f AS (SELECT target, identity, CASE WHEN semantic_name = lower(target) THEN 1 WHEN name = lower(target) THEN 2 ELSE 3 END AS tier FROM t JOIN s ON semantic_name = lower(target) OR name = lower(target) OR ends_with(semantic_name, '.' || lower(target)))
SELECT target, identity, tier::BIGINT AS tier FROM f WHERE tier = (SELECT min(tier) FROM f g WHERE g.target = f.target)""")
def resolve_name_tiers(spark: SparkSession, d: str) -> DataFrame:
    symbols = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("identity"), F.col("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_type", "p_partkey").alias("semantic_name"))
    targets = spark.createDataFrame([("red widget",), ("BRAND#1",), ("ECONOMY",), ("Brand#2.ECONOMY.3",), ("nothing",)], "target string")
    return ownership.resolve_names(targets, symbols)


@query("""WITH spans AS (SELECT user_id AS file, event_id AS line, event_id + CASE WHEN event_id % 50 = 0 THEN 1000000000 ELSE value::BIGINT % 40 END AS end_line, event_id AS identity FROM events WHERE event_type <> 'error'),
p AS (SELECT user_id AS file, event_id AS "at" FROM events WHERE event_type = 'error'),
j AS (SELECT p.file, p."at", identity, row_number() OVER (PARTITION BY p.file, p."at" ORDER BY line DESC, end_line - line, identity) AS n FROM p JOIN spans s ON p.file = s.file AND line <= p."at" AND p."at" <= end_line)
SELECT file, "at", identity FROM j WHERE n = 1""")
def resolve_interval(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    spans = events.where("event_type <> 'error'").select(F.col("user_id").alias("file"), F.col("event_id").alias("line"), (F.col("event_id") + F.when(F.col("event_id") % 50 == 0, 1000000000).otherwise(F.bround("value", 0).cast("bigint") % 40)).alias("end_line"), F.col("event_id").alias("identity"))
    points = events.where("event_type = 'error'").select(F.col("user_id").alias("file"), F.col("event_id").alias("at"))
    return ownership.containing_interval(points, spans).select("file", "at", "identity")
