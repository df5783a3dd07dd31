"""Queries that run the readers of tool output over files made from the driver's orders, one file a customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.names import relative_file
from cairn.operators import metrics
from cairn.plans.registry import query
from cairn.session import table
from cairn.sources import parsers as P

NUL = "\u0000"


def _files(spark: SparkSession, d: str, piece: str, separator: str = "", head: str = "", tail: str = "", suffix: str = "") -> DataFrame:
    """path, content: the pieces of a customer's orders (a dozen or so) in order of their keys."""
    rows = table(spark, d, "orders").select("o_custkey", F.struct("o_orderkey", F.expr(piece).alias("piece")).alias("x"))
    pieces = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["piece"])
    made = rows.groupBy("o_custkey").agg(F.concat(F.lit(head), F.array_join(pieces, separator), F.lit(tail)).alias("content"))
    return made.select(F.concat(F.lit("f"), F.col("o_custkey").cast("string"), F.lit(suffix)).alias("path"), "content")


@query("""SELECT concat('src/', o_orderkey, '.cs') AS path, CASE o_orderstatus WHEN 'P' THEN 'R' WHEN 'F' THEN 'M' ELSE '?' END AS index_status,
CASE o_orderstatus WHEN 'O' THEN '?' ELSE ' ' END AS working_tree_status FROM orders""")
def read_git_status(spark: SparkSession, d: str) -> DataFrame:
    piece = f"concat(CASE o_orderstatus WHEN 'P' THEN 'R  ' WHEN 'F' THEN 'M  ' ELSE '?? ' END, 'src\\\\', o_orderkey, '.cs{NUL}', CASE o_orderstatus WHEN 'P' THEN 'old.cs{NUL}' ELSE '' END)"
    return P.git_status(_files(spark, d, piece))


@query("""SELECT concat('src/', o_orderkey, '.cs') AS path, CASE o_orderstatus WHEN 'P' THEN 'R' WHEN 'F' THEN 'M' ELSE 'A' END AS status FROM orders
UNION ALL SELECT concat('old/', o_orderkey), 'R' FROM orders WHERE o_orderstatus = 'P'""")
def read_git_name_status(spark: SparkSession, d: str) -> DataFrame:
    piece = f"concat(CASE o_orderstatus WHEN 'P' THEN concat('R100{NUL}old/', o_orderkey, '{NUL}') WHEN 'F' THEN 'M{NUL}' ELSE 'A{NUL}' END, 'src/', o_orderkey, '.cs{NUL}')"
    return P.git_name_status(_files(spark, d, piece))


@query("""SELECT concat('c', o_orderkey) AS "commit", 'Ann' AS author, strftime(o_orderdate, '%Y-%m-%d') AS day, f AS file, CASE WHEN o_custkey % 4 > 0 THEN o_custkey END AS added, CASE WHEN o_custkey % 4 > 0 THEN o_orderkey % 90 END AS deleted
FROM orders, (VALUES ('a.cs'), ('b/c.cs')) AS v(f)""")
def read_git_numstat(spark: SparkSession, d: str) -> DataFrame:
    counts = "CASE WHEN o_custkey % 4 > 0 THEN concat(o_custkey, '\\t', o_orderkey % 90) ELSE '-\\t-' END"
    piece = f"concat('@@\\tc', o_orderkey, '\\tAnn\\t', date_format(o_orderdate, 'yyyy-MM-dd'), 'T12:00:00Z\\n\\n', {counts}, '\\ta.cs\\n', {counts}, '\\tb\\\\c.cs\\n')"
    rows = P.git_numstat(P.file_lines(_files(spark, d, piece)))
    return rows.select("commit", "author", F.date_format("at", "yyyy-MM-dd").alias("day"), "file", "added", "deleted")


@query("""WITH r AS (SELECT concat('f', o_custkey) AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, concat('src/', o_custkey % 20, '.cs') AS file, o_orderkey % 500 + 1 AS line,
  CASE o_orderstatus WHEN 'F' THEN 'error' ELSE 'warning' END AS severity, concat('CS', o_orderkey % 3) AS rule FROM orders),
k AS (SELECT *, sha256(concat_ws('|', 'build', severity, rule, file, 'odd thing')) AS identity FROM r)
SELECT identity, 'build' AS tool, severity, rule, file, line, 7 AS col, 'odd thing' AS message, 'p.csproj' AS project FROM (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY path DESC, n DESC) AS k FROM k) WHERE k = 1""")
def read_build_log(spark: SparkSession, d: str) -> DataFrame:
    piece = "concat('src/', o_custkey % 20, '.cs(', o_orderkey % 500 + 1, ',7): ', CASE o_orderstatus WHEN 'F' THEN 'error' ELSE 'warning' END, ' CS', o_orderkey % 3, ': odd thing [p.csproj]\\nnoise')"
    rows = P.build_log(P.file_lines(_files(spark, d, piece, "\n")))
    return rows.select("identity", "tool", "severity", "rule", "file", F.col("line").cast("long").alias("line"), F.col("column").alias("col"), "message", "project")


@query("""SELECT sha256(concat_ws('|', CASE WHEN o_orderstatus <> 'P' THEN concat('C', o_orderkey % 9) ELSE '' END, concat('T', o_orderkey))) AS identity, concat('T', o_orderkey) AS name, CASE WHEN o_orderstatus <> 'P' THEN concat('C', o_orderkey % 9) END AS class_name,
CASE o_orderstatus WHEN 'F' THEN 'Failed' ELSE 'Passed' END AS outcome, 61500::BIGINT AS duration_ms, CASE WHEN o_orderstatus = 'F' THEN 'boom' END AS error_message FROM orders""")
def read_trx(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    test = "CASE WHEN o_orderstatus <> 'P' THEN concat('<UnitTest id=\"', o_orderkey, '\" name=\"T\"><TestMethod className=\"C', o_orderkey % 9, '\"/></UnitTest>') ELSE '' END"
    result = "concat('<UnitTestResult testId=\"', o_orderkey, '\" testName=\"T', o_orderkey, '\" outcome=\"', CASE o_orderstatus WHEN 'F' THEN 'Failed' ELSE 'Passed' END, '\" duration=\"00:01:01.5\">', CASE o_orderstatus WHEN 'F' THEN '<Output><ErrorInfo><Message>boom</Message></ErrorInfo></Output>' ELSE '' END, '</UnitTestResult>')"
    made = orders.groupBy("o_custkey").agg(F.array_join(F.collect_list(F.expr(test)), "").alias("t"), F.array_join(F.collect_list(F.expr(result)), "").alias("r"))
    content = F.concat(F.lit('<TestRun xmlns="http://x"><TestDefinitions><UnitTest id="none" name="N"><TestMethod className="N"/></UnitTest>'), "t", F.lit("</TestDefinitions><Results>"), "r", F.lit("</Results></TestRun>"))
    return P.trx(made.select(F.concat(F.lit("f"), "o_custkey").alias("path"), content.alias("content")))


@query("""WITH r AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'error' WHEN 'O' THEN 'info' ELSE 'warning' END AS severity, CASE WHEN o_orderkey % 5 > 0 THEN concat('R', o_orderkey % 5) ELSE 'QODANA' END AS rule, concat('src/a ', o_custkey, '.cs') AS file, o_orderkey AS line FROM orders)
SELECT sha256(concat_ws('|', 'qodana', severity, rule, file, 'm')) AS identity, severity, rule, file, line, 'm' AS message FROM r""")
def read_sarif(spark: SparkSession, d: str) -> DataFrame:
    piece = """concat('{', CASE WHEN o_orderkey % 5 > 0 THEN concat('"ruleId":"R', o_orderkey % 5, '",') ELSE '' END, '"level":"', CASE o_orderstatus WHEN 'F' THEN 'Error' WHEN 'O' THEN 'note' ELSE 'odd' END,
    '","message":{"text":"m"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"src/a%20', o_custkey, '.cs"},"region":{"startLine":', o_orderkey, '}}}]}')"""
    rows = P.sarif(_files(spark, d, piece, ",", '{"runs":[{"results":[', "]}]}"))
    return rows.select("identity", "severity", "rule", "file", F.col("line").cast("long").alias("line"), "message")


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN concat('src/a b/', o_custkey, '.cs') WHEN 1 THEN concat('src/', o_custkey, '.cs') WHEN 2 THEN concat('/elsewhere/', o_custkey, '+1.cs') END AS file FROM orders""")
def relative_files(spark: SparkSession, d: str) -> DataFrame:
    """File references of scanner reports, decoded and made relative to the repository's root."""
    uri = F.expr(r"CASE o_orderkey % 4 WHEN 0 THEN concat('file:///work/repo/src/a%20b/', o_custkey, '.cs') WHEN 1 THEN concat('./x/..\\src/', o_custkey, '.cs') WHEN 2 THEN concat('/work/repo/../../elsewhere/', o_custkey, '+1.cs') ELSE ' ' END")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), relative_file(uri, "/work/repo/").alias("file"))


@query("""WITH r AS (SELECT concat('W', o_orderkey % 2) AS rule, concat('src/', o_custkey, '.cs') AS file, o_orderkey AS line FROM orders)
SELECT sha256(concat_ws('|', 'format', 'warning', rule, file, 'fix')) AS identity, rule, file, min(line) AS line FROM r GROUP BY rule, file""")
def read_format_report(spark: SparkSession, d: str) -> DataFrame:
    piece = """concat('{"FilePath":"src\\\\\\\\', o_custkey, '.cs","FileChanges":[{"DiagnosticId":"W', o_orderkey % 2, '","FormatDescription":"fix","LineNumber":', o_orderkey, ',"CharNumber":1}]}')"""
    return P.format_report(_files(spark, d, piece, ",", "[", "]")).select("identity", "rule", "file", F.col("line").cast("long").alias("line"))


COVERED = "concat('<class filename=\"src/', o_custkey, '/', o_orderkey, '.cs\" line-rate=\"', CASE o_orderstatus WHEN 'P' THEN '1.5' ELSE '0.25' END, '\">', CASE o_orderstatus WHEN 'F' THEN concat('<lines><line number=\"', o_orderkey % 70, '\" hits=\"', o_custkey, '\"/></lines>') ELSE '' END, CASE WHEN o_orderkey % 4 = 0 THEN '<methods><method name=\"m\"><lines><line number=\"900\" hits=\"7\"/><line number=\"901\"/></lines></method></methods>' ELSE '' END, '</class>')"


def _coverage(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return P.cobertura(_files(spark, d, COVERED, "", "<coverage><packages><package><classes>", "</classes></package></packages></coverage>"))


@query("SELECT concat('src/', o_custkey, '/', o_orderkey, '.cs') AS file, o_orderkey % 70 AS line, o_custkey AS hits FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT concat('src/', o_custkey, '/', o_orderkey, '.cs'), 900, 7 FROM orders WHERE o_orderkey % 4 = 0")
def read_coverage_lines(spark: SparkSession, d: str) -> DataFrame:
    return _coverage(spark, d)[0].select("file", F.col("line").cast("long").alias("line"), "hits")


@query("SELECT concat('src/', o_custkey, '/', o_orderkey, '.cs') AS file, CASE o_orderstatus WHEN 'P' THEN 100.0::DOUBLE ELSE 25.0::DOUBLE END AS rate FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 4 <> 0")
def read_coverage_rates(spark: SparkSession, d: str) -> DataFrame:
    return _coverage(spark, d)[1].select("file", "rate")


@query("""WITH c AS (SELECT concat('src/', o_custkey, '/', o_orderkey, '.cs') AS file, o_orderstatus AS s, o_orderkey AS k, o_custkey AS hits FROM orders),
l AS (SELECT file, k % 70 AS line, hits FROM c WHERE s = 'F' UNION ALL SELECT file, 900, 7 FROM c WHERE k % 4 = 0),
r AS (SELECT file, CASE s WHEN 'P' THEN 100.0::DOUBLE ELSE 25.0::DOUBLE END AS rate FROM c WHERE s <> 'F' AND k % 4 <> 0 UNION ALL SELECT upper(file), 50.0 FROM c WHERE k % 5 = 0),
b AS (SELECT lower(file) AS f, line, max(hits) AS hits FROM l GROUP BY ALL), m AS (SELECT f, round(100.0 * count(*) FILTER (WHERE hits > 0) / count(*), 6) AS coverage FROM b GROUP BY f)
SELECT * FROM m UNION ALL SELECT lower(file), round(avg(rate), 6) FROM r WHERE lower(file) NOT IN (SELECT f FROM m) GROUP BY lower(file)""")
def coverage_with_rates(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of every file of the reports, by rates where there are no lines; a second report names files in capitals."""
    lines, rates = _coverage(spark, d)
    other = table(spark, d, "orders").where("o_orderkey % 5 = 0").select(F.expr("upper(concat('src/', o_custkey, '/', o_orderkey, '.cs'))").alias("file"), F.lit(50.0).alias("rate"))
    return metrics.merge_coverage(lines, rates.union(other)).select(F.lower("file").alias("f"), F.round("coverage", 6).alias("coverage"))


def _solutions_sql(suffix: str) -> str:
    return f"SELECT DISTINCT concat('f', o_custkey, '{suffix}') AS path, concat('src/', o_orderkey % 50, '.csproj') AS project FROM orders"


@query(f"{_solutions_sql('.sln')} UNION ALL {_solutions_sql('.slnx')} UNION ALL {_solutions_sql('.slnf')}")
def read_solutions(spark: SparkSession, d: str) -> DataFrame:
    sln = _files(spark, d, "concat('Project(\"{X}\") = \"n\", \"src\\\\', o_orderkey % 50, '.csproj\", \"{Y}\"\\nEndProject\\n')", suffix=".sln")
    slnx = _files(spark, d, "concat('<Project Id=\"a\" Path=\"src/', o_orderkey % 50, '.csproj\" />')", "", "<Solution>", "</Solution>", ".slnx")
    slnf = _files(spark, d, "concat('\"src/', o_orderkey % 50, '.csproj\"')", ",", '{"solution":{"projects":[', "]}}", ".slnf")
    return P.solution_projects(sln.union(slnx).union(slnf))


PROJECT_PIECE = "concat(CASE o_orderstatus WHEN 'P' THEN '<PackageReference Include=\"Microsoft.NET.Test.Sdk\" />' WHEN 'F' THEN concat('<ProjectReference Include=\"../p', o_orderkey, '/p.csproj\" />') ELSE '<ProjectReference Include=\"$(Root)/x.csproj\" />' END)"


@query("""SELECT concat('f', o_custkey, '.csproj') AS path, concat('f', o_custkey) AS name, bool_or(o_orderstatus = 'P') AS is_test, 'net8,net9' AS target_frameworks, coalesce(string_agg('../p' || o_orderkey || '/p.csproj', ',' ORDER BY '../p' || o_orderkey || '/p.csproj') FILTER (WHERE o_orderstatus = 'F'), '') AS project_references FROM orders GROUP BY o_custkey""")
def read_project_files(spark: SparkSession, d: str) -> DataFrame:
    rows = P.project_file(_files(spark, d, PROJECT_PIECE, "", "<Project><TargetFrameworks>net8;net9</TargetFrameworks>", "</Project>", ".csproj"))
    return rows.select("path", "name", "is_test", F.array_join("target_frameworks", ",").alias("target_frameworks"), F.array_join("project_references", ",").alias("project_references"))


@query("""SELECT concat('f', o_custkey, '.proj') AS path, concat('N', o_custkey) AS name, o_custkey % 2 = 0 OR bool_or(o_orderstatus = 'P') AS is_test, 'net9' AS target_frameworks,
string_agg(concat('src/', o_orderkey, '.cs'), ',' ORDER BY o_orderkey) AS source_files FROM orders GROUP BY o_custkey""")
def read_evaluations(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    compile_ = F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: F.concat(F.lit('{"Identity":"src\\\\'), k.cast("string"), F.lit('.cs"}'))), ",")
    packages = F.array_join(F.collect_list(F.when(F.col("o_orderstatus") == "P", F.lit('{"Identity":"microsoft.NET.test.sdk"}'))), ",")
    made = orders.groupBy("o_custkey").agg(compile_.alias("c"), packages.alias("p"))
    flag = F.when(F.col("o_custkey") % 2 == 0, "True").otherwise("")
    content = F.concat(F.lit('{"Properties":{"TargetFramework":"net9","TargetFrameworks":"","IsTestProject":"'), flag, F.lit('","AssemblyName":"N'), "o_custkey", F.lit('"},"Items":{"Compile":['), "c", F.lit('],"PackageReference":['), "p", F.lit("]}}"))
    rows = P.evaluation(made.select(F.concat(F.lit("f"), "o_custkey", F.lit(".proj")).alias("path"), content.alias("content")))
    return rows.select("path", "name", "is_test", F.array_join("target_frameworks", ",").alias("target_frameworks"), F.array_join("source_files", ",").alias("source_files"))


@query("""SELECT concat('f', o_custkey) AS path, CASE o_orderstatus WHEN 'F' THEN 'Analyzer' WHEN 'O' THEN 'Using' ELSE 'ReferencePath' END AS kind,
(row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY concat('n', o_orderkey % 7, CASE WHEN o_orderstatus <> 'O' THEN '.dll' ELSE '' END), CASE WHEN o_orderstatus = 'O' THEN concat('n', o_orderkey % 7) ELSE concat('/lib/', o_orderkey, '/n', o_orderkey % 7, '.dll') END))::BIGINT AS position,
CASE WHEN o_orderstatus = 'O' THEN concat('n', o_orderkey % 7) ELSE concat('/lib/', o_orderkey, '/n', o_orderkey % 7, '.dll') END AS item FROM orders""")
def read_references(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    item = lambda status, text: F.array_join(F.collect_list(F.when(F.col("o_orderstatus") == status, F.expr(text))), ",")
    dll = "concat('{\"Identity\":\"/lib/', o_orderkey, '/n', o_orderkey % 7, '.dll\"}')"
    made = orders.groupBy("o_custkey").agg(item("F", dll).alias("a"), item("O", "concat('{\"Identity\":\"n', o_orderkey % 7, '\"}')").alias("u"), item("P", dll).alias("r"))
    content = F.concat(F.lit('{"Items":{"ReferencePath":['), "r", F.lit('],"Analyzer":['), "a", F.lit('],"Using":['), "u", F.lit("]}}"))
    return P.resolved_references(made.select(F.concat(F.lit("f"), "o_custkey").alias("path"), content.alias("content")))
