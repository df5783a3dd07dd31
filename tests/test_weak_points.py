"""Reports as tools write them, reasons behind scores, verdicts over runs."""

from pyspark.sql import functions as F

from cairn.functions.names import beside, plain_path, relative_file
from cairn.operators import delta, graph, lexical, metrics, selection
from cairn.sources import parsers as P


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, content string")


def test_project_files_in_any_spelling(spark):
    xml = "<Project Sdk='x'><Choose><When Condition=\"a &lt; b\"><ItemGroup><ProjectReference Condition='c' Include='..\\lib\\L.fsproj'/></ItemGroup></When></Choose><PropertyGroup><TargetFramework>net7</TargetFramework></PropertyGroup><PropertyGroup><TargetFrameworks> net8 ;net9</TargetFrameworks><IsTestProject>false</IsTestProject><IsTestProject>TRUE</IsTestProject></PropertyGroup><ItemGroup><PackageReference Version='1' Update='U'/><PackageReference Include='P'/><ProjectReference Include='a*.csproj'/></ItemGroup></Project>"
    r = P.project_file(files(spark, ("src/app/A.csproj", xml), ("B.csproj", "<Project xmlns='urn:m'><PropertyGroup><TargetFramework>net6</TargetFramework></PropertyGroup></Project>"))).orderBy("path").collect()
    assert (r[1].project_references, r[1].target_frameworks, r[1].is_test, r[1].packages) == (["src/lib/L.fsproj"], ["net8", "net9"], True, ["P", "U"])
    assert (r[0].project_references, r[0].target_frameworks, r[0].is_test, r[0].packages) == ([], ["net6"], False, [])


def test_solutions_are_seen_from_their_folder(spark):
    rows = files(
        spark, ("build/x.sln", 'Project("{A}") = "n", "..\\src\\A.csproj", "{B}"\r\nEndProject\nProject("{A}") = "folder", "docs", "{C}"'),
        ("build/y.slnx", "<Solution><Folder Name='f'><Project Type='t' Path='../src/B.vbproj'/></Folder></Solution>"), ("f/z.slnf", '{"solution":{"path":"..\\\\build\\\\x.sln","projects":["..\\\\src\\\\C.fsproj","q.txt"]}}'),
    )
    assert {(r.path, r.project) for r in P.solution_projects(rows).collect()} == {("build/x.sln", "src/A.csproj"), ("build/y.slnx", "src/B.vbproj"), ("f/z.slnf", "src/C.fsproj")}


def test_paths(spark):
    df = spark.createDataFrame([("a/./b/../c",), ("../x",), ("a\\..\\..\\y",), ("",)], "p string")
    assert [r[0] for r in df.select(plain_path(F.col("p"))).collect()] == ["a/c", "../x", "../y", ""]
    df = spark.createDataFrame([("d/f.x", "../g"), ("f.x", "g/h"), ("d/f.x", "/abs"), ("d\\e\\f.x", "C:\\q")], "a string, b string")
    assert [r[0] for r in df.select(beside(F.col("a"), F.col("b"))).collect()] == ["g", "g/h", "/abs", "C:/q"]
    cases = {"file:///r/s/a%20b.cs": "a b.cs", "file:///C:/z/q.cs": "C:/z/q.cs", "x/../y+1.cs": "y+1.cs", "/r/s/k.cs": "k.cs", "/r/t.cs": "/r/t.cs", "../up.cs": "/r/up.cs", " ": None}
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert {r.u: r.f for r in df.select("u", relative_file(F.col("u"), "/r/s").alias("f")).collect()} == cases


def test_coverage_takes_rates_only_where_there_are_no_lines(spark):
    xml = """<coverage><packages><package><classes>
      <class filename="/A\\x.cs" line-rate="0.9"><methods><method><lines><line number="1" hits="0"/><line number="2" hits="3"/></lines></method></methods><lines><line number="1" hits="2"/></lines></class>
      <class filename="b.cs" line-rate="0.5"/><class filename="B.cs" line-rate="7"/><class filename="a/X.cs" line-rate="0.1"/><class filename="c.cs"/></classes></package></packages></coverage>"""
    lines, rates = P.cobertura(files(spark, ("r", xml)))
    assert {r.file.lower(): r.coverage for r in metrics.merge_coverage(lines, rates).collect()} == {"a/x.cs": 100.0, "b.cs": 75.0}


def test_reasons_of_scores_and_neighbours(spark):
    symbols = spark.createDataFrame([("a", "OpenGate", "Yard.OpenGate", "gate.fs", "method"), ("b", "Fence", "Gate.Fence", "other.fs", "class")], "identity string, name string, semantic_name string, file string, kind string")
    got = {r.identity: r.reasons for r in lexical.score(symbols, "gate", ["gate"]).collect()}
    assert got == {"a": ["symbol word matches 'gate'", "file name matches 'gate'", "focused executable declaration"], "b": ["semantic name matches word 'gate'"]}
    edges = spark.createDataFrame([("a", "b", "construct"), ("a", "b", "construct"), ("c", "b", "attribute"), ("b", "lost", "call")], "source string, target string, relationship string")
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    rows = {r.id: (r.score, r.reasons) for r in graph.expand(spark.createDataFrame([("b", 40)], "id string, score int"), edges, 2, known).collect()}
    assert rows == {"b": (40, []), "a": (2 * (115 + 10 - 15), ["graph depth 1: used by 'construct'"]), "c": (85 + 10 - 15, ["graph depth 1: used by 'attribute'"])}
    one = graph.relation(edges, spark.createDataFrame([("b",)], "id string"), "callees", symbols=known)
    assert one.count() == 0


def test_verdicts(spark):
    runs = spark.createDataFrame([(1, "Succeeded", "Failed"), (2, "Failed", "Failed"), (3, "Succeeded", "Succeeded"), (4, "Succeeded", None), (5, None, "Failed")], "run int, build_before string, build_now string")
    found = spark.createDataFrame([(2, "x", "error", True), (2, "x", "error", True), (3, "y", "warning", True), (3, "z", "error", False)], "run int, identity string, severity string, is_new boolean")
    failures = spark.createDataFrame([(5, "t", True), (3, "t", False)], "run int, identity string, is_new boolean")
    for counted, want in ((True, {1, 2, 3, 4, 5}), (False, {1, 2, 4, 5})):
        got = delta.regressions(runs, found, failures, "run", ["build"], counted).collect()
        assert {r.run for r in got if r.regressed} == want and {r.run: r.new_errors for r in got}[2] == 1
    assert [selection.scope_for(*x) for x in (("automatic", "change"), ("automatic", "review"), ("path", "change"))] == ["changed", "full", "path"]
    outcomes = spark.createDataFrame([("s", "Completed"), ("s", "ABORTED"), ("s", "Inconclusive"), ("s", "what"), ("s", None)], "suite string, outcome string")
    assert metrics.test_counts(outcomes, ["suite"]).head()[:] == ("s", 5, 1, 1, 1)
