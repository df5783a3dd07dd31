import pytest
from pyspark.sql import functions as F

from cairn.operators import store
from cairn.sources import parsers as P
from cairn.streaming.deltas import stream_deltas


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, content string")


def test_git_formats(spark):
    status = P.git_status(files(spark, ("s", " M a.cs\0R  new.cs\0old.cs\0?? b\\c.cs\0"))).collect()
    assert [(r.path, r.index_status, r.working_tree_status) for r in status] == [("a.cs", " ", "M"), ("new.cs", "R", " "), ("b/c.cs", "?", "?")]
    names = P.git_name_status(files(spark, ("s", "M\0a.cs\0R100\0old.cs\0new.cs\0D\0z\0"))).collect()
    assert [tuple(r) for r in names] == [("a.cs", "M"), ("old.cs", "R"), ("new.cs", "R"), ("z", "D")]
    log = "@@\tc1\tAnn\t2024-01-02T00:00:00Z\n3\t1\ta.cs\n-\t-\tb.bin\n\n@@\tc2\tann\t2024-01-03T00:00:00Z\n1\t0\ta.cs"
    rows = P.git_numstat(P.file_lines(files(spark, ("log", log)))).orderBy("commit", "file").collect()
    assert [(r.commit, r.file, r.added, r.deleted) for r in rows] == [("c1", "a.cs", 3, 1), ("c1", "b.bin", None, None), ("c2", "a.cs", 1, 0)]


def test_build_log_last_write_wins(spark):
    text = "src/A.cs(3,7): warning CS1: odd thing [p.csproj]\nnoise\nsrc/A.cs(9,1): warning CS1: odd thing [p.csproj]\nB.cs(1,1): ERROR X2: bad"
    rows = P.build_log(P.file_lines(files(spark, ("l", text)))).orderBy("file").collect()
    assert [(r.file, r.line, r.severity, r.rule, r.message, r.project) for r in rows] == [("B.cs", 1, "error", "X2", "bad", None), ("src/A.cs", 9, "warning", "CS1", "odd thing", "p.csproj")]


def test_json_formats(spark):
    report = '{"runs":[{"results":[{"level":"error","message":{"text":"m"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"a%20b.cs"},"region":{"startLine":4}}}]},{"ruleId":"R","level":"note","message":{"text":"n"}}]}]}'
    rows = {r.rule: r for r in P.sarif(files(spark, ("r", report))).collect()}
    assert (rows["QODANA"].severity, rows["QODANA"].file, rows["QODANA"].line) == ("error", "a b.cs", 4) and rows["R"].severity == "info" and rows["R"].file is None
    fmt = '[{"FilePath":"a.cs","FileChanges":[{"DiagnosticId":"W","FormatDescription":"fix","LineNumber":5,"CharNumber":1},{"DiagnosticId":"W","FormatDescription":"fix","LineNumber":2,"CharNumber":1}]}]'
    assert [(r.rule, r.line) for r in P.format_report(files(spark, ("f", fmt))).collect()] == [("W", 2)]


def test_xml_formats(spark):
    trx = '<TestRun xmlns="http://x"><TestDefinitions><UnitTest id="1" name="T"><TestMethod className="C"/></UnitTest></TestDefinitions><Results><UnitTestResult testId="1" testName="T" outcome="Failed" duration="00:00:01.5"><Output><ErrorInfo><Message>boom</Message></ErrorInfo></Output></UnitTestResult><UnitTestResult testId="2" testName="U" outcome="Passed"/></Results></TestRun>'
    rows = {r.name: r for r in P.trx(files(spark, ("t", trx))).collect()}
    assert (rows["T"].class_name, rows["T"].duration_ms, rows["T"].error_message) == ("C", 1500, "boom") and rows["U"].class_name is None
    cov = '<coverage><packages><package><classes><class filename="a\\b.cs" line-rate="0.5"><lines><line number="1" hits="0"/><line number="2" hits="3"/></lines></class><class filename="c.cs" line-rate="1.5"/></classes></package></packages></coverage>'
    lines, rates = P.cobertura(files(spark, ("c", cov)))
    assert [tuple(r) for r in lines.orderBy("line").collect()] == [("a/b.cs", 1, 0), ("a/b.cs", 2, 3)] and [tuple(r) for r in rates.collect()] == [("c.cs", 100.0)]
    sln = files(spark, ("x.sln", 'Project("{F}") = "A", "src\\A\\A.csproj", "{G}"'), ("x.slnx", '<Solution><Project Path="src/A/A.csproj"/></Solution>'), ("x.slnf", '{"solution":{"projects":["src\\\\A\\\\A.csproj"]}}'))
    assert {r.project for r in P.solution_projects(sln).collect()} == {"src/A/A.csproj"}
    proj = P.project_file(files(spark, ("t/A.Tests.csproj", '<Project><TargetFramework>net8.0</TargetFramework><ProjectReference Include="..\\A\\A.csproj"/><ProjectReference Include="$(X)"/></Project>'))).head()
    assert proj.is_test and proj.project_references == ["A/A.csproj"] and proj.target_frameworks == ["net8.0"]


def test_store_and_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    table, hit = store.materialise(spark, str(tmp_path), "t", "h1", lambda: df)
    again, hit2 = store.materialise(spark, str(tmp_path), "t", "h1", lambda: 1 / 0)
    assert (hit, hit2) == (False, True) and again.count() == table.count() == 2
    store.publish(df, str(tmp_path / "snap"))
    assert store.read_published(spark, str(tmp_path / "snap")).count() == 2
    assert '"additionalProperties": false' in store.json_schema(df.schema, "t")
    for i, rows in enumerate([[(1, "a"), (2, "b")], [(2, "b"), (3, "c")]]):
        spark.createDataFrame(rows, df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        if i:
            stream_deltas(stream, "id", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    new = spark.read.parquet(str(tmp_path / "out" / "new")).count()
    assert new == 3


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    schema, got = "id long, v string", {}
    for i, rows in enumerate([[(1, "a"), (2, "b")], [(2, "b"), (3, "c")], [(3, "c")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        stream_deltas(stream, "id", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        for kind in ("new", "resolved"):
            got[kind, i] = sorted(r.id for r in spark.read.schema(schema).parquet(str(tmp_path / "out" / kind / f"epoch={i}")).collect())
    assert got == {("new", 0): [1, 2], ("resolved", 0): [], ("new", 1): [3], ("resolved", 1): [1], ("new", 2): [], ("resolved", 2): [2]}
