"""Readers of tool output: text, NUL-delimited, JSON and XML formats as DataFrames.

Each takes a DataFrame of whole files (path, content) or of lines (path, line_no, line), so files can come from any
store by Spark's text, binaryFile or JSON sources. Malformed rows are left out, as the formats' own tools do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.names import beside, in_tool_folder, relative_file
from cairn.functions.text import identity, normal_path
from cairn.operators.keys import first_by

# Fixed value: the shape of a build diagnostic line.
DIAGNOSTIC = r"^(.+?)\((\d+),(\d+)\):\s+(?i:(warning|error))\s+([^:\s]+):\s+(.*?)(?:\s+\[(.+?)\])?$"


def whole_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, content of text files below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return found.select("path", F.decode("content", F.lit("UTF-8")).alias("content"))


def file_lines(files: DataFrame) -> DataFrame:
    """path, line_no (from 1), line of whole files."""
    return files.select("path", F.posexplode(F.split("content", r"\r?\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def inventory(spark: SparkSession, root: str, exclude_dirs: list[str]) -> DataFrame:
    """Paths (relative to root), sizes and times of files outside the excluded directories; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    relative = F.regexp_replace("path", "^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")
    parts = F.split(relative, "/")
    inside = F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: p.isin(exclude_dirs))
    return found.where(~inside).select(relative.alias("path"), "length", F.col("modificationTime").alias("modified"))


def _records(files: DataFrame, pattern: str, fields: int) -> DataFrame:
    """Records of NUL-delimited content in one linear pass: matches of a pattern that begins where the one before ended; null-padded fields."""
    found = F.regexp_extract_all(F.concat("content", F.lit("\0")), F.lit(f"({pattern})"), F.lit(1))
    rows = files.select("path", F.explode(found).alias("record")).select("path", F.split("record", "\0").alias("f"))
    return rows.select("path", *[F.get("f", F.lit(i)).alias(f"f{i}") for i in range(fields)])


def git_status(files: DataFrame) -> DataFrame:
    """path, index_status, working_tree_status of `status --porcelain -z` output; a rename's old path is passed over.

    An entry is `XY path`; one with R or C takes the next field with it. Shorter fields than an entry are passed over.
    """
    rename = r"(?:[RC][^\x00]|[^\x00][RC])[^\x00]{2,}\x00[^\x00]*\x00"
    rows = _records(files, rename + r"|[^\x00]*\x00", 1).where(F.length("f0") >= 4)
    return rows.select(normal_path(F.substring("f0", 4, 1 << 30)).alias("path"), F.substring("f0", 1, 1).alias("index_status"), F.substring("f0", 2, 1).alias("working_tree_status"))


def working_tree(status: DataFrame, contents: DataFrame, own_folders: list[str]) -> DataFrame:
    """Rows of git_status() outside tool folders, with the content hash of the file (path, content); null where it is gone."""
    kept = status.where(~in_tool_folder(F.col("path"), own_folders))
    hashes = contents.select(normal_path(F.col("path")).alias("path"), F.sha2("content", 256).alias("content_hash"))
    return kept.join(hashes, "path", "left")


def git_name_status(files: DataFrame) -> DataFrame:
    """path, status of `diff --name-status -z` output; renames and copies give the old and the new path."""
    two = r"[RC][^\x00]*\x00[^\x00]*\x00[^\x00]*\x00"
    rows = _records(files, two + r"|[^\x00]+\x00[^\x00]*\x00|[^\x00]*\x00", 4)
    # The last field is what stands behind the record's last NUL: nothing.
    moved = F.col("f0").rlike("^[RC]") & F.col("f3").isNotNull()
    paths = F.when(moved, F.array("f1", "f2")).otherwise(F.array("f1"))
    out = rows.where("f0 <> '' and f2 is not null").select(F.explode(paths).alias("p"), F.substring("f0", 1, 1).alias("status"))
    return out.select(normal_path(F.col("p")).alias("path"), "status")


def git_numstat(lines: DataFrame) -> DataFrame:
    """commit, author, at, file, added, deleted of a log with `@@\\tsha\\tauthor\\tdate` headers before numstat rows.

    Headers are carried down each log in ranges of lines, so one long log is many tasks; binary files ("-") count no lines.
    """
    from cairn.operators.metrics import carry_headers

    head = F.when(F.col("line").startswith("@@\t"), F.col("line"))
    carried = carry_headers(lines.withColumn("header", head), "path", ["line_no"], "header").where(~F.col("line").startswith("@@\t") & F.col("line").rlike(r"^(\d+|-)\t(\d+|-)\t.+"))
    h, r = F.split("header", "\t"), F.split("line", "\t", 3)
    return carried.select(h[1].alias("commit"), h[2].alias("author"), F.to_timestamp(h[3]).alias("at"), normal_path(r[2]).alias("file"), F.try_to_number(r[0], F.lit("999999999")).cast("long").alias("added"), F.try_to_number(r[1], F.lit("999999999")).cast("long").alias("deleted"))


def build_log(lines: DataFrame, tool: str = "build") -> DataFrame:
    """Diagnostics of build log lines; of equal identities the last line counts."""
    part = lambda n: F.regexp_extract("line", DIAGNOSTIC, n)
    rows = lines.where(F.col("line").rlike(DIAGNOSTIC)).select("path", "line_no", normal_path(F.trim(part(1))).alias("file"), part(2).cast("int").alias("line_in"), part(3).cast("int").alias("column"), F.lower(part(4)).alias("severity"), part(5).alias("rule"), F.trim(part(6)).alias("message"), F.when(part(7) != "", part(7)).alias("project"))
    rows = rows.withColumn("identity", identity(F.lit(tool), F.col("severity"), F.col("rule"), F.col("file"), F.col("message")))
    last = first_by(rows, ["identity"], [F.desc("path"), F.desc("line_no")])
    return last.select("identity", F.lit(tool).alias("tool"), "severity", "rule", "file", F.col("line_in").alias("line"), "column", "message", "project")


def trx(files: DataFrame) -> DataFrame:
    """Test outcomes of TRX files: each result joined to its definition's class."""
    doc = F.regexp_replace(F.col("content"), r'xmlns="[^"]*"', "")
    schema = "struct<TestDefinitions:struct<UnitTest:array<struct<_id:string,_name:string,TestMethod:struct<_className:string>>>>,Results:struct<UnitTestResult:array<struct<_testId:string,_testName:string,_outcome:string,_duration:string,Output:struct<ErrorInfo:struct<Message:string>>>>>>"
    parsed = files.select("path", F.from_xml(doc, schema).alias("x"))
    tests = parsed.select("path", F.explode("x.TestDefinitions.UnitTest").alias("t")).select("path", F.col("t._id").alias("id"), F.col("t.TestMethod._className").alias("class_name"))
    results = parsed.select("path", F.explode("x.Results.UnitTestResult").alias("r")).select("path", F.col("r._testId").alias("id"), F.col("r._testName").alias("name"), F.col("r._outcome").alias("outcome"), F.split("r._duration", ":").alias("d"), F.col("r.Output.ErrorInfo.Message").alias("error_message"))
    ms = ((F.get("d", F.lit(0)).cast("double") * 3600 + F.get("d", F.lit(1)).cast("double") * 60 + F.get("d", F.lit(2)).cast("double")) * 1000).cast("long")
    joined = results.join(tests, ["path", "id"], "left")
    return joined.select(F.sha2(F.concat_ws("|", F.coalesce("class_name", F.lit("")), "name"), 256).alias("identity"), "name", "class_name", "outcome", ms.alias("duration_ms"), "error_message")


def sarif(files: DataFrame, root: str = "") -> DataFrame:
    """Diagnostics of SARIF files: first location, relative to root where it is below it; levels mapped to error, warning and info."""
    schema = "runs array<struct<results:array<struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,startColumn:int>>>>>>>>"
    r = files.select(F.explode(F.from_json("content", schema)["runs"]).alias("run")).select(F.explode("run.results").alias("r"))
    place = F.get("r.locations", F.lit(0))["physicalLocation"]
    level = F.when(F.lower("r.level") == "error", "error").when(F.lower("r.level").isin("note", "none"), "info").otherwise("warning")
    rows = r.select(F.lit("qodana").alias("tool"), level.alias("severity"), F.coalesce("r.ruleId", F.lit("QODANA")).alias("rule"), (relative_file(place["artifactLocation"]["uri"], root) if root else normal_path(F.url_decode(F.regexp_replace(place["artifactLocation"]["uri"], "^file://", "")))).alias("file"), place["region"]["startLine"].alias("line"), place["region"]["startColumn"].alias("column"), F.col("r.message.text").alias("message"))
    return rows.withColumn("identity", identity(F.col("tool"), F.col("severity"), F.col("rule"), F.coalesce("file", F.lit("")), F.col("message")))


def format_report(files: DataFrame) -> DataFrame:
    """Diagnostics of a formatter's JSON report, one for each identity."""
    schema = "array<struct<FilePath:string,FileChanges:array<struct<DiagnosticId:string,FormatDescription:string,LineNumber:int,CharNumber:int>>>>"
    rows = files.select(F.explode(F.from_json("content", schema)).alias("f")).select(normal_path(F.col("f.FilePath")).alias("file"), F.explode("f.FileChanges").alias("c"))
    rows = rows.select(F.lit("format").alias("tool"), F.lit("warning").alias("severity"), F.col("c.DiagnosticId").alias("rule"), "file", F.col("c.LineNumber").alias("line"), F.col("c.CharNumber").alias("column"), F.col("c.FormatDescription").alias("message"))
    rows = rows.withColumn("identity", identity(F.col("tool"), F.col("severity"), F.col("rule"), F.col("file"), F.col("message")))
    return first_by(rows, ["identity"], ["file", "line", "column"])


def cobertura(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, line, hits) and (file, rate) of Cobertura reports: lines of classes and of their methods; the rate stands for classes without lines."""
    line = "struct<line:array<struct<_number:int,_hits:long>>>"
    schema = f"struct<packages:struct<package:array<struct<classes:struct<class:array<struct<_filename:string,`_line-rate`:double,lines:{line},methods:struct<method:array<struct<lines:{line}>>>>>>>>>>"
    classes = files.select(F.explode(F.flatten(F.transform(F.from_xml("content", schema)["packages"]["package"], lambda p: p["classes"]["class"]))).alias("c"))
    none = F.array().cast("array<struct<_number:int,_hits:bigint>>")
    own = F.coalesce("c.lines.line", none)
    of_methods = F.flatten(F.transform(F.coalesce("c.methods.method", F.array().cast(f"array<struct<lines:{line.replace('long', 'bigint')}>>")), lambda m: F.coalesce(m["lines"]["line"], none)))
    every = F.filter(F.concat(own, of_methods), lambda x: x["_number"].isNotNull() & x["_hits"].isNotNull())
    named = classes.select(normal_path(F.col("c._filename")).alias("file"), every.alias("lines"), F.when(F.col("c.`_line-rate`").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("c.`_line-rate`"))) * 100).alias("rate")).where(F.trim("file") != "")
    lines = named.select("file", F.explode("lines").alias("l")).select("file", F.col("l._number").alias("line"), F.col("l._hits").alias("hits"))
    return lines, named.where("size(lines) = 0 and rate is not null").select("file", "rate")


def solution_projects(files: DataFrame) -> DataFrame:
    """path (of the solution), project: project paths of .sln, .slnx and .slnf files, from the root, as seen from the solution's folder.

    A filter's paths are seen from the folder of the solution that it names. Only C#, F# and Visual Basic projects count.
    """
    sln = F.regexp_extract_all("content", F.lit(r'(?m)^Project\("[^"]+"\)\s*=\s*"[^"]*",\s*"([^"]+)"'), F.lit(1))
    slnx = F.xpath(F.when(F.col("path").endswith(".slnx"), F.col("content")), F.lit("//*[local-name()='Project']/@Path"))
    slnf = F.from_json("content", "solution struct<path:string,projects:array<string>>")["solution"]
    found = F.when(F.col("path").endswith(".slnx"), slnx).when(F.col("path").endswith(".slnf"), slnf["projects"]).otherwise(sln)
    seen_from = F.when(F.col("path").endswith(".slnf"), beside(F.col("path"), F.coalesce(slnf["path"], F.lit("x")))).otherwise(F.col("path"))
    rows = files.select("path", seen_from.alias("__at"), F.explode(found).alias("project")).where(F.trim("project") != "")
    return rows.select("path", beside(F.col("__at"), F.col("project")).alias("project")).where(F.lower("project").rlike(r"\.(?:cs|fs|vb)proj$")).distinct()


def project_file(files: DataFrame) -> DataFrame:
    """Project rows of project XML: references from the root, packages, frameworks, and whether it is a test project.

    Elements count wherever they stand, with any quotes and attribute order. Only literal paths count. Of properties the last value holds.
    """
    of = lambda path: F.xpath("content", F.lit(path))
    every = lambda tag: of(f"//*[local-name()='{tag}']/@Include")
    last = lambda tag: F.trim(F.coalesce(F.try_element_at(F.filter(of(f"//*[local-name()='{tag}']/text()"), lambda x: F.trim(x) != ""), F.lit(-1)), F.lit("")))
    literal = F.filter(every("ProjectReference"), lambda p: (F.trim(p) != "") & ~p.rlike(r"\$\(|[*?%]"))
    updates = of("//*[local-name()='PackageReference'][not(@Include)]/@Update")
    x = files.select("path", literal.alias("refs"), F.filter(F.concat(every("PackageReference"), updates), lambda p: p != "").alias("packages"), last("TargetFrameworks").alias("many"), last("TargetFramework").alias("one"), last("IsTestProject").alias("test"))
    frameworks = F.filter(F.transform(F.split(F.when(F.col("many") != "", F.col("many")).otherwise(F.col("one")), ";"), lambda f: F.trim(f)), lambda f: f != "")
    by_name = F.lower("path").rlike(r"tests?\.\w+proj$")
    test = (F.lower("test") == "true") | F.exists("packages", lambda p: F.lower(p) == "microsoft.net.test.sdk") | by_name
    return x.select(normal_path(F.col("path")).alias("path"), F.regexp_extract("path", r"([^/\\]*)\.\w+proj$", 1).alias("name"), test.alias("is_test"), frameworks.alias("target_frameworks"), F.array_sort(F.transform("refs", lambda r: beside(F.col("path"), r))).alias("project_references"), "packages")


def evaluation(files: DataFrame) -> DataFrame:
    """Project rows of build evaluation JSON (Properties, Items): frameworks, sources, references, and whether it is a test project.

    A test project says so, or has the test SDK package, or is named so.
    """
    item = "array<struct<Identity:string>>"
    schema = f"struct<Properties:map<string,string>,Items:struct<Compile:{item},ProjectReference:{item},PackageReference:{item}>>"
    x = files.select(normal_path(F.col("path")).alias("path"), F.from_json("content", schema).alias("x"))
    value = lambda k: F.coalesce(F.element_at("x.Properties", k), F.lit(""))
    names = lambda k: F.transform(F.coalesce(F.col(f"x.Items.{k}.Identity"), F.array().cast("array<string>")), normal_path)
    own = F.regexp_extract("path", r"([^/]*)\.\w+$", 1)
    frameworks = F.filter(F.split(F.when(value("TargetFrameworks") != "", value("TargetFrameworks")).otherwise(value("TargetFramework")), ";"), lambda f: f != "")
    test = (F.lower(value("IsTestProject")) == "true") | F.exists(names("PackageReference"), lambda p: F.lower(p) == "microsoft.net.test.sdk") | F.lower("path").rlike(r"tests?\.\w+proj$")
    return x.select("path", F.when(value("AssemblyName") != "", value("AssemblyName")).otherwise(own).alias("name"), test.alias("is_test"), frameworks.alias("target_frameworks"), names("Compile").alias("source_files"), names("ProjectReference").alias("project_references"), names("PackageReference").alias("packages"))


def resolved_references(files: DataFrame) -> DataFrame:
    """path, kind (ReferencePath, Analyzer, Using), position, item: by file name and then by path, so that machines agree."""
    item = "array<struct<Identity:string>>"
    kinds = ["ReferencePath", "Analyzer", "Using"]
    x = files.select("path", F.from_json("content", f"struct<Items:struct<{','.join(f'{k}:{item}' for k in kinds)}>>")["Items"].alias("i"))
    named = lambda k: F.transform(F.array_sort(F.transform(F.col(f"i.{k}.Identity"), lambda p: F.struct(F.regexp_extract(p, r"([^/\\\\]*)$", 1).alias("n"), p.alias("p")))), lambda s: s["p"])
    rows = x.select("path", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), named(k).alias("items")) for k in kinds])).alias("g"))
    return rows.select("path", "g.kind", F.posexplode("g.items").alias("position", "item")).withColumn("position", (F.col("position") + 1).cast("long"))
