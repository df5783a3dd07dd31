import random

import pytest
from pyspark.sql import functions as F

from cairn.functions.text import shared_input
from cairn.operators import metrics, ordered, ownership
from cairn.operators.fingerprint import fingerprints
from cairn.sources import parsers as P


@pytest.fixture
def many_parts(spark):
    """Ranges stay as many as asked for, so that a small series spans several."""
    for k, v in (("spark.sql.shuffle.partitions", "9"), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
        spark.conf.set(k, v)
    yield spark
    for k, v in (("spark.sql.shuffle.partitions", "4"), ("spark.sql.adaptive.coalescePartitions.enabled", "true")):
        spark.conf.set(k, v)


def test_running_sums_and_carried_values(many_parts):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else None if i % 2 else f"s{i % 5}", i, rng.choice([None, i]), rng.choice([None, 1, 5])) for i in range(400)]
    df = many_parts.createDataFrame(rows, "s string, at int, header int, size long").repartition(3)
    sums, last, want = {}, {}, {}
    for s, at, header, size in rows:
        sums[s] = sums.get(s, 0) + (size or 0)
        last[s] = header if header is not None else last.get(s)
        want[at] = (sums[s], last[s])
    assert {r.at: r.used for r in ordered.running_sums(df, ["s"], ["at"], {"size": "used"}).collect()} == {k: v[0] for k, v in want.items()}
    assert {r.at: r.header for r in ordered.carry_last(df, ["s"], ["at"], "header").collect()} == {k: v[1] for k, v in want.items()}
    assert {r.at for r in metrics.prefix_within(df, "s", "at", "size", 60).collect()} == {k for k, v in want.items() if v[0] <= 60}
    assert ordered.carry_last(df.limit(0), ["s"], ["at"], "header").count() == 0


def test_dyadic_blocks_cover_a_span_exactly(spark):
    spans = [(a, a + n) for a in (-7, 0, 1, 5, 8, 63) for n in (0, 1, 2, 7, 8, 30)] + [(3, 10**9 + 2)]
    covered = {}
    for r in ownership.span_blocks(spark.createDataFrame(spans, "a long, b long"), "a", "b").collect():
        covered.setdefault((r.a, r.b), []).append((r.number << r.level, (r.number + 1) << r.level))
    assert set(covered) == set(spans)
    for (a, b), blocks in covered.items():
        blocks.sort()
        assert blocks[0][0] == a and blocks[-1][1] == b + 1 and all(x[1] == y[0] for x, y in zip(blocks, blocks[1:], strict=False))
        assert len(blocks) <= 60


def test_intervals_match_brute_force(spark):
    rng = random.Random(2)
    spans = [(f"f{rng.randrange(3)}", a := rng.randrange(-20, 60), rng.choice([None, a, a - 1, a + rng.randrange(50), a + 10**12]), f"i{k}") for k in range(60)]
    points = [(f"f{rng.randrange(4)}", rng.randrange(-30, 120)) for _ in range(80)] + [(None, 3), ("f0", None)]
    want = {}
    for f, at in points:
        around = [(-a, (a if b is None else b) - a, i) for g, a, b, i in spans if f is not None and at is not None and g == f and a <= at <= (a if b is None else b)]
        if around:
            want[f, at] = min(around)[2]
    args = (spark.createDataFrame(points, "file string, at long"), spark.createDataFrame(spans, "file string, line long, end_line long, identity string"))
    assert {(r.file, r["at"]): r.identity for r in ownership.containing_interval(*args).collect()} == want
    none = ownership.containing_interval(args[0], args[1].limit(0))
    assert none.count() == 0 and none.columns == ["file", "at", "line", "end_line", "identity"]


def test_fingerprints_depend_on_lines_alone(spark):
    rows = [("a", f"x{i % 300}") for i in range(1000)] + [("b", "y"), ("b", None), (None, "z")]
    of = lambda rs, n: {r.k: r.fingerprint for r in fingerprints(spark.createDataFrame(rs, "k string, line string").repartition(n), ["k"], F.col("line")).collect()}
    first = of(rows, 2)
    assert first == of(rows[::-1], 7) and set(first) == {"a", "b", None}
    assert of([*rows, ("a", "x0")], 2)["a"] != first["a"] and of([*rows, ("a", "x0")], 2)["b"] == first["b"]


def status_by_hand(content):
    out, skip = [], False
    for s in content.split("\0"):
        if skip or len(s) < 4:
            skip = False
            continue
        out.append((s[3:], s[0], s[1]))
        skip = s[0] in "RC" or s[1] in "RC"
    return out


def names_by_hand(content):
    out, status, due = [], "", 0
    for s in content.split("\0"):
        if due:
            out.append((s, status))
            due -= 1
        elif s:
            status, due = s[0], 2 if s[0] in "RC" else 1
    return out


def test_records_are_parsed_as_by_a_state_machine(spark):
    rng = random.Random(3)
    pieces = ["R  a", "M  R  b", "R  R  c", " C d", "?? e", "x", "", "R", "M", "A", "R100", "C75", "Ma", "new\nline"]
    contents = ["\0".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14))) + "\0" for _ in range(150)]
    files = spark.createDataFrame([(str(i), c) for i, c in enumerate(contents)], "path string, content string")
    assert sorted((r.path, r.index_status, r.working_tree_status) for r in P.git_status(files).collect()) == sorted(x for c in contents for x in status_by_hand(c))
    odd = [p for p in pieces if p]  # paths that look like statuses
    whole = ["\0".join(f"{k}\0{rng.choice(odd)}" + (f"\0{rng.choice(odd)}" if k[0] in "RC" else "") for k in rng.choices(["M", "A", "D", "R100", "C075"], k=rng.randrange(1, 9))) + "\0" for _ in range(150)]
    files = spark.createDataFrame([(str(i), c) for i, c in enumerate(whole)], "path string, content string")
    assert sorted((r.path, r.status) for r in P.git_name_status(files).collect()) == sorted(x for c in whole for x in names_by_hand(c))
    cut = spark.createDataFrame([("c", "M\0a\0R100\0old")], "path string, content string")
    assert [(r.path, r.status) for r in P.git_name_status(cut).collect()][0] == ("a", "M")


def test_a_million_entries_of_one_file(spark):
    entry = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1_000_000)), lambda i: F.concat(F.lit("R  src/new"), i.cast("string"), F.lit("\0old"))), "\0")
    files = spark.range(1).select(F.lit("s").alias("path"), F.concat(entry, F.lit("\0")).alias("content"))
    assert P.git_status(files).agg(F.count("*"), F.count_distinct("path")).head()[:] == (1_000_000, 1_000_000)


def test_working_tree_has_hashes_and_no_tool_paths(spark):
    status = spark.createDataFrame([("a.cs", "M", " "), ("x/obj/b.cs", "?", "?"), ("gone.cs", "D", " "), (".own/c", "M", " ")], "path string, index_status string, working_tree_status string")
    contents = spark.createDataFrame([("a.cs", "text"), ("x/obj/b.cs", "b")], "path string, content string")
    assert sorted((r.path, (r.content_hash or "")[:6]) for r in P.working_tree(status, contents, [".own"]).collect()) == [("a.cs", "982d9e"), ("gone.cs", "")]


def test_shared_inputs(spark):
    names = {"x/Nested.sln": True, "q.slnx": True, "deep/er/.globalconfig": True, "our.editorconfig": True, "GLOBAL.JSON": True, "a/nuget.CONFIG": True, "rules.RuleSet": True, "b.targets": True, "sln": False, "global.json.bak": False, "x.slnf": False, "editorconfig": False}
    df = spark.createDataFrame(list(names.items()), "p string, w boolean")
    assert all(r.got == r.w for r in df.select("p", "w", shared_input(F.col("p")).alias("got")).collect())
    projects = spark.createDataFrame([("lib/a.csproj",), ("app/b.csproj",)], "path string")
    paths = spark.createDataFrame([("lib/Directory.Build.props",), ("docs/Odd.sln",), ("top.cs",)], "path string")
    got = {(r.path, r.project, r.reason) for r in ownership.owners(paths, projects, spark.createDataFrame([], "path string, project string")).collect()}
    assert got == {("lib/Directory.Build.props", "lib/a.csproj", "shared"), ("docs/Odd.sln", ownership.EVERY, "shared everywhere")}
