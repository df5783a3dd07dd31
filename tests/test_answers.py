import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import affected, benchmark, inventory, lexical, narrative, ordered, types
from cairn.session import Staging


def bounded_by_hand(items, base, budget, around=3):
    names = [d for d, _, _ in narrative.CLEARED]
    full = {d: [s or 0 for _, s in sorted((p, s) for x, p, s in items if x == d)] for d in names}

    def line(kept):
        parts = [f"{len(full[d]) - kept[d]} of {len(full[d])} {label}" for d, label, _ in narrative.CLEARED if kept[d] < len(full[d])]
        return narrative.GAP_HEAD + ", ".join(parts) + narrative.GAP_TAIL if parts else None

    def tokens(kept):
        gap = line(kept)
        return -(-(base + sum(sum(full[d][: kept[d]]) for d in names) + (len(gap) + around if gap else 0)) // 4)

    kept = {d: len(full[d]) for d in names}
    if tokens(kept) > budget:
        for i, (d, _, least) in enumerate(narrative.CLEARED):
            if i < 2 and tokens({**kept, d: 0}) > budget:
                kept[d] = 0
                continue
            kept[d] = min(len(full[d]), max([least, *(n for n in range(len(full[d]) + 1) if tokens({**kept, d: n}) <= budget)]))
            break
    return tokens(kept), line(kept), tuple(kept.values())


def test_narratives_are_bounded_as_by_hand(spark):
    rng = random.Random(1)
    rows = []
    for s in range(12):
        for d, _, _ in narrative.CLEARED:
            rows += [(f"s{s}", d, p, rng.choice([None, 0, 9, 40, 200])) for p in range(rng.choice([0, 1, 5, 30]))]
    df = spark.createDataFrame(rows, "series string, dimension string, position int, size int").repartition(3)
    cuts = set()
    for budget in (60, 150, 400, 700, 2000):
        report, kept = narrative.bound_narrative(df, F.lit(120), budget)
        got = {r.series: r for r in report.collect()}
        items = {}
        for r in kept.collect():
            items.setdefault((r.series, r.dimension), []).append(r.position)
        for s in {r[0] for r in rows}:
            want = bounded_by_hand([r[1:] for r in rows if r[0] == s], 120, budget)
            r = got[s]
            assert (r.tokens, r.gap, (r.kept_type_definitions, r.kept_symbols, r.kept_hotspots)) == want
            assert r.truncated == (want[1] is not None)
            for (d, _, _), n in zip(narrative.CLEARED, want[2], strict=True):
                assert sorted(items.get((s, d), [])) == list(range(n))
            cuts.add(tuple(n == 0 for n in want[2]))
    assert len(cuts) > 3
    assert narrative.bound_narrative(df.limit(0), F.lit(1), 10)[0].count() == 0


def test_a_series_of_all_items_is_many_tasks(spark):
    for k, v in (("spark.sql.shuffle.partitions", "8"), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
        spark.conf.set(k, v)
    try:
        df = spark.range(5000).select(F.lit("one").alias("series"), F.lit("symbols").alias("dimension"), F.col("id").alias("position"), F.lit(100).alias("size"))
        report, kept = narrative.bound_narrative(df, F.lit(0), 100_000)
        assert kept.count() == report.head().kept_symbols == (400_000 - len(report.head().gap) - 3) // 100
        spread = ordered.ranges(df, ["series"], ["position"], Staging()).groupBy("__part").count().collect()
        assert len(spread) > 3 and max(r["count"] for r in spread) < 2000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


FRAGMENT = "identity string, file string, line int, end_line int, kind string, modifiers array<string>, attributes array<struct<name:string,arguments:array<string>>>, interfaces array<string>, members array<struct<identity:string,file:string,line:int,text:string>>"


def test_partial_types_are_merged(spark):
    rows = [
        ("t", "b.cs", 9, 12, "late", ["partial", "public", "sealed"], [("X", ["1"]), ("A", [])], ["IZ", "IA"], [("m1", "b.cs", 10, "second"), ("m3", "b.cs", 11, "third")]),
        ("t", "a.cs", 5, 8, "first", ["static", "partial"], [("A", []), ("X", ["0"])], ["IZ"], [("m2", "a.cs", 7, "x"), ("m1", "a.cs", 6, "kept"), ("m1", "a.cs", 6, "same fragment, later")]),
        ("t", "a.cs", 5, 8, "first", ["static", "partial"], [("A", []), ("X", ["0"])], ["IZ"], [("m2", "a.cs", 7, "x")]),
        ("u", "c.cs", 1, None, "alone", None, None, None, None), ("v", "c.cs", 2, 3, "empty", [], [], [], []),
    ]
    got = {r.identity: r for r in types.merge_partial_types(spark.createDataFrame(rows, FRAGMENT).repartition(3)).collect()}
    t = got["t"]
    assert t.kind == "first" and t.modifiers == ["static", "sealed", "partial", "public"] and t.interfaces == ["IA", "IZ"]
    assert [(a.name, a.arguments) for a in t.attributes] == [("A", []), ("X", ["0"]), ("X", ["1"])]
    assert [(m.identity, m.text) for m in t.members] == [("m1", "kept"), ("m2", "x"), ("m3", "third")]
    assert [(d.file, d.line) for d in t.declarations] == [("a.cs", 5), ("b.cs", 9)]
    assert got["u"].kind == "alone" and got["u"].members == got["v"].members == [] and got["u"].modifiers == [] and len(got["u"].declarations) == 1


def test_affected_sets_say_how_they_were_reached(spark):
    frame = spark.createDataFrame
    symbol = "identity string, kind string, name string, namespace string, containing_type string, project string, file string"
    was = frame([("old", "method", "Old", "N", "C", "p1", "a.cs"), ("core", "method", "Was", "N", "C", "p1", "a.cs")], symbol)
    now = frame([("core", "method", "Core", "N", "C", "p1", "a.cs"), ("mid", "method", "Mid", "N", "M", "p2", "m.cs"), ("test", "test", "Checks", "N", "T", "P3", "t.cs"), ("far", "test", "Far", "N", "T", "p9", "z.cs")], symbol)
    both = affected.united(was, now, "identity")
    assert {r.identity: r.name for r in both.collect()}["core"] == "Was" and both.count() == 5
    references = frame([("mid", "old", "p2"), ("test", "mid", "p3"), ("core", "core", "p1"), ("mid", "core", "p2")], "source string, target string, source_project string")
    projects = frame([("p1", False), ("p2", False), ("p3", True), ("p4", True), ("p9", True)], "path string, is_test boolean")
    items = frame([("A.cs", "p1")], "path string, project string")
    needs = frame([("p4", "P2"), ("p2", "p1")], "source string, target string")
    got = {(r.what, r.id): (r.via, r.seed, r.wave) for r in affected.affected(frame([("A.cs",)], "path string"), both, references, projects, items, needs).collect()}
    assert got == {
        ("symbol", "old"): ("changed", "A.cs", 0), ("symbol", "core"): ("changed", "A.cs", 0), ("symbol", "mid"): ("reference", "A.cs", 1), ("symbol", "test"): ("reference", "A.cs", 2),
        ("project", "p1"): ("owner", "A.cs", 0), ("project", "p2"): ("reference", "A.cs", 0), ("project", "p3"): ("reference", "A.cs", 0), ("project", "p4"): ("dependency", "A.cs", 1),
        ("test-project", "p3"): ("reference", "A.cs", 0), ("test-project", "p4"): ("dependency", "A.cs", 1), ("test-case", "N.T.Checks"): ("reference", "A.cs", 2),
    }
    shared = affected.affected(frame([("x/global.json",)], "path string"), both, references, projects, items.limit(0), needs)
    assert {r.id for r in shared.where("what = 'project'").collect()} == {"p1", "p2", "p3", "p4", "p9"}
    assert affected.affected(frame([], "path string"), both, references, projects, items, needs).count() == 0


def test_expectations_by_kind_or_by_files(spark):
    frame = spark.createDataFrame
    blocks = frame([("c", "b1", "src\\Door.fs"), ("c", "b2", "/src/Hinge.fs"), ("d", "b1", "src/Door.fs")], "case string, block string, file string")
    actual = frame([("c", "b1", "b2", "Construct"), ("c", "b1", "unknown", "Override")], "case string, source_block string, target_block string, relationship string")
    wanted = ["construct", " OVERRIDE", "Construct: SRC/door.fs -> src\\Hinge.fs", "construct: src/Hinge.fs -> src/Door.fs", "Override: src/Door.fs -> src/Hinge.fs", "read", "READ"]
    expected = frame([("c", w) for w in wanted] + [("d", "construct")], "case string, expected string")
    got = sorted((r["case"], r.expected) for r in benchmark.missing_relationships(expected, actual, blocks).collect())
    assert got == sorted([("c", "construct: src/Hinge.fs -> src/Door.fs"), ("c", "Override: src/Door.fs -> src/Hinge.fs"), ("c", "READ"), ("d", "construct")])
    for bad in ("read: a", "read: a -> b -> c"):
        with pytest.raises(Exception, match="an expected relationship is a kind"):
            benchmark.missing_relationships(frame([("c", bad)], "case string, expected string"), actual, blocks).collect()
    cases = frame([("a", 1.0, 0.5, 10, 0, False), ("b", 0.5, 1.0, 20, 2, True)], "case string, file_recall double, file_precision double, tokens int, failures int, advisory boolean")
    assert benchmark.benchmark_summary(cases).head()[:] == (2, 0.75, 0.75, 30, True, 1)
    assert benchmark.benchmark_summary(cases.limit(0)).head()[:] == (0, None, None, 0, True, 0)


@pytest.mark.parametrize(
    ("rules", "kept", "left_out"),
    [
        (["*.log", "!keep.log"], ["a/keep.log", "x.txt"], ["b.log", "a/b.log"]),
        (["build/"], ["a/build"], ["build/x", "a/build/x/y"]),
        (["/top", "mid/deep"], ["a/top", "a/mid/deep"], ["top", "top/x", "mid/deep/z"]),
        (["a/**/z", "**/tmp?", "q/**"], ["a/zz", "tmp", "q"], ["a/z", "a/b/c/z", "k/tmp1", "q/r/s"]),
        (["dir/", "!dir/back"], ["x"], ["dir/back", "dir/a"]),
        (["# no", "", "[ab].c", "[!x-z]?.h", "\\!odd"], ["c.c", "xa.h", "odd"], ["a.c", "n/b.c", "aa.h", "!odd"]),
    ],
)
def test_ignore_rules(spark, rules, kept, left_out):
    made = [r for r in map(inventory.compile_rule, rules) if r]
    got = {r.path for r in inventory.inventory(spark.createDataFrame([(p,) for p in kept + left_out], "path string"), made, []).collect()}
    assert got == set(kept)


def test_inventory(spark):
    paths = ["./a.cs", "a.cs", "b\\c.cs", "obj/x", "b/obj", "gen/one.g", "gen/two.g", "/root/abs", "C:/abs", "", "src/n.log", "src/k.log"]
    rules = [inventory.compile_rule("*.g"), inventory.compile_rule("n.log", "src"), inventory.compile_rule("k.log", "other")]
    tracked = spark.createDataFrame([("gen/one.g",)], "path string")
    got = sorted(r.path for r in inventory.inventory(spark.createDataFrame([(p,) for p in paths], "path string"), rules, ["c.cs"], tracked).collect())
    assert got == ["a.cs", "b/obj", "gen/one.g", "src/k.log"]


def test_limited_scans_say_what_they_left_out(spark):
    files = [(f"f{i}", "needle here" if i % 2 else "nothing", 5000 if i == 1 else 10, i == 3) for i in range(8)]
    df = spark.createDataFrame(files, "path string, text string, bytes long, excluded boolean")
    found, gaps = lexical.scan_limited(df, ["needle"], 6, 100)
    assert [r.path for r in found.collect()] == ["f5"]
    assert sorted(r.gap for r in gaps.collect()) == [lexical.UNSCANNED.format(6, 8), lexical.OVERSIZED.format(1)]
    assert lexical.scan_decision(found, gaps).head()[:] == (1, "Partial")
    found, gaps = lexical.scan_limited(df.where("path > 'f3'"), ["needle"], 100, 100)
    assert gaps.count() == 0 and lexical.scan_decision(found, gaps).head().decision == "Sufficient"
    assert lexical.scan_decision(found, gaps, filtered=True).head().decision == "Partial"
    assert [r.gap for r in lexical.filter_gaps(spark, True).collect()] == [lexical.FILTERED] and lexical.filter_gaps(spark, False).count() == 0
    none, gaps = lexical.scan_limited(df.limit(0), ["needle"], 6, 100)
    assert none.count() == gaps.count() == 0 and lexical.scan_decision(none, gaps).head().decision == "Insufficient"
