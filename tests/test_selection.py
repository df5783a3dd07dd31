import random

import pytest
from pyspark.sql import functions as F

from cairn.functions import names as N
from cairn.operators import bundle, metrics, selection


def test_commands():
    assert N.split_command("""run  'a b' "c \\"d\\"" e\\f 'g'h""") == ["run", "a b", 'c "d"', "e\\f", "gh"]
    assert N.split_command(" ") == []
    with pytest.raises(ValueError):
        N.split_command("run 'x")


def test_formats(spark):
    one = spark.range(1)
    row = one.select(N.signed_delta(F.lit(2.5), 1, "%"), N.signed_delta(F.lit(-0.04), 1), N.signed_delta(F.lit(None).cast("double"), 1), N.last_identifier(F.lit("{a.b:}")), N.last_identifier(F.lit("''")), N.compact_message(F.lit(" a \r\n\n b")), N.fence_language(F.lit("x/Y.PROPS")))
    assert list(row.head()) == [" (+2.5%)", " (0.0)", "", "b", "", "a b", "xml"]
    assert selection.unknown_kinds(["Class", "gizmo", "GIZMO", "blob"], ["class"]) == ["blob", "gizmo"]


def test_excerpt_of_a_block(spark):
    text = "\n".join(f"l{i}" for i in range(1, 101))
    got = spark.createDataFrame([(text, 5, 7), (text, 98, None), (text, 1, 100), (text, 200, 210), ("", 1, None)], "t string, a int, b int").select(metrics.block_excerpt(F.col("t"), F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in got] == ["l5\nl6\nl7", "l98\nl99\nl100", "\n".join(f"l{i}" for i in range(1, 61)), "", ""]


def render(blocks, gaps):
    return "\n".join([*(b["text"] for b in blocks), *gaps])


@pytest.mark.parametrize("budget", [5, 12, 20, 40, 60, 120, 400])
def test_shrinking(budget):
    blocks = [{"file": f"f{i}", "text": f"block {i} " * 12} for i in range(4)]
    kept, gaps, cut = bundle.shrink_bundle(blocks, ["gap one", "gap two"], budget, render, "cut")
    assert cut == (bundle.estimate(render(blocks, ["gap one", "gap two"])) > budget)
    assert not cut or (gaps[-1] == "cut" and gaps[0] == "gap one")
    assert bundle.estimate(render(kept, gaps)) <= budget or (not kept and gaps == ["gap one", "cut"])
    assert [b["file"] for b in kept] == [b["file"] for b in blocks[: len(kept)]] and all(x["text"].startswith(y["text"]) for x, y in zip(blocks, kept))


def test_reserved_place():
    blocks = [{"file": "a"}, {"file": "b"}, {"file": "a", "n": 2}]
    find = {"file": "z", "confidence": "high"}
    assert bundle.reserve_lexical(blocks, find, 3) == [blocks[0], blocks[1], find]
    assert bundle.reserve_lexical(blocks, find | {"confidence": "low"}, 3) == blocks
    assert bundle.reserve_lexical(blocks, find, 3, filtered=True) == blocks and bundle.reserve_lexical(blocks, find, 1) == blocks[:1]
    assert bundle.reserve_lexical(blocks[:2], find, 3) == [*blocks[:2], find]
    m, a, g, cut = bundle.shrink_references(["m" * 40] * 3, ["a" * 40], ["g"], 12, lambda *x: "".join(map("".join, x)))
    assert (len(m), len(a), len(g), cut) == (0, 1, 1, True)
    assert bundle.capped_list("T", [str(i) for i in range(23)]).splitlines()[-1] == "  … and 3 more"


def _brute_force(edges, dependencies, types, symbols, edge_kinds, kinds):
    ids = {i for i, _, _ in types}
    pairs = {(s, t, r) for s, t, r in edges if r in edge_kinds and t in ids}
    for symbol, related, relationship in dependencies:
        bare = None if related is None else related.replace("global::", "")
        if bare is not None and relationship in kinds:
            pairs |= {(symbol, i, relationship) for i, name, whole in types if bare in (name, whole) or (name is not None and bare.endswith("." + name))}
    return sorted((s, t, r) for s, t, r in pairs if s in symbols and t in symbols)


def test_type_relations_match_brute_force_in_small_cells(spark, monkeypatch):
    """Nulls, empty names, names with dots, types of several names, edges that the names give too; every key is cut into cells."""
    monkeypatch.setattr(selection, "CELL", 3, raising=False)
    monkeypatch.setattr(selection, "TASK", 20, raising=False)
    rng = random.Random(21)
    parts = ["A", "B", "A.B", "", "global::A", None]
    text = lambda: rng.choice([None, *(".".join(x for x in rng.choices(parts, k=n) if x is not None) for n in (1, 2, 3))])
    types = [(rng.choice([None, *range(40)]), rng.choice(["A", "B", "A.B", "", None]), text()) for _ in range(60)]
    dependencies = [(rng.choice([None, *range(60)]), text(), rng.choice(["interface", "base-type", "attribute"])) for _ in range(200)]
    edges = [(rng.randrange(60), rng.randrange(60), rng.choice(["interface", "base-type", "interface-implementation"])) for _ in range(300)]
    symbols = [i for i in range(60) if i % 7]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    given = (
        frame(edges, "source long, target long, relationship string"), frame(dependencies, "symbol long, related string, relationship string"),
        frame(types, "id long, name string, semantic_name string"), frame([(i,) for i in symbols], "id long"),
    )
    for name, edge_kinds, kinds in (("subtypes", {"base-type", "interface"}, {"base-type", "interface"}), ("implementers", {"interface-implementation"}, {"interface"})):
        got = selection.type_relation(*given, given[2], name)
        assert sorted(map(tuple, got.collect())) == _brute_force(edges, dependencies, types, set(symbols), edge_kinds, kinds)


def test_one_name_in_many_rows_is_not_one_task(spark, monkeypatch):
    monkeypatch.setattr(selection, "CELL", 16, raising=False)
    monkeypatch.setattr(selection, "TASK", 2000, raising=False)
    types = spark.range(100).selectExpr("id", "'Hot' AS name", "concat('Shop.', id, '.Hot') AS semantic_name")
    dependencies = spark.range(1000, 1400).selectExpr("id AS symbol", "'Other.Hot' AS related", "'interface' AS relationship")
    symbols = spark.range(2000)
    edges = spark.createDataFrame([(1000, 5, "interface"), (3, 5, "interface"), (3, 5, "interface")], "source long, target long, relationship string")
    found = selection.type_relation(edges, dependencies, types, symbols, types, "subtypes")
    assert found.count() == found.distinct().count() == 400 * 100 + 1
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 400 * 100 / 4


def test_largest_task_of_implementers_does_not_grow_with_the_input(spark, monkeypatch):
    monkeypatch.setattr(selection, "CELL", 16, raising=False)
    monkeypatch.setattr(selection, "TASK", 2000, raising=False)
    edges = spark.createDataFrame([(1000, 5, "interface-implementation"), (3, 5, "interface-implementation"), (3, 5, "interface")], "source long, target long, relationship string")
    most = []
    for n in (200, 800):  # types and dependencies both; pairs grow by 16
        types = spark.range(n // 4).selectExpr("id", "'Hot' AS name", "concat('Shop.', id, '.Hot') AS semantic_name")
        dependencies = spark.range(1000, 1000 + n).selectExpr("id AS symbol", "'Other.Hot' AS related", "'interface' AS relationship")
        found = selection.type_relation(edges, dependencies, types, spark.range(2000), types, "implementers")
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == n * (n // 4) + 2
        most.append(max(sizes))
    assert most[1] < 2 * most[0]
