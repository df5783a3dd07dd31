import random

from cairn.llm import links


def test_components_of_random_graphs(spark):
    rng = random.Random(8)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(200, 300 + i) for i in range(30)] + [(7, 7)]
    root = {x: x for p in pairs for x in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in links.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: root[x] for x in linked}
    assert links.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_block_pairs_meet_once(spark):
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 3), (2, 57), (3, 1)) for i in range(n)], "k int, i int")
    cells = {}
    for r in links.block_pairs(rows, "k", "i", 10).collect():
        cells.setdefault((r.k, r["__cell"].i, r["__cell"].j), []).append((r.i, r["__side"]))
    met = {}
    for (k, i, j), items in cells.items():
        for a, sa in items:
            for b, sb in items:
                if a < b and sorted((sa, sb)) == [i, j]:
                    met[k, a, b] = met.get((k, a, b), 0) + 1
    assert set(met.values()) == {1} and len(met) == 3 + 57 * 56 // 2
