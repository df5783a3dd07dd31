import numpy as np
from pyspark.sql import functions as F

from cairn.llm import forest

SCHEMA = "vec_id long, embedding array<float>, rank string"


def brute(rows, k):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    vs = [np.array(v, np.float32).astype(float) if o else None for (_, v), o in zip(rows, ok, strict=True)]
    out = []
    for i, (vec_id, _) in enumerate(rows):
        if not ok[i] or vec_id is None or vec_id % 20:
            continue
        near = [((vs[i] * vs[j]).sum(), rows[j][0]) for j in range(len(rows)) if j != i and ok[j] and len(vs[j]) == len(vs[i])]
        near.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(vec_id, r + 1, v, s) for r, (s, v) in enumerate(near[:k])]
    return sorted(out, key=str)


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, forest.nearest(df, F.col("vec_id") % 20 == 0, **how).collect()), key=str)


def edge_rows():
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(50)]
    v = rows[0][1]
    return rows + [(60, v), (61, v), (61, v), (80, None), (100, []), (120, [0.0] * 6), (140, [None, *v[1:]]), (160, [float("nan"), *v[1:]]), (180, [float("inf"), *v[1:]]), (200, v[:3]), (201, v[:3]), (None, v), (-20, [100.0 * x for x in v]), (220, [1e-30 * x for x in v])]


def test_whole_share_is_exact(spark, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK", 7)
    monkeypatch.setattr(forest, "ASKS", 2)
    rows = edge_rows()
    got, want = run(spark, rows, k=5, share=1e9), brute(rows, 5)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)


def test_fewer_rows_than_wanted_and_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0])]
    assert run(spark, rows, k=20) == [(0, 1, 1, 4.0)]
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(0, None)]) == []
    assert forest.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).columns == ["query_id", "rank", "vec_id", "score"]


def test_recall_on_plain_and_crowded_vectors(spark):
    """Structureless vectors of all norms, and a third of all rows near copies of one."""
    rng = np.random.default_rng(6)
    plain = rng.normal(size=(2000, 32))
    crowd = plain[0] * 2 + rng.normal(size=(1000, 32)) * 0.05
    rows = [(i, x.astype(np.float32).tolist()) for i, x in enumerate(np.concatenate([plain, crowd]))]
    got, want = run(spark, rows, k=10), brute(rows, 10)
    assert len(got) == len(want)
    found = {(g[0], g[2]) for g in got}
    assert sum((w[0], w[2]) in found for w in want) >= 0.9 * len(want)
    clusters = np.repeat(rng.normal(size=(60, 32)), 40, 0) + rng.normal(size=(2400, 32)) * 0.15
    rows = [(i, x.astype(np.float32).tolist()) for i, x in enumerate(clusters)]
    got, want = run(spark, rows, k=10, share=0.05), brute(rows, 10)
    found = {(g[0], g[2]) for g in got}
    assert sum((w[0], w[2]) in found for w in want) >= 0.9 * len(want)


def test_levels_go_as_deep_as_there_are_enough_rows():
    bits, symbols = 2, 2
    counts = [(np.array([0, 1, 4, 5]), np.array([9, 1, 6, 4])), (np.array([0, 1, 16]), np.array([5, 4, 6]))]  # keys: tree, prefix
    trie = forest.Trie(bits, symbols, counts, *(np.zeros(1, np.int64) for _ in range(4)))
    asked = np.array([[0b0000, 0b0000], [0b0101, 0b0101], [0b1111, 0b1111]])
    assert forest.levels(trie, asked, 9, 1).tolist() == [2, 0, 0]  # 5 + 6 rows less the query's own
    assert forest.levels(trie, asked, 10, 1).tolist() == [1, 0, 0]
    assert forest.levels(trie, asked, 9, 6).tolist() == [1, 0, 0]  # no tree has six others two symbols deep
    assert forest.levels(trie, asked, 3, 3).tolist() == [2, 1, 0]
