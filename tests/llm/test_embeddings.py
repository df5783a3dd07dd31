import numpy as np

from cairn.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, c string"


def brute(rows, least=0.98):
    ok = [v is not None and lab is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab, *_ in rows]
    vs = [np.array(r[1], np.float32).astype(float) if o else None for r, o in zip(rows, ok, strict=True)]
    n, links = len(rows), []
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(vs[i]) == len(vs[j]) and vs[i] @ vs[j] / (np.linalg.norm(vs[i]) * np.linalg.norm(vs[j])) >= least:
                links.append((i, j))
    root = list(range(n))
    for _ in range(n):
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    count = np.bincount([x for p in links for x in p], minlength=n)
    ids = {}
    for i in range(n):
        if rows[i][0] is not None:
            ids[root[i]] = min(ids.get(root[i], rows[i][0]), rows[i][0])
    return sorted([(r[0], int(count[i]), ids.get(root[i]), ids.get(root[i]) == r[0]) for i, r in enumerate(rows)], key=str)


def sample():
    rng = np.random.default_rng(4)
    rows = []
    for b in range(60):
        base = rng.normal(size=24)
        for k in range(1 if b else 40):
            for _ in range(rng.integers(1, 4)):
                v = base + rng.normal(size=24) * 0.02 * (k > 0 or rng.random() < 0.7) * np.linalg.norm(base) / 5
                rows.append((len(rows), v.astype(np.float32).tolist(), int(b % 3), "x"))
    v = rows[0][1]
    extra = [(1000, v, 0), (1001, v, 0), (1002, v, None), (1003, None, 0), (1004, [0.0] * 24, 0), (1005, [None, *v[1:]], 0), (1006, [float("nan"), *v[1:]], 0), (1007, v[:12], 0), (1008, [x * 2 for x in v], 0), (None, v, 0), (1009, [], 0), (1009, [], 0)]
    return rows + [(*x, None) for x in extra]


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 30)
    df = spark.createDataFrame(sample(), SCHEMA).repartition(3)
    got = sorted(map(tuple, embeddings.near_duplicates(df).collect()), key=str)
    want = brute(sample())
    assert [g[0] for g in got] == [w[0] for w in want]
    assert sum(g[1] for g in got) >= 0.9 * sum(w[1] for w in want) and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert got == want
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    assert embeddings.near_duplicates(df.where("vec_id = 1003")).collect()[0].kept
