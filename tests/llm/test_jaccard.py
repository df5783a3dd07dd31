import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import jaccard
from cairn.llm.words import find_words

SCHEMA = "doc_id long, text string, c string"


def shingles(text):
    words = find_words((text or "").encode().lower().decode())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for members in groups.values():
        least = min((rows[i][0] for i in members if rows[i][0] is not None), default=None)
        out += [(rows[i][0], len(sets[i]), least) for i in members]
    return sorted(out, key=str)


def sample(seed, n_bases, sizes):
    rng = random.Random(seed)
    word = lambda: f"W{rng.randrange(3000)}"
    passage = [word() for _ in range(30)]
    rows = [(900, None, ""), (901, " \n", ""), (902, "one two", ""), (903, "One  TWO", ""), (904, "one two three", ""), (None, "one two", "")]
    for b in range(n_bases):
        base = [word() for _ in range(rng.choice(sizes))] + (passage if b % 3 == 0 else [])
        for _ in range(rng.randrange(1, 7)):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                i = rng.randrange(len(words) + 1)
                words[i : i + rng.randrange(2)] = [word()]
            rows.append((len(rows) * 3 + b, " ".join(words), "x"))
    return rows


def test_matches_brute_force(spark):
    rows = sample(5, 45, [4, 6, 9, 14, 25, 40, 70, 150, 400])
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(map(tuple, jaccard.digest(df).collect()), key=str) == brute(rows)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r[2] for r in brute(rows) if r[0] is not None})
    few = spark.createDataFrame([(None, "a b c", ""), (None, "a b c", ""), (1, "", ""), (1, "", ""), (2, "x y", ""), (2, "x y", ""), (3, "x y", "")], SCHEMA)
    assert sorted(map(str, (r.doc_id for r in jaccard.keep_one(few).collect()))) == ["1", "1", "2", "None"]
    assert jaccard.digest(df.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 400), st.floats(0, 1), st.integers(0, 2**32))
def test_similar_sets_share_a_signature(size, share, seed):
    rng = np.random.default_rng(seed)
    partition = jaccard.Partition(3, 4)
    x = np.unique(rng.integers(0, 2**64, size, np.uint64))
    apart = int(partition.most_apart(len(x), len(x)) * share)
    gone = rng.integers(0, apart + 1)
    y = np.unique(np.concatenate([x[rng.permutation(len(x))[: len(x) - min(gone, len(x) - 1)]], rng.integers(0, 2**64, apart - gone, np.uint64)]))
    both = len(np.intersect1d(x, y))
    if 4 * both < 3 * (len(x) + len(y) - both):
        return
    sides = [np.concatenate([s for _, _, s in partition.signatures(t)]) for t in (x, y)]
    own = [{int(s) >> 2 for s in side if not int(s) & 1} for side in sides]
    every = [{int(s) >> 2 for s in side} for side in sides]
    assert own[0] & every[1] or own[1] & every[0]
    raw = [np.frombuffer(jaccard.sketch(t), np.uint8) for t in (x, y)]
    least = min(map(len, raw))
    assert int(np.bitwise_count(jaccard.fold(raw[0], least) ^ jaccard.fold(raw[1], least)).sum()) <= len(x) + len(y) - 2 * both


def test_hot_lists_in_blocks(spark, monkeypatch):
    """Lists beyond HOT go through cells, and large ones through several blocks."""
    monkeypatch.setattr(jaccard, "HOT", 2)
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    monkeypatch.setattr(jaccard, "BROADCAST_HOMES", 0)
    rng = random.Random(8)
    word = lambda: f"V{rng.randrange(10**6)}"
    passage = [word() for _ in range(12)]
    rows = [(i, " ".join([*passage[: rng.randrange(7, 13)], *(word() for _ in range(rng.randrange(1, 6)))]), "") for i in range(60)]
    rows += [(100 + i, " ".join([*passage, *([word()] * (i % 3))]), "") for i in range(30)]
    rows += sample(6, 10, [6, 12, 30])
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(map(tuple, jaccard.digest(df).collect()), key=str) == brute(rows)


@settings(max_examples=100, deadline=None)
@given(st.integers(2, 300), st.floats(0, 1), st.integers(0, 2**32))
def test_kept_signatures_still_meet(size, share, seed):
    """Two similar sets keep a common signature when each gives up the widest shared ones within its spare allowances."""
    rng = np.random.default_rng(seed)
    partition = jaccard.Partition(3, 4)
    x = np.unique(rng.integers(0, 2**64, size, np.uint64))
    gone = int(partition.most_apart(len(x), len(x)) * share) // 2
    y = np.unique(np.concatenate([x[gone:], rng.integers(0, 2**64, gone, np.uint64)]))
    both = len(np.intersect1d(x, y))
    if 4 * both < 3 * (len(x) + len(y) - both):
        return
    width = {}
    kept = []
    for t in (x, y):
        mine = {}
        for space, spare, signatures in partition.signatures(t):
            rows = {}
            for s in signatures.tolist():
                rows[s >> 2] = min(rows.get(s >> 2, (1, 9)), (s & 1, 1 + (s >> 1 & 1)))
            order = sorted(rows, key=lambda s: (width.setdefault(s, int(rng.integers(0, 5))), s), reverse=True)
            lost = 0
            for s in order:
                lost += rows[s][1]
                if lost > spare:
                    mine[s] = rows[s][0] == 0
        kept.append(mine)
    assert any(own or kept[1][s] for s, own in kept[0].items() if s in kept[1])
