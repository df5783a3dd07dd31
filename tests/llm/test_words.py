import random

import numpy as np
import pyarrow as pa

from cairn.llm import substrings, words
from cairn.llm.words import Rolling, find_words, hash_texts


def test_words_of_texts(monkeypatch):
    rng = random.Random(4)
    letters = ["a", "B", "é", "漢", " ", " ", "\n", "\t", "\r\x0b", "😀", "\x1c"]
    texts = [None, "", " ", "one", *("".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(400)), "x" * 5000 + " y" * 300]
    for step in (7, 1 << 20):
        monkeypatch.setattr(words, "STEP", step)
        for lower in (False, True):
            hashes, bounds = hash_texts(pa.array(["left out", *texts], pa.string())[1:], lower)
            same = {}
            for i, t in enumerate(texts):
                own = find_words((t or "").encode().lower().decode() if lower else t or "")
                assert len(own) == bounds[i + 1] - bounds[i]
                for w, h in zip(own, hashes[bounds[i] :].tolist()):
                    assert same.setdefault(w, h) == h
            assert len(set(same.values())) == len(same)
    assert [len(x) for x in hash_texts(pa.array([], pa.string()))] == [0, 1]


def test_rolling_in_blocks(monkeypatch):
    w = np.random.default_rng(1).integers(0, 2**64, 500, np.uint64)
    whole = Rolling(20)(w)
    monkeypatch.setattr(words, "STEP", 33)
    assert (Rolling(20)(w) == whole).all() and len(whole) == 481
    assert Rolling(20)(w[100:120])[0] == whole[100] and len(Rolling(20)(w[:19])) == 0


def test_size_of_a_batch_does_not_follow_the_ranges():
    rng = np.random.default_rng(2)
    size = {}
    for ranges in (64, 5000):
        held = substrings._Batch(20, ranges)
        for k in range(1500):
            held.add(k * 7, k, rng.integers(0, 2**64, 400, np.uint64))
        size[ranges] = sum(len(raw) for _, _, raw in held.rows())
    assert size[5000] < 2.2 * size[64]
