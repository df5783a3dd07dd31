import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import resample
from cairn.llm.chunks import raw_texts

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(bytes(b + 32 if 65 <= b < 91 else b for b in (text or "").encode()))


def grams(text, longest):
    ws = words(text)
    return [zlib.crc32(b" ".join(ws[i : i + j])) for i in range(len(ws)) for j in range(1, longest + 1) if i + j <= len(ws)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aZ09 .\n")), max_size=40), max_size=6), st.integers(1, 3))
def test_automaton_matches_plain_crc(texts, longest):
    raw, bounds = raw_texts(pa.array(texts, pa.large_string()))
    values, cuts, n = resample.buckets_of(raw, bounds, longest, 997)
    for i, t in enumerate(texts):
        assert n[i + 1] - n[i] == len(words(t))
        assert sorted(values[cuts[i] : cuts[i + 1]].tolist()) == sorted(x % 997 for x in grams(t, longest))


def test_long_words_and_blocks(monkeypatch):
    monkeypatch.setattr(resample, "STEP", 3)
    texts = ["x" * 5000 + " Q " + "é" * 200 + " a b c d e", "", "tail"]
    raw, bounds = raw_texts(pa.array(texts, pa.large_string()))
    values, cuts, _ = resample.buckets_of(raw, bounds, 2, 10_000)
    for i, t in enumerate(texts):
        assert sorted(values[cuts[i] : cuts[i + 1]].tolist()) == sorted(x % 10_000 for x in grams(t, 2))


def brute(docs, target, percent, least, longest=1, size=10_000):
    s, t = np.zeros(size, int), np.zeros(size, int)
    for _, text in docs:
        np.add.at(s, [x % size for x in grams(text, longest)], 1)
    for text in target:
        np.add.at(t, [x % size for x in grams(text, longest)], 1)
    gain = [math.floor(1000 * math.log(float((b + 1) * (s.sum() + size)) / float((a + 1) * (t.sum() + size)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)]
    rows = []
    for doc_id, text in docs:
        found = grams(text, longest)
        weight = sum(gain[x % size] for x in found)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2]))
    for i, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def docs():
    rng = np.random.default_rng(3)
    out = [(i, " ".join(f"w{int(x)}" for x in rng.integers(0, 60, rng.integers(0, 60)))) for i in range(150)]
    return out + [(500, None), (501, ""), (502, " .,- "), (None, "Alpha beta " * 15), (7, out[7][1]), (7, out[7][1]), (503, "w1 " * 30_000)]


def test_matches_brute_force(spark):
    rows = docs()
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, rank int, weight string").repartition(3)
    target = spark.createDataFrame([(1, "w1 w2 w3 w1"), (2, None), (None, "W4 alpha")], "item_id long, text string")
    for longest in (1, 2):
        got = resample.resample(df, target, 30, 20, longest)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows, ["w1 w2 w3 w1", None, "W4 alpha"], 30, 20, longest)
    assert resample.resample(df.limit(0), target).count() == 0
    nothing = resample.resample(df, target.limit(0), 100, 0).collect()
    assert sorted(r["rank"] for r in nothing) == list(range(1, len(rows) + 1))
