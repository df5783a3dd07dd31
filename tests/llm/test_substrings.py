import hashlib
import random

from cairn.llm import substrings
from cairn.llm.words import find_words

SCHEMA = "doc_id long, text string, spans string"


def brute(rows, width=20):
    seen, flags = {}, {}
    keyed = [(r[0] if r[0] is not None else -(2**63), find_words(r[1] or "")) for r in rows]
    for k, words in keyed:
        for i in range(len(words) - width + 1):
            w = tuple(words[i : i + width])
            seen[w] = min(seen.get(w, (k, i)), (k, i))
    out = []
    for (k, words), r in zip(keyed, rows, strict=True):
        gone = set()
        for i in range(len(words) - width + 1):
            if seen[tuple(words[i : i + width])] < (k, i):
                gone.update(range(i, i + width))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((r[0], len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def sample():
    rng = random.Random(3)
    make = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    passages = [make(n) for n in (19, 20, 21, 45, 80)]
    rows = []
    for d in range(120):
        words = make(rng.randrange(60))
        for _ in range(rng.randrange(3)):
            words += rng.choice(passages) + make(rng.randrange(5))
        rows.append((rng.randrange(-40, 90), " \n\t"[d % 3].join(words), "x"))
    rows += [(500, "same word " * 90, ""), (501, None, None), (502, "", ""), (None, " ".join(passages[4]), ""), (None, " ".join(passages[4]), ""), (503, " ".join(passages[4]), "")]
    return rows + rows[:3] + [(7, " ".join(passages[3] * 3000), "")]


def test_matches_brute_force(spark, monkeypatch):
    df = spark.createDataFrame(sample(), SCHEMA).repartition(5)
    assert sorted(map(tuple, substrings.digest(df).collect()), key=str) == brute(sample())
    assert substrings.digest(df.limit(0)).count() == 0


def test_strip(spark):
    text = " ".join(f"a{i}" for i in range(30))
    df = spark.createDataFrame([(2, "x  y\n" + text, "keep"), (1, text, "me")], SCHEMA)
    got = {r.doc_id: (r.text, r.spans) for r in substrings.strip_repeats(df).collect()}
    assert got == {1: (text, "me"), 2: ("x y", "keep")}
