import hashlib
import random

import corpus_pipeline
from cairn.llm import mixing, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "to", *(f"w{rng.randrange(900)}" for _ in range(6))]) for _ in range(n)) + "."


def sample():
    rng = random.Random(2)
    texts = [prose(rng, rng.randrange(60, 160)) for _ in range(30)]
    passage = prose(rng, 60)
    texts[3] = texts[3] + "\n" + passage
    texts[9] = passage + "\n" + texts[9]
    texts += [texts[0], texts[1] + " tail", "too short", None, "", "WORD!! " * 100]
    return [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


def test_stages(spark, tmp_path):
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert seen["quality_rules"].keys() == set(range(32))
    assert seen["near_duplicates"].keys() == set(range(30))
    stripped = seen["substring_dedup"]
    assert len(stripped[9].split()) == len(rows[9][1].split()) - 60 and stripped[3] == rows[3][1]
    assert all(stripped[i] == rows[i][1] for i in range(30) if i != 9)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert all(r.decoded_sha256 == hashlib.sha256(stripped[r.doc_id].encode()).hexdigest() for r in last)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, whole)) == sorted(map(str, last))


def test_mixing_rates(spark):
    rows = [(i, "x" * 10, None, "big" if i % 4 else "small", 0) for i in range(4000)] + [(None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.replicate(df, {"big": 1, "small": 1}).collect()
    n = {s: sum(r.source == s for r in got) for s in ("big", "small")}
    assert abs(n["big"] / 2000 - 1) < 0.06 and abs(n["small"] / 2000 - 1) < 0.06
    assert {r.rate for r in got if r.source == "small"} == {2.0}
    assert len({(r.doc_id, r.copy) for r in got}) == len(got)
    assert mixing.replicate(df.limit(0)).count() == 0
    again = mixing.replicate(df, {"big": 1, "small": 1}).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_base_counts(spark):
    texts = [None, "", "a b", "a b\na b\n\nx #*", " ".join("abcdefgh") + " y " + " ".join("abcdefgh") + " " + " ".join("abcdefgh"), "z " * 40]
    df = spark.createDataFrame([(i, t, "xx", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert [got[i].n_words for i in range(6)] == [0, 0, 2, 6, 25, 40]
    assert [got[i].n_repeat_words for i in range(6)] == [0, 0, 0, 0, 24, 40]
    assert (got[3].n_symbols, got[3].n_dup_lines, got[3].word_chars) == (2, 1, 7)
    assert not got[1].kept and got[1].base_failed and got[4].base_failed
    assert quality.judge(df.limit(0)).count() == 0


def test_rates_beyond_one_draw(spark):
    """A tiny source beside a huge weight is replicated, not refused."""
    rows = [(i, "x" * 50, None, "big", 0) for i in range(400)] + [(1000 + i, "y", None, "tiny", 0) for i in range(5)]
    got = mixing.replicate(spark.createDataFrame(rows, SCHEMA), {"big": 1, "tiny": 1}).where("source = 'tiny'").groupBy("doc_id", "rate").count().collect()
    assert {r.rate for r in got} == {2000.5} and len(got) == 5
    assert all(abs(r["count"] / 2000 - 1) < 0.15 for r in got) and len({r["count"] for r in got}) > 1
