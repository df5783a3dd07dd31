import random
import time

import corpus_pipeline
from cairn.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made(rng, n, common):
    """n words, of which `common` percent are common words of English, drawn as often as in its profile."""
    shares = quality.WORD_PROFILES["en"][:-1]
    return " ".join(rng.choices(quality.COMMON_WORDS["en"], shares)[0] if rng.randrange(100) < common else "".join(rng.choices("abcdefgh", k=7)) for _ in range(n))


def test_junk_share_does_not_switch_the_rule_off(spark):
    rng = random.Random(4)
    good = [made(rng, rng.randrange(80, 300), 17) for _ in range(60)]
    junk = [made(rng, rng.randrange(80, 300), 0) for _ in range(90)]
    for n in (6, 30, 90):
        rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(good + junk[:n])]
        df = spark.createDataFrame(rows, SCHEMA)
        assert {r.doc_id for r in corpus_pipeline.quality_rules(spark, df, "").collect()} == set(range(60))


def test_other_languages_have_no_word_rule(spark):
    text = made(random.Random(5), 200, 0)
    df = spark.createDataFrame([(1, text, "xx", "s", 0), (2, text, None, "s", 0), (3, text, "en", "s", 0)], SCHEMA)
    assert {r.doc_id for r in quality.judge(df, quality.STEADY).where("kept").collect()} == {1, 2}
    assert quality.judge(df.limit(0), quality.STEADY).count() == 0


def test_result_can_be_filtered(spark):
    """A filter on the result is not pushed into the computation, and columns keep their names."""
    rng = random.Random(6)
    rows = [(i, made(rng, 30 + 10 * i, 17 * (i % 2)), "en", i) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, __words long")
    whole = {r.doc_id: r for r in quality.judge(df, quality.STEADY).collect()}
    assert all(r["__words"] == i for i, r in whole.items())
    for wanted in ("kept", "not base_failed", "n_words > 200"):
        found = quality.judge(df, quality.STEADY).where(wanted)
        assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 2 * len(quality.CLASSES)
        began = time.monotonic()
        got = {r.doc_id for r in found.select("doc_id").collect()}
        assert time.monotonic() - began < 60
        assert got == {i for i, r in whole.items() if {"kept": r.kept, "not base_failed": not r.base_failed}.get(wanted, r.n_words > 200)}


def twin(text, lang, shares_of_classes, rules):
    """The verdict's second half in Python: distances of one document to given references."""
    import math
    import re

    def distance(counts, reference):
        total = sum(counts)
        if not total:
            return None
        parts = 0.0
        for c, q in zip(counts, reference, strict=True):
            p = c / total
            m = (p + q) / 2
            parts += (p * math.log2(p / m) if p else 0) + (q * math.log2(q / m) if q else 0)
        return math.sqrt(max(parts, 0) / 2)

    words = [w for w in re.split(r"[\x20\x09-\x0d]+", text) if w]
    common = [words.count(w) for w in quality.COMMON_WORDS[lang]]
    common.append(len(words) - sum(common))
    classes = [0] * 7
    for c in text:
        classes[0 if c.islower() else 1 if c in " \t\n\x0b\x0c\r" else 2 if c.isupper() else 3 if c in ".,;:!?'\"()-" else 4 if c.isdigit() else 5 if c in "#*$%&|<>" else 6] += 1
    cd = distance(classes, shares_of_classes) if len(text) >= rules.min_chars else None
    profile = quality.WORD_PROFILES[lang]
    wd = distance(common, profile) if len(words) >= rules.min_words_for_distance else None
    cutoff = distance([0] * 12 + [1], profile) * min(rules.word_share + rules.word_noise / math.sqrt(max(len(words), 1)), 0.99)
    return cd, wd, not (cd is not None and cd > rules.char_distance) and not (wd is not None and wd > cutoff and common[-1] > profile[-1] * len(words))


def test_distances_match_a_python_version(spark):
    rng = random.Random(9)
    texts = [made(rng, rng.randrange(20, 400), rng.choice([0, 4, 8, 17, 30])) for _ in range(60)] + ["x! " * 30_000, "AB12 #*$ " * 200, "the of and " * 9]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    shares = quality.references(df, words=False)["en"][0]
    for r in quality.judge(df, quality.STEADY).collect():
        cd, wd, near = twin(texts[r.doc_id], "en", shares, quality.STEADY)
        assert (r.class_distance is None) == (cd is None) and (cd is None or abs(r.class_distance - cd) < 1e-9)
        assert (r.word_distance is None) == (wd is None) and (wd is None or abs(r.word_distance - wd) < 1e-9)
        assert r.kept == (near and not r.base_failed)


def test_words_are_held_to_the_corpus_too(spark):
    """A text of one common word has more of them than the profile, so only the corpus's words tell it from the rest."""
    rng = random.Random(12)
    good = [made(rng, rng.randrange(80, 300), 17) for _ in range(60)]
    odd = " ".join(x for _ in range(60) for x in ("as", "".join(rng.choices("abcdefgh", k=7))))
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*good, odd])], "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in quality.judge(df, quality.STEADY).collect()}
    assert not rows[60].base_failed and {i for i, r in rows.items() if r.kept} == set(range(60))
