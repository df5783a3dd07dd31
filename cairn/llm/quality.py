"""Quality rules: base counts, and divergence of a document's histograms from its language's reference.

Two histograms are compared by Jensen-Shannon distance (base 2, 0 to 1): characters by class, and common words
of the language (each its own bin, the rest one bin). References are the sums over all documents of the
language, a handful of numbers for each language of COMMON_WORDS; the driver collects just these. Everything
is a column expression; there is no join and the only shuffle is the partial sums by language.

A distance counts only for documents that are long enough (min_chars, min_words). Documents of a language
without a reference, or with null lang, are judged by the base rules alone. Null text counts as empty, with
zero counts and base_failed. Repeated rows are judged alike. Other columns do not matter.

With Rules.word_share the words are compared with the language's fixed profile too, which junk cannot shift, and the
cutoff there is a share of the distance that a document without common words has, plus sampling noise at its length.
It holds for documents with fewer common words than the profile. word_distance is then the distance to the profile;
the distance to the corpus counts as it does without word_share.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frequent function words by language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "for", "with", "on", "as"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "ist", "des", "ein", "dem"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "del", "las", "se", "por", "con"],
}
# Usual shares of these words in running text of the language, in percent, as frequency lists give them.
WORD_PERCENT = {
    "en": [6.0, 3.0, 2.7, 2.6, 1.9, 1.0, 1.1, 1.0, 0.9, 0.7, 0.7, 0.7],
    "de": [3.2, 3.3, 2.9, 1.7, 1.4, 1.1, 1.2, 1.2, 0.9, 0.9, 0.7, 0.9],
    "fr": [4.8, 2.7, 2.2, 2.1, 1.9, 1.6, 1.3, 1.2, 1.1, 1.0, 1.0, 1.0],
    "es": [6.0, 3.8, 3.0, 2.7, 2.6, 2.5, 1.7, 1.1, 1.1, 1.2, 0.9, 0.9],
}
#: The same as shares, and the rest's.
WORD_PROFILES = {name: [x / 100 for x in xs] + [1 - sum(xs) / 100] for name, xs in WORD_PERCENT.items()}
#: Character classes, taken out of the text one after the other, largest first; what is left is the last bin.
CLASSES = [r"\p{Ll}", r"[\x20\x09-\x0D]", r"\p{Lu}", r"[.,;:!?'\"()-]", r"\p{Nd}", r"[#*$%&|<>]"]
SPACE_CLASS, SYMBOL_CLASS = 1, 5
SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    max_repeat_percent: int = 30
    char_distance: float = 0.3
    min_chars: int = 300
    word_distance: float = 0.27
    min_words_for_distance: int = 80
    #: Cutoff by the fixed profiles, beside word_distance to the corpus: word_share + word_noise / sqrt(words) of the ceiling.
    word_share: float | None = None
    word_noise: float = 1.2


#: Rules that find documents without common words however much of the corpus is junk.
STEADY = Rules(word_share=0.8)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def with_classes(df: DataFrame) -> DataFrame:
    """df (with __body) with __classes: characters in each class, the rest last."""
    left = [F.col("__body")]
    for k, pattern in enumerate(CLASSES):
        df = df.withColumn(f"__left{k}", F.regexp_replace(left[-1], f"(?:{pattern})++", F.lit("")))
        left.append(F.col(f"__left{k}"))
    sizes = [F.length(x) for x in left]
    return df.withColumn("__classes", F.array(*(a - b for a, b in zip(sizes, sizes[1:], strict=False)), sizes[-1]))


def base_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), and __words, __body, __classes."""
    out = with_classes(df.withColumn("__body", F.coalesce(F.col(text), F.lit(""))).withColumn("__words", words_of(F.col("__body"))))
    lines = F.filter(F.split("__body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("__lines", lines).withColumn("__n", F.size("__words"))
    none = F.array().cast("array<bigint>")
    hashes = F.when(F.col("__n") >= WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(F.col("__n") - (WINDOW - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("__words", i, WINDOW)))).otherwise(none)
    out = out.withColumn("__hashes", hashes).withColumn("__again", F.size(F.array_distinct("__hashes")) < F.size("__hashes"))
    pairs = F.when(F.col("__again"), F.array_sort(F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    out = out.withColumn("__pairs", pairs).withColumn("__starts", _repeated_starts("__pairs"))
    return out.select(
        *df.columns, "__words", "__body", "__classes",
        F.col("__n").cast("long").alias("n_words"),
        (F.length("__body") - F.get("__classes", F.lit(SPACE_CLASS))).cast("long").alias("word_chars"),
        F.get("__classes", F.lit(SYMBOL_CLASS)).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        _covered("__starts").cast("long").alias("n_repeat_words"),
    )


def _repeated_starts(pairs: str) -> Column:
    """Starts, in order, of windows whose hash another window has; pairs is the sorted array of (hash, start)."""
    h = lambda j: F.get(pairs, j)["h"]
    at = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda j: h(j).eqNullSafe(h(j - 1)) | h(j).eqNullSafe(h(j + 1)))
    return F.when(F.size(pairs) > 0, F.array_sort(F.transform(at, lambda j: F.get(pairs, j)["i"]))).otherwise(F.array().cast("array<int>"))


def _covered(starts: str) -> Column:
    """Words covered by windows at these starts."""
    step = lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["at"])).alias("n"), x.alias("at"))
    return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at")), step)["n"]


def with_common(df: DataFrame, lang: str = "lang") -> DataFrame:
    """df (with __words) with __common: counts of the language's common words, the rest last; null without a list."""
    every = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    bins = F.lit(None).cast("array<string>")
    for name, ws in COMMON_WORDS.items():
        bins = F.when(F.col(lang) == name, F.array(*map(F.lit, ws))).otherwise(bins)
    # __found is named twice, so that the optimizer does not move its filter into the loop over the bins.
    out = df.withColumn("__found", F.filter("__words", lambda w: w.isin(every)))
    counts = F.when(F.size("__found") >= 0, F.transform(bins, lambda b: F.size(F.filter("__found", lambda w: w == b))))
    out = out.withColumn("__counts", counts)
    rest = F.size("__words") - F.aggregate("__counts", F.lit(0), lambda a, x: a + x)
    return out.withColumn("__common", F.concat("__counts", F.array(rest)))


def references(df: DataFrame, text: str = "text", lang: str = "lang", words: bool = True) -> dict[str, tuple[list[float], list[float]]]:
    """For each language its histograms over all documents, as shares (without words, of characters alone). At most len(COMMON_WORDS) rows reach the driver."""
    source = df.select(F.col(lang).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("__body")).where(F.col("lang").isin(list(COMMON_WORDS)))
    made = with_classes(source)
    made = with_common(made.withColumn("__words", words_of(F.col("__body")))) if words else made
    n_classes, n_words = len(CLASSES) + 1, len(next(iter(COMMON_WORDS.values()))) + 1 if words else 0
    sums = [F.sum(F.get("__classes", F.lit(i)).cast("long")).alias(f"c{i}") for i in range(n_classes)] + [F.sum(F.get("__common", F.lit(i)).cast("long")).alias(f"w{i}") for i in range(n_words)]
    out = {}
    for row in made.groupBy("lang").agg(*sums).collect():
        classes, common = [row[f"c{i}"] or 0 for i in range(n_classes)], [row[f"w{i}"] or 0 for i in range(n_words)]
        if sum(classes) and (sum(common) or not words):
            out[row["lang"]] = ([x / sum(classes) for x in classes], [x / sum(common) for x in common])
    return out


def js_distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of counts to a reference of shares; null without either."""
    total = F.aggregate(counts, F.lit(0), lambda a, x: a + x)
    term = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    parts = F.zip_with(counts, reference, lambda c, q: term(c / total, (c / total + q) / 2) + term(q, (c / total + q) / 2))
    return F.when(total > 0, F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0))))


def _without_common(shares: list[float]) -> float:
    """The Jensen-Shannon distance of a document without common words to these shares."""
    *common, rest = shares
    return math.sqrt((sum(common) + math.log2(2 / (1 + rest)) + rest * math.log2(2 * rest / (1 + rest))) / 2)


def missing_words(rules: Rules, lang: str = "lang") -> Column:
    """Whether word_distance, taken to the profiles, is beyond word_share for a document with too few common words."""
    ceilings, rests = F.lit(None).cast("double"), F.lit(None).cast("double")
    for name, shares in WORD_PROFILES.items():
        ceilings = F.when(F.col(lang) == name, F.lit(_without_common(shares))).otherwise(ceilings)
        rests = F.when(F.col(lang) == name, F.lit(shares[-1])).otherwise(rests)
    cutoff = ceilings * F.least(F.lit(rules.word_share) + F.lit(rules.word_noise) / F.sqrt("n_words"), F.lit(0.99))
    return (F.col("word_distance") > cutoff) & (F.element_at("__common", -1) > rests * F.col("n_words"))


RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept"]


def judge(df: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang", known: dict | None = None) -> DataFrame:  # noqa: B008
    """df's columns, the base counts, class_distance, word_distance, base_failed and kept (RESULTS).

    Columns of df named like a result are replaced; all others stay, whatever they are called.
    """
    known = references(df, text, lang) if known is None else known
    # df's columns wait under other names, so that none clashes with a name used here.
    own = {f"__own{i}": c for i, c in enumerate(df.columns) if c not in RESULTS}
    held = df.select(*[F.col(f"`{c}`").alias(o) for o, c in own.items()], F.col(text).alias("__text"), F.col(lang).alias("__lang"))
    lang = "__lang"
    out = with_common(base_counts(held, "__text"), lang)
    classes, common, profile = [F.lit(None).cast("array<double>")] * 3
    for name, (c, w) in known.items():
        classes = F.when(F.col(lang) == name, F.array(*map(F.lit, c))).otherwise(classes)
        common = F.when(F.col(lang) == name, F.array(*map(F.lit, w))).otherwise(common)
    for name, shares in WORD_PROFILES.items():
        profile = F.when(F.col(lang) == name, F.array(*map(F.lit, shares))).otherwise(profile)
    out = out.withColumn("__rc", classes).withColumn("__rw", common).withColumn("__rp", profile)
    out = out.withColumn("class_distance", F.when(F.length("__body") >= rules.min_chars, js_distance(F.col("__classes"), F.col("__rc"))))
    words_to = lambda reference: F.when(F.col("n_words") >= rules.min_words_for_distance, js_distance(F.col("__common"), F.col(reference)))
    out = out.withColumn("__corpus_distance", words_to("__rw"))
    out = out.withColumn("word_distance", F.col("__corpus_distance") if rules.word_share is None else words_to("__rp"))
    out = out.withColumn("base_failed", (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")))
    far = F.coalesce(F.col("class_distance") > rules.char_distance, F.lit(False)) | F.coalesce(F.col("__corpus_distance") > rules.word_distance, F.lit(False))
    far = far if rules.word_share is None else far | F.coalesce(missing_words(rules, lang), F.lit(False))
    out = out.withColumn("kept", ~F.col("base_failed") & ~far)
    # Each result gets a zero that is not deterministic, so a filter on it stays above this projection and nothing is computed twice.
    zero = F.shiftrightunsigned(F.monotonically_increasing_id(), 63)
    fixed = [(F.col(c) & (zero == 0) if c in ("base_failed", "kept") else F.col(c) + zero).alias(c) for c in RESULTS]
    return out.select(*[F.col(o).alias(c) for o, c in own.items()], *fixed)
