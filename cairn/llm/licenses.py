"""Licence scans: a trained paragraph classifier, an unknown class, and template comparison.

A paragraph ends at a blank line or at a line that ends a sentence, so a notice wrapped over lines is one and a line of
its own is one. Features are its word n-grams (1 to 3) that hold an anchor word and occur in the training texts; numbers
count as one word. A multinomial logistic regression gives a probability to every licence family and to `unknown`.

It is trained on the driver from the seed texts and identifier forms below, each cut and reworded by rule, and, as unknown,
from whole paragraphs of the corpus: BACKGROUND without anchor words, and HARD with them that are near no template, both
of least hash in their buckets and of LONGEST characters at most. Half of these and other variants are held out; a
temperature is fitted on them, so that probabilities, that of unknown too, are calibrated. Weights below MIN_WEIGHT are dropped.

A prediction counts if its probability reaches `threshold` and some template of its family confirms it: `min_cover` of the
template's bigrams, or of the paragraph's own, are shared. Unconfirmed predictions count nowhere but in n_unconfirmed.

Scoring is column expressions only. Paragraphs without an anchor word cannot have a feature and are unknown without
being scored. Null and empty texts have no paragraphs and family null. Repeated rows are scanned alike.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Short licence notices by family, as licences ask for or as is customary.
SEEDS = {
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This project is released under the terms of the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This software is distributed under the MIT License, see the file LICENSE.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "This code is licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Distributed under the GNU GPL v2 or later.",
        "Licensed under the GNU Lesser General Public License, version 2.1 or any later version.",
        "This library is covered by the GNU Affero General Public License.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Text available under the CC BY-NC-SA license, non-commercial use only.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Content is available under the Creative Commons Attribution-ShareAlike License.",
        "Text available under the CC BY-SA 3.0 license.",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ],
    "Proprietary": [
        "All rights reserved.",
        "Copyright (c) the authors. All rights reserved. No part of this publication may be reproduced without permission.",
        "Copyright and all rights reserved by the publisher.",
    ],
}
#: Licences named by identifier only; trained on like the seeds, but no templates.
FORMS = {
    "Apache": ["Apache-2.0", "Released under Apache 2.0."],
    "MIT": ["MIT-licensed", "Available under MIT license terms."],
    "BSD": ["BSD-3-Clause", "BSD licence", "Available under BSD terms."],
    "GPL": ["GPL-3.0", "GPL 2", "Released under the GPL.", "Available under GPL terms."],
    "CC-BY-NC": ["CC-BY-NC-4.0", "CC BY-NC", "Released under CC BY-NC-ND."],
    "CC-BY": ["CC-BY-4.0", "CC BY", "Available under CC BY."],
    "MPL": ["MPL-2.0", "MPL 1.1", "Released under the MPL.", "SPDX-License-Identifier: MPL-2.0"],
}
#: Sentences with licence words that grant nothing.
NEGATIVES = [
    "He lost his driving license on the way to the office.", "The poet took some licence with the facts.", "You need permission to land at the airport.",
    "The copyright office is closed on public holidays.", "The general public was free to enter the source of the river.", "A fishing license is required under state law.",
    "The apache helicopter landed near the commons.", "She studied at MIT before the war.", "The rights of the people were reserved for later debate.", "Terms of the contract were subject to use and form.",
]
#: Every feature holds one of these words.
ANCHORS = [
    "licensed", "license", "licence", "licenced", "copyright", "permission", "permitted", "redistribution", "redistribute", "reserved", "apache", "mit", "bsd", "gnu", "gpl", "cc", "creative", "commons", "mozilla", "mpl", "spdx",
]
BACKGROUND, HARD, LONGEST, MIN_WEIGHT = 2000, 500, 2000, 0.05
#: A corpus paragraph that shares less than this of any template's bigrams, and of its own, is no licence.
FAR = 0.2
UNKNOWN = "unknown"
#: Words are runs of letters or of digits (all numbers are one word), so that identifiers fall into a family's stem and the rest: cc-by-4.0, apache2.
_WORD = r"[a-z]+|[0-9]+"
#: gplv3, lgpl and agpl count as gpl, mplv2 as mpl.
_STEM = r"(?<![a-z])(?:[al]?(gpl)v?|(mpl|apache|bsd|mit)v)(?![a-z])"


_ANCHOR = r"(?<![a-z])(?:" + "|".join(ANCHORS) + r")(?![a-z])|" + _STEM


def words_of(line: str) -> list[str]:
    return re.findall(_WORD, re.sub("[0-9]+", "0", re.sub(_STEM, lambda m: m[1] or m[2], line.lower())))


#: Where a paragraph ends: behind a line that ends a sentence, and at a blank line.
_END = r"(?<=[.!?:;])[ \t\r\x0b\x0c]*\n|\n[ \t\r\x0b\x0c]*(?=\n)"


def paragraphs_of(text: str) -> list[str]:
    return [p for p in re.split(_END, text) if p.strip(" \t\n\r\x0b\x0c")]


def features_of(words: list[str]) -> set[str]:
    """N-grams of 1 to 3 words that hold an anchor."""
    grams = ((n, i) for n in (1, 2, 3) for i in range(len(words) - n + 1))
    return {" ".join(words[i : i + n]) for n, i in grams if any(w in ANCHORS for w in words[i : i + n])}


@dataclass(frozen=True)
class Model:
    """Families (unknown last), weights of each n-gram by family, biases, and templates' bigrams by family."""

    families: list[str]
    weights: dict[str, list[float]]
    bias: list[float]
    templates: dict[str, list[list[str]]]

    def probabilities(self, line: str) -> list[float]:
        """What the column expressions compute, in Python, for tests."""
        found = features_of(words_of(line)) & self.weights.keys()
        z = np.array(self.bias) + sum((np.array(self.weights[f]) for f in found), np.zeros(len(self.bias)))
        e = np.exp(z - z.max())
        return (e / e.sum()).tolist()


def variants(rng: random.Random, text: str, n: int) -> list[str]:
    """The text, cut at a sentence or behind other words, with words dropped, in another case."""
    filler = "see file below for details about our own data and these texts which are used here by many".split()
    out = [text]
    for _ in range(n - 1):
        words = text.split()
        if len(words) > 8 and rng.random() < 0.5:
            at = rng.randrange(len(words) - 7)
            words = words[at : at + rng.randrange(7, len(words) - at + 1)]
        words = [w for w in words if rng.random() > 0.04] or words
        words = rng.choices(filler, k=rng.randrange(4)) + words + rng.choices(filler, k=rng.randrange(4))
        line = " ".join(words)
        out.append(line.upper() if rng.random() < 0.1 else line)
    return out


def bigrams(line: str) -> list[str]:
    """The distinct bigrams of a text; the word itself, if it has but one."""
    ws = words_of(line)
    return sorted({" ".join(p) for p in zip(ws, ws[1:], strict=False)}) or sorted(set(ws))


TEMPLATES = {f: [bigrams(s) for s in [*SEEDS[f], *FORMS.get(f, [])]] for f in SEEDS}


def cover(line: str, families: list[str] | None = None) -> float:
    """The largest share of a template's bigrams that a text has, or of its own that a template has."""
    own = set(bigrams(line))
    return max((max(len(own & set(t)) / len(t), len(own & set(t)) / max(len(own), 1)) for f in families or TEMPLATES for t in TEMPLATES[f]), default=0.0)


def labelled(background: list[str], seed: int, n: int) -> tuple[list[str], list[str]]:
    rng = random.Random(seed)
    texts = [(v, family) for family, seeds in SEEDS.items() for s in seeds for v in variants(rng, s, n)]
    texts += [(v, family) for family, forms in FORMS.items() for s in forms for v in variants(rng, s, n)]
    texts += [(v, UNKNOWN) for s in NEGATIVES for v in variants(rng, s, n)] + [(x, UNKNOWN) for x in background]
    return [t for t, _ in texts], [f for _, f in texts]


def fit(background: list[str], seed: int = 11, rounds: int = 400) -> Model:
    """Train on variants of the seeds and on every other background paragraph; calibrate on others."""
    families = [*SEEDS, UNKNOWN]
    texts, labels = labelled(background[::2], seed, 12)
    sets = [features_of(words_of(t)) for t in texts]
    vocabulary = sorted({f for s, label in zip(sets, labels, strict=True) for f in s if label != UNKNOWN or len(f.split()) < 3})
    column = {f: i for i, f in enumerate(vocabulary)}

    def matrix(rows: list[set[str]]) -> np.ndarray:
        x = np.zeros((len(rows), len(vocabulary)))
        for i, s in enumerate(rows):
            x[i, [column[f] for f in s if f in column]] = 1
        return x

    x, y = matrix(sets), np.eye(len(families))[[families.index(f) for f in labels]]
    weight = (1 / y.sum(0).clip(1))[y.argmax(1)]
    weight /= weight.sum()
    w, b = np.zeros((len(vocabulary), len(families))), np.zeros(len(families))

    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        gradient = (softmax(x @ w + b) - y) * weight[:, None]
        vw, vb = 0.9 * vw - 4.0 * (x.T @ gradient + 1e-4 * w), 0.9 * vb - 4.0 * gradient.sum(0)
        w, b = w + vw, b + vb
        w = np.sign(w) * np.maximum(np.abs(w) - 2e-4, 0)
    kept = np.abs(w).max(1) >= MIN_WEIGHT
    w[~kept] = 0
    held, truth = labelled(background[1::2], seed + 1, 6)
    z, t = matrix([features_of(words_of(h)) for h in held]) @ w + b, [families.index(f) for f in truth]
    balance = (1 / np.bincount(t, minlength=len(families)).clip(1))[t]
    scale = min((0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0), key=lambda s: -(balance * np.log(softmax(z * s)[np.arange(len(t)), t].clip(1e-9))).sum())
    b = b * scale
    weights = {f: [float(round(v * scale, 6)) for v in w[i]] for f, i in column.items() if kept[i]}
    return Model(families, weights, [float(round(v, 6)) for v in b], TEMPLATES)


def train(docs: DataFrame, text: str = "text") -> Model:
    """fit() with bounded samples of the corpus's paragraphs; BACKGROUND + HARD whole paragraphs of LONGEST characters at most reach the driver."""
    parts = docs.select(F.explode(F.split(F.col(text), _END)).alias("line")).where((F.length("line") <= LONGEST) & (F.trim("line") != ""))
    hashed = parts.select("line", F.xxhash64("line").alias("h"), F.lower("line").rlike(_ANCHOR).alias("hard"))
    bucket = F.when(F.col("hard"), F.pmod("h", F.lit(HARD))).otherwise(F.pmod("h", F.lit(BACKGROUND)))
    # The paragraph of least hash in each bucket: a partial minimum, so tasks send at most that many rows.
    rows = hashed.groupBy("hard", bucket.alias("b")).agg(F.min(F.struct("h", "line")).alias("first")).select("hard", "first.line").collect()
    return fit(sorted(r.line for r in rows if not r.hard or cover(r.line) < FAR))


def _grams(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, model: Model, threshold: float = 0.5, min_cover: float = 0.5, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: id, n_paragraphs, n_licences, n_unconfirmed, families (sorted, joined by commas), family (the most probable) and probability."""
    out = docs.select(F.col(id_column), F.filter(F.split(F.coalesce(F.col(text), F.lit("")), _END), lambda x: x.rlike("[^ \\t\\n\\r\\x0b\\x0c]")).alias("lines"))
    out = out.withColumn("n_paragraphs", F.size("lines").cast("long"))
    out = out.withColumn("hits", F.filter("lines", lambda x: F.lower(x).rlike(_ANCHOR)))
    words = lambda x: F.regexp_extract_all(F.regexp_replace(F.regexp_replace(F.lower(x), _STEM, "$1$2"), "[0-9]+", "0"), F.lit(_WORD), F.lit(0))
    out = out.withColumn("said", F.transform("hits", words))
    vocabulary = sorted(model.weights)
    tables = F.create_map(*[v for f in vocabulary for v in (F.lit(f), F.array(*map(F.lit, model.weights[f])))]) if vocabulary else F.lit(None).cast("map<string,array<double>>")
    n = len(model.families)
    grams = lambda ws: F.array_distinct(F.filter(F.concat(_grams(ws, 1), _grams(ws, 2), _grams(ws, 3)), lambda g: g.isin(vocabulary)))
    out = out.withColumn("features", F.transform("said", grams))
    add = lambda a, f: F.zip_with(a, F.element_at(tables, f), lambda p, q: p + q)
    out = out.withColumn("scores", F.transform("features", lambda fs: F.aggregate(fs, F.array(*map(F.lit, model.bias)), add)))
    softmax = lambda z: F.transform(z, lambda v: F.exp(v - F.array_max(z)) / F.aggregate(z, F.lit(0.0), lambda s, u: s + F.exp(u - F.array_max(z))))
    out = out.withColumn("chances", F.transform("scores", softmax))
    out = out.withColumn("best", F.transform("chances", lambda p: F.struct(F.array_max(p).alias("p"), F.array_position(p, F.array_max(p)).cast("int").alias("k"))))
    cover = F.array(*[F.array(*[F.array(*map(F.lit, t)) for t in model.templates[f]]) for f in model.families[:-1]])
    both = lambda own, t: F.size(F.array_intersect(own, t))
    near = lambda own, t: F.greatest(both(own, t) / F.size(t), both(own, t) / F.greatest(F.size(own), F.lit(1)))
    pairs = lambda ws: F.when(F.size(ws) > 1, F.array_distinct(_grams(ws, 2))).otherwise(F.array_distinct(ws))
    closest = lambda ws, k: F.array_max(F.transform(F.element_at(cover, k), lambda t: near(pairs(ws), t)))
    found = lambda b: (b["k"] < n) & (b["p"] >= threshold)
    judged = F.zip_with("best", "said", lambda b, ws: F.struct(b["p"].alias("p"), F.when(found(b), b["k"]).alias("k"), F.when(found(b), closest(ws, b["k"]) >= min_cover).alias("confirmed")))
    out = out.withColumn("predicted", F.filter(judged, lambda b: b["k"].isNotNull())).withColumn("judged", F.filter("predicted", lambda b: b["confirmed"]))
    names = F.array(*map(F.lit, model.families))
    out = out.withColumn("top", F.array_max(F.transform("judged", lambda b: F.struct(b["p"].alias("p"), (-b["k"]).alias("k")))))
    return out.select(
        id_column, "n_paragraphs", F.size("judged").cast("long").alias("n_licences"), (F.size("predicted") - F.size("judged")).cast("long").alias("n_unconfirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("judged", lambda b: F.element_at(names, b["k"])))), ",").alias("families"),
        F.when(F.col("top").isNotNull(), F.element_at(names, -F.col("top.k"))).alias("family"), F.round("top.p", 6).alias("probability"),
    )
