from cairn.llm import licenses

BACKGROUND = ["It rained all day and the river rose", "the cat sat on a mat", "prices of bread went up again", ""]


#: Notices in other words than the training texts, and prose with their words.
OTHERS = {
    "Apache": ["The Apache Software Foundation licenses this file to You under the Apache License, Version 2.0.", "Code in this folder is under the Apache 2 license.", "Dual-licensed; you may choose Apache License v2.0."],
    "MIT": ["MIT License", "The software is provided under the MIT license, without warranty of any kind.", "Permission is hereby granted, free of charge, to any person who obtains a copy of this software."],
    "BSD": ["Redistributions in source or binary forms, with or without modification, are permitted.", "Published under a BSD-style license.", "The New BSD License applies (BSD 3-Clause)."],
    "GPL": ["GNU Lesser General Public License v2.1", "You can redistribute it and modify it under the terms of the GNU General Public License.", "Covered by the GNU GPL version 2."],
    "CC-BY-NC": ["Creative Commons Attribution-NonCommercial-ShareAlike 4.0 applies to this work.", "The photographs are CC BY-NC 2.0."],
    "CC-BY": ["This article is distributed under the terms of the Creative Commons Attribution 4.0 License.", "Text is available under the Creative Commons Attribution-ShareAlike License; terms may apply."],
    "MPL": ["Subject to the terms of the Mozilla Public License, version 2.0.", "The module is covered by the Mozilla Public License 1.1."],
    "Proprietary": ["Copyright 2019 Example Press. All rights reserved."],
    None: ["He was granted a fishing license last summer.", "They bought gnu and antelope for the zoo.", "The rights of way are reserved for walkers by custom.", "She left MIT for the coast.", "Mit dem Zug kam er an.", "The apache rode over the creative commons of the town.",
           "No permission was asked and none was given.", "MIT", "The copyright on the song ran out."],
}
GERMAN = ["mit und in den", "Er ging mit ihr.", "Mit ein wenig Glueck.", "alles mit der Zeit"]


def test_held_out_notices(spark):
    pairs = [(t, f) for f, ts in OTHERS.items() for t in ts]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(pairs)], "doc_id long, text string")
    got = {r.doc_id: r.family for r in licenses.scan(df, licenses.fit(BACKGROUND * 10 + GERMAN * 5)).collect()}
    wrong = [(t, f, got[i]) for i, (t, f) in enumerate(pairs) if got[i] != f]
    assert len(wrong) <= 0.12 * len(pairs), wrong


def test_unknown_is_calibrated():
    """Of held-out paragraphs of both kinds, predicted and true shares of unknown agree; plain prose is unknown without a push."""
    model = licenses.fit(BACKGROUND * 10)
    texts, labels = licenses.labelled(["an ordinary line of prose"] * 20, 99, 8)
    chances = [model.probabilities(t) for t in texts]
    right = sum(model.families[max(range(len(p)), key=p.__getitem__)] == label for p, label in zip(chances, labels, strict=True))
    assert right / len(texts) > 0.9
    share = sum(label == licenses.UNKNOWN for label in labels) / len(labels)
    assert abs(sum(p[-1] for p in chances) / len(chances) - share) < 0.1
    assert model.probabilities("nothing here")[-1] > 0.5


def test_wrapped_notices_and_unconfirmed_predictions(spark):
    text = "Some words here.\n\n  Permission is hereby granted, free of charge, to any\n  person obtaining a copy of this software and\n  associated documentation files.\n\nBye"
    assert len(licenses.paragraphs_of(text)) == 3
    long = "word " * 200_000 + "\nThis work is licensed under the GNU General Public License, version 3.\n" + "more " * 100
    model = licenses.fit(BACKGROUND)
    df = spark.createDataFrame([(1, text), (2, long), (3, "Permission and license of the charge.")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df, model).collect()}
    assert (got[1].family, got[1].n_licences, got[1].n_paragraphs) == ("MIT", 1, 3) and got[2].family == "GPL"
    strict = {r.doc_id: r for r in licenses.scan(df, model, min_cover=1.1).collect()}
    assert all(r.n_licences == 0 and r.family is None and r.families == "" for r in strict.values()) and strict[1].n_unconfirmed == 1


def test_scan_matches_python(spark):
    model = licenses.fit(BACKGROUND)
    lines = [s for seeds in licenses.SEEDS.values() for s in seeds] + licenses.NEGATIVES + BACKGROUND
    rows = [(i, f"Some text before.\n{s}\n\nmore", "x") for i, s in enumerate(lines)] + [(500, None, ""), (501, "", ""), (None, "Released under the MIT License.", ""), (0, f"Some text before.\n{lines[0]}\n\nmore", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, family string")
    got = licenses.scan(df, model).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for d, t, _ in rows if d == r.doc_id) or ""
        want = []
        unconfirmed = 0
        for part in licenses.paragraphs_of(text):
            p = model.probabilities(part)
            k = max(range(len(p)), key=p.__getitem__)
            if k < len(p) - 1 and p[k] >= 0.5 and licenses.cover(part, [model.families[k]]) >= 0.5:
                want.append((model.families[k], round(p[k], 6)))
            elif k < len(p) - 1 and p[k] >= 0.5:
                unconfirmed += 1
        assert (r.n_licences, r.n_unconfirmed, r.n_paragraphs) == (len(want), unconfirmed, len(licenses.paragraphs_of(text)))
        if want:
            assert (r.family, round(r.probability, 5)) == (want[0][0], round(want[0][1], 5))
    by_id = {r.doc_id: r for r in got}
    assert by_id[None].family == "MIT"
    assert by_id[500].family is None and by_id[500].n_paragraphs == 0
    assert licenses.scan(df.limit(0), model).count() == 0


def test_identifiers_outside_the_seeds(spark):
    """Versions, hyphens and glued forms that neither SEEDS nor FORMS hold."""
    want = {
        "This text is available under CC-BY-SA-4.0.": "CC-BY", "CC BY 3.0": "CC-BY", "Published under CC-BY-NC-SA-3.0.": "CC-BY-NC", "Distributed under GPLv3.": "GPL", "Available under GPL-2.0-only terms.": "GPL",
        "LGPL-2.1": "GPL", "AGPL-3.0": "GPL", "Released under the MPL-2.0.": "MPL", "BSD-2-Clause": "BSD", "Published under Apache2": "Apache", "This code is MIT-licensed.": "MIT",
    }
    none = ["Er kam mit dem Zug 2 Stunden zu spaet.", "A gplus and an impl of bsdiff.", "Send it cc to the office.", "It rained all day."]
    assert not {t for t in want if t in sum([*licenses.SEEDS.values(), *licenses.FORMS.values()], [])}
    df = spark.createDataFrame(list(enumerate([*want, *none])), "doc_id long, text string")
    got = {r.doc_id: r.family for r in licenses.scan(df, licenses.fit(BACKGROUND)).collect()}
    assert [got[i] for i in range(len(want) + len(none))] == [*want.values(), *[None] * len(none)]
