"""License signatures: keywords lose no match, and texts with one signature alone are found."""

import re

from tillproof.llm import licenses

ALONE = {
    "Proprietary and confidential.": "proprietary",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "This software is provided 'as-is', without any express or implied warranty.": "zlib",
    "This program is free software: you can redistribute it and/or modify it": "gpl",
    "released under the MIT": "mit",
    "released under the Expat": "mit",
    "distributed under the terms of the BSD 3-clause": "bsd-3-clause",
    "available under Apache 2.0": "apache-2.0",
    "released under the zlib": "zlib",
    "Internet Systems Consortium license": "isc",
    "PSF license": "psf-2.0",
    "do what the fuck you want to public license": "wtfpl",
    "It was distributed. Commit under the tree, mit dem Baum.": "",
}


def test_a_signature_alone_is_found(spark):
    docs = spark.createDataFrame(list(enumerate(ALONE)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert {t: got[i].labels for i, t in enumerate(ALONE)} == ALONE
    assert all((got[i].score > 0) == bool(x) for i, x in enumerate(ALONE.values()))


def test_every_alternative_holds_its_keyword():
    for label, keyword, name in licenses.NAMED:
        plain = re.sub(r"\(\?:[^()]*\|[^()]*\)", "", name)
        assert all(keyword in x for x in plain.split("|")), (label, keyword)


def plain_scan(text):
    """Labels, score and the number of detections left, by Python's regular expressions and a plain loop."""
    lower = re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")
    w = re.sub(licenses.NOT_WORD, " ", lower).strip(" ")
    found = []
    for label, priority, _, expression in licenses.signatures():
        for m in re.finditer(expression, w):
            found.append((w.count(" ", 0, m.start()), w.count(" ", 0, m.end()) + 1, priority, label))
    kept = []
    for d in sorted(found, key=lambda d: (d[0], -d[1], -d[2], d[3])):
        if not any(k[0] <= d[0] and d[1] <= k[1] and k[2] >= d[2] for k in found if k != d and (k[0], -k[1], -k[2], k[3]) < (d[0], -d[1], -d[2], d[3])):
            kept.append(d)
    base = {label for phrase, label in licenses.BASE if re.search(f"(?<![^ ]){phrase}(?![^ ])", w)}
    score = max([licenses.WEIGHT[d[2]] for d in kept] + [0.4] * bool(base) + [0.0])
    return ",".join(sorted(base | {d[3] for d in kept})), score, len(kept)


def test_scan_equals_a_plain_version(spark, sf):
    import random

    draw = random.Random(6)
    words = sorted({x for _, _, k, e in licenses.signatures() for x in re.findall("[a-z0-9]+", e)})
    made = [" ".join(draw.choices(words, k=60)) for _ in range(60)]
    grants = ["Licensed under the Apache License, Version 2.0", "distributed under the terms of the GNU General Public License v3", "under the MIT license or BSD 3-clause", "SPDX-License-Identifier: GPL-2.0-or-later", "Creative Commons Attribution-ShareAlike 4.0 International", "cc by nc nd 3.0", "the zlib/libpng license and Boost Software License 1.0"]
    made += [f"{draw.choice(grants)} {' '.join(draw.choices(words, k=5))} {draw.choice(grants)}" for _ in range(80)]
    made += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score, r.n_kept) for r in licenses.scan(docs).collect()}
    wrong = [(made[i], got[i], plain_scan(made[i])) for i in got if got[i] != plain_scan(made[i])]
    assert not wrong, wrong[0]
