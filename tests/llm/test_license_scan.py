"""License scan against a plain version with Python's regular expressions."""

import random
import re

from helpers import make_docs, prose, ugly_rows, with_clashes

from cartlens.llm import license_scan

SNIPPETS = [
    "Licensed under CC BY-NC 4.0.", "All rights reserved.", "Released under the MIT License.",
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under the Apache License, Version 2.0.", "(c) Copyright 2019-2021 by Some One",
    "SPDX-License-Identifier: GPL-3.0-or-later", "cc by cc by", "ALL RIGHTS\nRESERVED all rights reserved",
    "in the public domain", "a MIT graduate", "the unlicense", "Permission is hereby granted, free of charge",
    "see the Mozilla Public License 2.0", "general public license general public license",
]


def slow_scan(text):
    lowered = (text or "").lower()
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    joined = f" {' '.join(words)} "
    base = []
    for phrase, label in license_scan.BASE:
        wanted = phrase.split()
        base += [(label, i) for i in range(len(words)) if words[i : i + len(wanted)] == wanted]
    found = []
    for number, label, keyword, shape, priority, confidence in license_scan.rules():
        if keyword in joined:
            for m in re.finditer(shape, joined):
                start = joined.count(" ", 0, m.start()) - 1
                found.append((start, m[0].count(" ") + 1, number, label, priority, confidence))

    def nested(x, y):
        a, b = (x[0], x[0] + x[1]), (y[0], y[0] + y[1])
        return a[0] <= b[0] and a[1] >= b[1] or b[0] <= a[0] and b[1] >= a[1]

    def rank(x):
        return x[4], x[1], -x[2]

    left = [x for x in found if not any(nested(x, y) and rank(y) > rank(x) for y in found)]
    labels = sorted({label for label, _ in base})
    starts = [s for _, s in base]
    return (
        len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(labels),
        ",".join(sorted({*labels, *[x[3] for x in left]})), max([x[5] for x in left], default=0.0),
    )


def test_scan_equals_plain_version(spark):
    rng = random.Random(7)
    texts = [*SNIPPETS, *[t for _, t, *_ in ugly_rows()]]
    for i in range(120):
        words = prose(i, rng.randint(0, 40)).split()
        for _ in range(rng.randint(0, 4)):
            words.insert(rng.randint(0, len(words)), rng.choice(SNIPPETS))
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    got = license_scan.query(with_clashes(make_docs(spark, rows))).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == {i: slow_scan(t) for i, t in rows}


def test_every_rule_needs_a_stem():
    """Each rule's expression only matches texts that the prefilter lets through."""
    assert len(license_scan.rules()) > 300
    for _, _, _, shape, _, _ in license_scan.rules():
        body = shape.removeprefix("(?<= )(?:").removesuffix(")(?= )")
        for option in body.split("|") if "|" in body and "(" not in body else [body]:
            plain = re.sub(r"licen\[cs\]e", "license", option)
            assert any(s in plain for s in license_scan.STEMS), shape


def test_specific_detection_wins(spark):
    docs = make_docs(spark, [(1, "Licensed under the Apache License, Version 2.0."), (2, "the Apache License")])
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.query(docs).collect()}
    assert got == {1: ("apache-2.0", 0.95), 2: ("apache", 0.6)}


def test_empty_table(spark):
    assert license_scan.query(make_docs(spark, ugly_rows()).where("false")).collect() == []


def wordings(tree):
    """A text for every choice of alternatives and optional parts of a parsed expression."""
    out = [""]
    for kind, value in tree:
        kind = str(kind)
        if kind == "LITERAL":
            some = [chr(value)]
        elif kind == "IN":
            what, first = value[0]
            some = ["q"] if str(what) == "NEGATE" else [chr(first if str(what) == "LITERAL" else first[0])]
        elif kind == "NOT_LITERAL":
            some = ["q"]
        elif kind == "SUBPATTERN":
            some = wordings(value[3])
        elif kind == "BRANCH":
            some = [x for branch in value[1] for x in wordings(branch)]
        elif kind == "MAX_REPEAT":
            least, _, inner = value
            some = [x * max(least, 1) for x in wordings(inner)] + ([""] if least == 0 else [])
        else:
            assert kind.startswith("ASSERT"), kind
            continue
        out = [a + b for a in out for b in some]
    return out


def test_every_alternative_passes_the_filters():
    for _, label, keyword, shape, _, _ in license_scan.rules():
        for text in wordings(re._parser.parse(shape)):
            assert re.search(shape, f" {text} "), (shape, text)
            assert keyword in f" {text} ", (label, keyword, text)
            assert any(stem in text for stem in license_scan.STEMS), (label, text)


def test_alternatives_without_the_common_word(spark):
    texts = {
        "proprietary software": "proprietary", "GNU Library General Public License": "gpl,lgpl",
        "OpenRAIL-M License": "openrail", "Creative Commons Attribution 4.0": "cc-by-4.0",
        "see the Creative Commons Attribution 3.0 Unported": "cc-by-3.0",
    }
    rows = list(enumerate(texts))
    got = {rows[r.doc_id][1]: r.labels for r in license_scan.query(make_docs(spark, rows)).collect()}
    assert got == texts
