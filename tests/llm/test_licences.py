"""Operator 1: cosines and inheritance against plain versions."""

import math
from collections import Counter

import pytest
from cases import LONG

from passband.llm import licences, queries

MIT, APACHE = licences.TEMPLATES["MIT"][0], licences.TEMPLATES["Apache-2.0"][0]
BAGS = {(n, k): licences.terms(t) for n, texts in licences.TEMPLATES.items() for k, t in enumerate(texts)}
SPREAD = Counter(t for b in BAGS.values() for t in b)


def cosine(text, name):
    """Dense cosine over all terms, with the same weights."""
    weight = lambda bag: {t: n * licences.idf(len(BAGS), SPREAD[t]) for t, n in bag.items()}
    a = weight(licences.terms(text))
    return max(dense(a, weight(bag)) for (n, _), bag in BAGS.items() if n == name)


def dense(a, b):
    dot = sum(w * b.get(t, 0.0) for t, w in a.items())
    return dot / math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values()))


def test_sparse_cosine():
    vectors = licences.template_vectors(licences.TEMPLATES)
    for text in (MIT, "Released under the MIT License.", "the quick MIT brown fox license", "Licensed under CC BY-NC 4.0."):
        name, score = licences.best_match(text, vectors, len(BAGS))
        scores = {n: cosine(text, n) for n in licences.TEMPLATES}
        assert score == pytest.approx(max(scores.values())) and scores[name] == pytest.approx(score)
    assert licences.best_match("neither here nor there", vectors, len(BAGS)) == (None, 0.0)


FILES = [
    (1, "a/LICENSE", MIT),
    (2, "a/b/c/x.py", "# prose\nand more of it"),
    (3, "a/b/LICENSE", APACHE),
    (4, "a/b/d/y.py", "print"),
    (5, "a/z.py", "Licensed under CC BY-NC 4.0.\n" + LONG),
    (6, "q/r.py", "none here"),
    (7, "top.py", ""),
    (8, None, None),
    (9, "a/b/COPYING", APACHE + " as it is"),
    (None, "a//odd/", "x"),
    (2, "a/b/c/x.py", "# prose\nand more of it"),
    (10, "a/\nb/x", "y"),
]


def test_inheritance(spark):
    df = spark.createDataFrame([(*f, "own?", 1.0) for f in FILES], "doc_id bigint, path string, text string, own string, cosine double")
    rows = licences.licences(df).collect()
    assert len(rows) == len(FILES)
    by = {r.path: (r.licence, r.origin, r.from_dir) for r in rows}
    assert by["a/LICENSE"] == ("MIT", "own", None) and by["a/b/LICENSE"] == ("Apache-2.0", "own", None)
    assert by["a/b/c/x.py"] == ("Apache-2.0", "directory", "a/b") and by["a/b/d/y.py"] == ("Apache-2.0", "directory", "a/b")
    assert by["a/z.py"] == ("CC-BY-NC", "own", None)
    assert by["q/r.py"] == (None, "none", None) and by["top.py"] == (None, "none", None) and by[None] == (None, "none", None)
    assert by["a//odd/"] == ("MIT", "directory", "a") and by["a/\nb/x"] == ("MIT", "directory", "a")
    assert licences.licences(df.limit(0)).count() == 0


def test_whole_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in queries.op1_license_scan(spark, folder).collect()}
    assert rows.keys() == texts.keys()
    own = licences_of(texts.values())
    files = {}
    for i, (name, score, is_file) in own.items():
        if is_file:
            folder_ = f"{texts[i].source}/{texts[i].lang}"
            best = (-score, f"{folder_}/{i}", name)
            files[folder_] = min(files.get(folder_, best), best)
    for i, r in rows.items():
        name = own[i][0]
        above = files.get(f"{texts[i].source}/{texts[i].lang}")
        assert r.licence == (name or (above[2] if above else None)), i
    notices = {
        "Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "All rights reserved.": "proprietary",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL",
    }
    told = [(i, notices[x]) for i, t in texts.items() for x in (t.text or "").split("\n")[-1:] if x in notices]
    assert len(told) > 2 and all(rows[i].licence == name for i, name in told)


def licences_of(docs):
    """Brute force: every template against every header line and the whole text, densely."""
    out = {}
    for d in docs:
        lines = d.text.split("\n")
        lines = [x for k, x in enumerate(lines) if k < 5 or k >= len(lines) - 5]
        best = min([(0.0, ""), *((-cosine(line, n), n) for line in lines if licences.terms(line) for n in licences.TEMPLATES)])
        if licences.terms(d.text):
            whole = min((-cosine(d.text, n), n) for n in licences.TEMPLATES)
            if -whole[0] >= licences.FILE_COSINE:
                out[d.doc_id] = (whole[1], -whole[0], True)
                continue
        out[d.doc_id] = (best[1] if -best[0] >= licences.LINE_COSINE else None, -best[0], False)
    return out


SHORT = [
    (1, "a/1", "CC BY 4.0", "CC-BY"), (2, "b/2", "# CC BY-SA 4.0", "CC-BY-SA"), (3, "c/3", "x\n" + LONG + "\nCC BY-NC 4.0", "CC-BY-NC"),
    (4, "d/4", "License: CC BY-NC 4.0\n" + LONG, "CC-BY-NC"), (5, "e/5", "by the BY", None),
]


def test_short_notices_and_whole_texts_without_a_gate(spark):
    edge = "Jo Doe\n\n2020\n\n\n"
    files = [f[:3] for f in SHORT] + [(6, "f/LICENSE", edge + licences.TEMPLATES["BSD"][0] + "\n" + edge), (7, "f/x", "none here")]
    rows = {r.doc_id: r for r in licences.licences(spark.createDataFrame(files, "doc_id bigint, path string, text string")).collect()}
    for i, _, text, name in SHORT:
        assert rows[i].licence == name, text
        lines = [x for x in text.split("\n") if len(x) < 1000]
        best = max(cosine(x, n) for x in [*lines, text] for n in licences.TEMPLATES)
        assert rows[i].cosine == pytest.approx(best)
    assert (rows[6].licence, rows[7].licence, rows[7].origin) == ("BSD", "BSD", "directory")


def test_whole_query_scores_every_line(spark):
    """Every template against every header line and every whole text, densely and without a gate."""
    folder = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in queries.op1_license_scan(spark, folder).collect()}
    best = lambda text: max(cosine(text, n) for n in licences.TEMPLATES) if licences.terms(text) else 0.0
    for d in spark.read.parquet(f"{folder}/documents.parquet").collect():
        lines = d.text.split("\n")
        line, whole = max(best(x) for k, x in enumerate(lines) if k < 5 or k >= len(lines) - 5), best(d.text)
        assert rows[d.doc_id].cosine == pytest.approx(whole if whole >= licences.FILE_COSINE else line)
        assert (rows[d.doc_id].origin == "own") == (line >= licences.LINE_COSINE or whole >= licences.FILE_COSINE)


MIT_FILE = "MIT License\n\nCopyright (c) 2021 Jo Doe\n\n" + "\n".join(licences.TEXTS["MIT"][0].split(". "))
GPL_FILE = (
    "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc."
    " <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n"
    + "The licenses for most software and other practical works are designed to take away your freedom to share and change the works.\n" * 40
)
APACHE_FILE = (
    "\n                                 Apache License\n                           Version 2.0, January 2004\n"
    "                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.\n"
    + '      "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9.\n' * 30
)


def test_licence_files_as_they_are(spark):
    """Whole texts stand for their directories; tags and notices for their files."""
    bsd = "Copyright 2020, Jo Doe\n" + licences.TEXTS["BSD"][1]
    files = [
        (1, "mit/LICENSE", MIT_FILE), (2, "mit/src/x.c", "int main;"), (3, "gpl/COPYING", GPL_FILE), (4, "gpl/a/b/y.py", "y = 1"),
        (5, "asf/LICENSE", APACHE_FILE), (6, "asf/z.java", "class Z {}"), (7, "bsd/LICENSE.txt", bsd), (8, "bsd/q", "q"),
        (9, "mit/src/t.rs", "// SPDX-License-Identifier: Apache-2.0\nfn main() {}\n" + LONG), (10, "n/u.c", "/* SPDX-License-Identifier: GPL-2.0-only */\n" + LONG),
        (11, "n/v.md", LONG + "\nThis project is licensed under the MIT License. See LICENSE for details."),
        (12, "isc/LICENSE", "ISC License\n\nCopyright 2019 Jo\n\n" + licences.TEXTS["ISC"][0]), (13, "isc/deep/er/w", "w"),
        (14, "n/mpl.js", "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0.\nlet a"),
    ]
    rows = {r.doc_id: r for r in licences.licences(spark.createDataFrame(files, "doc_id bigint, path string, text string")).collect()}
    want = {
        1: ("MIT", "own"), 2: ("MIT", "directory"), 3: ("GPL", "own"), 4: ("GPL", "directory"), 5: ("Apache-2.0", "own"), 6: ("Apache-2.0", "directory"),
        7: ("BSD", "own"), 8: ("BSD", "directory"), 9: ("Apache-2.0", "own"), 10: ("GPL", "own"), 11: ("MIT", "own"), 12: ("ISC", "own"),
        13: ("ISC", "directory"), 14: ("MPL-2.0", "own"),
    }
    assert {i: (r.licence, r.origin) for i, r in rows.items()} == want
