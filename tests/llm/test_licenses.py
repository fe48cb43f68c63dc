import os
import random
import re
import textwrap

import pytest

from episodica.llm import licenses as L

FOLDER = "/usr/share/common-licenses"
FILES = {
    "apache-2.0": "Apache-2.0", "artistic-1.0": "Artistic", "cc0-1.0": "CC0-1.0", "gpl-1.0": "GPL-1", "gpl-2.0": "GPL-2", "gpl-3.0": "GPL-3", "lgpl-2.0": "LGPL-2", "lgpl-2.1": "LGPL-2.1",
    "lgpl-3.0": "LGPL-3", "mpl-1.1": "MPL-1.1", "mpl-2.0": "MPL-2.0",
}


def wrapped(text, width):
    """Paragraphs anew; the head, which has lines of its own, as it is."""
    paragraphs = re.split(r"\n\s*\n", text)
    own = lambda p: len(p) < 200 or re.search(r"(?im)^ *(copyright|version)\b.*[0-9]", p)
    return "\n\n".join(p if own(p) else textwrap.fill(" ".join(p.split()), width) for p in paragraphs)


def respelt(text):
    """Other spellings that guidelines take for the same."""
    for a, b in (("license", "licence"), ("organization", "organisation"), ("noncommercial", "non-commercial"), ("copyright holder", "copyright owner"), ("http:", "https:"), ("favor", "favour")):
        text = text.replace(a, b)
    return text


def test_every_known_text_in_other_dress(spark):
    """Wrapped at any width, in capitals, with other quotes, under a title, copyright and rights lines."""
    rnd, rows = random.Random(1), []
    for name, text in L.LICENSES.items():
        if name not in L.NOTICES:
            title = rnd.choice(["The MIT License (MIT)", "BSD 3-Clause License", "ISC License", "zlib License", "Boost Software License - Version 1.0 - August 17th, 2003", "MIT No Attribution"][:4])
            for width in range(40, 121, 4):
                rows += [(name, wrapped(text, width)), (name, f"{title}\n\nCopyright (c) 2019-2024 Jane Doe <jane@example.org>\nAll rights reserved.\n\n{wrapped(text, width).upper()}")]
            rows += [(name, "  " + respelt(text).replace('"', "''")), (name, f"© 2001 The Regents\r\nPortions copyright John Roe\r\n\r\n{text}".replace("\n", "\r\n"))]
    got = L.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    wrong = [(r.doc_id, r.license_id) for r in got if r.license_id != r.doc_id]
    assert not wrong, wrong[:10]


def test_named_owners(spark):
    text = L.LICENSES["bsd-3-clause"].replace("the copyright holder nor", "Example Corp. nor").replace("COPYRIGHT HOLDERS AND CONTRIBUTORS", "EXAMPLE CORP. AND CONTRIBUTORS")
    rows = [("bsd-3-clause", text), (None, text.replace("prior written permission", "prior permission")), (None, text + " And more.")]
    got = L.scan(spark.createDataFrame(list(enumerate(t for _, t in rows)), "doc_id long, text string")).collect()
    assert [r.license_id for r in sorted(got)] == [k for k, _ in rows]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no license texts on this machine")
def test_digests_of_long_texts(spark):
    rows = []
    for name, file in FILES.items():
        text = open(f"{FOLDER}/{file}", encoding="utf-8", errors="replace").read()
        rows += [(name, text), *((name, wrapped(text, w)) for w in (40, 57, 80, 88, 120)), (name, respelt(text).upper())]
    got = L.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    wrong = [(r.doc_id, r.license_id) for r in got if r.license_id != r.doc_id]
    assert not wrong, wrong[:10]


def test_sentences_that_begin_with_copyright_stay(spark):
    lines = ["copyright notice must stay", "Copyright holders be liable", "COPYRIGHT LAW applies", "copyright", "Copyright 2020 X", "Copyright Jane Doe", "(c) 2020 X", "(c) You must keep", "copyrighted material"]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, t string")
    got = {r.i: r.c for r in df.select("i", L.joined(L.canonical(df.t)).alias("c")).collect()}
    assert [bool(got[i]) for i in range(9)] == [True, True, True, True, False, False, False, True, True]


def test_spellings_meet(spark):
    mit = L.LICENSES["mit"]
    other = "Copyright (c) 2020 A. Body\n© 2021 B\n\n" + mit.upper().replace('"AS IS"', "“as is”").replace("SUBLICENSE", "Sub-Licence").replace(" ", "  \t")
    df = spark.createDataFrame([(1, mit), (2, other), (3, mit + " and more"), (4, None), (5, ""), (6, "x\n LICENCED under the Apache-Licence, version 2.0\ny"), (6, "x")], "doc_id long, text string")
    got = {(r.doc_id, r.license_id, r.notices) for r in L.scan(df).collect()}
    assert got == {(1, "mit", ""), (2, "mit", ""), (3, None, ""), (4, None, None), (5, None, ""), (6, None, "apache-2.0-notice"), (6, None, "")}


def test_notices(spark):
    df = spark.createDataFrame([(1, "a\nReleased under the MIT licence.\nb\nAll rights reserved\nreleased under the mit license"), (2, "All rights reserved.")], "doc_id long, text string")
    got = {r.doc_id: (r.license_id, r.notices) for r in L.scan(df).collect()}
    assert got == {1: (None, "all-rights-reserved,mit-notice"), 2: ("all-rights-reserved", "all-rights-reserved")}


def test_own_list_and_odd_rows(spark, odd_docs, no_docs):
    got = L.scan(odd_docs, known={"z": "One!", "b": "one", "empty": "..."}, notices={})
    assert got.count() == odd_docs.count() and {(r.doc_id, r.license_id) for r in got.filter("license_id is not null").collect()} == {(9, "b")}
    assert L.scan(no_docs).count() == 0


def test_texts_of_very_many_lines(spark):
    """No pattern recurses with the text: blank lines, lines that may stand above a license, numbers, copyright lines, one line of any length."""
    mit, n = L.LICENSES["mit"], 1_000_000
    heads = ["mit license", "The MIT License (MIT)", "  all rights reserved ", "Version 2.0, January 2004", "", "SPDX-License-Identifier: MIT", "5 may 2019"]
    above = ["\n" * n, " \n" * n, "mit license\n" * 100_000, "\n".join(heads[i % len(heads)] for i in range(100_000)) + "\n", "mit" + " 1" * 100_000 + "\n", "version" + " 2" * 100_000 + "\n"]
    above += ["Copyright 2020 X\n" * 100_000, "x" * n + "\n", "mit license x\n" * 100_000, "copyright law\n" * 100_000]
    df = spark.createDataFrame([(i, a + mit) for i, a in enumerate(above)] + [(20 + i, a) for i, a in enumerate(above)], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in L.scan(df).collect()}
    assert [got[i] for i in range(len(above))] == ["mit"] * 7 + [None] * 3 and not any(got[20 + i] for i in range(len(above)))
