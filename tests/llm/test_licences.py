import math
from collections import Counter

import pytest

from panelwise.llm import licences
from panelwise.llm.catalog import QUERIES

FOLDER = "/root/testdata/sf0.01"
LINES = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}


def cosine(text):
    """Best template by dense vectors over all terms."""
    vectors = [licences.terms(t) for _, t in licences.TEMPLATES]
    n = len(vectors)
    seen = Counter(t for v in vectors for t in v)
    idf = lambda t: math.log((1 + n) / (1 + seen[t])) + 1
    norm = lambda v: math.sqrt(sum((c * idf(t)) ** 2 for t, c in v.items())) or 1
    x = licences.terms(text)
    scores = [sum(x[t] * v[t] * idf(t) ** 2 for t in v) / norm(x) / norm(v) for v in vectors]
    k = max(range(n), key=lambda i: (round(scores[i], 12), -i))
    return licences.TEMPLATES[k][0], scores[k]


@pytest.mark.parametrize("text", [*LINES, "Copyright (c) 2020 Jane. All rights reserved.", "licensed under the apache license version 2.0 see file", "/* Released under the MIT License. */", "An ordinary line of text"])
def test_sparse_equals_dense(text):
    name, score = licences.Templates(licences.TEMPLATES).best(text)
    want = cosine(text)
    if name is None:
        assert want[1] < licences.THRESHOLD
    else:
        assert name == want[0] and abs(score - want[1]) < 1e-9


def test_query_finds_all_notices(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in QUERIES["op3_licences"](spark, FOLDER).collect()}
    assert set(rows) == set(texts)
    named = 0
    for d, t in texts.items():
        hit = {v for k, v in LINES.items() if k in t.split("\n")} | ({"Proprietary"} if "ll rights reserved" in t else set())
        if hit:
            named += 1
            assert rows[d].origin == "own" and rows[d].licence in hit
        else:
            assert rows[d].origin != "own"
    assert named > 3
    own = {d: r for d, r in rows.items() if r.origin == "own"}
    files = {r.path.rpartition("/")[0]: r.licence for r in own.values() if r.path.endswith("/LICENSE")}
    for r in rows.values():
        if r.origin != "own":
            parts = r.path.split("/")[:-1]
            near = next((a for k in range(len(parts), 0, -1) if (a := "/".join(parts[:k])) in files), None)
            assert r.from_dir == near and r.licence == files.get(near)


def test_inheritance_and_odd_rows(spark):
    mit, apache = list(LINES)[:2]
    rows = [
        (1, "a/LICENSE", mit), (2, "a/x.py", None), (3, "a/b/c/y.py", ""), (4, "a/b/LICENSE.txt", apache), (5, "a/b/c/z.py", "text " * 50000), (6, "a/q.py", f"# head\n{apache}\ncode"),
        (7, None, mit), (8, None, "x"), (9, "top.py", "x"), (10, "ab/x", "x"), (1, "a/LICENSE", mit), (11, "a/b/NOTICE", "nothing"), (12, "c/COPYING", "prose only"), (13, "c/f", "x"),
    ]
    files = spark.createDataFrame([(*r, 1.0, "d") for r in rows], "id bigint, path string, text string, score double, dir string")
    got = {(r.id, r.licence, r.origin, r.from_dir) for r in licences.licences(licences.own_licences(files)).collect()}
    assert got == {
        (1, "MIT", "own", None), (2, "MIT", "inherited", "a"), (3, "Apache-2.0", "inherited", "a/b"), (4, "Apache-2.0", "own", None), (5, "Apache-2.0", "inherited", "a/b"), (6, "Apache-2.0", "own", None),
        (7, "MIT", "own", None), (8, None, None, None), (9, None, None, None), (10, None, None, None), (11, "Apache-2.0", "inherited", "a/b"), (12, None, None, None), (13, None, None, None),
    }
    assert licences.licences(licences.own_licences(files)).count() == len(rows)
    assert licences.licences(licences.own_licences(files.where("false"))).count() == 0


LGPL = "This library is free software{0} you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation{1} either version {2} of the License, or (at your option) any later version."
AGPL = LGPL.format(":", ",", "3").replace("library", "program").replace("Lesser", "Affero")


@pytest.mark.parametrize("text, name", [
    (AGPL, "AGPL-3.0"), (LGPL.format(":", ",", "3"), "LGPL-3.0"), (LGPL.format(";", ";", "2.1"), "LGPL-2.1"),
    *((f"// SPDX-License-Identifier: {x}", x) for x in ("BSD-2-Clause", "ISC", "EPL-2.0", "BSL-1.0", "Zlib")), ("SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"),
    ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "GPL-3.0"), ("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "LGPL-3.0"),
])
def test_headers_and_identifiers(text, name):
    assert licences.Templates(licences.TEMPLATES).scan("\n".join(["x = 1", "", text, "", "y"]), False)[0] == name


def test_full_texts_name_themselves():
    known = licences.Templates(licences.TEMPLATES)
    for name, text in licences.FULL_TEXTS:
        found, score = known.scan(text.replace("Copyright (c)", "Copyright (c) 2024 Jane Doe"), True)
        assert found == name and score > 0.9
    assert known.best("the ordinary prose of a file")[1] > 0
