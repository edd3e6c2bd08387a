"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

1. Templates are short notices, standard headers, SPDX lines and full texts. Every line and every paragraph of a file, and a
   licence file as a whole, is a sparse vector of its words and word pairs.
   Terms weigh by their rarity among the templates; terms that no template has weigh as the rarest. The best cosine
   with a template, if it reaches the threshold, is the file's own licence. Whole texts are read, nothing is shuffled.
2. Licence files, by name, give their directory a licence. Every distinct directory is joined with the licences of its
   ancestors by path, and takes the deepest; files without a licence of their own inherit that of their directory.

Directories, not files, go through the ancestor join, so a directory of very many files is one row there; the final join is
an equality join on directories, which Spark splits where it is skewed. Several licence files of a directory: the highest
score, then the first name. Null and empty texts have no licence of their own. A null path has no directory and inherits nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import texts_of

# Short notices and standard headers of licences by their identifier; full texts follow below.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("ISC", "Licensed under the ISC License."),
    ("Zlib", "Licensed under the zlib License."),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "Copyright. All rights reserved."),
]
SPDX = {
    "GPL-1.0": "-only -or-later", "GPL-2.0": "-only -or-later", "GPL-3.0": "-only -or-later", "LGPL-2.0": "-only -or-later", "LGPL-2.1": "-only -or-later", "LGPL-3.0": "-only -or-later",
    "AGPL-3.0": "-only -or-later", "BSD-2-Clause": "", "BSD-3-Clause": "", "ISC": "", "Zlib": "", "0BSD": "", "EPL-2.0": "", "BSL-1.0": "", "MPL-1.1": "", "MPL-2.0": "", "CC0-1.0": "",
    "CC-BY-4.0": "", "CC-BY-SA-4.0": "", "CC-BY-NC-4.0": "", "Unlicense": "", "Artistic-1.0-Perl": "",
}
#: Full texts by identifier; the driver reads them and sends them with the task. There are none of AGPL-3.0, EPL-2.0 and BSL-1.0: their
#: files are known by title and by the header that they quote.
FULL_TEXTS = [(p.stem, p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]
TEMPLATES = [*NOTICES, *((name, f"SPDX-License-Identifier: {name}{end}") for name, ends in SPDX.items() for end in dict.fromkeys(["", *ends.split()])), *FULL_TEXTS]
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)(\.[a-z]+)?$"

TERM = re.compile(r"[a-z]+|\d+(?:\.\d+)*")
THRESHOLD = 0.6


def tokens(text: str) -> list[str]:
    return TERM.findall(text.lower())


def counted(words: list[str]) -> Counter[str]:
    """Words and pairs of neighbours with their counts."""
    return Counter(chain(words, map(" ".join, zip(words, words[1:], strict=False))))


def terms(text: str) -> Counter[str]:
    return counted(tokens(text))


class Templates:
    """Weights of terms, and a row for each term with its share in every template."""

    def __init__(self, templates: list[tuple[str, str]]):
        vectors = [terms(text) for _, text in templates]
        seen = Counter(t for v in vectors for t in v)
        self.names = [name for name, _ in templates]
        self.weight = {t: math.log((1 + len(vectors)) / (1 + n)) + 1 for t, n in seen.items()}
        self.other = math.log(1 + len(vectors)) + 1
        self.row = {t: k for k, t in enumerate(self.weight)}
        self.found = {t: (k, self.weight[t]) for t, k in self.row.items()}
        self.shares = np.zeros((len(self.row), len(vectors)))
        for i, v in enumerate(vectors):
            norm = math.sqrt(sum((c * self.weight[t]) ** 2 for t, c in v.items()))
            for t, c in v.items():
                self.shares[self.row[t], i] = c * self.weight[t] / norm

    def best(self, text: str) -> tuple[str | None, float]:
        """Name and cosine of the closest template (the first of equals)."""
        return self.above(tokens(text), 0.0)

    def above(self, words: list[str], least: float) -> tuple[str | None, float]:
        """Name and cosine of the closest template; nothing if no cosine can exceed `least`.

        A template's vector has length one, so no cosine exceeds the length of a text's known terms over that of all its terms.
        """
        norm = known = 0.0
        rows, values = [], []
        find, other = self.found.get, self.other
        for t, c in counted(words).items():
            at = find(t)
            if at is None:
                norm += (c * other) ** 2
            else:
                x = c * at[1]
                known += x * x
                rows.append(at[0])
                values.append(x)
        norm += known
        if not rows or known < (least - 1e-9) ** 2 * norm and least > 1e-9:
            return None, 0.0
        scores = np.round(np.array(values) @ self.shares[rows] / math.sqrt(norm), 12)
        i = int(scores.argmax())
        return self.names[i], min(1.0, float(scores[i]))

    def scan(self, text: str, whole: bool) -> tuple[str | None, float]:
        """Best of all lines and paragraphs, and of the whole text if asked for. Each line is cut into words once."""
        found: tuple[str | None, float] = (None, 0.0)
        paragraph: list[list[str]] = []
        every: list[list[str]] = []

        def look(words: list[str]) -> None:
            nonlocal found
            name, score = self.above(words, found[1])
            if score > found[1]:
                found = name, score

        for line in [*text.split("\n"), ""]:
            if line.strip():
                words = tokens(line)
                look(words)
                paragraph.append(words)
            else:
                if len(paragraph) > 1:
                    look([w for words in paragraph for w in words])
                if whole:
                    every += paragraph
                paragraph = []
        if whole:
            look([w for words in every for w in words])
        return found


@lru_cache(maxsize=2)
def prepared(templates: tuple[tuple[str, str], ...]) -> Templates:
    return Templates(list(templates))


def own_licences(files: DataFrame, threshold: float = THRESHOLD, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(id, path, licence, score) of every file: the licence that its own text names, if any, and the best cosine."""
    fixed = tuple(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = prepared(fixed)
        for batch in batches:
            found = [known.scan(t, bool(w)) for t, w in zip(texts_of(batch), batch.column("whole").to_pylist(), strict=True)]
            names = pa.array([n if s >= threshold else None for n, s in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("path"), names, pa.array([float(s) for _, s in found])], ["id", "path", "licence", "score"])

    whole = F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False))
    return files.select("id", "path", "text", whole.alias("whole")).mapInArrow(run, "id bigint, path string, licence string, score double")


def directory(path: Column) -> Column:
    """Directory of a path; the root is the empty string."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).when(path.isNotNull(), F.lit(""))


def inherited(own: DataFrame) -> DataFrame:
    """(dir, from_dir, dir_licence): the licence of the nearest ancestor (or the directory itself) of every directory that has one."""
    given = own.where(F.col("path").rlike(LICENCE_FILE) & F.col("licence").isNotNull())
    given = given.groupBy(directory(F.col("path")).alias("from_dir")).agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("top"))
    given = given.select("from_dir", F.col("top.licence").alias("dir_licence"))
    dirs = own.where(F.col("path").isNotNull()).select(directory(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    above = F.array_distinct(F.concat(F.array(F.lit("")), above))
    up = dirs.select("dir", F.explode(above).alias("ancestor"))
    met = up.join(given, F.col("ancestor") == F.col("from_dir"))
    deepest = met.groupBy("dir").agg(F.max(F.struct(F.length("from_dir").alias("n"), "from_dir", "dir_licence")).alias("top"))
    return deepest.select("dir", F.col("top.from_dir").alias("from_dir"), F.col("top.dir_licence").alias("dir_licence"))


def licences(own: DataFrame) -> DataFrame:
    """(id, path, licence, score, origin, from_dir): origin is own, inherited or null."""
    rows = own.withColumn("own_dir", directory(F.col("path")))
    joined = rows.join(inherited(own), F.col("own_dir") == F.col("dir"), "left")
    takes = F.col("licence").isNull() & F.col("dir_licence").isNotNull()
    return joined.select(
        "id", "path", F.coalesce("licence", "dir_licence").alias("licence"), "score",
        F.when(F.col("licence").isNotNull(), "own").when(takes, "inherited").alias("origin"), F.when(takes, F.col("from_dir")).alias("from_dir"),
    )
