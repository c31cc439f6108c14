"""License scans: Dice coefficient over word bigrams against licence templates.

Texts and templates are normalised alike: lower case, and every run of other
characters than letters, digits and line feeds becomes one space. A text's
units are its lines, its sentences (over line ends), its paragraphs of several
lines and, if it has several lines, the whole text. A unit of m bigrams can
reach the threshold t only with templates of m t / (2 - t) to m (2 - t) / t
bigrams, so units outside all of the templates' bounds make no bigrams at all,
and the join on bigrams holds each pair to its bounds. Nor do units without any
of the templates' key words: a template's are chosen so that too few of its
bigrams are without one of them for a match. All of it is DataFrame functions;
the templates are a fixed table and the only side that is broadcast.

A notice that shares its sentence with as many other words again is below the
threshold, and so not one.

Defined cases
- null or empty texts, units of fewer than two words: no match.
- bigrams count as often as they occur, in units and templates.
- ties between templates: the licence that sorts first, then the template that does.
- repeated rows: each is scanned; null ids are scanned too. Empty input: no rows.
- texts are scanned whole. Other columns are not read. U+001E in a text is a space.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.licence_texts import TEXTS

THRESHOLD = 0.8
#: The mark that ends a sentence while texts are cut to units.
MARK = "\x1e"
_ENDS, _REST = r"""[.!?;]["')\]]*(\s)""", r"[^\p{L}\p{N}\n\x1e]+"

# Licence templates (fixed values): licence, text.
TEMPLATES = [
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Apache-2.0", "This project is licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "This project is licensed under the BSD 3-Clause License."),
    ("GPL-3.0", "This project is licensed under the GNU General Public License, version 3."),
    ("MIT", "This project is licensed under the MIT License."),
    *TEXTS,
]


def bigrams_of(text: str) -> Counter:
    """Word bigrams of a template, with their counts."""
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return Counter(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))


def bounds(templates: list[tuple[str, str]], threshold: float) -> list[tuple[int, int]]:
    """Disjoint ranges that hold all bigram counts which can meet the threshold with some template."""
    spans = []
    for _, text in templates:
        n = sum(bigrams_of(text).values())
        spans.append((int(n * threshold / (2 - threshold)), int(n * (2 - threshold) / threshold) + 1))
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def key_words(templates: list[tuple[str, str]], threshold: float) -> list[str]:
    """Words of which every unit that can match has one.

    A match with a template of n bigrams shares n t / (2 - t) of them at least. Its long words are taken,
    those in most bigrams first and those already taken for other templates before others, until fewer
    bigrams than that have none of them.
    """
    taken: list[str] = []
    for _, text in sorted(templates, key=lambda t: len(t[1])):
        left = bigrams_of(text)
        need = left.total() * threshold / (2 - threshold)
        while left.total() >= need - 1e-9 and left:
            weight: Counter = Counter()
            for g, n in left.items():
                for w in set(g.split(" ")):
                    weight[w] += n
            word = min(weight, key=lambda w: (w not in taken, len(w) < 5, -weight[w], w))
            if word not in taken:
                taken.append(word)
            left = Counter({g: n for g, n in left.items() if word not in g.split(" ")})
    return taken


def normalised(text: Column) -> Column:
    """Lower case, one space for each run of other characters than letters, digits and line feeds, a mark after each sentence."""
    marked = F.regexp_replace(F.translate(F.lower(text), MARK, " "), _ENDS, f"{MARK}$1")
    return F.regexp_replace(marked, _REST, " ")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per unit with a match: id, kind, unit, license, template, bigrams, dice.

    Kinds: line, sentence, paragraph and text; units of a kind are numbered from 0 on.
    """
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    rows = [(k, name, g, c, sum(b.values())) for k, (name, text) in enumerate(templates) for b in [bigrams_of(text)] for g, c in b.items()]
    table = spark.createDataFrame(rows, "_template int, _license string, _gram string, _count int, _size int")

    unit = ["_id", "_row", "_kind", "_no"]
    norm = normalised(F.col(text_col).cast("string"))
    units = docs.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"), norm.alias("_norm"))
    none = F.array().cast("array<string>")
    flat = lambda c, x: F.replace(c, F.lit(x), F.lit(" "))
    units = units.select("_id", "_row", "_norm", flat(F.col("_norm"), MARK).alias("_plain"))
    several = F.contains(F.col("_plain"), F.lit("\n"))
    parted = F.contains(F.col("_plain"), F.lit("\n\n")) | F.contains(F.col("_plain"), F.lit("\n \n"))
    paragraphs = F.filter(F.split("_plain", "\n ?\n[ \n]*"), lambda x: F.contains(x, F.lit("\n")))
    kinds = {
        "text": F.when(several, F.array(flat(F.col("_plain"), "\n"))).otherwise(none),
        "paragraph": F.when(parted, F.transform(paragraphs, lambda x: flat(x, "\n"))).otherwise(none),
        "sentence": F.when(F.contains(F.col("_norm"), F.lit(MARK)), F.split(flat(F.col("_norm"), "\n"), MARK)).otherwise(none),
        "line": F.split("_plain", "\n"),
    }

    def numbered(kind: str, c: Column) -> Column:
        return F.transform(c, lambda x, i: F.struct(F.lit(kind).alias("_kind"), i.alias("_no"), x.alias("_unit")))

    units = units.select("_id", "_row", F.explode(F.concat(*[numbered(k, c) for k, c in kinds.items()])).alias("_u")).select("_id", "_row", "_u.*")
    words = F.split(F.trim("_unit"), " +")
    units = units.select("_id", "_row", "_kind", "_no", words.alias("_words")).withColumn("_n", F.size("_words") - 1)
    fits = F.lit(False)
    for lo, hi in bounds(templates, threshold):
        fits = fits | F.col("_n").between(max(lo, 1), hi)
    grams = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.concat(F.col("_words")[i], F.lit(" "), F.col("_words")[i + 1]))
    keyed = F.arrays_overlap("_words", F.array(*map(F.lit, key_words(templates, threshold))))
    each = units.filter(fits & keyed).select(*unit, "_n", F.explode(grams).alias("_gram"))
    # t (m + n) <= 2 min(m, n) is the bound on sizes
    sized = F.least("_n", "_size") * 2.0 >= F.lit(threshold) * (F.col("_n") + F.col("_size")) - 1e-9
    met = each.join(F.broadcast(table), "_gram").filter(sized)
    shared = met.groupBy(*unit, "_n", "_template", "_license", "_size", "_gram", "_count").agg(F.count(F.lit(1)).alias("_c"))
    dice = shared.groupBy(*unit, "_n", "_template", "_license", "_size").agg(F.sum(F.least("_c", "_count")).alias("_both"))
    dice = dice.withColumn("dice", F.col("_both") * 2.0 / (F.col("_n") + F.col("_size"))).filter(F.col("dice") >= threshold)
    best = Window.partitionBy("_row", "_kind", "_no").orderBy(F.desc("dice"), "_license", "_template")
    return (
        dice.withColumn("_nth", F.row_number().over(best))
        .filter("_nth = 1")
        .select(F.col("_id").alias(id_col), F.col("_kind").alias("kind"), F.col("_no").alias("unit"), F.col("_license").alias("license"), F.col("_template").alias("template"), F.col("_n").alias("bigrams"), "dice")
    )


def oracle_sql(threshold: float = THRESHOLD) -> str:
    """The same over `documents` in DuckDB."""
    values = ", ".join(f"({k}, '{name}', '{g}', {c}, {sum(b.values())})" for k, (name, text) in enumerate(TEMPLATES) for b in [bigrams_of(text)] for g, c in b.items())
    fits = " OR ".join(f"n BETWEEN {max(lo, 1)} AND {hi}" for lo, hi in bounds(TEMPLATES, threshold))
    ends, rest = _ENDS.replace("'", "''"), _REST
    return f"""
WITH t(template, license, gram, cnt, size) AS (VALUES {values}),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_replace(regexp_replace(replace(lower(text), chr(30), ' '), '{ends}', chr(30) || '\\1', 'g'), '{rest}', ' ', 'g') AS norm FROM documents),
e AS (SELECT doc_id, r, norm, replace(norm, chr(30), ' ') AS plain FROM d),
k AS (SELECT doc_id, r, 'line' AS kind, string_split(plain, chr(10)) AS units FROM e
  UNION ALL SELECT doc_id, r, 'sentence', string_split(replace(norm, chr(10), ' '), chr(30)) FROM e WHERE contains(norm, chr(30))
  UNION ALL SELECT doc_id, r, 'paragraph', list_filter(regexp_split_to_array(plain, '\\n ?\\n[ \\n]*'), lambda x: contains(x, chr(10))) FROM e WHERE regexp_matches(plain, '\\n ?\\n')
  UNION ALL SELECT doc_id, r, 'text', [plain] FROM e WHERE contains(plain, chr(10))),
u AS (SELECT doc_id, r, kind, unnest(range(len(units))) AS unit, replace(unnest(units), chr(10), ' ') AS s FROM k),
w AS (SELECT doc_id, r, kind, unit, regexp_split_to_array(trim(s), ' +') AS words, len(regexp_split_to_array(trim(s), ' +')) - 1 AS n FROM u),
g AS (SELECT doc_id, r, kind, unit, words, n, unnest(range(1, len(words))) AS i FROM w WHERE {fits}),
c AS (SELECT doc_id, r, kind, unit, n, words[i] || ' ' || words[i + 1] AS gram, count(*) AS c FROM g GROUP BY ALL),
x AS (SELECT doc_id, r, kind, unit, n, template, license, size, sum(least(c, cnt)) AS shared FROM c JOIN t USING (gram) GROUP BY ALL),
y AS (SELECT *, shared * 2.0::DOUBLE / (n + size) AS dice FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY r, kind, unit ORDER BY dice DESC, license, template) AS nth FROM y WHERE dice >= {threshold})
SELECT doc_id, kind, unit::INT AS unit, license, template, n AS bigrams, dice FROM z WHERE nth = 1
"""
