import re
from collections import Counter

import duckdb

from tideline.llm import licences
from tideline.llm.licence_texts import TEXTS as TEXTS_WHOLE


def brute(text, threshold=licences.THRESHOLD):
    def grams(unit):
        w = [x for x in unit.split(" ") if x]
        return Counter(zip(w, w[1:], strict=False))

    marked = re.sub(r"[.!?;][\"')\]]*(\s)", "\x1e\\1", (text or "").lower().replace("\x1e", " "))
    norm = re.sub(r"(?:(?!\x1e)[^\w\n]|_)+", " ", marked)
    plain = norm.replace("\x1e", " ")
    lines = plain.split("\n")
    units = [("line", k, x) for k, x in enumerate(lines)] + ([("text", 0, " ".join(lines))] if len(lines) > 1 else [])
    if "\x1e" in norm:
        units += [("sentence", k, x.replace("\n", " ")) for k, x in enumerate(norm.split("\x1e"))]
    if re.search(r"\n ?\n", plain):
        units += [("paragraph", k, p.replace("\n", " ")) for k, p in enumerate(p for p in re.split(r"\n ?\n[ \n]*", plain) if "\n" in p)]
    out = []
    for kind, no, unit in units:
        a = grams(unit)
        best = None
        for k, (name, t) in enumerate(licences.TEMPLATES):
            b = Counter(tuple(g.split(" ")) for g in licences.bigrams_of(t).elements())
            dice = 2 * sum((a & b).values()) / (a.total() + b.total())
            if dice >= threshold and (best is None or (-dice, name, k) < best):
                best = (-dice, name, k)
        if best:
            out.append((kind, no, best[1], best[2], a.total(), round(-best[0], 9)))
    return out


LONG = [t for _, t in licences.TEMPLATES]
TEXTS = [None, "", " \n", "MIT", "Released under the MIT License.", "x\nLicensed under CC BY-NC 4.0!\ny", LONG[23], LONG[23].replace("Software", "Program", 1), LONG[17] + " extra words", "Licensed under the Apache License Version 2.0\n\nReleased under the MIT licence", "word " * 5000, "the MIT License the MIT License the MIT License", LONG[3] + "\n" + LONG[15], "A title\n\n" + LONG[23].replace(", ", ",\n") + "\n \n\nThe\nend\n\nRELEASED under\nthe MIT license", "ß É released UNDER the mit license", "Copyright 2024 Foo Inc. Licensed under the Apache License, Version 2.0. Some more", "x = 1; licensed under\nthe MIT license.\n\nThis project is licensed under the MIT License!", *[f"Copyright (c) 2020 Jane Doe\n\n{t}\n" for _, t in TEXTS_WHOLE], TEXTS_WHOLE[8][1].replace(" ", "\n", 40)]


def test_scan_is_brute_force(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, TEXTS[4], 1), (4, TEXTS[4], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, unit int")
    got = sorted((str(r["doc_id"]), r["kind"], r["unit"], r["license"], r["template"], r["bigrams"], round(r["dice"], 9)) for r in licences.scan(df).collect())
    assert got == sorted((str(i), *m) for i, t, _ in rows for m in brute(t))
    assert len(got) > 8 and licences.scan(df.limit(0)).count() == 0


def test_bounds_hold_every_pair_that_can_match():
    spans = licences.bounds(licences.TEMPLATES, 0.8)
    for _, t in licences.TEMPLATES:
        n = licences.bigrams_of(t).total()
        for m in range(1, 3 * n):
            if 2 * min(m, n) / (m + n) >= 0.8:
                assert any(lo <= m <= hi for lo, hi in spans)


def test_sql_gives_the_same(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(licences.oracle_sql()).fetchall()
    got = [(r["doc_id"], r["kind"], r["unit"], r["license"], r["template"], r["bigrams"], r["dice"]) for r in licences.scan(docs).collect()]
    assert sorted(got) == sorted(want) and got


def test_whole_texts_are_found(spark):
    rows = [(k, f"Copyright (c) 2020 Jane Doe\nAll rights reserved\n\n{t}\n") for k, (_, t) in enumerate(TEXTS_WHOLE)]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).filter("kind = 'text'").collect()
    assert {r["doc_id"]: r["license"] for r in got} == {k: n for k, (n, _) in enumerate(TEXTS_WHOLE)}


def test_key_words_are_in_every_unit_that_can_match():
    keys = set(licences.key_words(licences.TEMPLATES, 0.8))
    for _, t in licences.TEMPLATES:
        b = licences.bigrams_of(t)
        without = sum(n for g, n in b.items() if not keys & set(g.split(" ")))
        assert without < b.total() * 0.8 / 1.2
    assert len(keys) < 80


def test_a_long_text(spark):
    df = spark.range(1).selectExpr("id AS doc_id", "concat(repeat('some words of a long text.\\n', 500000), 'Released under the MIT License.') AS text")  # 13 MB
    assert [(r["kind"], r["license"]) for r in licences.scan(df).orderBy("kind").collect()] == [("line", "MIT"), ("sentence", "MIT")]
