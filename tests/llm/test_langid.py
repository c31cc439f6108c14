import random
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd

from tideline.llm import langid


def counts_of(texts_by_lang):
    parts = []
    for lang, texts in texts_by_lang.items():
        g, n = langid.count([t.encode() for t in texts])
        parts.append(pd.DataFrame({"lang": lang, "gram": g, "n": n}))
    return pd.concat(parts)


def brute(texts, text):
    """Prediction by partial matching, escape method C with exclusion, order three, by definition."""
    seen = defaultdict(lambda: defaultdict(int))
    for t in texts:
        padded = [-1] * 3 + list(t.encode())
        for i in range(3, len(padded)):
            for k in range(4):
                seen[tuple(padded[i - k : i])][padded[i]] += 1
    bits, padded = 0.0, [-1] * 3 + list(text.encode())
    for i in range(3, len(padded)):
        gone = set()
        for k in (3, 2, 1, 0):
            here = {b: n for b, n in seen.get(tuple(padded[i - k : i]), {}).items() if b not in gone}
            if not here:
                continue
            total = sum(here.values()) + len(here)
            if padded[i] in here:
                bits -= np.log2(here[padded[i]] / total)
                break
            bits -= np.log2(len(here) / total)
            gone |= set(here)
        else:
            bits += np.log2(256 - len(gone))
    return bits


TEXTS = {"aa": ["the cat sat on the mat", "a cat and the dog", "x"], "bb": ["el gato y la luna", "la luna é ñ", ""], "cc": ["der hund und die katze ß"]}


def test_code_lengths_are_those_of_the_definition():
    rng = random.Random(4)
    langs = sorted(TEXTS)
    pairs = [langid.count([t.encode() for t in TEXTS[l]]) for l in langs]
    model = langid.Model(langs, [g for g, _ in pairs], [n for _, n in pairs])
    texts = ["", "the", "漢字", "la gata ñ", "zzz\x00"] + ["".join(rng.choice("the catluna ñß漢.") for _ in range(rng.randrange(40))) for _ in range(60)]
    raw = [t.encode() for t in texts]
    got = model.bits(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    assert np.allclose(got, [[brute(TEXTS[l], t) for l in langs] for t in texts], atol=1e-3)


def test_sorted_counts_give_the_same_lengths_as_the_table():
    rng = random.Random(6)
    langs = sorted(TEXTS)
    pairs = [langid.count([t.encode() for t in TEXTS[l]]) for l in langs]
    table, counts = (langid.Model(langs, [g for g, _ in pairs], [n for _, n in pairs], table_bytes=m) for m in (1 << 26, 0))
    assert table.table is not None and counts.table is None
    raw = [t.encode() for t in ["", "the", "漢字", *("".join(rng.choice("the catluna ñß漢.") for _ in range(rng.randrange(60))) for _ in range(300))]]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    assert np.allclose(table.bits(data, off), counts.bits(data, off), atol=1e-4)
    assert np.allclose(counts.bits(data, off)[:20], [[brute(TEXTS[l], r.decode()) for l in langs] for r in raw[:20]], atol=1e-3)


def test_many_languages_lose_no_context():
    rng = random.Random(7)
    texts = {f"l{k:02}": ["".join(chr(rng.randrange(97, 123)) for _ in range(400))] for k in range(30)}
    pairs = [langid.count([t.encode() for t in ts]) for ts in texts.values()]
    model = langid.Model(list(texts), [g for g, _ in pairs], [n for _, n in pairs], table_bytes=1 << 16)
    raw = [ts[0][50:90].encode() for ts in texts.values()]
    bits = model.bits(np.frombuffer(b"".join(raw), np.uint8), np.arange(31) * 40)
    assert bits.argmin(1).tolist() == list(range(30))
    assert np.allclose(bits[3], [brute(ts, raw[3].decode()) for ts in texts.values()], atol=1e-3)


def test_predictions(spark):
    rows = [(i, t, l) for l, ts in TEXTS.items() for i, t in enumerate(ts * 9, ord(l[0]) * 100)]
    rows += [(1, None, "aa"), (2, "12 34!", "aa"), (3, "", None), (None, "the cat", "zz"), (4, "la luna", None), (4, "la luna", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumnRenamed("x", "y")
    got = langid.predict(df, langid.learn(df)).collect()
    assert len(got) == len(rows)
    by_id = defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append(r)
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 4 == 2)
    assert [by_id[k][0]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3
    assert [r["lang_pred"] for r in by_id[4]] == ["bb", "bb"] and by_id[None][0]["lang_pred"] == "aa"
    kept = langid.keep(df, langid.learn(df), 8.0)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3 - 9  # nine empty texts of TEXTS too


def test_nothing_learned(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in langid.predict(df, langid.learn(df)).collect()] == ["und"]
    assert langid.predict(df.limit(0), langid.learn(df.limit(0))).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict(docs, langid.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.95


def test_repeated_ids_and_long_texts(spark):
    rows = [(i, t, l) for l, ts in TEXTS.items() for i, t in enumerate(ts * 9, ord(l[0]) * 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one = next(i for i, t, l in rows if l == "bb" and t and zlib.crc32(str(i).encode()) % 4 != 2)
    many = df.unionByName(spark.range(3000).selectExpr(f"{one}L AS doc_id", "'el gato y la luna' AS text", "'bb' AS lang"))
    many = many.unionByName(spark.range(1).selectExpr("5L AS doc_id", "repeat('der hund und die katze ', 500000) AS text", "'cc' AS lang"))  # 12 MB
    counts = langid.learn(many)
    plain = langid.learn(df)
    bb, was = (c[c["lang"] == "bb"]["n"].sum() for c in (counts, plain))
    assert abs(bb - was) <= 20  # the repeated id is one text
    assert counts[counts["lang"] == "cc"]["n"].sum() <= langid.TEXT_CHARS + 2000
    got = langid.predict(many, counts).filter("doc_id = 5").collect()
    assert [r["lang_pred"] for r in got] == ["cc"]
