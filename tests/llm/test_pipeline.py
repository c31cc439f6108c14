"""The pipeline and its stages against plain versions of each decision, over small tables."""

import re

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import xxhash

import corpus_pipeline
from tideline.llm import langid, quality
from tideline.llm.queries import ORACLE_SQL, QUERIES, model_path
from tideline.llm.textbytes import slices

SF = "/root/testdata/sf0.001"


def prints(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def one_of_each(rows):
    value = [prints(r["text"]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (value[i] ^ value[j]).bit_count() <= 4:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    best = {}
    for i, r in enumerate(rows):
        best[find(i)] = min(best.get(find(i), r["doc_id"]), r["doc_id"])
    return set(best.values())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = docs.collect()

    net = quality.learn(docs, labels)
    kept = corpus_pipeline.keep_good(spark, docs, SF)
    assert kept.columns == docs.columns
    ((_, _, data, off),) = slices(pa.array([r["text"] for r in rows]), 1 << 30)
    good = {r["doc_id"] for r, p in zip(rows, net.score(*quality.passages(data, off)), strict=True) if p >= 0.5}
    kept = kept.cache()
    assert {r["doc_id"] for r in kept.collect()} == good

    counts = langid.learn(kept)
    langs = sorted(counts["lang"].unique())
    model = langid.Model(langs, *[[counts[counts["lang"] == l][c].to_numpy() for l in langs] for c in ("gram", "n")])
    told = corpus_pipeline.keep_known_languages(spark, kept, SF)
    assert told.columns == docs.columns
    left = [r for r in rows if r["doc_id"] in good]
    ((_, _, data, off),) = slices(pa.array([r["text"] for r in left]), 1 << 30)
    bits = model.bits(data, off)
    rate = bits.min(1) / np.maximum(np.diff(off), 1)
    sure = 1 / np.exp2(np.maximum(bits.min(1)[:, None] - bits, -1000)).sum(1)
    known = {r["doc_id"] for r, x, p in zip(left, rate, sure, strict=True) if x <= corpus_pipeline.MOST_BITS and p >= corpus_pipeline.LEAST_SCORE and any(c.isalpha() for c in r["text"])}
    assert {r["doc_id"] for r in told.collect()} == known

    left = [r for r in left if r["doc_id"] in known]
    single = corpus_pipeline.keep_one_of_each(spark, told, SF)
    assert single.columns == docs.columns and {r["doc_id"] for r in single.collect()} == one_of_each(left)
    assert single.count() == len(one_of_each(left))

    flat = lambda t: " ".join(t.split())
    items = [flat(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = [r for r in left if r["doc_id"] in one_of_each(left)]
    clean = corpus_pipeline.drop_benchmark(spark, single, SF)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in left if not any(i in flat(r["text"]) for i in items)}

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    texts = {r["doc_id"]: r["text"] for r in rows}
    got = corpus_pipeline.encode(spark, clean, SF).collect()
    assert len(got) == clean.count() and all(r["ids"] == sp.encode(texts[r["doc_id"]]) for r in got)


def test_run_is_its_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(r["doc_id"] for r in got.select("doc_id").collect()) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows_in_every_stage(spark, stage):
    rows = [(1, None, "en", "s", None), (2, "", None, None, 0), (None, "some words here", "en", "s", 3), (3, "a b " * 30000, "en", "s", 5), (3, "a b " * 30000, "en", "s", 5), (4, "漢字", "zz", "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    plain = stage(spark, docs, SF).collect()
    assert stage(spark, docs.limit(0), SF).count() == 0
    clash = ["_text", "_letter", "score", "predicted", "held_out", "lang_pred", "_fp", "_text_hash", "_row_key", "_row_hash", "_nth", "_doc_key", "_key", "_id", "n_tokens", "quality", "component_id", "_h"]
    wide = docs.selectExpr("*", *[f"'{c}' AS {c}" for c in clash])
    got = stage(spark, wide, SF)
    assert got.count() == len(plain)
    if stage is not corpus_pipeline.STAGES[-1][1]:
        assert got.columns == wide.columns and all(r[c] == c for r in got.collect() for c in clash)


def test_names():
    assert [q for n in range(1, 14) for q in QUERIES if q.startswith(f"op{n}_")] == list(QUERIES)
    assert set(ORACLE_SQL) <= set(QUERIES) and len(corpus_pipeline.STAGES) == 5
