import hashlib
import math
import random
import re
from zlib import crc32

import duckdb
import pandas as pd

from tideline.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain(docs, target, buckets=10_000, percent=5):
    def counts(texts):
        out = [0] * buckets
        for t in texts:
            for f in features(t)[1]:
                out[crc32(f.encode()) % buckets] += 1
        return out

    s, t = counts(x for _, x in docs), counts(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for id_, text in docs:
        n, found = features(text)
        weight = sum(gain[crc32(f.encode()) % buckets] for f in found)
        h = int(hashlib.sha256(f"42:{'' if id_ is None else id_}".encode()).hexdigest()[:8], 16)
        rows.append((id_, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20))
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = percent * len(fit) // 100
    out = [(*r[:4], i + 1 if i < drawn else None) for i, r in enumerate(fit)]
    return out + [(*r[:4], None) for r in rows if not r[4]]


def texts(n, seed=1):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "ÉTÉ", "été", "x1", "don't", "漢字", "a-b", "\x00", "_", "gamma delta", "7"]
    return [rng.choice([" ", "\n", ", "]).join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


def key(r):
    return tuple(-1 if x is None else x for x in r)


def test_ring_is_crc_of_every_run():
    for t in [*texts(200), "", " ", "a", "a b", "A\x00b\x7fc\x80d"]:
        got = [x for part in importance.ring(t.encode()) for x in part]
        assert sorted(got) == sorted(crc32(f.encode()) for f in features(t)[1])
        assert len(got) == importance.features_of(features(t)[0])
    one = [x for part in importance.ring(b"a b a", 1) for x in part]
    assert one == [crc32(b"a"), crc32(b"b"), crc32(b"a")]


def test_the_ring_goes_over_from_piece_to_piece(monkeypatch):
    text = " ".join(texts(30))
    whole = [x for part in importance.ring(text.encode()) for x in part]
    for size in (1, 7, 64):
        monkeypatch.setattr(importance, "SLICE_BYTES", size)
        assert [x for part in importance.ring(text.encode()) for x in part] == whole


def test_brute_force(spark):
    docs = [*enumerate(texts(300)), (None, None), (None, texts(5, 9)[0] * 3), (7, texts(300)[7]), (900, ""), (901, "one " * 20), (902, "one " * 19), (901, "one " * 20)]
    target = [*texts(20, 2), None, ""]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, rank string").repartition(5)
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = importance.resample(df, goal)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(key, got.collect())) == sorted(map(key, plain(docs, target)))
    half = importance.resample(df, goal, percent=50, buckets=97)
    assert sorted(map(key, half.collect())) == sorted(map(key, plain(docs, target, 97, 50)))
    assert importance.resample(df.limit(0), goal).count() == 0
    assert sorted(map(key, importance.resample(df, goal.limit(0)).collect())) == sorted(map(key, plain(docs, [])))


def test_long_text(spark):
    df = spark.createDataFrame([(1, "some words of it "), (2, "unbroken")], "doc_id long, text string").selectExpr("doc_id", "repeat(text, 300000) AS text")
    got = {r["doc_id"]: r["n_features"] for r in importance.resample(df, df.limit(0)).collect()}
    assert got == {1: importance.features_of(1_200_000), 2: 1}


def test_sql(spark):
    documents = pd.DataFrame(list(enumerate(texts(60, 3))), columns=["doc_id", "text"])
    benchmark = pd.DataFrame(list(enumerate(texts(9, 4))), columns=["item_id", "text"])
    want = duckdb.sql(importance.oracle_sql()).fetchall()
    docs = list(zip(documents.doc_id.tolist(), documents.text, strict=True))
    assert sorted(map(key, want)) == sorted(map(key, plain(docs, list(benchmark.text))))
