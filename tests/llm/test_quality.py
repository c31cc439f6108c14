import itertools
import math
import re

import numpy as np
import pyarrow as pa

from tideline.llm import quality
from tideline.llm.textbytes import slices


def features(texts, most=1 << 20):
    xs, base = [], [0]
    for _, _, data, off in slices(pa.array(texts), most):
        x, b = quality.passages(data, off)
        xs.append(x)
        base += [base[-1] + k for k in b[1:]]
    return np.concatenate(xs), np.array(base)


def plain_features(text):
    """The features of each passage of a text, word by word and byte by byte."""
    w = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    rows = []
    for lo in range(0, len(w), 64):
        part = w[lo : lo + 64]
        raw = text[part[0][0] : part[-1][1]]
        kinds = [0] * quality.CLASSES
        for c in raw:
            ch = chr(c)
            if c > 127:
                k = 5
            elif ch.islower():
                k = 1
            elif ch.isupper():
                k = 2
            elif ch.isdigit():
                k = 3
            elif ch in " \t\n\v\f\r":
                k = 4
            else:
                k = 6 + quality._MARKS.index(ch) if ch in quality._MARKS else 0
            kinds[k] += 1
        words = [text[a:z] for a, z in part]
        low, n = [x.lower() for x in words], len(words)
        size = [len(x) for x in words]
        mean = sum(size) / n
        spread = max(sum(x * x for x in size) / n - mean * mean, 0) ** 0.5
        marks = [x for x in words if x[-1] < 128 and chr(x[-1]) in quality._MARKS]
        own = [math.log1p(mean), math.log1p(spread), sum(a == b for a, b in itertools.pairwise(low)) / n, len(set(low)) / n, sum(x[:1].isupper() for x in words) / n, len(marks) / n, size.count(1) / n, n / 64]
        rows.append([(k / len(raw)) ** 0.5 for k in kinds] + own)
    return rows or [[0.0] * quality.FEATURES]


TEXTS = ["a b c " * 50, None, "", "é | x!! " * 70, " ", "one", "the the the end", "A" * 9000, "  lead and trail \n\n", "\x01 Odd Marks, here; 12%", "漢字 " * 200]


def test_passages_against_a_plain_version():
    x, base = features(TEXTS)
    for i, t in enumerate(TEXTS):
        want = plain_features((t or "").encode())
        assert base[i + 1] - base[i] == len(want) and np.allclose(x[base[i] : base[i + 1]], want, atol=1e-6), t


def test_scores_do_not_depend_on_neighbours_or_slices():
    rng = np.random.default_rng(3)
    texts = TEXTS + [" ".join(f"w{rng.integers(300)}" for _ in range(int(rng.integers(1, 900)))) for _ in range(60)]
    x, base = features(texts)
    net = quality.fit(x.astype(float), base, (np.arange(len(texts)) % 2).astype(float))
    want = net.score(x, base)
    alone = np.concatenate([net.score(*features([t])) for t in texts])
    blank = features([u for t in texts for u in (t, " " * 3000 + "z", "\n" * 500)])
    assert np.array_equal(want, alone) and np.array_equal(want, net.score(*blank)[::3])
    for most in (1, 10, 1000):
        y, base2 = features(texts, most)
        assert np.array_equal(x, y) and base.tolist() == base2.tolist()


def test_network_against_a_plain_version():
    rng = np.random.default_rng(5)
    bags = [rng.normal(size=(n, 6)) for n in (1, 4, 2)]
    base = np.array([0, 1, 5, 7])
    net = quality.fit(np.concatenate(bags), base, np.array([1.0, 0, 1]))
    e, eb, v, u, w, o, b = net.weights
    for bag, got in zip(bags, net.score(np.concatenate(bags), base), strict=True):
        h = [np.tanh(e.T @ np.clip((p - net.mean) * net.scale, -8, 8) + eb) for p in bag]
        g = [math.exp(w @ (np.tanh(v.T @ x) / (1 + np.exp(-(u.T @ x))))) for x in h]
        whole = sum(a * x for a, x in zip(g, h, strict=True)) / sum(g)
        assert abs(got - 1 / (1 + math.exp(-(o @ whole + b)))) < 1e-12


def test_gradient_by_differences():
    rng = np.random.default_rng(0)
    x, base, y, share = rng.normal(size=(30, 5)), np.array([0, 3, 4, 14, 30]), np.array([0.0, 1, 0, 1]), np.array([0.1, 0.4, 0.2, 0.3])
    net = quality.fit(x, base, y)
    _, grads = quality.loss_and_gradient(net, x, base, y, share)
    for k, g in enumerate(grads):
        for at in np.ndindex(np.shape(g)):
            if rng.random() < 0.7 and np.ndim(g):
                continue
            ends = []
            for d in (1e-5, -1e-5):
                weights = [np.array(a, float) for a in net.weights]
                weights[k][at] += d
                ends.append(quality.loss_and_gradient(quality.Network(net.mean, net.scale, weights), x, base, y, share)[0])
            assert abs((ends[0] - ends[1]) / 2e-5 - np.asarray(g)[at]) < 1e-7


def test_a_long_text_and_a_repeated_id(spark):
    ids = spark.range(60).filter(~quality.held_out("id", 3, 1)).toPandas()["id"].tolist()
    good, bad = "the small house stood near the river and its garden ", "@@ || ## 77 $$ "
    docs = spark.createDataFrame([(i, (good if k % 2 else bad) * 20) for k, i in enumerate(ids)], "doc_id long, text string")
    one = spark.createDataFrame([(ids[1],)], "doc_id long")
    docs = docs.unionByName(spark.range(400).join(one).selectExpr("doc_id", f"repeat('{good}', 20) AS text"))
    docs = docs.unionByName(spark.range(1).selectExpr("1000L AS doc_id", f"repeat('{good}', 400000) AS text"))  # 20 MB
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int")
    got = quality.score(docs, quality.learn(docs, labels)).toPandas()
    assert len(got) == len(ids) + 401 and (got[got["doc_id"].isin([1000, ids[1]])]["predicted"] == 1).all()


def test_attention_finds_the_passage():
    rng = np.random.default_rng(1)
    bags, y = [], []
    for i in range(300):
        x = rng.normal(size=(rng.integers(2, 9), 4))
        if i % 2:
            x[rng.integers(len(x))] += [0, 3, 0, 3]
        bags.append(x)
        y.append(float(i % 2))
    base = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    net = quality.fit(np.concatenate(bags), base, np.array(y))
    assert ((net.score(np.concatenate(bags), base) >= 0.5) == (np.array(y) == 1)).mean() > 0.9


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score(docs, quality.learn(docs, labels))
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").filter("held_out").toPandas()
    assert (rows["predicted"] == rows["quality"]).mean() > 0.97
    assert rows["score"].between(0, 1).all()


def test_one_huge_text_does_not_empty_the_sample(spark):
    from pyspark.sql import functions as F

    ids = spark.range(40).filter(~quality.held_out("id", 3, 1)).orderBy(F.xxhash64("id")).toPandas()["id"].tolist()
    good, bad = "the small house stood near the river and its garden ", "@@ || ## 77 $$ "
    docs = [(i, (good if k % 2 else bad) * (20 if k else 3000)) for k, i in enumerate(ids)]  # the text of the least hash is longer than all that is sampled
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int")
    net = quality.learn(df, labels, sample_passages=100)
    assert net is not None
    got = {r["doc_id"]: r["predicted"] for r in quality.score(df, net).collect()}
    assert got == {i: k % 2 for k, i in enumerate(ids)}


def test_shares_and_spread():
    assert quality.shares(np.array([5000, 3, 40]), 50).tolist() == [23, 3, 23]
    assert quality.shares(np.array([5, 3]), 50).tolist() == [5, 3] and quality.shares(np.array([5, 3, 2]), 2).tolist() == [1, 1, 0]
    assert quality.evenly(10, 3).tolist() == [1, 5, 8] and quality.evenly(4, 9).tolist() == [0, 1, 2, 3]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "a b", 5), (3, "x " * 5000, 5), (3, "x " * 5000, 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    net = quality.learn(docs, labels)
    assert net is None  # one kind of label only
    got = quality.score(docs, net).collect()
    assert len(got) == 5 and all(r["score"] == 0.5 and r["predicted"] == 1 for r in got)
    assert quality.score(docs.limit(0), net).count() == 0
    kept = quality.keep(docs, net)
    assert kept.columns == docs.columns and kept.count() == 5 and quality.keep(docs, net, least=0.6).count() == 0
