import numpy as np

from tideline.llm import ann


def brute(x, ids, queries, k):
    out = {}
    for q in queries:
        v = x[q]
        s = (x @ v) / (np.linalg.norm(x, axis=1) * np.linalg.norm(v))
        s[ids == ids[q]] = -9
        out[int(ids[q])] = [(int(ids[i]), s[i]) for i in np.lexsort((ids, -s))[:k]]
    return out


def table(spark, x, ids):
    return spark.createDataFrame([(int(i), [float(v) for v in r], "c") for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, rank string")


def test_recall_and_scores(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    p = rows.toPandas()
    x, ids = np.stack(p["embedding"]).astype(float), p["vec_id"].to_numpy()
    want = brute(x, ids, np.flatnonzero(ids % 50 == 0), 5)
    got = ann.search(rows, rows.filter("vec_id % 50 = 0")).toPandas()
    assert set(got["query_id"]) == set(want) and (got.groupby("query_id").size() == 5).all()
    hits = sum(v in {i for i, _ in want[q]} for q, v in zip(got["query_id"], got["vec_id"], strict=True))
    assert hits / len(got) >= 0.9
    where = {int(i): k for k, i in enumerate(ids)}
    for q, v, s in zip(got["query_id"], got["vec_id"], got["score"], strict=True):
        a, b = x[where[q]], x[where[v]]
        assert abs(s - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12
    for _, g in got.sort_values("rank").groupby("query_id"):
        assert list(g["rank"]) == [1, 2, 3, 4, 5] and (np.diff(g["score"]) <= 0).all()


def test_hot_bucket_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK", 40)
    monkeypatch.setattr(ann, "QUERIES", 10)
    rng = np.random.default_rng(0)
    x = np.concatenate([np.tile(rng.normal(size=8), (150, 1)), rng.normal(size=(100, 8))])
    ids = np.arange(250)
    df = table(spark, x, ids)
    x = np.array([r["embedding"] for r in df.orderBy("vec_id").collect()])
    got = ann.search(df, df.filter("vec_id % 5 = 0"), tables=2, dims=3, success=0.9)
    by = {}
    for r in got.collect():
        by.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    want = brute(x, ids, np.arange(0, 250, 5), 5)
    for q in range(0, 150, 5):  # copies: the smallest ids win
        assert [by[q][k] for k in range(1, 6)] == [i for i in range(7) if i != q][:5]
    hits = sum(v in {i for i, _ in want[q]} for q in range(150, 250, 5) for v in by[q].values())
    assert hits >= 0.9 * 100


def test_odd_vectors(spark):
    rows = [(50, [1.0, 0.0, 0.0]), (1, [1.0, 0.1, 0.0]), (2, [1.0, 0.1, 0.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [float("nan"), 1.0, 1.0]), (6, [1.0, None, 1.0]), (7, [-1.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (8, [1.0, 2.0]), (9, [float("inf"), 1.0, 1.0]), (10, []), (50, [1.0, 0.0, 0.0]), (0, [0.0, 0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(df, df.filter("vec_id % 50 = 0")).collect())
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 7), (0, 4, 50), (50, 1, 1), (50, 2, 2), (50, 3, 0), (50, 4, 7)]
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_visits_are_in_order_of_success():
    t = ann.Tables(16)
    u = ann._unit(np.random.default_rng(2).normal(size=(5, 16)))
    chance = t.chances(u, 1)
    assert np.allclose(chance.sum(2), 1)
    for p in (0.3, 0.8):
        least = t.least(chance, p)
        for q in range(5):
            every = np.array([1.0])
            for d in range(t.dims):
                every = (every[:, None] * chance[q, d][None, :]).ravel()
            visited = every[every >= least[q]]
            assert visited.sum() >= p and np.sort(visited)[1:].sum() < p


def test_a_short_first_vector_takes_nobody_away(spark):
    rng = np.random.default_rng(4)
    rows = [(0, [1.0, 2.0])] + [(i, rng.normal(size=6).tolist()) for i in range(1, 101)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, df.filter("vec_id % 50 = 0")).toPandas()
    assert sorted(got["query_id"].unique()) == [50, 100] and len(got) == 10 and 0 not in set(got["vec_id"])


def test_vectors_of_any_size(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(101, 6))
    want = None
    for size in (1.0, 1e-170, 1e170, 2.0**-1050):
        df = spark.createDataFrame([(i, (v * size).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(df, df.filter("vec_id % 50 = 0"), success=1.0, reach=1.2).orderBy("query_id", "rank").collect()]
        assert len(got) == 15
        want = want or got
        assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-4 if size == 2.0**-1050 else 1e-14)
    ids = np.arange(101)
    plain = brute(x, ids, np.array([0, 50, 100]), 5)
    assert [(q, i) for q, _, i, _ in want] == [(q, i) for q in (0, 50, 100) for i, _ in plain[q]]


def test_reach_fitted_to_other_queries(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    p = rows.toPandas()
    x, ids = np.stack(p["embedding"]).astype(float), p["vec_id"].to_numpy()
    some = [r["_id"] for r in rows.filter("vec_id % 50 = 0").selectExpr("vec_id AS _id").collect()][:8]
    as_rows = rows.selectExpr("vec_id AS _id", "CAST(embedding AS array<double>) AS _v")
    reach = ann.fitted_reach(as_rows, as_rows.filter(as_rows["_id"].isin(some)), 5)
    rest = np.array([i for i in np.flatnonzero(ids % 50 == 0) if ids[i] not in some])
    got = ann.search(rows, rows.filter("vec_id % 50 = 0"), reach=reach).toPandas()
    want = brute(x, ids, rest, 5)
    hits = sum(v in {i for i, _ in want[q]} for q, v in zip(got["query_id"], got["vec_id"], strict=True) if q in want)
    assert hits / (5 * len(want)) >= 0.9


def test_normal_distribution():
    from math import erf, sqrt

    z = np.linspace(-6, 6, 101)
    assert np.allclose(ann._normal(z), [0.5 * (1 + erf(v / sqrt(2))) for v in z], atol=2e-7)
