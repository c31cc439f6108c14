import hashlib
import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from tideline.llm import ballkmeans

SCHEMA = "vec_id long, embedding array<float>, cluster string"


def plain(rows, k, rounds, scale, length, seed):
    """Every vector against every centroid, in whole numbers."""
    kept = []
    for id_, v, _ in rows:
        if v is not None and len(v) == length and all(x is not None and math.isfinite(x) for x in v):
            whole = [max(-ballkmeans.MOST, min(ballkmeans.MOST, math.floor(scale * float(np.float32(x))))) for x in v]
            key = hashlib.sha256(f"{seed}:{'' if id_ is None else id_}".encode()).hexdigest()
            kept.append((key, whole, id_))
    centroids = [v for _, v, _ in sorted(kept, key=lambda t: t[:2])[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v, _ in kept]
        for i in range(len(centroids)):
            members = [v for (_, v, _), o in zip(kept, own, strict=True) if o == i]
            if members:
                centroids[i] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    final = [(id_, *nearest(v)) for _, v, id_ in kept]
    own = {}
    for _, d, i in final:
        own[i] = own.get(i, 0) + d
    return sorted((-1 if id_ is None else id_, i, d, own[i], sum(own.values()), hashlib.sha256(",".join(map(str, centroids[i])).encode()).hexdigest()) for id_, d, i in final)


def run(spark, rows, **args):
    got = ballkmeans.clusters(spark.createDataFrame(rows, SCHEMA).repartition(3), **args)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in map(tuple, got.collect()))


def grid(n, length, spread, seed):
    rng = random.Random(seed)
    return [(i, [rng.randrange(-spread, spread) / 4 for _ in range(length)], "x") for i in range(n)]


@pytest.mark.parametrize(("k", "length", "spread"), [(5, 2, 4), (16, 3, 9), (7, 1, 30)])
def test_brute_force_with_many_ties(spark, k, length, spread):
    rows = grid(400, length, spread, k)
    args = {"k": k, "rounds": 3, "scale": 4, "length": length, "seed": 1}
    assert run(spark, rows, **args) == plain(rows, **args)


def test_odd_vectors_repeats_and_nulls(spark):
    args = {"k": 4, "rounds": 3, "scale": 64, "length": 2, "seed": 1}
    rows = [*grid(40, 2, 20, 3), *grid(10, 2, 20, 3), (None, [0.5, 0.25], "n"), (None, [0.5, -0.25], "n")]
    odd = [(100, None, "x"), (101, [], "x"), (102, [1.0], "x"), (103, [1.0, None], "x"), (104, [float("nan"), 1.0], "x"), (105, [float("inf"), 1.0], "x"), (106, [1.0, 2.0, 3.0], "x")]
    assert run(spark, rows + odd, **args) == plain(rows + odd, **args)
    huge = [*rows, (200, [3e38, -3e38], "x"), (201, [3e6, 1.0], "x")]
    assert run(spark, huge, **args) == plain(huge, **args)


def test_few_and_none(spark):
    args = {"k": 16, "rounds": 2, "scale": 64, "length": 2, "seed": 1}
    rows = [(1, [1.0, 2.0], "x"), (2, [1.0, 2.0], "x"), (3, [1.0, 2.0], "x")]
    got = run(spark, rows, **args)
    assert got == plain(rows, **args) and {r[1] for r in got} == {0}
    assert run(spark, [], **args) == []
    assert run(spark, [(1, None, "x")], **args) == []


def test_only_relevant_neighbours_are_compared():
    rng = np.random.default_rng(5)
    centers = rng.integers(-5000, 5000, (40, 8))
    x = (centers[rng.integers(0, 40, 4000)] + rng.integers(-60, 60, (4000, 8))).astype(np.int64)
    full = ballkmeans.Balls(centers.astype(np.int64))
    own, d, seen_all = full.assign(x)
    radii = np.full(40, -1, np.int64)
    np.maximum.at(radii, own, d)
    stirred = own.copy()
    stirred[::50] = rng.integers(0, 40, 80)  # as if these had been elsewhere
    wide = np.full(40, -1, np.int64)
    np.maximum.at(wide, stirred, full.to_own(x, stirred))
    for before, r, most in ((own, radii, 1.1), (stirred, wide, 6)):
        best, there, seen = ballkmeans.Balls(centers.astype(np.int64), r).reassign(x, before)
        assert (best == own).all() and (there == d).all()
        assert seen < most * len(x) < seen_all


def test_distances_are_exact():
    x = np.array([[1 << 27, -(1 << 27)] * 32, [3, 4] * 32], np.int64)
    c = np.array([[-(1 << 27), 1 << 27] * 32, [(1 << 20) - 1, 0] * 32], np.int64)
    want = [[sum((a - b) ** 2 for a, b in zip(v, w, strict=True)) for w in c.tolist()] for v in x.tolist()]
    assert ballkmeans.squared(x, c).tolist() == want
    assert ballkmeans.squared(x[1:], c[1:]).tolist() == [want[1][1:]]


def test_sql(spark):
    rng = random.Random(2)
    embeddings = pd.DataFrame({"vec_id": range(120), "embedding": [[rng.gauss(0, 0.1) for _ in range(64)] for _ in range(120)]})  # noqa: F841
    rows = [(i, v, "x") for i, v in zip(embeddings.vec_id, embeddings.embedding, strict=True)]
    want = duckdb.sql(ballkmeans.oracle_sql()).fetchall()
    assert sorted(want) == plain([(i, v, c) for i, v, c in rows], 16, 3, 64, 64, 1) == run(spark, rows)
