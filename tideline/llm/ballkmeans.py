"""Ball k-means over integer vectors, exact in every step.

A cluster is a ball: its centroid and, as radius, the distance of its farthest
member. In each round

1. the members' distances to their own moved centroid are taken, and the largest
   of each cluster, so that the radii are those of the balls as they are now;
2. centroid j is a neighbour of ball i only if half the distance of the two is no
   more than i's radius; no member of i can be as near to any other centroid;
3. a member belongs to the stable core if it is nearer to its centroid than half the
   way to the nearest neighbour, and stays unseen by any other. Beyond, half the
   ways to the neighbours, in order, cut the ball into annuli; a member of the m-th
   annulus is compared with the m nearest neighbours alone.

All conditions are on squared distances of integers, with equality on the side of a
comparison, so ties are decided as by comparing with all centroids.

Only k centroids with their counts and sums are ever on the driver. The vectors with
their clusters are written to the shared folder once a round, and the table of
the round before is deleted; sums and radii are taken in each task first.

Defined cases
- vectors that are null, of another length, or hold null or non-finite components take no part and have no row.
- components beyond 2 ** 27 after scaling count as that, with their sign: squared distances must fit a long.
- repeated rows are vectors of their own; null ids take part, hashed as an empty id. Equal hashes: the lesser vector first.
- fewer vectors than k: as many centroids as vectors. A cluster without members keeps its centroid. Empty input: no rows.
- other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.session import discard, scratch_path

K, ROUNDS, SCALE, LENGTH, SEED = 16, 3, 64, 64, 1
MOST = 1 << 27
#: Components up to which products of vectors are exact in doubles.
EXACT = 1 << 20
#: Vectors that are compared at once.
STEP = 8192


class Balls:
    """Centroids, the squared distances between them, and each ball's neighbours in order of nearness."""

    def __init__(self, centroids: np.ndarray, radii: np.ndarray | None = None) -> None:
        self.c = centroids
        apart = squared(centroids, centroids)
        np.fill_diagonal(apart, -1)
        self.near, self.ways = [], []
        for i, row in enumerate(apart):
            order = np.argsort(row, kind="stable")
            order = order[order != i]
            if radii is not None:  # half the way is within the radius: a quarter of its square within the radius's
                order = order[row[order] // 4 + (row[order] % 4 > 0) <= radii[i]]
            self.near.append(order)
            self.ways.append(row[order])

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest centroid of each vector by comparing with all of them, the squared distance, and how many comparisons."""
        d = squared(x, self.c)
        best = d.argmin(1) if len(self.c) else np.zeros(len(x), np.int64)
        return best, d[np.arange(len(x)), best], d.size

    def reassign(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The same from the clusters of before, each vector compared with its annulus's neighbours alone."""
        best, d = own.copy(), self.to_own(x, own)
        seen = len(x)
        for i in np.unique(own):
            rows = np.flatnonzero(own == i)
            # a neighbour may be as near if its way is at most twice the distance
            quarter = self.ways[i] // 4 + (self.ways[i] % 4 > 0)
            annulus = np.searchsorted(quarter, d[rows], "right")
            rows, annulus = rows[annulus > 0], annulus[annulus > 0]
            home = d[rows]
            for m, j in enumerate(self.near[i][: annulus.max(initial=0)]):
                rows, annulus, home = rows[annulus > m], annulus[annulus > m], home[annulus > m]
                there = squared(x[rows], self.c[j : j + 1])[:, 0]
                seen += len(rows)
                nearer = (there < d[rows]) | ((there == d[rows]) & (j < best[rows]))
                best[rows[nearer]], d[rows[nearer]] = j, there[nearer]
        return best, d, seen

    def to_own(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The squared distance of each vector to its cluster's centroid."""
        out = np.empty(len(x), np.int64)
        for lo in range(0, len(x), STEP):
            step = x[lo : lo + STEP] - self.c[own[lo : lo + STEP]]
            out[lo : lo + STEP] = (step * step).sum(1)
        return out


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of integer vectors, exact: by a product in doubles where that holds all of it, else by differences."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for lo in range(0, len(x), 512):
        step = x[lo : lo + 512, None, :] - c[None]
        out[lo : lo + 512] = (step * step).sum(2)
    return out


def integers(vec: Column, scale: int) -> Column:
    """floor(scale * x) of every component, in doubles, within MOST."""
    return F.transform(vec, lambda x: F.greatest(F.least(F.floor(F.lit(float(scale)) * x.cast("double")), F.lit(MOST)), F.lit(-MOST)).cast("int"))


def sound(vec: Column, length: int) -> Column:
    """A vector of that length without null or non-finite components."""
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vec) == length) & ok, F.lit(False))


def first_centroids(kept: DataFrame, k: int, seed: int, length: int) -> np.ndarray:
    """The k vectors of the smallest SHA-256 of the seed and their id, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    first = kept.select(key.alias("h"), "_v").orderBy("h", "_v").limit(k).collect()
    return np.array([r["_v"] for r in first], np.int64).reshape(len(first), length)


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), length)


def _by_task(rows: DataFrame, take: Callable[[dict, np.ndarray, np.ndarray], None], give: Callable[[dict], pa.RecordBatch], schema: str, length: int) -> DataFrame:
    """One small result for each task over rows (_v, _cluster)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            if len(batch):
                take(held, _matrix(batch.column(0), length), batch.column(1).to_numpy().astype(np.int64))
        yield give(held)

    return rows.select("_v", "_cluster").mapInArrow(run, schema)


def radii(rows: DataFrame, balls: Balls, length: int) -> np.ndarray:
    """The largest squared distance of each cluster's members to its centroid; -1 of none."""
    k = len(balls.c)

    def take(held: dict, x: np.ndarray, own: np.ndarray) -> None:
        np.maximum.at(held.setdefault("most", np.full(k, -1, np.int64)), own, balls.to_own(x, own))

    def give(held: dict) -> pa.RecordBatch:
        most = held.get("most", np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(most), dtype=np.int32)), pa.array(most)], names=["c", "r"])

    out = np.full(k, -1, np.int64)
    for r in _by_task(rows, take, give, "c int, r long", length).groupBy("c").agg(F.max("r").alias("r")).collect():  # k rows
        out[r["c"]] = r["r"]
    return out


def moved(rows: DataFrame, centroids: np.ndarray, length: int) -> np.ndarray:
    """Each cluster's floored mean; where it has no member, the centroid as it was.

    Sums are kept as one row for each component of each cluster, as decimals, which no count of rows overflows.
    """
    k = len(centroids)

    def take(held: dict, x: np.ndarray, own: np.ndarray) -> None:
        n = held.setdefault("n", [0] * k)
        sums = held.setdefault("s", [[0] * length for _ in range(k)])
        for i in np.unique(own).tolist():
            members = x[own == i]
            n[i] += len(members)
            sums[i] = [a + b for a, b in zip(sums[i], members.sum(0).tolist(), strict=True)]

    def give(held: dict) -> pa.RecordBatch:
        there = [i for i, n in enumerate(held.get("n", [])) if n]
        flat = [(i, j, held["n"][i], s) for i in there for j, s in enumerate(held["s"][i])]
        columns = zip(*flat, strict=True) if flat else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["c", "j", "n", "s"])

    out = centroids.copy()
    sums = _by_task(rows, take, give, "c int, j int, n long, s long", length).groupBy("c", "j").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    for r in sums.collect():  # a row for each component of each centroid
        out[r["c"], r["j"]] = int(r["s"]) // r["n"]
    return out


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, length: int = LENGTH, seed: int = SEED, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every sound vector."""
    spark = vectors.sparkSession
    kept = vectors.filter(sound(F.col(vec_col), length)).select(F.col(id_col).alias("_id"), integers(F.col(vec_col), scale).alias("_v"))
    centroids = first_centroids(kept, k, seed, length)
    schema = f"_id {kept.schema['_id'].dataType.simpleString()}, _v array<int>, _cluster int, _d long"

    def assigned(rows: DataFrame, balls: Balls, first: bool) -> str:
        """The path of rows with their clusters and squared distances under the balls as they are."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, len(batch), STEP):
                    part = batch.slice(lo, STEP)
                    x = _matrix(part.column(1), length)
                    best, d, _ = balls.assign(x) if first else balls.reassign(x, part.column(2).to_numpy().astype(np.int64))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(best.astype(np.int32)), pa.array(d)], names=["_id", "_v", "_cluster", "_d"])

        path = scratch_path(spark, "balls")
        rows.mapInArrow(run, schema).write.parquet(path)
        return path

    path = assigned(kept, Balls(centroids), first=True)
    for _ in range(rounds):
        rows = spark.read.schema(schema).parquet(path)
        centroids = moved(rows, centroids, length)
        balls = Balls(centroids, radii(rows, Balls(centroids), length))
        before, path = path, assigned(rows, balls, first=False)
        discard(spark, before)
    rows = spark.read.schema(schema).parquet(path)

    sums = rows.groupBy("_cluster").agg(F.sum(F.col("_d").cast("decimal(38,0)")).alias("s"))
    inertia = {r["_cluster"]: int(r["s"]) for r in sums.collect()}  # at most k rows
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of_cluster = spark.createDataFrame([(i, s, sum(inertia.values()), digest[i]) for i, s in inertia.items()], "_cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(of_cluster), "_cluster").select(
        F.col("_id").alias(id_col), F.col("_cluster").alias("cluster"), F.col("_d").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256"
    )


def oracle_sql(k: int = K, rounds: int = ROUNDS, scale: int = SCALE, length: int = LENGTH, seed: int = SEED) -> str:
    """The same over `embeddings` in DuckDB, where every vector is compared with every centroid."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
d{r} AS MATERIALIZED (SELECT x.r, c.c, list_sum(list_transform(range(1, {length + 1}), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))::BIGINT AS d FROM x CROSS JOIN c{r} AS c),
a{r} AS MATERIALIZED (SELECT x.r, x.v, o.c, o.d FROM x JOIN (SELECT r, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1) o USING (r))""")
        if r < rounds:
            steps.append(f"""
m{r} AS (SELECT c, list(m ORDER BY j) AS v FROM (SELECT c, j, (sum(v[j]) - ((sum(v[j]) % count(*)) + count(*)) % count(*)) // count(*) AS m FROM a{r}, (SELECT unnest(range(1, {length + 1})) AS j) GROUP BY c, j) GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m.v, c{r}.v)::BIGINT[] AS v FROM c{r} LEFT JOIN m{r} AS m USING (c))""")
    return f"""
WITH x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: greatest(least(floor({scale} * e::DOUBLE), {MOST}), {-MOST})::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {length} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {length}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v FROM x QUALIFY c < {k}),{','.join(steps)},
n AS (SELECT c, sum(d)::BIGINT AS s FROM a{rounds} GROUP BY c)
SELECT x.vec_id, a.c::INT AS cluster, a.d AS distance, n.s AS cluster_inertia, (SELECT sum(d)::BIGINT FROM a{rounds}) AS inertia, sha256(array_to_string(f.v, ',')) AS centroid_sha256
FROM a{rounds} AS a JOIN x USING (r) JOIN n USING (c) JOIN c{rounds} AS f USING (c)
"""
