"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to length one, so that the nearest by cosine are the
nearest in the plane of Euclid, for which Gaussian projections are 2-stable.
Each of ``tables`` tables cuts ``dims`` projections to cells of width
``width``; a cell of all of them is a bucket. A query visits a table's buckets
in order of their estimated success: the probability that a vector at distance
``reach`` lies there, a product over the projections of normal probabilities
of the cell given the query's own value (Datar et al. 2004; Lv et al. 2007).
``reach`` is fitted to a sample of the queries.
It stops when the buckets visited have probability ``success`` together; as
that order is one of a threshold, a visited bucket is one of at least the
query's own least probability, which a task can tell for any bucket.

Buckets live in blocks by the cells of their first two projections, and blocks
are split to chunks by a hash of the id when they are large, so a hot bucket
is many tasks' work and none is capped. A query goes to the blocks that hold a
bucket it visits. In a block the candidates are compared exactly, each query
keeps its nearest, and the blocks' results are merged and reranked.

Queries that find fewer than ``k`` in this way visit every bucket.

Defined cases
- vectors that are null, zero, of another length than the commonest one of sound vectors (of
  equals the shorter), or with null or non-finite components take no part, neither as queries
  nor as candidates; null ids neither. Vectors of any size do: they are scaled by powers of two,
  which changes no cosine.
- ties: the smaller id. Repeated ids: rows of one id with equal scores are one answer; a query's own rows are all of its id.
- fewer than k candidates: all of them. Empty input: no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.session import bounded_batches, cut

TABLES, DIMS, WIDTH, SUCCESS = 2, 6, 1.0, 0.75
#: Queries whose own k-th nearest distances ``reach`` is fitted to, as this quantile of them.
SAMPLE, QUANTILE = 64, 0.9
#: Cells on each side of zero; those at the ends hold all beyond.
SIDE = 3
#: Vectors of a chunk of a block, and queries of one; candidates compared at once.
CHUNK, QUERIES, STEP = 16_384, 8_192, 4_096
SEED = 11

CELLS = 2 * SIDE


class Tables:
    """The projections, the same wherever they are made."""

    def __init__(self, length: int, tables: int = TABLES, dims: int = DIMS, width: float = WIDTH, reach: float = 1.0) -> None:
        rng = np.random.default_rng(SEED)
        self.a = rng.normal(size=(tables, length, dims))
        self.shift = rng.uniform(0, width, size=(tables, dims))
        self.tables, self.dims, self.width, self.reach = tables, dims, width, reach

    def places(self, unit: np.ndarray, table: int) -> np.ndarray:
        return (unit @ self.a[table] + self.shift[table]) / self.width

    def cells(self, unit: np.ndarray, table: int) -> np.ndarray:
        """Cell of each vector in each projection: 0 to CELLS - 1."""
        return np.clip(np.floor(self.places(unit, table)) + SIDE, 0, CELLS - 1).astype(np.int64)

    def chances(self, unit: np.ndarray, table: int) -> np.ndarray:
        """Queries x projections x cells: the probability that a vector at ``reach`` falls there.

        Over the choice of a projection, its values for two unit vectors of cosine c have the
        joint normal distribution of correlation c, so that of the one given the other is known.
        """
        c = min(1 - self.reach**2 / 2, 0.9999)
        own = unit @ self.a[table]
        edges = np.arange(-SIDE + 1, SIDE)[None, None, :] * self.width - self.shift[table][None, :, None]
        z = (edges - c * own[:, :, None]) / sqrt(1 - c * c)
        below = np.concatenate([np.zeros((*own.shape, 1)), _normal(z), np.ones((*own.shape, 1))], 2)
        return np.maximum(np.diff(below, axis=2), 0)

    def least(self, chance: np.ndarray, success: float) -> np.ndarray:
        """For each query the probability of its last bucket, when it visits them in order of success."""
        out = np.empty(len(chance))
        for lo in range(0, len(chance), 256):
            p = chance[lo : lo + 256, 0]
            for d in range(1, self.dims):
                p = (p[:, :, None] * chance[lo : lo + 256, d][:, None, :]).reshape(len(p), -1)
            p = -np.sort(-p, axis=1)
            last = (np.cumsum(p, 1) < success).sum(1)
            out[lo : lo + 256] = p[np.arange(len(p)), np.minimum(last, p.shape[1] - 1)]
        return out * (1 - 1e-9)


def _normal(z: np.ndarray) -> np.ndarray:
    """The normal distribution function, by formula 7.1.26 of Abramowitz and Stegun (error below 2e-7)."""
    x = np.abs(z) / sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    tail = 0.5 * np.exp(-x * x) * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.where(z < 0, tail, 1 - tail)


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each vector times the power of two that brings its largest component to between a half and one."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0.0))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _sound(vec: Column) -> Column:
    """A vector that takes part, if it is of the right length."""
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(ok, F.lit(False)) & F.exists(vec, lambda x: x != 0)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = TABLES, dims: int = DIMS, width: float = WIDTH, reach: float | None = None, success: float = SUCCESS) -> DataFrame:
    """query_id, rank, id, score: each query's k nearest found."""
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"query_id {kind}, vec_id {kind}, score double"

    def sound(df: DataFrame) -> DataFrame:
        v = F.col(vec_col).cast("array<double>")
        return df.select(F.col(id_col).alias("_id"), v.alias("_v")).filter(F.col("_id").isNotNull() & _sound(F.col("_v")))

    commonest = sound(vectors).groupBy(F.size("_v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").first()
    length = commonest["n"] if commonest else 0
    bounded_batches(vectors)
    rows, asked = (sound(df).filter(F.size("_v") == length) for df in (vectors, queries))
    reach = fitted_reach(rows, asked, k) if reach is None else reach
    t = Tables(max(length, 1), tables, dims, width, reach)
    found = _visit(rows, asked, t, k, success, schema, kind)
    found = cut(_merged(found))
    served = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
    left = asked.join(served, asked["_id"] == served["query_id"], "left_anti")
    left = cut(left)
    if not left.isEmpty():  # few, unless there are hardly any candidates
        one = Tables(max(length, 1), 1, dims, width, reach)
        found = _merged(found.unionByName(_visit(rows, left, one, k, 2.0, schema, kind)))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", nth).filter(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias(id_col), "score")


def _merged(found: DataFrame) -> DataFrame:
    """Each pair once, whichever tables found it."""
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def fitted_reach(rows: DataFrame, asked: DataFrame, k: int) -> float:
    """The QUANTILE of the true k-th nearest distances of at most SAMPLE queries, held against all rows."""
    some = asked.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE).collect()
    if not some:
        return 1.0
    ids, u = np.array([r["_id"] for r in some]), _unit(np.array([r["_v"] for r in some]))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(ids), k), -np.inf)
        for b in batches:
            near = u @ _unit(_matrix(b.column(1))).T
            near[ids[:, None] == b.column(0).to_numpy()[None, :]] = -np.inf
            both = np.concatenate([best, near], 1)
            best = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        q, c = np.nonzero(best > -2)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(best[q, c])], names=["q", "s"])

    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s")))
    kth = rows.mapInArrow(nearest, "q long, s double").withColumn("n", nth).filter(F.col("n") <= k).groupBy("q").agg(F.min("s").alias("s")).collect()
    far = [sqrt(max(0.0, 2 - 2 * r["s"])) for r in kth]
    return max(0.05, float(np.quantile(far, QUANTILE))) if far else 1.0


def _visit(rows: DataFrame, asked: DataFrame, t: Tables, k: int, success: float, schema: str, kind: str) -> DataFrame:
    spark = rows.sparkSession
    blocks = CELLS * CELLS

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            unit = _unit(_matrix(b.column(1)))
            for table in range(t.tables):
                c = t.cells(unit, table)
                block = table * blocks + c[:, 0] * CELLS + c[:, 1]
                yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), b.column(0), b.column(1)], names=["_block", "_id", "_v"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            unit = _unit(_matrix(b.column(1)))
            for table in range(t.tables):
                chance = t.chances(unit, table)
                least = t.least(chance, success) if success <= 1 else np.full(len(unit), -1.0)
                # the best bucket of every block: is it visited?
                best = chance[:, 0, :, None] * chance[:, 1, None, :] * chance[:, 2:].max(2).prod(1)[:, None, None]
                q, c = np.nonzero(best.reshape(len(unit), -1) >= least[:, None])
                take = pa.array(q)
                yield pa.RecordBatch.from_arrays([pa.array((table * blocks + c).astype(np.int32)), b.column(0).take(take), b.column(1).take(take), pa.array(least[q])], names=["_block", "_id", "_v", "_least"])

    dealt = rows.mapInArrow(deal, f"_block int, _id {kind}, _v array<double>")
    sent = asked.mapInArrow(ask, f"_block int, _id {kind}, _v array<double>, _least double")
    # at most tables * CELLS ** 2 counts
    parts = {r["_block"]: -(-r["n"] // CHUNK) for r in dealt.groupBy("_block").agg(F.count(F.lit(1)).alias("n")).collect()}
    groups = {r["_block"]: -(-r["n"] // QUERIES) for r in sent.groupBy("_block").agg(F.count(F.lit(1)).alias("n")).collect()}
    both = [(b, n, groups[b]) for b, n in parts.items() if b in groups] or [(-1, 1, 1)]

    def spread(df: DataFrame, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        sizes = spark.createDataFrame(both, "_block int, _parts long, _groups long")
        df = df.join(F.broadcast(sizes), "_block").withColumn(own, F.pmod(F.xxhash64("_id"), F.col(own_n)))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other_n) - 1))).drop("_parts", "_groups")

    dealt, sent = spread(dealt, "_i", "_parts", "_g", "_groups"), spread(sent, "_g", "_groups", "_i", "_parts")
    names = ["_block", "_i", "_g"]

    def compare(key: tuple, some: pa.Table, wanted: pa.Table) -> pa.Table:
        if not some.num_rows or not wanted.num_rows:
            return _as(some, wanted).empty_table()
        table = key[0].as_py() // blocks
        x, ids = _matrix(some.column("_v")), some.column("_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        x, ids = x[order], ids[order]
        unit = _unit(x)
        # candidates by bucket: whether a query visits one is the same for all in it
        bucket = t.cells(unit, table)[:, 2:] @ CELLS ** np.arange(t.dims - 2)
        buckets, at = np.unique(bucket, return_inverse=True)
        cells = buckets[:, None] // CELLS ** np.arange(t.dims - 2) % CELLS
        y, own = _matrix(wanted.column("_v")), wanted.column("_id").to_numpy()
        least = wanted.column("_least").to_numpy()
        here = key[0].as_py() % blocks
        size = max(1, STEP * 512 // len(x))
        out: list[tuple] = []
        for lo in range(0, len(y), size):
            u = _unit(y[lo : lo + size])
            chance = t.chances(u, table)
            p = np.repeat((chance[:, 0, here // CELLS] * chance[:, 1, here % CELLS])[:, None], len(buckets), 1)
            for d in range(2, t.dims):
                p *= chance[:, d][:, cells[:, d - 2]]
            p = (p >= least[lo : lo + size, None])[:, at]
            near = u @ unit.T
            near[~p | (own[lo : lo + size, None] == ids[None, :])] = -np.inf
            n = min(k, len(x))
            kth = -np.partition(-near, n - 1, axis=1)[:, n - 1]
            q, c = np.nonzero((near >= kth[:, None] - 1e-9) & (near > -2))
            # of many equals only the first k, by id, can matter
            s = exact(y[lo + q], x[c])
            rank = np.lexsort((ids[c], -s, q))
            q, c, s = q[rank], c[rank], s[rank]
            heads = np.flatnonzero(np.diff(q, prepend=-1))
            nth = np.arange(len(q)) - np.repeat(heads, np.diff(np.append(heads, len(q))))
            ok = nth < k
            out.append((own[lo + q[ok]], ids[c[ok]], s[ok]))
        q, c, s = (np.concatenate(v) for v in zip(*out, strict=True))
        return pa.table({"query_id": q, "vec_id": c, "score": s})

    return dealt.groupBy(*names).cogroup(sent.groupBy(*names)).applyInArrow(compare, schema)


def _as(some: pa.Table, wanted: pa.Table) -> pa.Schema:
    kind = (some if some.num_columns else wanted).schema.field("_id").type
    return pa.schema([("query_id", kind), ("vec_id", kind), ("score", pa.float64())])


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of pairs of vectors in double precision."""
    a, b = _scaled(a), _scaled(b)
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
