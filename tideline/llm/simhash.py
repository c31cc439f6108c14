"""SimHash near-duplicates: tiled exact comparison of 64-bit fingerprints.

Every text becomes one fingerprint. Texts with the same fingerprint fall
together first. The distinct fingerprints are sorted by the population counts
of their four 16-bit parts and cut to blocks: two fingerprints within the
radius have parts whose counts differ by no more than it in sum, so pairs of
blocks that are farther apart are never sent anywhere. Each other pair of
blocks is one task's group; in it the same holds for tile pairs, and the rest
are compared with numpy's exclusive or and bit counts. A group returns a
spanning forest of its links, never all pairs, so that a large family of near
copies stays linear. Components of all forests are found by star operations in
Spark; only fingerprints with links are renamed by their component's least id.

Cost: the comparison is exact, so its work is quadratic in the *distinct*
fingerprints, less what the counts skip (of random pairs about nine tenths).
A block holds about SPREAD * sqrt(N) fingerprints, so blocks are
sqrt(N) / SPREAD and groups grow with the input.

Defined cases
- null or empty texts, and texts of white space: fingerprint zero, linked like any other.
- fewer than ``shingle`` words: the whole sequence is the one shingle.
- repeated rows and equal texts: same fingerprint, same component.
- null ids: the row is kept; ids that are null never name a component unless all of its ids are null.
- empty input: no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.components import components
from tideline.llm.textbytes import LOWER, single_spaced, slices, words
from tideline.session import bounded_batches, cut, fresh_name, join_hot, written

SEED = 42
#: A block holds SPREAD times the root of all fingerprints, and LEAST at least.
SPREAD, LEAST = 32, 2048
#: Rows and columns of a tile: its 128 Ki comparisons stay in the cache.
ROWS, COLS = 256, 512
#: Shingles hashed at once.
RUN = 1 << 18
#: Bits of a part; numbers of cells are base-17 numbers of the parts' counts.
PART = 16

_ONES = np.uint64(0x0101010101010101)


def fingerprints_of(data: np.ndarray, off: np.ndarray, shingle: int) -> np.ndarray:
    """The fingerprint of each row, as unsigned 64-bit integers."""
    starts, ends, first = words(data, off)
    text, ws, we = single_spaced(LOWER[data], starts, ends)
    n_words = np.diff(first)
    n_shingles = np.where(n_words >= shingle, n_words - shingle + 1, np.minimum(n_words, 1))
    base = np.concatenate([[0], np.cumsum(n_shingles)])
    raw, hash64 = text.tobytes(), xxhash.xxh64_intdigest
    h = np.empty(int(base[-1]), np.uint64)
    for lo in range(0, len(h), RUN):
        at = np.arange(lo, min(lo + RUN, len(h)))
        row = np.searchsorted(base, at, "right") - 1
        head = first[row] + (at - base[row])
        tail = np.minimum(head + shingle, first[row + 1]) - 1
        h[lo : lo + len(at)] = np.fromiter((hash64(raw[a:b], SEED) for a, b in zip(ws[head].tolist(), we[tail].tolist(), strict=True)), np.uint64, len(at))
    return majority(h, base)


def majority(h: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Bit by bit: set in over half of the hashes h[base[i]:base[i + 1]]?"""
    rows, n = len(base) - 1, np.diff(base)
    out = np.zeros(rows, np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    # runs of at most 255 hashes, whose bits eight byte lanes can count
    runs = -(-n[full] // 255)
    run_of = np.concatenate([[0], np.cumsum(runs)])
    at = np.repeat(base[full], runs) + 255 * (np.arange(run_of[-1]) - np.repeat(run_of[:-1], runs))
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & _ONES, at)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), run_of[:-1], axis=0)
        over = (2 * counts > n[full][:, None]).astype(np.uint8)
        out[full] |= np.ascontiguousarray(over).view(np.uint64).ravel() << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, _text_hash, _fp): the fingerprint as a signed long, a hash to tell apart rows of one id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprints_of(data, off, shingle) for _, _, data, off in slices(batch.column(2))]
            fp = np.concatenate(fps).view(np.int64) if fps else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], names=[id_col, "_text_hash", "_fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = bounded_batches(docs).select(F.col(id_col), F.xxhash64(text_col).alias("_text_hash"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, _text_hash long, _fp long")


def counts_of(fp: np.ndarray) -> np.ndarray:
    """Population counts of the four parts, a row for each fingerprint."""
    return np.stack([np.bitwise_count(fp >> np.uint64(shift) & np.uint64(0xFFFF)) for shift in (48, 32, 16, 0)], 1).astype(np.int16)


def apart(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> np.ndarray:
    """How far apart boxes of counts are at least, summed over the parts."""
    return np.maximum(np.maximum(lo_a - hi_b, lo_b - hi_a), 0).sum(-1)


def _tiles(fp: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The fingerprints in the order of their counts, and the boxes of tiles of that size."""
    c = counts_of(fp)
    order = np.lexsort((fp, *c.T[::-1]))
    fp, c, at = fp[order], c[order], np.arange(0, len(fp), size)
    return fp, np.minimum.reduceat(c, at), np.maximum.reduceat(c, at)


def links_in(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (a, b) of the links within left, or between left and right."""
    own = right is None
    if not len(left) or not own and not len(right):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    x, x_lo, x_hi = _tiles(left, ROWS)
    y, y_lo, y_hi = _tiles(left if own else right, COLS)
    shift = 0 if own else len(x)
    parent = np.arange(len(x) + (0 if own else len(y)))
    buf = np.empty((ROWS, COLS), np.uint64)
    far = np.empty((ROWS, COLS), np.uint8)
    for tile, i in enumerate(range(0, len(x), ROWS)):
        a = x[i : i + ROWS]
        meet = np.flatnonzero(apart(x_lo[tile], x_hi[tile], y_lo, y_hi) <= radius) * COLS
        for j in meet[meet + COLS > i].tolist() if own else meet.tolist():
            b = y[j : j + COLS]
            xor, bits = buf[: len(a), : len(b)], far[: len(a), : len(b)]
            np.bitwise_xor(a[:, None], b[None, :], out=xor)
            np.bitwise_count(xor, out=bits)
            near = bits <= radius
            if own and j < i + ROWS:
                near &= np.arange(j, j + len(b))[None, :] > np.arange(i, i + len(a))[:, None]
            if near.any():
                r, c = np.nonzero(near)
                _join(parent, r + i, c + j + shift)
    node = np.concatenate([x] if own else [x, y])
    root = _roots(parent)
    child = np.flatnonzero(root != np.arange(len(root)))
    return node[child], node[root[child]]


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent[:] = up


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of a[i] and b[i] for all i, by hooking roots to smaller ones."""
    while len(a):
        _roots(parent)
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        if not open_.any():
            return
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))


def blocks_of(cells: list[tuple[int, int]], most: int) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray]:
    """Cells of equal counts packed to blocks of about ``most`` fingerprints: (cell, first block, blocks), and the blocks' boxes.

    A cell that is larger than a block is spread over several by the fingerprints' hashes.
    """
    places, boxes, held = [], [], 0
    for cell, n in sorted(cells):
        c = [cell // 17**k % 17 for k in (3, 2, 1, 0)]
        parts = -(-n // most)
        if parts > 1 or not boxes or held + n > most:
            places.append((cell, len(boxes), parts))
            boxes += [(c, c)] * parts
            held = most if parts > 1 else n
        else:
            places.append((cell, len(boxes) - 1, 1))
            boxes[-1] = ([min(p, q) for p, q in zip(boxes[-1][0], c, strict=True)], [max(p, q) for p, q in zip(boxes[-1][1], c, strict=True)])
            held += n
    return places, np.array([b[0] for b in boxes], np.int16).reshape(-1, 4), np.array([b[1] for b in boxes], np.int16).reshape(-1, 4)


def near_links(fps: DataFrame, radius: int, least: int = LEAST) -> DataFrame:
    """(a, b): a spanning forest's edges over distinct fingerprints (column _fp) that differ in at most ``radius`` bits."""
    spark = fps.sparkSession
    part = lambda k: F.bit_count(F.shiftrightunsigned("_fp", 48 - PART * k).bitwiseAND(F.lit(0xFFFF)))
    fps = fps.select("_fp", (((part(0) * 17 + part(1)) * 17 + part(2)) * 17 + part(3)).cast("int").alias("_cell"))
    cells = [tuple(r) for r in fps.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()]  # at most 17 ** 4
    total = sum(n for _, n in cells)
    places, lo, hi = blocks_of(cells, max(least, int(SPREAD * total**0.5)))
    others = [[int(o) for o in np.flatnonzero(apart(lo[b], hi[b], lo, hi) <= radius)] for b in range(len(lo))]
    # for each block the groups that it goes to; sqrt(total) / SPREAD rows of as many numbers at most
    table = spark.createDataFrame([(b, o) for b, o in enumerate(others)], "_b int, _o array<int>")
    where = spark.createDataFrame(places, "_cell int, _first int, _parts int")
    dealt = fps.join(F.broadcast(where), "_cell").select("_fp", (F.col("_first") + F.pmod(F.xxhash64("_fp"), F.col("_parts"))).cast("int").alias("_b"))
    pairs = dealt.join(F.broadcast(table), "_b").select("_fp", "_b", F.explode("_o").alias("_o"))
    pairs = pairs.select("_fp", "_b", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"))

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        i, j = key
        fp, b = group["_fp"].to_numpy().view(np.uint64), group["_b"].to_numpy()
        a, z = links_in(fp, None, radius) if i == j else links_in(fp[b == i], fp[b == j], radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": z.view(np.int64)})

    # a task for a group, however few bytes it has: the work is quadratic in them
    groups = sum(o >= b for b, os in enumerate(others) for o in os)
    return pairs.repartition(max(1, groups), "_i", "_j").groupBy("_i", "_j").applyInPandas(compare, "a long, b long")


def _rooted(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int) -> DataFrame:
    """One row per input row: _id, _text_hash, _fp, _root (a fingerprint of its component) and _low (the least id there)."""
    prints = cut(fingerprints(docs, id_col, text_col, shingle).withColumnRenamed(id_col, "_id"))
    distinct = cut(prints.groupBy("_fp").agg(F.min("_id").alias("_low"), F.count(F.lit(1)).alias("_n")))
    # only fingerprints with links, few of all, are named anew
    roots = components(near_links(distinct.select("_fp"), radius)).withColumnRenamed("node", "_fp").join(distinct.select("_fp", "_low"), "_fp")
    roots = cut(roots)
    lows = roots.groupBy("root").agg(F.min("_low").alias("_least"), F.count(F.lit(1)).alias("_k"))
    named = join_hot(roots.drop("_low"), lows, "root", "_k")
    rooted = distinct.join(named, "_fp", "left").select("_fp", "_n", F.coalesce("root", "_fp").alias("_root"), F.when(F.col("root").isNull(), F.col("_low")).otherwise(F.col("_least")).alias("_low"))
    return join_hot(prints, cut(rooted), "_fp", "_n").select("_id", "_text_hash", "_fp", "_root", "_low")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row per input row: id, fingerprint, component_id."""
    return _rooted(docs, id_col, text_col, shingle, radius).select(
        F.col("_id").alias(id_col),
        F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        F.col("_low").alias("component_id"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """The rows of docs, less all but one of each component: that of the smallest id.

    Among rows with that id the one with the least fingerprint stays, then that with the least text hash; of equal rows one.
    Only keys are compared, and written first. The keys of the rows that go grow with the input, so they are
    never broadcast: texts move once, to meet them in hash tables, at every size alike.
    """
    rows = _rooted(docs, id_col, text_col, shingle, radius)
    names = [fresh_name(docs, "_row_key"), fresh_name(docs, "_row_hash")]
    key = [F.xxhash64("_id", "_text_hash").alias(names[0]), F.col("_text_hash").alias(names[1])]
    rows = rows.withColumn("_first", F.col("_id").eqNullSafe(F.col("_low")))
    rows = written(rows.groupBy("_id", "_text_hash", "_fp", "_root", "_first").agg(F.count(F.lit(1)).alias("_n")), "simhash-rows")
    firsts = rows.filter("_first").select(*rows.columns, F.struct("_fp", "_text_hash").alias("_order"))
    best = firsts.groupBy("_root").agg(F.min("_order").alias("_best"))
    firsts = firsts.join(best, "_root")
    gone = rows.filter("NOT _first").select(*key).unionByName(firsts.filter("_order != _best").select(*key))
    gone = written(gone, "simhash-gone")
    again = written(firsts.filter("_order = _best AND _n > 1").select(*key), "simhash-again")
    keyed = docs.withColumn(names[1], F.xxhash64(text_col)).withColumn(names[0], F.xxhash64(F.col(id_col), F.col(names[1])))
    left = keyed.join(gone.hint("shuffle_hash"), names, "left_anti")
    if not again.isEmpty():  # rows that stand there several times, as they are
        left = left.join(again, names, "left_anti").unionByName(left.join(again, names, "left_semi").dropDuplicates(names))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
