"""Importance resampling of documents towards a target, over hashed word n-grams.

A streaming CRC ring makes the features: one scan over a text's words keeps the
running zlib states of the n-grams that began at the last ``n`` words, extends each
by a space and the word, and emits every state as a bucket. An n-gram is never
built as bytes, and the states go over from one piece of a long text to the next.

Both corpora are counted by bucket, in each task first. The counts, one row for
each of ``buckets`` buckets, whatever the size of the input, give every bucket's gain,
the floor of 1000 times the logarithm of its smoothed ratio in the target and in the
documents. A second scan sums the gains of each document's features. Gumbel noise from
a hash of the id is added, so that the highest scores are a draw without replacement in
proportion to the weights.

The ranks of the draw are those of a range partitioning by score: a row's place in
its partition, and the sizes of the partitions before. Nothing is sorted in one task.

Defined cases
- words are runs of 0-9, a-z, A-Z in lower case, and all characters from U+0080 on.
- null and empty texts have no words: no features, weight 0. Null ids are hashed as an empty id and come last among ties.
- repeated rows are drawn one by one: equal ones take ranks that follow each other.
- an empty table gives no rows; an empty target leaves only the smoothing.
- other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.textbytes import SLICE_BYTES, slices
from tideline.session import bounded_batches, discard, scratch_path

WORDS, BUCKETS, LEAST_WORDS, PERCENT, SEED = 3, 10_000, 20, 5, 42

#: Bytes of words, A-Z in lower case; all others are spaces.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of those of about SLICE_BYTES each."""
    lo = 0
    while lo < len(text):
        hi = lo + SLICE_BYTES
        part = text[lo:hi].translate(_WORD_BYTES)
        while hi < len(text) and _WORD_BYTES[text[hi]] != 32:  # to the end of the word
            more = text[hi : hi + SLICE_BYTES].translate(_WORD_BYTES)
            end = more.find(b" ")
            part += more if end < 0 else more[:end]
            hi += len(more) if end < 0 else end
        yield part.split()
        lo = hi


def ring(text: bytes, n: int = WORDS) -> Iterator[list[int]]:
    """CRC-32 of every run of 1 to ``n`` consecutive words joined by spaces, as lists over pieces of the text."""
    states: list[int] = []
    for words in words_of(text):
        out: list[int] = []
        for word in words:
            more = b" " + word
            states = [crc32(more, s) for s in states[-(n - 1) :]] if n > 1 else []
            states.append(crc32(word))
            out += states
        yield out


def _buckets(text: bytes, n: int, buckets: int) -> Iterator[np.ndarray]:
    for states in ring(text, n):
        yield np.array(states, np.int64) % buckets


def bucket_counts(docs: DataFrame, text_col: str = "text", n: int = WORDS, buckets: int = BUCKETS) -> DataFrame:
    """bucket, count: how many features of all texts fall to each bucket; those with none have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(buckets, np.int64)
        for batch in batches:
            for lo, hi, data, off in slices(batch.column(0)):
                raw = data.tobytes()
                for i in range(hi - lo):
                    for found in _buckets(raw[off[i] : off[i + 1]], n, buckets):
                        count += np.bincount(found, minlength=buckets)
        there = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(count[there])], names=["bucket", "count"])

    counted = bounded_batches(docs).select(F.col(text_col).cast("string").alias("_text")).mapInArrow(run, "bucket int, count long")
    return counted.groupBy("bucket").agg(F.sum("count").alias("count"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_text: str = "text", n: int = WORDS, buckets: int = BUCKETS) -> list[int]:
    """Every bucket's gain. One row for each of ``buckets`` buckets comes to the driver, whatever the size of the input."""
    own, goal = [0] * buckets, [0] * buckets
    for rows, into in ((bucket_counts(docs, text_col, n, buckets), own), (bucket_counts(target, target_text, n, buckets), goal)):
        for r in rows.collect():
            into[r["bucket"]] = r["count"]
    all_own, all_goal = sum(own) + buckets, sum(goal) + buckets
    return [floor(1000 * log(((t + 1) * all_own) / ((s + 1) * all_goal))) for s, t in zip(own, goal, strict=True)]


def weigh(docs: DataFrame, gain: list[int], id_col: str = "doc_id", text_col: str = "text", n: int = WORDS) -> DataFrame:
    """The id, n_words, n_features and weight, the sum of the gains of a text's features."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worth = np.array(gain, np.int64)
        for whole in batches:
            for lo, hi, data, off in slices(whole.column(1)):
                raw, n_features, weight = data.tobytes(), [], []
                for i in range(hi - lo):
                    size = total = 0
                    for found in _buckets(raw[off[i] : off[i + 1]], n, buckets):
                        size += len(found)
                        total += int(worth[found].sum())
                    n_features.append(size)
                    weight.append(total)
                yield pa.RecordBatch.from_arrays([whole.column(0).slice(lo, hi - lo), pa.array(n_features, pa.int64()), pa.array(weight, pa.int64())], names=names)

    names = [id_col, "n_features", "weight"]
    kind = docs.schema[id_col].dataType.simpleString()
    return bounded_batches(docs).select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, n_features long, weight long")


def features_of(words: int, n: int = WORDS) -> int:
    """The number of runs of 1 to n words of so many words."""
    return sum(max(0, words - k) for k in range(n))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", n: int = WORDS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """id, n_features, weight, score and rank of every document; rank is null for those not drawn.

    Of those with ``least_words`` words at least, ``percent`` in a hundred are drawn.
    """
    spark = docs.sparkSession
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    gain = gains(docs, target, text_col, target_text, n, buckets)
    unsorted = scratch_path(spark, "weights")  # numbers alone, so that the sampling of ranges reads no text
    weigh(docs, gain, id_col, text_col, n).withColumn("score", F.col("weight") + noise).write.parquet(unsorted)
    weighed = spark.read.parquet(unsorted)

    # ranges by score, whose rows are numbered in order; written, so that the numbers and their sums are of one sorting
    fits = F.col("n_features") >= features_of(least_words, n)
    ordered = weighed.withColumn("_fits", fits).repartitionByRange(F.col("_fits").desc(), F.col("score").desc(), F.col(id_col).asc_nulls_last(), F.col("n_features"))
    ordered = ordered.sortWithinPartitions(F.col("_fits").desc(), F.col("score").desc(), F.col(id_col).asc_nulls_last(), F.col("n_features"))
    path = scratch_path(spark, "scores")
    ordered.withColumn("_place", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    discard(spark, unsorted)
    part = F.shiftright("_place", 33)
    sizes = sorted((r["p"], r["n"]) for r in rows.filter("_fits").groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # one row a partition
    first, before = [], 0
    for p, size in sizes:
        first.append((p, before))
        before += size
    drawn = percent * before // 100
    starts = F.broadcast(spark.createDataFrame(first, "_part long, _first long"))
    place = F.col("_first") + F.col("_place").bitwiseAND((1 << 33) - 1) + 1
    return rows.join(starts, part == F.col("_part"), "left").select(
        id_col, "n_features", "weight", "score", F.when(F.col("_fits") & (place <= drawn), place).alias("rank")
    )


def oracle_sql(n: int = WORDS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> str:
    """The same over `documents` and `benchmark` in DuckDB, whose CRC-32 of each distinct run goes on from that of the run without its last word."""
    table = list(range(256))
    for _ in range(8):
        table = [c >> 1 ^ 0xEDB88320 if c & 1 else c >> 1 for c in table]
    octets = "list_transform(regexp_extract_all(hex(encode(' ' || x1)), '..'), lambda h: ('0x' || h)::INT::UBIGINT)"
    fold = f"list_reduce(list_prepend({{}}, {{}}), lambda c, h: xor(list_extract({table}::UBIGINT[], ((xor(c, h) & 255) + 1)::BIGINT), c >> 8))"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    names = [f"x{k}" for k in range(1, n + 1)]
    states = [f"s1 AS MATERIALIZED (SELECT x1, {fold.format('4294967295::UBIGINT', 'o[2:]')} AS s FROM v)"]
    for k in range(2, n + 1):
        some, all_ = ", ".join(names[: k - 1]), ", ".join(names[:k])
        states.append(f"s{k} AS MATERIALIZED (SELECT q.*, {fold.format('s', 'o')} AS s FROM (SELECT DISTINCT {all_} FROM q WHERE x{k} IS NOT NULL) q JOIN s{k - 1} USING ({some}) JOIN (SELECT x1 AS x{k}, o FROM v) USING (x{k}))")
    features = " UNION ALL ".join(f"SELECT r, goal, s FROM q JOIN s{k} USING ({', '.join(names[:k])})" for k in range(1, n + 1))
    return f"""
WITH a AS (SELECT row_number() OVER () AS r, 0 AS goal, doc_id, text FROM documents UNION ALL SELECT row_number() OVER (), 1, NULL, text FROM benchmark),
w AS MATERIALIZED (SELECT r, goal, doc_id, regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM a),
q AS MATERIALIZED (SELECT r, goal, {', '.join(f'z[{k}] AS x{k}' for k in range(1, n + 1))} FROM (SELECT r, goal, unnest(list_zip({', '.join(f'w[{k}:]' for k in range(1, n + 1))})) AS z FROM w)),
v AS MATERIALIZED (SELECT x1, {octets} AS o FROM (SELECT DISTINCT x1 FROM q)),
{", ".join(states)},
c AS MATERIALIZED (SELECT r, goal, (xor(s, 4294967295) % {buckets})::INT AS b, count(*) AS n FROM ({features}) GROUP BY ALL),
counts AS (SELECT b, coalesce(sum(n) FILTER (goal = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (goal = 1), 0)::DOUBLE AS t FROM c GROUP BY b),
gains AS (SELECT b, floor(1000 * ln((t + 1) * (sum(s) OVER () + {buckets}) / ((s + 1) * (sum(t) OVER () + {buckets}))))::BIGINT AS gain FROM counts),
m AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM c JOIN gains USING (b) WHERE goal = 0 GROUP BY r),
d AS (SELECT w.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) >= {least_words} AS fits,
  floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || coalesce(w.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise
  FROM w LEFT JOIN m USING (r) WHERE goal = 0),
o AS (SELECT doc_id, n_features, weight, weight + noise AS score, fits, row_number() OVER (PARTITION BY fits ORDER BY weight + noise DESC, doc_id NULLS LAST, n_features) AS place, count(*) FILTER (fits) OVER () AS total FROM d)
SELECT doc_id, n_features, weight, score, CASE WHEN fits AND place <= {percent} * total // 100 THEN place END AS rank FROM o
"""
