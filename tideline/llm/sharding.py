"""Contiguous shards of nearly equal bytes, by global prefix sums.

Rows are put in one global order, by the texts' MD5 and the ids, by range partitioning. Each partition gives
one total; the totals' running sums give every partition its base, and a
running sum inside the partition gives every row its global byte offset. The
byte range is cut at equal targets.

Defined cases
- null or empty text: size 1 (no bytes plus 1), crc32 of the empty string.
- null ids sort first; repeated rows are all kept, each with its own slot.
- equal texts are neighbours in the order. A cut that falls inside such a
  group moves to the group's nearer end if that is within ``slack`` of a
  shard's target; beyond it the group is cut, as balance is the law here.
- empty input: no rows. More shards than rows: some shards stay empty.
- other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.session import cut

SHARDS = 8
SLACK = 0.005


def byte_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, slack: float = SLACK, partitions: int | None = None) -> DataFrame:
    """Columns: the id, size, text_crc32, law, shard, slot, grown_shard.

    The driver receives one total per partition (``partitions`` rows, the
    session's shuffle partitions by default) and the groups at the
    ``shards - 1`` cuts; nothing else.
    """
    spark = docs.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("_size"),
        F.crc32(text.cast("binary")).alias("_crc"),
        F.md5(text.cast("binary")).alias("_hash"),
    )
    order = ["_hash", "_id"]
    placed = cut(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))

    totals = {r["_part"]: (r["n"], r["b"]) for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("b")).collect()}
    bases, n, b = [], 0, 0
    for part in range(max(totals, default=-1) + 1):
        bases.append((part, n, b))
        n, b = n + totals.get(part, (0, 0))[0], b + totals.get(part, (0, 0))[1]
    base = spark.createDataFrame(bases or [(0, 0, 0)], "_part int, _rows long, _bytes long")

    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = (
        placed.join(F.broadcast(base), "_part")
        .withColumn("_at", F.col("_rows") + F.count(F.lit(1)).over(inside) - 1)
        .withColumn("_from", F.col("_bytes") + F.sum("_size").over(inside) - F.col("_size"))
    )
    numbered = cut(numbered.select("_id", "_size", "_crc", "_hash", "_at", "_from"))

    cuts = _snapped(numbered, b, shards, slack)
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.col("_from") >= F.lit(c)).cast("int")
    sharded = numbered.withColumn("_shard", shard)
    first = sharded.groupBy("_shard").agg(F.min("_at").alias("_first"))  # at most one row per shard
    return sharded.join(F.broadcast(first), "_shard").select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"),
        (F.col("_at") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _snapped(numbered: DataFrame, total: int, shards: int, slack: float) -> list[int]:
    """The byte offsets at which shards 1, 2, ... begin: a row goes where it starts."""
    if not total:
        return []
    targets = [-(-total * k // shards) for k in range(1, shards)]
    end = F.col("_from") + F.col("_size")
    at_cut = F.lit(False)
    for t in targets:
        at_cut = at_cut | ((F.col("_from") < t) & (end > t))
    keys = numbered.filter(at_cut).select("_hash").distinct()  # at most one group per cut
    groups = numbered.join(F.broadcast(keys), "_hash").groupBy("_hash").agg(F.min("_from").alias("a"), F.max(end).alias("z")).collect()
    room = int(total / shards * slack)
    cuts = []
    for t in targets:
        near = [e for g in groups if g["a"] < t < g["z"] for e in (g["a"], g["z"]) if abs(e - t) <= room]
        cuts.append(min(near, key=lambda e: abs(e - t), default=t))
    return cuts


def _crc_table() -> list[int]:
    """The table of CRC-32 by bytes, from its polynomial."""
    out = list(range(256))
    for _ in range(8):
        out = [c >> 1 ^ 0xEDB88320 if c & 1 else c >> 1 for c in out]
    return out


def oracle_sql(shards: int = SHARDS, slack: float = SLACK) -> str:
    """The same over `documents` in DuckDB, which has no CRC-32: it is folded over the bytes."""
    octets = "list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::INT::UBIGINT)"
    fold = f"list_reduce(list_prepend(4294967295::UBIGINT, {octets}), lambda c, x: xor(list_extract({_crc_table()}::UBIGINT[], ((xor(c, x) & 255) + 1)::BIGINT), c >> 8))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
o AS (SELECT doc_id, md5(t) AS h, strlen(t) + 1 AS size, xor({fold}, 4294967295)::BIGINT AS crc FROM d),
n AS (SELECT *, row_number() OVER w - 1 AS place, (sum(size) OVER w)::BIGINT - size AS start FROM o WINDOW w AS (ORDER BY h, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)),
total AS (SELECT sum(size)::BIGINT AS b FROM n),
targets AS (SELECT (b * k + {shards - 1}) // {shards} AS t, b FROM total, (SELECT unnest(range(1, {shards})) AS k)),
same AS (SELECT h, min(start) AS a, max(start + size) AS z FROM n GROUP BY h),
ends AS (SELECT t, unnest([a, z]) AS e, b FROM targets JOIN same ON a < t AND t < z),
cuts AS (SELECT t, coalesce(arg_min(e, abs(e - t) * 2 + (e > t)::INT) FILTER (abs(e - t) <= floor(b / {shards} * {slack})), t) AS cut FROM targets LEFT JOIN ends USING (t, b) GROUP BY t),
s AS (SELECT n.*, (SELECT count(*) FROM cuts WHERE cut <= start) AS shard FROM n)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard::INT AS shard, place - min(place) OVER (PARTITION BY shard) AS slot, NULL::INT AS grown_shard FROM s
"""
