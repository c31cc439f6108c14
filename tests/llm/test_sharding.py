import hashlib
import zlib

from tideline.llm import sharding


def test_shards(spark):
    rows = [(i, "x" * (i * 37 % 400), "c") for i in range(400)] + [(i, "same text " * 3, "c") for i in range(1000, 1200)] + [(7, None, "c"), (None, "", "c"), (7, None, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _part string")
    got = sharding.byte_shards(df, shards=8).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    for s in range(8):
        mine = [r for r in got if r["shard"] == s]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        assert abs(sum(r["size"] for r in mine) - total / 8) <= largest + 2 * sharding.SLACK * total / 8 + 1
    assert {r["law"] for r in got} == {"bytes"} and all(r["grown_shard"] is None for r in got)


def test_equal_texts_stay_together_where_balance_allows(spark):
    rows = [(i, f"text {i // 4} " * 4) for i in range(4000)]
    got = sharding.byte_shards(spark.createDataFrame(rows, "doc_id long, text string"), shards=8, slack=0.02).collect()
    where = {}
    for r in got:
        where.setdefault(r["doc_id"] // 4, set()).add(r["shard"])
    assert all(len(s) == 1 for s in where.values())


def test_order_is_the_same_for_other_partitions(spark):
    rows = [(i, f"t{i % 50}" * (i % 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (sorted(map(tuple, sharding.byte_shards(df.repartition(n), partitions=p).collect())) for n, p in ((2, 3), (5, 7)))
    assert a == b


def test_few_rows_and_none(spark):
    assert sharding.byte_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = sharding.byte_shards(spark.createDataFrame([(1, "a")], "doc_id long, text string")).collect()
    assert [(r["shard"], r["slot"]) for r in got] == [(0, 0)]


def brute(rows, shards, slack):
    """(id, crc, shard, slot) of every row, by a loop over the sorted rows."""
    raw = sorted(((t or "").encode(), i) for i, t in rows)
    raw.sort(key=lambda r: (hashlib.md5(r[0]).hexdigest(), r[1]))
    starts, at = [], 0
    for t, _ in raw:
        starts.append(at)
        at += len(t) + 1
    cuts = []
    for k in range(1, shards):
        t = -(-at * k // shards)
        over = [j for j, s in enumerate(starts) if s < t < s + len(raw[j][0]) + 1]
        same = [j for j in range(len(raw)) if raw[j][0] == raw[max(j for j, s in enumerate(starts) if s < t)][0]]
        a, z = starts[same[0]], starts[same[-1]] + len(raw[same[-1]][0]) + 1
        ends = [e for e in (a, z) if a < t < z and abs(e - t) <= int(at / shards * slack)]
        cuts.append(min(ends, key=lambda e: abs(e - t)) if ends and (over or len(same) > 1) else t)
    out, first = [], {}
    for j, (t, i) in enumerate(raw):
        s = sum(starts[j] >= c for c in cuts)
        out.append((i, zlib.crc32(t), s, j - first.setdefault(s, j)))
    return sorted(out)


def test_every_row_against_brute_force(spark):
    rows = [(i, "x" * (i * 37 % 400)) for i in range(300)] + [(i, f"same text {i % 3} " * 9) for i in range(1000, 1300)] + [(5000, "long " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for shards, slack in ((8, sharding.SLACK), (5, 0.3), (3, 0.0)):
        got = sharding.byte_shards(df, shards=shards, slack=slack).collect()
        assert sorted((r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in got) == brute(rows, shards, slack)


def test_sql_gives_the_same(spark):
    import duckdb

    from tideline.llm.queries import ORACLE_SQL, op5_sharding

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    cols = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE_SQL['op5_sharding']})").fetchall()
    assert sorted(map(tuple, op5_sharding(spark, "/root/testdata/sf0.001").select(*cols).collect())) == sorted(want)
