import gzip
import random
from collections import defaultdict

import pytest

from tideline.llm import warc
from tideline.session import scratch_path

ROWS = [
    (1, "http://a.b/x", "é<p>"),
    (2, "http://a.b/x", "same"),
    (3, "https://c.d", "same"),
    (5, None, "same"),
    (None, "http://q.r/1", "same"),
    (7, "noscheme", None),
    (8, "http://A.b/x\r\ny", "x\r\n\r\nWARC/1.1\r\n"),
    (8, "http://A.b/x\r\ny", "x\r\n\r\nWARC/1.1\r\n"),
    (9, "", ""),
    (10, "http://a.b/x", None),
]


def want(rows, least=0):
    groups = defaultdict(list)
    for p, _, h in rows:
        groups[h or ""].append(p)
    out = []
    for p, _, h in rows:
        body = (h or "").encode()
        top = max((x for x in groups[h or ""] if x is not None), default=None)
        again = len(body) >= least and top is not None and p != top
        out.append((str(p), len(body), warc.digest(body), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


def found(df):
    return sorted(((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("least", [0, 1, 5])
def test_round_trip(spark, least):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, key string")
    assert found(warc.round_trip(df, least=least)) == want(ROWS, least)


def test_payloads_come_back(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    got = sorted((str(r["page_id"]), bytes(r["payload"])) for r in warc.round_trip(df, payload=True).collect())
    assert got == sorted((str(p), (h or "").encode()) for p, _, h in ROWS)


def test_a_revisit_without_its_response_is_noticed(spark):
    rows = [(1, "response", 3, "AAA", None, b"abc"), (2, "revisit", 3, "BBB", 1, b"")]
    df = spark.createDataFrame(rows, "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")
    with pytest.raises(Exception, match="no response for the revisit of page 2"):
        warc.resolved(df).collect()


def test_archives_ranges_and_payloads_beyond_their_sizes(spark):
    rng = random.Random(5)
    rows = [(i, f"http://h{i % 7}.org/{i}", "".join(chr(rng.randrange(33, 1000)) for _ in range(rng.randrange(4000)))) for i in range(120)] + [(500, "http://big.org/", "x y " * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    folder = scratch_path(spark, "warc")
    manifest = warc.write(df, folder, archive_bytes=20_000)
    assert manifest.select("file").distinct().count() > 5
    got = {r["page_id"]: bytes(r["payload"]) for r in warc.read(manifest, folder, read_bytes=5_000).collect()}
    assert got == {p: h.encode() for p, _, h in rows}


def test_copies_that_are_a_third_of_all(spark):
    df = spark.range(3000).selectExpr("id AS page_id", "concat('http://a.b/', id) AS url", "CASE WHEN id % 3 > 0 THEN concat('own ', id) END AS html")
    got = warc.round_trip(df).toPandas().set_index("page_id")
    assert (got.loc[range(0, 2997, 3), "refers_to"] == 2997).all() and (got["record_type"] == "revisit").sum() == 999


def test_many_ranges_blocks_and_equal_keys(spark):
    rng = random.Random(3)
    rows = [(i % 700, f"http://h{rng.randrange(3)}.example.org/{'same' if i % 3 else i}", f"page {rng.randrange(400)}" * rng.randrange(3)) for i in range(900)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = scratch_path(spark, "warc")
    manifest = warc.write(df, f"{folder}/a")
    directory = warc.build_index(manifest, f"{folder}/i", block=16, per_range=100)
    assert directory.count() > 20 and directory.agg({"captures": "sum"}).first()[0] == 900
    captures = df.select(warc.url_key(df["url"]).alias("key"), "page_id")
    places = warc.look_up(captures, directory, f"{folder}/i")
    assert sorted(map(tuple, places.select("file", "offset").collect())) == sorted(map(tuple, manifest.select("file", "offset").collect()))
    assert warc.look_up(spark.createDataFrame([("org,example,h0)/none", 5)], "key string, page_id long"), directory, f"{folder}/i").count() == 0
    some = captures.filter("page_id < 40")
    assert warc.look_up(some, directory, f"{folder}/i").count() == some.count()
    assert found(warc.read(places, f"{folder}/a")) == want(rows)


def test_archives_are_plain_gzip_members(spark):
    from pyarrow import fs

    folder = scratch_path(spark, "warc")
    manifest = warc.write(spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1), folder)
    ((name,),) = manifest.select("file").distinct().collect()
    f, root = fs.FileSystem.from_uri(folder)
    with f.open_input_file(f"{root}/{name}") as s:
        text = gzip.decompress(s.read())
    assert text.count(b"WARC-Type: ") == len(ROWS)


def test_a_damaged_record_is_noticed():
    raw = warc.record(1, "http://a.b", b"abc")
    assert warc.parsed(raw)[1].endswith(b"abc")
    with pytest.raises(ValueError):
        warc.parsed(raw[:-5])


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(df).count() == 0
