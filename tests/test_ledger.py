import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import ledger

NOW = dt.datetime(2026, 1, 1, 12)
SCHEMA = "source string, key int, at timestamp, status string"


def ago(seconds):
    return NOW - dt.timedelta(seconds=seconds)


@pytest.fixture
def table(spark):
    return lambda rows: spark.createDataFrame(rows, SCHEMA)


def test_rolling_counts(table):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), i, ago(rng.randrange(0, 400) / 2), "ok") for i in range(300)]
    got = {(r["source"], r["key"]): r["n"] for r in ledger.rolling(table(rows), 60, "n").collect()}
    assert got == {(s, k): sum(1 for s2, _, at2, _ in rows if s2 == s and dt.timedelta(0) <= at - at2 <= dt.timedelta(seconds=60)) for s, k, at, _ in rows}


def test_standing(table):
    limits = ledger.Limits(13, 65, 3)
    rows = [("s", 1, ago(500), "error"), ("s", 1, ago(400), "ok"), ("s", 2, ago(300), "limited"), ("s", 2, ago(200), "limited"), ("s", 3, ago(9), "error"), ("s", 5, ago(1), "denied"), ("s", 6, ago(90), "ok"), ("s", 6, ago(80), "limited")]
    rows += [("s", 4, ago(100 * k), "error") for k in range(1, 5)]
    got = {r["key"]: (r["status"], r["tries"], r["due"]) for r in ledger.standing(table(rows), limits).collect()}
    assert got == {1: ("ok", 0, None), 2: ("limited", 2, ago(200 - 130)), 3: ("error", 1, ago(9 - 13)), 4: ("error", 4, None), 5: ("denied", 1, None), 6: ("limited", 1, ago(80 - 65))}


def test_allowance(table):
    rows = [("a", k, ago(10 * k), "ok") for k in range(1, 8)] + [("b", 1, ago(7200), "ok"), ("c", 1, ago(5), "ok")]
    got = {r["source"]: (r["left"], r["next_at"]) for r in ledger.allowance(table(rows), ledger.DOCKETS, NOW).collect()}
    # the fifth last of a was 50 seconds ago
    assert got == {"a": (0, ago(-10)), "b": (5, NOW), "c": (4, ago(-8))}
    assert ledger.allowance(table(rows), ledger.TERMS, NOW).filter("source = 'a'").count() == 0  # nothing in the last second


def test_ask_next(spark, table):
    rows = [("a", 1, ago(50), "ok"), ("a", 2, ago(40), "limited"), ("a", 3, ago(20), "error"), ("a", 4, ago(8000), "limited"), ("b", 1, ago(100), "ok"), ("b", 2, ago(50), "denied"), ("c", 9, ago(90000), "ok")]
    wanted = spark.createDataFrame([(s, k, -k) for s in "abc" for k in range(1, 9)], "source string, key int, rank int")
    got = [(r["source"], r["key"]) for r in ledger.ask_next(wanted, table(rows), ledger.DOCKETS, NOW, [F.col("rank")]).collect()]
    assert [k for s, k in got if s == "a"] == [8, 7]  # three of five in the last minute are spent
    assert not [k for s, k in got if s == "b"] and [k for s, k in got if s == "c"] == [8, 7, 6, 5, 4]
    free = [(r["source"], r["key"]) for r in ledger.ask_next(wanted, table(rows), ledger.TERMS, NOW, [F.col("rank")]).collect()]
    assert [k for s, k in free if s == "a"] == [8, 7, 6, 5, 4, 3, 2]


def test_rolling_counts_at_the_edges_by_running_counts_alone(table):
    # the same moment, just as long ago as the window, a microsecond more, and before 1970
    at = [NOW, NOW, ago(60), ago(60), ago(60) - dt.timedelta(microseconds=1), ago(120), dt.datetime(1969, 12, 31, 23, 59, 30), dt.datetime(1970, 1, 1, 0, 0, 20)]
    got = ledger.rolling(table([("a", k, t, "ok") for k, t in enumerate(at)]), 60, "n")
    assert {r["key"]: r["n"] for r in got.collect()} == {0: 4, 1: 4, 2: 4, 3: 4, 4: 2, 5: 1, 6: 1, 7: 2}
    assert "RangeFrame, -" not in got._jdf.queryExecution().toString()  # a frame that slides is gone through for every row
