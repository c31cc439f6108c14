"""Queries against their SQL over the smallest tables: those over texts of the sources' formats, runs of sources, and some that lists share."""

import datetime as dt
from pathlib import Path

import duckdb
import pytest

from tideline.plans import ingest_queries, queries, source_queries

SF = Path("/root/testdata/sf0.001")
OWN = [n for n, f in queries.QUERIES.items() if f.__module__ in (source_queries.__name__, ingest_queries.__name__)]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in SF.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value


@pytest.mark.parametrize("name", [*OWN, "horizon_counts", "portfolio_tiles", "controlling_item", "proximity_grouping", "growing_cases", "token_containment_join", "merged_cases", "entry_precedence", "reference_two_step", "conditional_narrowing", "nested_detail", "html_strip", "patent_lookup", "term_enrichment", "term_responses", "autocomplete_trigram", "list_filtered"])
def test_rows_are_those_of_the_sql(spark, con, name):
    df = queries.QUERIES[name](spark, str(SF))
    cols = sorted(df.columns)
    got = con.execute(queries.ORACLE_SQL[name])
    at = [[c[0] for c in got.description].index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str) == want


def test_every_query_of_the_plans_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)


def test_docket_candidates_leave_no_product_of_a_party_out(spark, con):
    sides = " UNION ".join(f"SELECT event_id, p_partkey FROM events JOIN part ON p_partkey % (SELECT count(*) FROM supplier) = {side}" for side in ("user_id % 150", "event_id % 90"))
    got = sorted((r["docket_id"], r["product_id"]) for r in queries.QUERIES["docket_candidates"](spark, str(SF)).collect())
    assert got == sorted(con.execute(sides).fetchall())


def test_strengths_of_two_figures_narrow_the_products_of_a_brand(spark, tmp_path):
    t = duckdb.connect()
    t.execute("CREATE TABLE part AS SELECT k::BIGINT AS p_partkey, 'x' AS p_name, s::INT AS p_size FROM (VALUES (2, 15), (202, 5), (402, 15), (1, 17), (201, 7), (401, 17), (3, 11), (203, 1)) v(k, s)")
    t.execute("CREATE TABLE customer AS SELECT p_partkey AS c_custkey FROM part WHERE p_partkey NOT IN (201, 402)")
    for name in ("part", "customer"):
        t.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    got = sorted((r["case_id"], r["product_id"]) for r in queries.QUERIES["named_products"](spark, str(tmp_path)).collect() if r["case_id"] != 3)
    # 2 and 202 state their own strength, 1 and 401 another product's, and 203 none
    assert got == [(1, 201), (2, 2), (2, 402), (202, 202), (203, 3), (203, 203), (401, 201)]
    assert sorted(t.execute(f"SELECT case_id, product_id FROM ({queries.ORACLE_SQL['named_products']}) WHERE case_id <> 3").fetchall()) == got


def same_as_sql(spark, folder, name, **tables):
    """The query's rows over tables of one's own, after they were found to be those of its SQL."""
    t = duckdb.connect()
    for table, sql in tables.items():
        t.execute(f"CREATE TABLE {table} AS {sql}")
        t.execute(f"COPY {table} TO '{folder}/{table}.parquet' (FORMAT parquet)")
    df = queries.QUERIES[name](spark, str(folder))
    got = sorted((tuple(plain(v) for v in r) for r in df.collect()), key=str)
    assert got == sorted((tuple(plain(v) for v in r) for r in t.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()), key=str)
    return got


LINES = "SELECT k::BIGINT AS l_orderkey, 3::BIGINT AS l_partkey, 1::BIGINT AS l_suppkey, 1::INT AS l_linenumber, 1.0::DOUBLE AS l_quantity, price::DOUBLE AS l_extendedprice, 'N' AS l_returnflag, 'O' AS l_linestatus, day::TIMESTAMP AS l_shipdate FROM (VALUES {}) v(k, price, day)"


def test_first_lines_of_patents_are_told_apart_by_a_price_alone(spark, tmp_path):
    values = ", ".join(f"({k}, {price}, '{day}')" for k in (149_999, 900_000) for price, day in ((100, "2001-05-06"), (30_000, "2001-04-05")))
    got = same_as_sql(spark, tmp_path, "tilde_patents", lineitem=LINES.format(values))
    assert len(got) == 2


def test_orders_of_seven_figures_keep_their_patents_apart(spark, tmp_path):
    values = ", ".join(f"({k}, 100, '2001-05-0{k % 10}')" for k in (1_234_567, 1_234_568, 54_000_009))
    got = same_as_sql(spark, tmp_path, "tilde_patents", lineitem=LINES.format(values))
    assert [r[0] for r in got] == ["NDA123456", "NDA123456", "NDA540000"]


@pytest.mark.parametrize("name", ["monthly_products", "monthly_exclusivities"])
def test_the_second_section_follows_the_first_whatever_the_keys(spark, tmp_path, name):
    part = "SELECT k::BIGINT AS p_partkey, 'name ' || k AS p_name, 'Brand#' || k % 9 AS p_brand, 'LARGE' AS p_type, 5::INT AS p_size FROM (VALUES (8), (999988), (999992), (1000004), (1200000), (7000000000000)) v(k)"
    assert len(same_as_sql(spark, tmp_path, name, part=part)) >= 6
