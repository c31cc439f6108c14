"""Two runs of one source with changed input, over texts made of the test tables; what the tables hold then, in SQL too."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.text import without_quotes
from tideline.operators import ingest, runs
from tideline.operators.commits import Store
from tideline.plans import binding as b
from tideline.plans.queries import query
from tideline.plans.source_queries import _HEAD
from tideline.session import scratch_path

FIRST, SECOND = dt.datetime(2026, 1, 1, 12), dt.datetime(2026, 2, 1, 12)


def _with_head(rows: DataFrame, fields: int) -> DataFrame:
    head = rows.sparkSession.createDataFrame([(1, "~".join(["h"] * fields))], "line long, raw string")
    return head.unionByName(rows.select(F.col("line").cast("long").alias("line"), "raw"))


_APPLICATION = "CASE WHEN {k} % 5 = 0 THEN 'X' WHEN {k} % 5 = 1 THEN 'A' ELSE 'N' END, lpad(CAST({k} AS string), 6, '0'), '001'"


def _release(spark: SparkSession, d: str, n: int) -> dict[str, DataFrame]:
    """The three files of the n-th release: each has three quarters of the parts; every sixth part stands twice."""
    part = b.table(spark, d, "part").filter(f"p_partkey % 4 <> {3 if n == 1 else 0}")
    twice = part.withColumn("again", F.explode(F.when(F.col("p_partkey") % 6 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    product = f"""concat_ws('~', CASE WHEN p_partkey % 3 = 0 THEN 'ADALIMUMAB' ELSE 'CALCIUM' END, 'TABLET; ORAL', concat(p_name, CASE WHEN again = 1 THEN ' again' ELSE '' END), 'x', concat(p_size, '{"MG" if n == 1 else "G"}'),
      {_APPLICATION.format(k="p_partkey")}, 'x', 'Jan 5, 2001', 'x', 'x', 'x', concat(p_brand, ' ', p_partkey % 7 + {0 if n == 1 else 3}))"""
    products = twice.select((F.col("p_partkey") + 10 + F.col("again") * 10_000_000).alias("line"), F.expr(product).alias("raw"))
    days = b.table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.to_date(F.min("l_shipdate")).alias("a"), F.to_date(F.max("l_shipdate")).alias("z"))
    both = days.withColumn("e", F.explode(F.when(F.col("l_suppkey") % 2 == 0, F.array(F.struct(F.lit("").alias("mark"), F.col("a").alias("day")), F.struct(F.lit("*PED").alias("mark"), F.col("z").alias("day")))).otherwise(F.array(F.struct(F.lit("").alias("mark"), F.col("a").alias("day"))))))
    patent = f"concat_ws('~', {_APPLICATION.format(k='l_partkey')}, concat(l_suppkey, e.mark), date_format(date_add(e.day, {n - 1}), 'MMM d, yyyy'), 'Y', '', '', 'x', '')"
    patents = both.select((F.col("l_partkey") * 100_000 + F.col("l_suppkey") * 2 + F.length("e.mark") + 10).alias("line"), F.expr(patent).alias("raw"))
    orders = b.table(spark, d, "orders").filter(f"o_orderkey % 4 <> {n}")
    code = f"concat_ws('~', {_APPLICATION.format(k='o_custkey')}, o_orderpriority, date_format(trunc(o_orderdate, 'MM'), 'MMM d, yyyy'))"
    exclusivities = orders.select((F.col("o_orderkey") + 10).alias("line"), F.expr(code).alias("raw"))
    return {"products": _with_head(products, 14), "patents": _with_head(patents, 10), "exclusivities": _with_head(exclusivities, 5)}


def _enriched(store: Store) -> None:
    """Terms of a second source, between the two releases: patents whose number is divisible by three."""
    base = store.last()
    theirs = F.col("patent_number").cast("int") % 3 == 0
    rows = store.read("patents_a", ingest.SCHEMAS["patents_a"], base).withColumns({"filing_date": F.when(theirs, F.lit(dt.date(1980, 1, 1))), "expiry": F.when(theirs, F.lit(dt.date(2050, 1, 1))).otherwise(F.col("expiry"))})
    store.commit(base, {"patents_a": store.stage("patents_a", rows)}, note="terms", now=FIRST)


_STORES: dict[tuple[str, str], Store] = {}


def _two_runs(spark: SparkSession, d: str) -> Store:
    """The tables after both runs; the queries of a session share them."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STORES:
        store = Store(spark, scratch_path(spark, "ingested"))
        runs.run(store, "tilde", ingest.tilde_load(_release(spark, d, 1)), FIRST)
        _enriched(store)
        runs.run(store, "tilde", ingest.tilde_load(_release(spark, d, 2)), SECOND)
        _STORES[key] = store
    return _STORES[key]


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return _two_runs(spark, d).read(name, ingest.SCHEMAS[name])


def _release_sql(n: int) -> str:
    return f"""
p{n} AS (SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 1 THEN 'ANDA' ELSE 'NDA' END || lpad(p_partkey::VARCHAR, 6, '0') AS app, p_name AS name, p_size || '{"MG" if n == 1 else "G"}' AS strength, p_brand || ' ' || (p_partkey % 7 + {0 if n == 1 else 3}) AS company FROM part WHERE p_partkey % 4 <> {3 if n == 1 else 0} AND p_partkey % 5 <> 0),
t{n} AS (SELECT CASE l_partkey % 5 WHEN 1 THEN 'ANDA' ELSE 'NDA' END || lpad(l_partkey::VARCHAR, 6, '0') AS app, l_partkey % 5 = 0 AS odd, l_suppkey::VARCHAR AS number, min(l_shipdate)::DATE + {n - 1} AS a, CASE WHEN l_suppkey % 2 = 0 THEN max(l_shipdate)::DATE + {n - 1} END AS z FROM lineitem GROUP BY l_partkey, l_suppkey),
x{n} AS (SELECT CASE o_custkey % 5 WHEN 1 THEN 'ANDA' ELSE 'NDA' END || lpad(o_custkey::VARCHAR, 6, '0') AS app, o_custkey % 5 = 0 AS odd, o_orderpriority AS code, date_trunc('month', o_orderdate)::DATE AS expiry FROM orders WHERE o_orderkey % 4 <> {n})"""


#: Common table expressions: releases (p, t, x with the number of the run), companies, ids.
SQL = f"""WITH {_release_sql(1)}, {_release_sql(2)},
c1 AS (SELECT company AS name, row_number() OVER (ORDER BY company) AS company_id FROM (SELECT DISTINCT company FROM p1)),
companies AS (SELECT * FROM c1 UNION ALL SELECT company, (SELECT count(*) FROM c1) + row_number() OVER (ORDER BY company) FROM (SELECT DISTINCT company FROM p2 WHERE company NOT IN (SELECT name FROM c1))),
i1 AS (SELECT app, row_number() OVER (ORDER BY app) AS product_id FROM p1),
ids AS (SELECT * FROM i1 UNION ALL SELECT app, (SELECT count(*) FROM i1) + row_number() OVER (ORDER BY app) FROM p2 WHERE app NOT IN (SELECT app FROM i1)),
m1 AS (SELECT product_id, t.* FROM t1 t JOIN ids USING (app) WHERE app IN (SELECT app FROM p1)), m2 AS (SELECT product_id, t.* FROM t2 t JOIN ids USING (app) WHERE app IN (SELECT app FROM p2)),
e1 AS (SELECT DISTINCT product_id, code, expiry FROM x1 JOIN ids USING (app) WHERE app IN (SELECT app FROM p1)), e2 AS (SELECT DISTINCT product_id, code, expiry FROM x2 JOIN ids USING (app) WHERE app IN (SELECT app FROM p2))
"""


@query(SQL + "SELECT company_id, name FROM companies")
def ingested_companies(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "companies")


@query(
    SQL
    + """SELECT product_id, app AS application_number, '001' AS product_number, p.name, company_id, strength, CASE WHEN k % 3 = 0 THEN 'MONOCLONAL_ANTIBODY' ELSE 'SMALL_MOLECULE' END AS modality, DATE '2001-01-05' AS approval_date
FROM (SELECT * FROM p2 UNION ALL SELECT * FROM p1 WHERE app NOT IN (SELECT app FROM p2)) p JOIN ids USING (app) JOIN companies c ON c.name = p.company"""
)
def ingested_products(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "products_a").select("product_id", "application_number", "product_number", "name", "company_id", "strength", "modality", "approval_date")


@query(
    SQL
    + """, f AS (SELECT *, number::INT % 3 = 0 AS theirs FROM m1)
SELECT coalesce(m2.product_id, f.product_id) AS product_id, coalesce(m2.number, f.number) AS patent_number, coalesce(m2.a, f.a) AS nominal_expiry, CASE WHEN f.theirs THEN DATE '2050-01-01' ELSE coalesce(m2.z, m2.a, f.z, f.a) END AS expiry,
  CASE WHEN f.theirs OR m2.number IS NULL THEN datediff('day', f.a, f.z) ELSE datediff('day', m2.a, m2.z) END::INT AS adjustment_days, CASE WHEN f.theirs THEN DATE '1980-01-01' END AS filing_date, true AS covers_substance
FROM m2 FULL JOIN f ON f.product_id = m2.product_id AND f.number = m2.number"""
)
def ingested_patents(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "patents_a").select("product_id", "patent_number", "nominal_expiry", "expiry", "adjustment_days", "filing_date", "covers_substance")


@query(SQL + "SELECT * FROM e1 UNION SELECT * FROM e2")
def ingested_exclusivities(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "exclusivities_a")


@query(
    SQL
    + """, r AS (SELECT 1 AS run, 'product' AS entity_kind, product_id::VARCHAR AS entity_id FROM ids WHERE app IN (SELECT app FROM p1) UNION ALL SELECT 2, 'product', product_id::VARCHAR FROM ids WHERE app IN (SELECT app FROM p2)
  UNION ALL SELECT 1, 'patent', product_id || '/' || number || '/' FROM m1 UNION ALL SELECT 2, 'patent', product_id || '/' || number || '/' FROM m2
  UNION ALL SELECT 1, 'exclusivity', product_id || '/' || code || '/' || expiry FROM e1 UNION ALL SELECT 2, 'exclusivity', product_id || '/' || code || '/' || expiry FROM e2)
SELECT 'tilde' AS source, entity_kind, entity_id, CASE run WHEN 1 THEN TIMESTAMP '2026-01-01 12:00:00' ELSE TIMESTAMP '2026-02-01 12:00:00' END AS verified_at FROM r"""
)
def ingested_records(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "records").select("source", "entity_kind", "entity_id", "verified_at")


def _issues_sql(n: int) -> str:
    product = f"FROM part WHERE p_partkey % 4 <> {3 if n == 1 else 0}"
    order = f"FROM orders WHERE o_orderkey % 4 <> {n}"
    return f"""SELECT {n} AS run, 'products.txt' AS file, 'unknown application type "…"' AS category, sum(1 + (p_partkey % 6 = 0)::INT) AS n {product} AND p_partkey % 5 = 0
UNION ALL SELECT {n}, 'products.txt', count(*) || ' rows repeat a key that was seen before in this run', 1 {product} AND p_partkey % 5 <> 0 AND p_partkey % 6 = 0
UNION ALL SELECT {n}, 'patent.txt', 'unknown application type "…"', sum(1 + (z IS NOT NULL)::INT) FROM t{n} WHERE odd
UNION ALL SELECT {n}, 'patent.txt', 'no product found for "…"', count(*) FROM t{n} WHERE NOT odd AND app NOT IN (SELECT app FROM p{n})
UNION ALL SELECT {n}, 'exclusivity.txt', 'unknown application type "…"', count(*) {order} AND o_custkey % 5 = 0
UNION ALL SELECT {n}, 'exclusivity.txt', (count(*) - count(DISTINCT (app, code, expiry))) || ' rows repeat a key that was seen before in this run', 1 FROM x{n} WHERE NOT odd
UNION ALL SELECT {n}, 'exclusivity.txt', 'no product found for "…"', count(*) FROM (SELECT DISTINCT app, code, expiry FROM x{n} WHERE NOT odd AND app NOT IN (SELECT app FROM p{n}))"""


@query(SQL + f", i AS ({_issues_sql(1)} UNION ALL {_issues_sql(2)}) SELECT run, file, category, n::BIGINT AS n FROM i WHERE n > 0 AND category NOT LIKE '0 rows%'")
def ingested_issues(spark: SparkSession, d: str) -> DataFrame:
    store = _two_runs(spark, d)
    nth = runs.runs(store).select("run_id", F.when(F.col("started_at") == F.lit(FIRST), 1).otherwise(2).alias("run"))
    issues = store.read("issues", ingest.SCHEMAS["issues"]).withColumn("category", without_quotes(F.col("reason")))
    return issues.join(F.broadcast(nth), "run_id").groupBy("run", "file", "category").agg(F.count(F.lit(1)).alias("n"))  # one row a run


@query(
    SQL
    + f""", i AS ({_issues_sql(1)} UNION ALL {_issues_sql(2)}), s AS (SELECT run, sum(n) FILTER (n > 0 AND category NOT LIKE '0 rows%') AS issues, coalesce(sum(n) FILTER (category LIKE 'no product%'), 0) AS skipped FROM i GROUP BY run),
u AS (SELECT 1 AS run, (SELECT count(*) FROM p1) AS products, (SELECT count(*) FROM m1) AS patents, (SELECT count(*) FROM e1) AS exclusivities UNION ALL SELECT 2, (SELECT count(*) FROM p2), (SELECT count(*) FROM m2), (SELECT count(*) FROM e2))
SELECT run, 'PARTIAL' AS status, products + patents + exclusivities AS rows_upserted, skipped::BIGINT AS rows_skipped, issues::BIGINT AS issues, products::BIGINT AS products, CASE run WHEN 1 THEN products ELSE (SELECT count(*) FROM p2 WHERE app NOT IN (SELECT app FROM p1)) END::BIGINT AS new_products FROM s JOIN u USING (run)"""
)
def ingested_runs(spark: SparkSession, d: str) -> DataFrame:
    said = lambda path: F.get_json_object("summary", path).cast("long")
    return runs.runs(_two_runs(spark, d)).select(
        F.when(F.col("started_at") == F.lit(FIRST), 1).otherwise(2).alias("run"),
        "status",
        "rows_upserted",
        "rows_skipped",
        said("$.issues").alias("issues"),
        said("$.upserted.products_a").alias("products"),
        said("$.inserted.products_a").alias("new_products"),
    )


@query(SQL + "SELECT product_id, app AS application_number, strength, 'FAILED' AS status FROM p1 JOIN ids USING (app)")
def ingest_killed(spark: SparkSession, d: str) -> DataFrame:
    """A second run that dies after its products are written, before its patents are: what readers see then."""
    store = Store(spark, scratch_path(spark, "killed"))
    runs.run(store, "tilde", ingest.tilde_load(_release(spark, d, 1)), FIRST)
    release = _release(spark, d, 2)
    release["patents"] = release["patents"].withColumn("raw", F.raise_error(F.lit("the machine is gone")).cast("string"))
    runs.run(store, "tilde", ingest.tilde_load(release), SECOND)
    ended = runs.runs(store).filter(F.col("started_at") == F.lit(SECOND)).first()["status"]
    return store.read("products_a", ingest.SCHEMAS["products_a"]).select("product_id", "application_number", "strength", F.lit(ended).alias("status"))


# --- the other two sources --------------------------------------------------------------------------


def _forms(spark: SparkSession, d: str, n: int) -> dict[str, DataFrame]:
    """Products of some hundred applications in several forms; in the second release every fifth is a gel."""
    form = "p_type" if n == 1 else "CASE WHEN p_partkey % 5 = 0 THEN 'GEL' ELSE p_type END"
    raw = f"concat_ws('~', 'CALCIUM', concat({form}, '; ORAL'), p_name, 'x', '5MG', 'N', lpad(CAST(p_partkey % 300 AS string), 6, '0'), CAST(p_partkey AS string), 'x', 'Jan 5, 2001', 'x', 'x', 'x', p_brand)"
    products = b.table(spark, d, "part").select((F.col("p_partkey") + 10).alias("line"), F.expr(raw).alias("raw"))
    none = spark.createDataFrame([], "line long, raw string")
    return {"products": _with_head(products, 14), "patents": _with_head(none, 10), "exclusivities": _with_head(none, 5)}


@query(
    """WITH c AS (SELECT c_custkey AS k, c_custkey % 350 AS app, CASE c_custkey % 3 WHEN 0 THEN 'PROMO' WHEN 1 THEN 'ECONOMY' ELSE 'GEL' END AS form FROM customer),
p AS (SELECT p_partkey AS product, p_partkey % 300 AS app, p_type AS f1, CASE WHEN p_partkey % 5 = 0 THEN 'GEL' ELSE p_type END AS f2 FROM part),
j AS (SELECT k, product, CASE WHEN k % 2 = 0 THEN f2 ELSE f1 END AS own, form FROM c JOIN p USING (app)),
w AS (SELECT *, min(own) OVER v <> max(own) OVER v AS several, bool_or(own = form) OVER v AS anyone FROM j WINDOW v AS (PARTITION BY k))
SELECT 'Name ' || k AS challenge, product::VARCHAR AS product_number FROM w WHERE NOT several OR NOT anyone OR own = form"""
)
def ingested_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of printed challenges to products: made once, and made anew for every second challenge after the products have changed."""
    store = Store(spark, scratch_path(spark, "challenges"))
    k = F.col("c_custkey")
    form = F.when(k % 3 == 0, "Promos").when(k % 3 == 1, "economy, oral").otherwise("gels")
    texts = {
        "ingredient": F.lit("x"), "form": form, "strength": F.concat(k.cast("string"), F.lit("MG")), "listed": F.concat(F.lit("Name "), k.cast("string"), F.lit("\n"), F.lpad((k % 350).cast("string"), 6, "0")),
        "submitted": F.lit("1/5/2020"), "applicants": F.lit("1"), "status": F.lit("Eligible"), "posting": F.lit("1/6/2020"), "approval": F.lit(""), "marketing": F.lit(""), "expiration": F.lit(""),
    }
    cells = b.table(spark, d, "customer").select(k.alias("line"), *[c.alias(n) for n, c in texts.items()])
    loads = {1: cells, 2: cells.filter("line % 2 = 0")}
    for n, now in ((1, FIRST), (2, SECOND)):
        runs.run(store, "tilde", ingest.tilde_load(_forms(spark, d, n)), now)
        runs.run(store, "challenges", ingest.challenges_load(loads[n]), now)
    t = lambda name: store.read(name, ingest.SCHEMAS[name])
    return t("challenge_links").join(t("challenges").select("challenge_id", F.col("name").alias("challenge")), "challenge_id").join(t("products_a").select("product_id", "product_number"), "product_id").select("challenge", "product_number")


@query(
    """WITH p AS (SELECT p_partkey AS k, 'Name ' || p_partkey AS name, CASE p_partkey % 4 WHEN 1 THEN p_partkey - 1 WHEN 2 THEN p_partkey WHEN 3 THEN p_partkey - 3 END AS r FROM part),
q AS (SELECT s.k, s.name, CASE WHEN t.k <> s.k THEN t.name END AS reference FROM p s LEFT JOIN p t ON t.k = s.r)
SELECT k::VARCHAR AS application_number, name, reference, CASE WHEN k % 4 = 2 THEN 'no known product for the reference "name ' || k || '", which is kept as a name' END AS issue FROM q"""
)
def ingested_references(spark: SparkSession, d: str) -> DataFrame:
    """Biologic products whose references are stated by the one name, by their own, or by the other name."""
    store = Store(spark, scratch_path(spark, "monthly"))
    ref = "CASE p_partkey % 4 WHEN 1 THEN concat('NAME ', p_partkey - 1) WHEN 2 THEN concat('name ', p_partkey) ELSE 'N/A' END"
    proper = "CASE p_partkey % 4 WHEN 2 THEN concat('proper ', p_partkey - 2) WHEN 3 THEN concat('Proper ', p_partkey - 3) ELSE '' END"
    raw = f"concat_ws(',', '', p_brand, p_partkey, concat('Name ', p_partkey), concat('proper ', p_partkey), '351(a)', '5', 'VIAL', 'IV', '001', '', '5-Jan-01', 'CDER', {proper}, {ref}, '', '', '')"
    lines = spark.createDataFrame([(1, ",".join(_HEAD))], "line long, raw string").unionByName(b.table(spark, d, "part").select((F.col("p_partkey") + 10).alias("line"), F.expr(raw).alias("raw")))
    runs.run(store, "monthly", ingest.monthly_load(lines, _HEAD), FIRST)
    products = store.read("products_b", ingest.SCHEMAS["products_b"])
    issues = store.read("issues", ingest.SCHEMAS["issues"]).select(F.substring_index("raw", "/", 1).alias("application_number"), F.col("reason").alias("issue"))
    names = products.select(F.col("product_id").alias("reference_id"), F.col("name").alias("reference"))
    return products.join(names, "reference_id", "left").join(issues, "application_number", "left").select("application_number", "name", "reference", "issue")
