"""Queries over the test data, one or more for each family of operators, and the same in SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import classify, dates, display, parties, text
from tideline.operators import detail, enrich, estimate, matching, search, stats, store
from tideline.plans import binding as b
from tideline.session import cut
from tideline.sources import layout, monthly, responses, tilde

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    """Register a query under its name, with its SQL."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _est(spark: SparkSession, d: str) -> DataFrame:
    return estimate.estimates(b.products(spark, d), b.patents(spark, d), b.exclusivities(spark, d))


def _prepared(spark: SparkSession, d: str, q: search.ListQuery) -> DataFrame:
    sold = b.marketed(spark, d)
    return search.prepared(_est(spark, d), q, b.patents(spark, d), b.exclusivities(spark, d), has_marketing=sold)


# --- the unified estimate ------------------------------------------------------------------


@query(b.SQL + "SELECT source, product_id, estimate, confidence, patent_count, exclusivity_count, max_gap_days FROM est")
def estimate_view(spark: SparkSession, d: str) -> DataFrame:
    return _est(spark, d).select("source", "product_id", "estimate", "confidence", "patent_count", "exclusivity_count", "max_gap_days")


@query(b.SQL + "SELECT source, product_id, name, estimate, confidence FROM est WHERE estimate IS NOT NULL ORDER BY estimate, source, product_id LIMIT 100")
def list_soonest(spark: SparkSession, d: str) -> DataFrame:
    q = search.ListQuery(b.AS_OF, limit=100)
    return search.page(_prepared(spark, d, q), q).select("source", "product_id", "name", "estimate", "confidence")


_FILTER = """estimate IS NOT NULL AND estimate <= DATE '2000-01-01' AND modality IN ('1-URGENT', '2-HIGH') AND application_type IN ('O', 'F') AND max_gap_days >= 5
  AND (contains(lower(name), '1') OR contains(lower(alt_name), '1') OR contains(lower(company), '1'))
  AND EXISTS (SELECT 1 FROM patents p WHERE p.source = e.source AND p.product_id = e.product_id AND p.live AND (p.covers_substance OR p.use_code <> ''))
  AND EXISTS (SELECT 1 FROM exclusivities x WHERE x.source = e.source AND x.product_id = e.product_id AND x.code IN ('N', 'A'))
  AND EXISTS (SELECT 1 FROM marketed m WHERE m.source = e.source AND m.product_id = e.product_id)"""


def _filter_query(**more: object) -> search.ListQuery:
    return search.ListQuery(b.AS_OF, q="1", within_days=365, modality=["1-URGENT", "2-HIGH"], application_type=["O", "F"], min_gap_days=5, patent_type=["substance", "use"], exclusivity_code=["N", "A"], has_marketing=True, **more)


@query(b.SQL + f"SELECT source, product_id, estimate, max_gap_days FROM est e WHERE {_FILTER} ORDER BY max_gap_days DESC NULLS LAST, source, product_id LIMIT 50 OFFSET 5")
def list_filtered(spark: SparkSession, d: str) -> DataFrame:
    q = _filter_query(sort="gap_desc", limit=50, offset=5)
    return search.page(_prepared(spark, d, q), q).select("source", "product_id", "estimate", "max_gap_days")


@query(b.SQL + f"SELECT count(*) AS total FROM est e WHERE {_FILTER}")
def list_total(spark: SparkSession, d: str) -> DataFrame:
    q = _filter_query(offset=10_000)
    return search.total(_prepared(spark, d, q), q)


@query(
    b.SQL
    + """, r AS (SELECT *, modality IN ('1-URGENT', '5-LOW') AS m, dosage_form IN ('BUILDING', 'ECONOMY') AS f, source IN ('A') AS s FROM est WHERE estimate IS NOT NULL AND estimate >= DATE '1998-01-01')
SELECT 'modality' AS facet, modality AS value, count(*) AS n FROM r WHERE f AND s AND modality IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'application_type', application_type, count(*) FROM r WHERE m AND f AND s AND application_type IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'dosage_form', dosage_form, count(*) FROM r WHERE m AND s AND dosage_form IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'route', route, count(*) FROM r WHERE m AND f AND s AND route IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'source', source, count(*) FROM r WHERE m AND f GROUP BY ALL"""
)
def facets_leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    q = search.ListQuery(b.AS_OF, expires_after=dt.date(1998, 1, 1), modality=["1-URGENT", "5-LOW"], dosage_form=["BUILDING", "ECONOMY"], source=["A"])
    return search.facets(_prepared(spark, d, q), q)


@query(
    b.SQL
    + """, top AS (SELECT *, row_number() OVER (ORDER BY estimate DESC, source, product_id) AS position FROM est WHERE estimate IS NOT NULL AND source = 'B'),
c AS (SELECT position, name, CASE WHEN regexp_matches(company, '[",\\n]') THEN '"' || company || '"' ELSE company END AS company, estimate::VARCHAR AS e, coalesce(max_gap_days::VARCHAR, '') AS g,
  CASE confidence WHEN 'confirmed' THEN 'Confirmed, exactly' ELSE 'Pending' END AS conf FROM top WHERE position <= 500)
SELECT position, name || ',' || company || ',' || e || ',' || g || ',' || CASE WHEN contains(conf, ',') THEN '"' || conf || '"' ELSE conf END AS line FROM c"""
)
def export_lines(spark: SparkSession, d: str) -> DataFrame:
    q = search.ListQuery(b.AS_OF, source=["B"], sort="entry_desc")
    columns = {"name": "Name", "company": "Company", "estimate": "Entry", "max_gap_days": "Gap", "confidence": "Confidence"}
    return search.export_lines(_prepared(spark, d, q), q, columns, {"confidence": {"confirmed": "Confirmed, exactly", "pending_verification": "Pending"}})


@query(b.SQL + "SELECT count(*) FILTER (d <= 30) AS within_30, count(*) FILTER (d <= 90) AS within_90, count(*) FILTER (d <= 365) AS within_365 FROM (SELECT datediff('day', DATE '1999-01-01', estimate) AS d FROM est)")
def horizon_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.horizon_counts(_est(spark, d), b.AS_OF)


_TIMELINE = """, cal AS (SELECT unnest(generate_series(DATE '1999-01-01', DATE '1999-12-01', INTERVAL 1 MONTH))::DATE AS month),
tl AS (SELECT month, count(estimate) AS n FROM cal LEFT JOIN est ON date_trunc('month', estimate)::DATE = month GROUP BY month)
"""


@query(b.SQL + _TIMELINE + "SELECT month, n FROM tl")
def timeline_12m(spark: SparkSession, d: str) -> DataFrame:
    return stats.timeline(_est(spark, d), b.AS_OF)


@query(b.SQL + _TIMELINE + "SELECT month, n, CASE WHEN n = 0 THEN 4 ELSE greatest(8, round(n * 100.0 / (SELECT greatest(max(n), 1) FROM tl))::INT) END AS height FROM tl")
def timeline_bars(spark: SparkSession, d: str) -> DataFrame:
    return stats.bar_heights(stats.timeline(_est(spark, d), b.AS_OF))


@query(
    b.SQL
    + """, c AS (SELECT source, product_id, expiry, 0 AS rank, 'patent' AS kind, patent_number AS label, use_code, adjustment_days IS NOT NULL AS verified FROM patents WHERE live
  UNION ALL SELECT source, product_id, expiry, 1, 'exclusivity', code, '', true FROM exclusivities),
n AS (SELECT *, row_number() OVER (PARTITION BY source, product_id ORDER BY expiry DESC, rank, label, use_code, verified DESC) AS nth FROM c),
s AS (SELECT *, CASE kind WHEN 'patent' THEN 'Patent ' ELSE 'Exclusivity ' END || label || CASE WHEN use_code <> '' THEN ' (use code ' || use_code || ')' ELSE '' END AS said FROM n WHERE nth = 1)
SELECT source, product_id, kind, said AS label, expiry, CASE WHEN verified THEN 'confirmed' ELSE 'pending_verification' END AS confidence,
  'The latest to expire is ' || said || CASE WHEN verified THEN '' ELSE ', whose term has not been checked yet, so the date may still move' END || '; nothing else that is listed expires after ' || expiry::VARCHAR || '.' AS basis FROM s"""
)
def controlling_item(spark: SparkSession, d: str) -> DataFrame:
    return estimate.controlling(b.patents(spark, d), b.exclusivities(spark, d))


@query(b.SQL + "SELECT m.source, m.product_id, marketing_date, estimate FROM (SELECT DISTINCT * FROM marketed) m JOIN est e USING (source, product_id) WHERE marketing_date < estimate")
def divergence(spark: SparkSession, d: str) -> DataFrame:
    return stats.diverging(_est(spark, d), b.marketed(spark, d))


def _challenges(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "EXTINGUISHED").when(F.col("event_type") == "click", "ELIGIBLE").when(F.col("event_type") == "view", "DEFERRED")
    return b.table(spark, d, "events").select(F.col("event_id").alias("challenge_id"), "user_id", status.alias("current_status"), F.to_date("ts").alias("date"), "event_type", "props", "value")


@query(
    b.SQL
    + """SELECT (SELECT count(*) FROM est) AS tracked, count(*) FILTER (d <= 30) AS within_30, count(*) FILTER (d <= 90) AS within_90, count(*) FILTER (d <= 365) AS within_365,
  (SELECT count(*) FROM events WHERE event_type <> 'error') AS active_challenges,
  (SELECT count(*) FROM (SELECT DISTINCT * FROM marketed) m JOIN est e USING (source, product_id) WHERE marketing_date < estimate) AS divergence
FROM (SELECT datediff('day', DATE '1999-01-01', estimate) AS d FROM est)"""
)
def portfolio_tiles(spark: SparkSession, d: str) -> DataFrame:
    return stats.portfolio(_est(spark, d), _challenges(spark, d), b.marketed(spark, d), b.AS_OF)


@query(
    """WITH e AS (SELECT event_type, ts::DATE AS date, 'user ' || user_id AS product, event_type || ' ' || event_id AS detail, event_id FROM events),
p AS (SELECT * FROM (SELECT 'signup' AS kind, 0 AS o, date, product, detail FROM e WHERE event_type = 'signup' ORDER BY date DESC, product, detail LIMIT 300)
 UNION ALL SELECT * FROM (SELECT 'purchase', 1, date, product, detail FROM e WHERE event_type = 'purchase' ORDER BY date DESC, product, detail LIMIT 300)
 UNION ALL SELECT * FROM (SELECT 'view', 2, date, product, detail FROM e WHERE event_type = 'view' ORDER BY date DESC, product, detail LIMIT 300)
 UNION ALL (SELECT 'confirmed', 3, date, n || ' product' || CASE WHEN n = 1 THEN '' ELSE 's' END, 'Patent terms confirmed' FROM (SELECT ts::DATE AS date, count(DISTINCT user_id) AS n FROM events WHERE event_type = 'click' GROUP BY 1 ORDER BY 1 DESC LIMIT 15)))
SELECT kind, date, product, detail FROM p ORDER BY date DESC, o, product, detail LIMIT 60 OFFSET 10"""
)
def activity_feed(spark: SparkSession, d: str) -> DataFrame:
    e = b.table(spark, d, "events").select(
        "event_type", "user_id", F.to_date("ts").alias("date"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("product"), F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("detail")
    )
    confirmed = stats.confirmations(e.filter("event_type = 'click'").select("date", F.col("user_id").alias("product_id")))
    parts = [(k, e.filter(F.col("event_type") == k)) for k in ("signup", "purchase", "view")] + [("confirmed", confirmed)]
    return stats.feed(parts, limit=60, offset=10)


# --- top one of a group, queues, vocabularies -------------------------------------------------


@query("SELECT user_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    e = b.table(spark, d, "events").withColumn("_by", F.struct("ts", "event_id"))
    return estimate.latest_per_key(e, ["user_id"], "_by", "event_type").select("user_id", "event_type", F.col("_by.ts").alias("ts"))


@query("SELECT p_name, p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_retailprice DESC, p_partkey) = 1")
def distinct_on_name(spark: SparkSession, d: str) -> DataFrame:
    p = b.table(spark, d, "part").select("p_name", "p_brand", "p_partkey", "p_retailprice")
    return estimate.distinct_on(p, ["p_brand", "p_name"], F.desc("p_retailprice"), "p_partkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) = 1")
def dedupe_first_seen(spark: SparkSession, d: str) -> DataFrame:
    rows = b.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return estimate.first_seen(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"])


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def first_linked(spark: SparkSession, d: str) -> DataFrame:
    return stats.first_linked(b.table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id")


@query(
    """WITH l AS (SELECT c_custkey, max(ts) AS checked FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1)
SELECT c_custkey, checked FROM l WHERE checked IS NULL OR checked < TIMESTAMP '2024-01-29 00:00:00' ORDER BY checked ASC NULLS FIRST, c_custkey LIMIT 1400"""
)
def work_queue(spark: SparkSession, d: str) -> DataFrame:
    last = b.table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("checked"))
    rows = b.table(spark, d, "customer").select("c_custkey").join(last, F.col("c_custkey") == F.col("user_id"), "left").select("c_custkey", "checked")
    return stats.queue(rows, "checked", dt.datetime(2024, 4, 28), 90, 1400, "c_custkey")


@query("SELECT 'brand' AS facet, p_brand AS value FROM part UNION SELECT 'type', p_type FROM part UNION SELECT 'segment', c_mktsegment FROM customer UNION SELECT 'type', 'NEVER SEEN'")
def vocab_union(spark: SparkSession, d: str) -> DataFrame:
    p = b.table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))
    c = b.table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"))
    return search.vocabulary([p, c], ["brand", "type", "segment"], {"type": ["NEVER SEEN"]})


@query("WITH f AS (SELECT event_type, min(event_id) AS f FROM events GROUP BY 1 ORDER BY 2, 1 LIMIT 2) SELECT event_type, event_id, value FROM events JOIN f USING (event_type)")
def capped_groups(spark: SparkSession, d: str) -> DataFrame:
    return stats.capped_groups(b.table(spark, d, "events").select("event_type", "event_id", "value"), "event_type", "event_id", 2)


@query("SELECT o_orderstatus AS kind, count(*) AS total, count(o_totalprice) FILTER (o_totalprice > 200000) AS done, round(count(*) FILTER (o_totalprice > 200000) * 100.0 / count(*))::INT AS percent FROM orders GROUP BY 1")
def enrichment_progress(spark: SparkSession, d: str) -> DataFrame:
    o = b.table(spark, d, "orders").select(F.col("o_orderstatus").alias("kind"), F.when(F.col("o_totalprice") > 200000, F.lit(1)).alias("ok"))
    return stats.progress(o, "kind", "ok")


@query("SELECT p_brand, count(DISTINCT p_type) = count(*) AS tells_apart FROM part GROUP BY 1")
def differentiators(spark: SparkSession, d: str) -> DataFrame:
    return stats.tells_apart(b.table(spark, d, "part"), ["p_brand"], "p_type")


# --- semi, anti, lookups, matching -------------------------------------------------------------


@query(b.SQL + "SELECT DISTINCT source, product_id FROM patents WHERE live AND (covers_substance OR covers_product)")
def semi_exists_type(spark: SparkSession, d: str) -> DataFrame:
    keys = search.of_patent_types(b.patents(spark, d), ["substance", "product"])
    return b.products(spark, d).select("source", "product_id").join(keys, ["source", "product_id"], "left_semi")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def anti_unlinked(spark: SparkSession, d: str) -> DataFrame:
    links = b.table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return store.unlinked(b.table(spark, d, "customer").select("c_custkey", "c_name"), links, "c_custkey")


@query("SELECT user_id, count(*) AS n FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1")
def lookup_misses(spark: SparkSession, d: str) -> DataFrame:
    events = b.table(spark, d, "events").select(F.col("user_id"))
    known = b.table(spark, d, "supplier").select(F.col("s_suppkey").alias("user_id"), "s_name")
    _, missing = matching.hash_lookup(events, known, ["user_id"], "s_name", "unknown supplier")
    return missing.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey, s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def fan_out_by_part_key(spark: SparkSession, d: str) -> DataFrame:
    n = b.table(spark, d, "nation").select("n_nationkey")
    s = b.table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    return matching.fan_out(n, s, "n_nationkey")[0]


_NORM = "regexp_replace(trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')), '([a-z0-9])( (inc|incorporated|corp|corporation|llc|ltd|limited|co|company|usa|pharmaceuticals|pharmaceutical|pharma))+$', '\\1')"


@query(f"SELECT s_suppkey, {_NORM.replace('x)', 's)', 1)} AS norm FROM (SELECT s_suppkey, s_name || CASE s_suppkey % 4 WHEN 0 THEN ' Pharma, Inc.' WHEN 1 THEN ' CO. LTD' WHEN 2 THEN ' Incident' ELSE '' END AS s FROM supplier)")
def company_normalize(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey") % 4
    name = F.concat("s_name", F.when(k == 0, " Pharma, Inc.").when(k == 1, " CO. LTD").when(k == 2, " Incident").otherwise(""))
    return b.table(spark, d, "supplier").select("s_suppkey", parties.company(name).alias("norm"))


@query(
    """WITH known AS (SELECT min(p_partkey) AS id, p_name AS name FROM part WHERE p_size > 10 GROUP BY p_name),
asked AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' Inc' WHEN 2 THEN 'Great ' || p_name ELSE split_part(p_name, ' ', 1) END AS name FROM part),
na AS (SELECT name, CASE WHEN name LIKE '% Inc' THEN lower(name[:-5]) ELSE lower(name) END AS norm FROM asked),
ex AS (SELECT na.name, count(k.id) AS n, min(k.id) AS id FROM na LEFT JOIN known k ON k.name = norm GROUP BY 1),
fz AS (SELECT na.name, min(k.id) AS a, max(k.id) AS z FROM na JOIN known k ON list_has_all(string_split(k.name, ' '), string_split(norm, ' ')) OR list_has_all(string_split(norm, ' '), string_split(k.name, ' ')) GROUP BY 1)
SELECT ex.name, CASE WHEN n = 1 THEN ex.id WHEN n = 0 AND a = z THEN a END AS company_id, CASE WHEN n = 1 THEN 'exact' WHEN n = 0 AND a = z THEN 'fuzzy' ELSE 'none' END AS match FROM ex LEFT JOIN fz USING (name)"""
)
def token_containment_join(spark: SparkSession, d: str) -> DataFrame:
    p = b.table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    known = p.filter("p_size > 10").groupBy("p_name").agg(F.min("p_partkey").alias("id")).select("id", F.col("p_name").alias("name"))
    k = F.col("p_partkey") % 4
    asked = p.select(F.when(k == 0, F.col("p_name")).when(k == 1, F.concat("p_name", F.lit(" Inc"))).when(k == 2, F.concat(F.lit("Great "), F.col("p_name"))).otherwise(F.substring_index("p_name", " ", 1)).alias("name"))
    return matching.companies(asked, known)


@query(
    """WITH h AS (SELECT o_orderkey AS docket_id, CASE WHEN o_custkey % 100 > 30 THEN o_custkey % 100 END AS plaintiff_id, CASE WHEN o_custkey % 7 > 1 THEN o_custkey % 7 END AS defendant_id,
  CASE WHEN o_custkey % 100 <= 30 THEN 'party ' || o_custkey % 50 END AS plaintiff_name, CASE WHEN o_custkey % 7 <= 1 THEN 'party ' || o_custkey % 3 END AS defendant_name, o_orderdate::DATE AS filed, CASE WHEN o_orderstatus = 'F' THEN o_orderdate::DATE END AS terminated FROM orders),
g AS (SELECT *, CASE WHEN datediff('day', lag(filed) OVER w, filed) > 30 THEN 1 ELSE 0 END AS s FROM h WINDOW w AS (PARTITION BY plaintiff_id, defendant_id, plaintiff_name, defendant_name ORDER BY filed NULLS FIRST, docket_id)),
c AS (SELECT *, sum(s) OVER (PARTITION BY plaintiff_id, defendant_id, plaintiff_name, defendant_name ORDER BY filed NULLS FIRST, docket_id ROWS UNBOUNDED PRECEDING)::BIGINT AS case_no FROM g)
SELECT plaintiff_id, defendant_id, plaintiff_name, defendant_name, case_no, min(filed) AS filed, CASE WHEN bool_or(terminated IS NULL) THEN 'ONGOING' ELSE 'UNCLEAR' END AS outcome, count(*) AS n_dockets FROM c GROUP BY 1, 2, 3, 4, 5"""
)
def proximity_grouping(spark: SparkSession, d: str) -> DataFrame:
    o = b.table(spark, d, "orders")
    a, z = F.col("o_custkey") % 100, F.col("o_custkey") % 7
    party = lambda k: F.concat(F.lit("party "), (F.col("o_custkey") % k).cast("string"))
    hits = o.select(
        F.col("o_orderkey").alias("docket_id"), F.when(a > 30, a).alias("plaintiff_id"), F.when(z > 1, z).alias("defendant_id"), party(50).alias("plaintiff"), party(3).alias("defendant"), F.to_date("o_orderdate").alias("filed"), F.when(F.col("o_orderstatus") == "F", F.to_date("o_orderdate")).alias("terminated")
    )
    return matching.case_summary(matching.grouped_cases(hits, 30))


@query(
    """WITH h AS (SELECT o_orderkey AS docket_id, CASE WHEN o_custkey % 100 > 30 THEN o_custkey % 100 END AS plaintiff_id, CASE WHEN o_custkey % 7 > 1 THEN o_custkey % 7 END AS defendant_id,
  CASE WHEN o_custkey % 100 <= 30 THEN 'party ' || o_custkey % 50 END AS plaintiff_name, CASE WHEN o_custkey % 7 <= 1 THEN 'party ' || o_custkey % 3 END AS defendant_name, o_orderdate::DATE AS filed FROM orders),
g AS (SELECT *, CASE WHEN datediff('day', lag(filed) OVER w, filed) > 30 THEN 1 ELSE 0 END AS s FROM h WINDOW w AS (PARTITION BY plaintiff_id, defendant_id, plaintiff_name, defendant_name ORDER BY filed, docket_id))
SELECT docket_id, sum(s) OVER (PARTITION BY plaintiff_id, defendant_id, plaintiff_name, defendant_name ORDER BY filed, docket_id ROWS UNBOUNDED PRECEDING)::BIGINT AS case_no FROM g"""
)
def growing_cases(spark: SparkSession, d: str) -> DataFrame:
    """Dockets that come in three batches, the earlier first, put into cases that keep their numbers."""
    a, z = F.col("o_custkey") % 100, F.col("o_custkey") % 7
    party = lambda k: F.concat(F.lit("party "), (F.col("o_custkey") % k).cast("string"))
    hits = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("docket_id"), F.when(a > 30, a).alias("plaintiff_id"), F.when(z > 1, z).alias("defendant_id"), party(50).alias("plaintiff"), party(3).alias("defendant"), F.to_date("o_orderdate").alias("filed"))
    cases = spark.createDataFrame([], "plaintiff_id long, defendant_id long, plaintiff_name string, defendant_name string, case_no long, first date, last date")
    out = []
    for begin, end in (("1900-01-01", "1994-06-01"), ("1994-06-01", "1996-03-01"), ("1996-03-01", "2100-01-01")):
        placed, cases = matching.grown_cases(cases, hits.filter((F.col("filed") >= begin) & (F.col("filed") < end)), 30)
        cases = cut(cases)
        out.append(placed.select("docket_id", "case_no"))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(
    """WITH p AS (SELECT o_custkey AS challenge_id, o_orderkey AS product_id, o_orderpriority AS form, c_mktsegment AS own FROM orders JOIN customer ON o_custkey = c_custkey),
j AS (SELECT *, contains(form, 'HIGH') OR contains(form, 'LOW') AS holds FROM p),
w AS (SELECT *, min(form) OVER k <> max(form) OVER k AS several, bool_or(holds) OVER k AS anyone FROM j WINDOW k AS (PARTITION BY challenge_id))
SELECT challenge_id, product_id FROM w WHERE NOT several OR NOT anyone OR holds"""
)
def conditional_narrowing(spark: SparkSession, d: str) -> DataFrame:
    pairs = b.table(spark, d, "orders").select(F.col("o_custkey").alias("challenge_id"), F.col("o_orderkey").alias("product_id"), F.col("o_orderpriority").alias("form"))
    return matching.narrowed(pairs, "challenge_id", "form", matching.words_overlap(F.col("form"), F.lit("highs, low"))).select("challenge_id", "product_id")


@query(
    """WITH t AS (SELECT p_partkey AS product_id, p_name AS name, p_brand AS alt, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN 'unknown' END AS r1, CASE WHEN p_partkey % 2 = 0 THEN lower(p_brand) END AS r2 FROM part),
f AS (SELECT lower(name) AS k, min(product_id) AS a FROM t GROUP BY 1), s AS (SELECT lower(alt) AS k, min(product_id) AS z FROM t GROUP BY 1)
SELECT t.product_id, CASE WHEN coalesce(a, z) <> t.product_id THEN coalesce(a, z) END AS reference_id FROM t LEFT JOIN f ON f.k = lower(r1) LEFT JOIN s ON s.k = lower(r2)"""
)
def reference_two_step(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    t = b.table(spark, d, "part").select(
        k.alias("product_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("alt_name"), F.when(k % 3 == 0, F.upper("p_name")).when(k % 3 == 1, "unknown").alias("reference_name"), F.when(k % 2 == 0, F.lower("p_brand")).alias("reference_alt_name")
    )
    return matching.references(t)


@query("SELECT e.event_id, coalesce(c_name, s_name, n_name) AS label FROM events e LEFT JOIN customer ON event_id % 4 = 0 AND c_custkey = user_id LEFT JOIN supplier ON event_id % 4 = 1 AND s_suppkey = user_id LEFT JOIN nation ON event_id % 4 = 2 AND n_nationkey = user_id")
def polymorphic_labels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 4
    r = b.table(spark, d, "events").select("event_id", *[F.when(k == i, F.col("user_id")).cast(kind).alias(c) for i, (c, kind) in enumerate([("customer_id", "long"), ("supplier_id", "long"), ("nation_id", "int")])])
    targets = [("customer_id", b.table(spark, d, "customer"), "c_custkey", "c_name"), ("supplier_id", b.table(spark, d, "supplier"), "s_suppkey", "s_name"), ("nation_id", b.table(spark, d, "nation"), "n_nationkey", "n_name")]
    return matching.labelled(r, targets).select("event_id", "label")


@query("SELECT user_id, event_type, CASE max(CASE WHEN value > 30 THEN 2 WHEN value > 10 THEN 1 ELSE 0 END) WHEN 2 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM events GROUP BY 1, 2")
def tier_only_raised(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    e = b.table(spark, d, "events").select("user_id", "event_type", "event_id", F.when(v > 30, "HIGH").when(v > 10, "MEDIUM").otherwise("LOW").alias("tier"))
    return matching.raised_tier(e.filter("tier = 'LOW'"), e.filter("tier != 'LOW'"), ["user_id", "event_type"])


# --- nested detail, cases, disclosures -----------------------------------------------------------


@query(
    b.SQL
    + """, p AS (SELECT source, product_id, string_agg(patent_number || '@' || expiry, ';' ORDER BY expiry, patent_number) AS patents FROM patents GROUP BY ALL),
e AS (SELECT source, product_id, string_agg(code || '@' || expiry, ';' ORDER BY expiry, code) AS exclusivities FROM exclusivities GROUP BY ALL)
SELECT source, product_id, coalesce(patents, '') AS patents, coalesce(exclusivities, '') AS exclusivities, estimate IS NULL AS nothing_listed FROM est LEFT JOIN p USING (source, product_id) LEFT JOIN e USING (source, product_id)"""
)
def nested_detail(spark: SparkSession, d: str) -> DataFrame:
    full = detail.product_details(b.products(spark, d), b.patents(spark, d), b.exclusivities(spark, d))
    said = lambda c, label: F.array_join(F.transform(c, lambda s: F.concat(s[label], F.lit("@"), s["expiry"].cast("string"))), ";")
    return full.select("source", "product_id", said("patents", "patent_number").alias("patents"), said("exclusivities", "code").alias("exclusivities"), (F.col("basis") == detail.NO_BARRIER).alias("nothing_listed"))


@query(
    b.SQL
    + """, f AS (SELECT p.*, name, company FROM patents p JOIN products USING (source, product_id) WHERE regexp_replace(patent_number, '[^0-9]', '', 'g') = '171'),
x AS (SELECT source, product_id, string_agg(code || '@' || expiry, ';' ORDER BY expiry, code) AS exclusivities FROM exclusivities GROUP BY ALL),
o AS (SELECT o_orderkey::VARCHAR AS product_id, o_custkey, o_orderpriority FROM orders),
ch AS (SELECT product_id, string_agg(coalesce(st, '-') || '@' || coalesce(day::VARCHAR, '-'), ';' ORDER BY day DESC NULLS FIRST, st NULLS FIRST, kind) AS challenges FROM o JOIN
  (SELECT user_id, CASE event_type WHEN 'error' THEN 'EXTINGUISHED' WHEN 'click' THEN 'ELIGIBLE' END AS st, CASE WHEN event_type <> 'view' THEN ts::DATE END AS day, event_type AS kind FROM events) e ON o_custkey = user_id GROUP BY 1),
ca AS (SELECT product_id, string_agg(c_mktsegment || '/' || dk, ';') AS cases FROM o JOIN customer ON o_custkey = c_custkey JOIN (SELECT user_id, string_agg(event_id || '@' || ts::DATE, '+' ORDER BY ts::DATE, event_id::VARCHAR) AS dk FROM events GROUP BY 1) e ON e.user_id = c_custkey GROUP BY 1)
SELECT f.source, f.product_id, patent_number, use_code, name, company, coalesce(exclusivities, '') AS exclusivities, CASE WHEN f.source = 'A' THEN coalesce(challenges, '') ELSE '' END AS challenges,
  CASE WHEN f.source = 'A' THEN coalesce(cases, '') ELSE '' END AS cases FROM f LEFT JOIN x USING (source, product_id) LEFT JOIN ch ON ch.product_id = f.product_id LEFT JOIN ca ON ca.product_id = f.product_id"""
)
def patent_lookup(spark: SparkSession, d: str) -> DataFrame:
    e, o = b.table(spark, d, "events"), b.table(spark, d, "orders")
    status = F.when(F.col("event_type") == "error", "EXTINGUISHED").when(F.col("event_type") == "click", "ELIGIBLE")
    challenges = e.select(F.col("event_id").alias("challenge_id"), "user_id", status.alias("current_status"), F.when(F.col("event_type") != "view", F.to_date("ts")).alias("submission_date"), F.col("event_type").alias("submission_kind"))
    product = [F.lit("A").alias("source"), F.col("o_orderkey").cast("string").alias("product_id")]
    links = o.join(challenges.select("challenge_id", "user_id"), F.col("o_custkey") == F.col("user_id")).select(*product, "challenge_id")
    cases = b.table(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_mktsegment").alias("outcome"), F.lit(None).cast("date").alias("filed"), F.lit("LOW").alias("tier"))
    dockets = e.select(F.col("user_id").alias("case_id"), F.col("event_id").cast("string").alias("docket_number"), F.lit("DE").alias("court"), F.to_date("ts").alias("filed"))
    found = detail.lookup("17-1", b.patents(spark, d), b.products(spark, d), b.exclusivities(spark, d), links, challenges.drop("user_id"), o.select(*product, F.col("o_custkey").alias("case_id")), cases, dockets)
    at = lambda x, y: F.concat(F.coalesce(x, F.lit("-")), F.lit("@"), F.coalesce(y.cast("string"), F.lit("-")))
    told = {
        "exclusivities": F.transform("exclusivities", lambda s: at(s["code"], s["expiry"])),
        "challenges": F.transform("challenges", lambda s: at(s["current_status"], s["submission_date"])),
        "cases": F.transform("cases", lambda s: F.concat(s["outcome"], F.lit("/"), F.array_join(F.transform(s["dockets"], lambda k: at(k["docket_number"], k["filed"])), "+"))),
    }
    return found.select("source", "product_id", "patent_number", "use_code", "name", "company", *[F.array_join(c, ";").alias(n) for n, c in told.items()])


@query(
    """WITH c AS (SELECT o_orderkey AS k, 'p' || o_custkey % 40 AS plaintiff, 'd' || o_custkey % 9 AS defendant, CASE WHEN o_custkey % 5 > 0 AND o_custkey % 7 > 0 THEN o_custkey % 40 || '|' || o_custkey % 9 ELSE 'case ' || o_orderkey END AS party,
  CASE WHEN o_orderkey % 97 = 0 THEN 'ONGOING' WHEN o_custkey % 40 % 3 = 0 OR o_orderstatus = 'F' THEN 'SETTLED' ELSE 'DISMISSED' END AS outcome, o_orderdate::DATE AS filed, CASE WHEN o_orderkey % 13 > 0 THEN o_orderdate::DATE END AS day, o_orderpriority AS pr FROM orders)
SELECT min(plaintiff) AS plaintiff, min(defendant) AS defendant, CASE WHEN bool_or(outcome = 'ONGOING') THEN 'ONGOING' WHEN count(DISTINCT outcome) > 1 THEN 'UNCLEAR' ELSE min(outcome) END AS outcome,
  CASE WHEN count(DISTINCT outcome) > 1 THEN 'made of ' || count(*) || ' cases whose outcomes differ' END AS outcome_note, count(*) AS n_cases, min(filed) AS filed,
  CASE max(CASE pr WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 1 ELSE 0 END) WHEN 2 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS tier, string_agg(DISTINCT pr, ',' ORDER BY pr) AS notes, string_agg(k::VARCHAR, ',' ORDER BY day NULLS LAST, k) AS dockets FROM c GROUP BY party"""
)
def merged_cases(spark: SparkSession, d: str) -> DataFrame:
    k, o, pr = F.col("o_custkey"), F.col("o_orderkey"), F.col("o_orderpriority")
    day = F.to_date("o_orderdate")
    cases = b.table(spark, d, "orders").select(
        o.alias("case_id"),
        F.concat(F.lit("p"), (k % 40).cast("string")).alias("plaintiff"),
        F.concat(F.lit("d"), (k % 9).cast("string")).alias("defendant"),
        F.when(k % 5 > 0, k % 40).alias("plaintiff_id"),
        F.when(k % 7 > 0, k % 9).alias("defendant_id"),
        F.when(o % 97 == 0, "ONGOING").when((k % 40 % 3 == 0) | (F.col("o_orderstatus") == "F"), "SETTLED").otherwise("DISMISSED").alias("outcome"),
        F.when(pr == "1-URGENT", "HIGH").when(pr == "2-HIGH", "MEDIUM").otherwise("LOW").alias("tier"),
        pr.alias("note"),
        F.array(F.struct(F.when(o % 13 > 0, day).alias("filed"), o.alias("docket_id"))).alias("dockets"),
        day.alias("filed"),
    )
    dockets = F.array_join(F.transform("dockets", lambda x: x["docket_id"].cast("string")), ",")
    return detail.merged_cases(cases).select("plaintiff", "defendant", "outcome", "outcome_note", "n_cases", "filed", "tier", F.array_join("notes", ",").alias("notes"), dockets.alias("dockets"))


@query("SELECT user_id AS product_id, arg_max(struct_pack(c := event_type, l := (ts + INTERVAL 1 YEAR)::DATE, f := ts::DATE), struct_pack(a := ts::DATE, b := event_id))['c'] AS counterparty, arg_max((ts + INTERVAL 1 YEAR)::DATE, struct_pack(a := ts::DATE, b := event_id)) AS licensed_entry, max(ts)::DATE AS filed FROM events GROUP BY user_id, lower(event_type)")
def latest_disclosures(spark: SparkSession, d: str) -> DataFrame:
    e = b.table(spark, d, "events").select(F.col("user_id").alias("product_id"), F.col("event_type").alias("counterparty"), F.to_date(F.col("ts") + F.expr("interval 1 year")).alias("licensed_entry"), F.to_date("ts").alias("filed"), F.col("event_id").alias("disclosure_id"))
    return detail.latest_disclosures(e).select("product_id", "counterparty", "licensed_entry", "filed")


@query(
    b.SQL
    + """, c AS (SELECT source, product_id, marketing_date AS m FROM marketed WHERE marketing_date <= DATE '1999-01-20'), f AS (SELECT source, product_id, min(m) AS marketed FROM c GROUP BY ALL),
n AS (SELECT c.source, c.product_id, marketed, count(*) AS n_first FROM c JOIN f ON c.source = f.source AND c.product_id = f.product_id AND m = marketed GROUP BY ALL),
l AS (SELECT 'A' AS source, o_orderkey::VARCHAR AS product_id, DATE '1996-06-01' + (o_orderkey % 900)::INT AS licensed FROM orders WHERE o_orderkey % 3 = 0),
e AS (SELECT * REPLACE (CASE WHEN product_id::BIGINT % 4 > 0 THEN estimate END AS estimate) FROM est)
SELECT e.source, e.product_id, n_first, coalesce(marketed, CASE WHEN estimate IS NULL OR licensed < estimate THEN licensed END, estimate) AS entry_date,
  CASE WHEN marketed IS NOT NULL THEN 'marketed' WHEN licensed < estimate OR (estimate IS NULL AND licensed IS NOT NULL) THEN 'licensed' WHEN estimate IS NOT NULL THEN 'estimate' END AS basis FROM e LEFT JOIN n USING (source, product_id) LEFT JOIN l USING (source, product_id)"""
)
def entry_precedence(spark: SparkSession, d: str) -> DataFrame:
    sold = b.marketed(spark, d).withColumnRenamed("marketing_date", "first_marketing")
    k = F.col("o_orderkey")
    licences = b.table(spark, d, "orders").filter(k % 3 == 0).select(F.lit("A").alias("source"), k.cast("string").alias("product_id"), F.date_add(F.lit(dt.date(1996, 6, 1)), (k % 900).cast("int")).alias("licensed_entry"))
    some = _est(spark, d).withColumn("estimate", F.when(F.col("product_id").cast("long") % 4 > 0, F.col("estimate")))  # the others as if nothing were listed
    return detail.entry_facts(some, sold, licences, dt.date(1999, 1, 20)).select("source", "product_id", "n_first", "entry_date", "basis")


# --- scalar functions ------------------------------------------------------------------------------

_NAMES = "CASE p_partkey % 8 WHEN 0 THEN p_name || ' SODIUM' WHEN 1 THEN 'Adali' || 'mumab' WHEN 2 THEN 'elivaldogene autotemcel' WHEN 3 THEN 'ATORVASTATIN calcium; ' || p_name WHEN 4 THEN 'Nystatin/' || p_name WHEN 5 THEN 'axicabtagene ciloleucel' WHEN 6 THEN 'measles VACCINE, live' ELSE 'LOSARTAN (potassium)' END"


@query(
    f"""WITH n AS (SELECT p_partkey, {_NAMES} AS name FROM part)
SELECT p_partkey, CASE p_partkey % 8 WHEN 1 THEN 'MONOCLONAL_ANTIBODY' WHEN 2 THEN 'GENE_THERAPY' WHEN 5 THEN 'CELL_THERAPY' WHEN 6 THEN 'VACCINE' ELSE 'SMALL_MOLECULE' END AS modality,
  CASE p_partkey % 8 WHEN 3 THEN 'Statin' WHEN 7 THEN 'Angiotensin receptor blocker (ARB)' END AS drug_class,
  array_to_string(list_filter(list_transform(regexp_split_to_array(lower(name), '[\\s;,()/]+'), lambda t: regexp_replace(t, '[^a-z]', '', 'g')), lambda t: t <> '' AND t NOT IN ('sodium', 'calcium', 'potassium')), ' ') AS tokens FROM n"""
)
def token_classify(spark: SparkSession, d: str) -> DataFrame:
    rows = b.table(spark, d, "part").select("p_partkey", F.expr(_NAMES).alias("name"))
    return rows.select("p_partkey", classify.modality(F.col("name"), "SMALL_MOLECULE").alias("modality"), classify.drug_class(F.col("name")).alias("drug_class"), F.array_join(classify.tokens(F.col("name")), " ").alias("tokens"))


@query(
    """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%-d-%b-%y') WHEN 1 THEN strftime(o_orderdate, '%B %-d, %Y') ELSE 'Date TBD' END AS raw, o_orderdate::DATE AS day FROM orders)
SELECT o_orderkey, raw, CASE WHEN o_orderkey % 3 < 2 THEN day END AS parsed FROM t"""
)
def date_parse_pivot(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    raw = F.when(k == 0, F.date_format("o_orderdate", "d-MMM-yy")).when(k == 1, F.date_format("o_orderdate", "MMMM d, yyyy")).otherwise("Date TBD")
    return b.table(spark, d, "orders").select("o_orderkey", raw.alias("raw")).select("o_orderkey", "raw", dates.pivot_year_date(F.col("raw")).alias("parsed"))


@query("SELECT o_orderkey, make_date(year(o_orderdate), 1, 1) + to_months((month(o_orderdate) + 3)::INT) + to_days((day(o_orderdate) + 4)::INT) AS parsed FROM orders")
def date_roll_over(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat_ws("/", (F.month("o_orderdate") + 4).cast("string"), (F.day("o_orderdate") + 5).cast("string"), F.year("o_orderdate").cast("string"))
    return b.table(spark, d, "orders").select("o_orderkey", dates.rolling_date(raw).cast("timestamp").alias("parsed"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey, (CASE WHEN l_suppkey % 5 > 0 THEN l_shipdate::DATE + INTERVAL 20 YEAR ELSE l_shipdate::DATE END + to_days((l_quantity * 10)::INT))::DATE AS expiry FROM lineitem")
def term_math(spark: SparkSession, d: str) -> DataFrame:
    ship = F.to_date("l_shipdate")
    number = F.when(F.col("l_suppkey") % 5 > 0, F.col("l_suppkey").cast("string")).otherwise(F.concat(F.lit("RE"), F.col("l_suppkey").cast("string")))
    return b.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", dates.term_expiry(ship, ship, number, (F.col("l_quantity") * 10).cast("int")).alias("expiry"))


@query("SELECT CASE WHEN d <= 0 THEN 'open' WHEN d <= 180 THEN 'imminent' WHEN d <= 730 THEN 'upcoming' ELSE 'distant' END AS urgency, count(*) AS n FROM (SELECT datediff('day', DATE '1999-01-01', l_shipdate::DATE) AS d FROM lineitem) GROUP BY 1")
def urgency_buckets(spark: SparkSession, d: str) -> DataFrame:
    rows = b.table(spark, d, "lineitem").select(dates.urgency(F.to_date("l_shipdate"), F.lit(b.AS_OF)).alias("urgency"))
    return rows.groupBy("urgency").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&#160;', ' '), '&rsquo;', chr(39)), '&amp;', '&'), '\\s+', ' ', 'g')) AS body FROM pages")
def html_strip(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "pages").select("page_id", text.strip_html(F.col("html")).alias("body"))


@query(
    """WITH t AS (SELECT unnest(regexp_extract_all(html, '(?is)(<a\\s[^>]*>.*?</a>)', 1)) AS tag FROM pages),
s AS (SELECT tag, concat_ws(' ', regexp_replace(tag, '<[^>]*>', ' ', 'g'), regexp_extract(tag, '(?is)^<a\\s[^>]*title="([^"]*)"', 1)) AS said FROM t)
SELECT href, count(*) AS n FROM (SELECT regexp_extract(tag, '(?is)^<a\\s[^>]*href="([^"]*)"', 1) AS href FROM s WHERE contains(lower(said), 'e')) WHERE href <> '' GROUP BY 1"""
)
def html_links(spark: SparkSession, d: str) -> DataFrame:
    return monthly.links(b.table(spark, d, "pages"), "E").groupBy("href").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, (props::JSON->>'k')::INT AS k FROM events WHERE (props::JSON->>'k')::INT >= 50")
def json_first(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")).filter("k >= 50")


@query("SELECT o_orderkey, plaintiff, defendant FROM (SELECT o_orderkey, trim(split_part(c, '|', 1)) AS plaintiff, trim(split_part(c, '|', 2)) AS defendant FROM (SELECT o_orderkey, 'Brand ' || o_custkey || '|' || o_clerk AS c FROM (SELECT *, 'Generic ' || o_orderstatus AS o_clerk FROM orders) WHERE o_orderkey % 3 < 2))")
def caption_sides(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    between = F.when(k == 0, " v. ").when(k == 1, "  VS. ").otherwise(" and ")
    caption = F.concat(F.lit("Brand "), F.col("o_custkey").cast("string"), between, F.lit("Generic "), F.col("o_orderstatus"))
    rows = b.table(spark, d, "orders").select("o_orderkey", parties.sides(caption).alias("s")).filter("s IS NOT NULL")
    return rows.select("o_orderkey", "s.plaintiff", "s.defendant")


_TRIGRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(
    b.SQL
    + f""", t AS (SELECT product_id, source, name, alt_name, {_TRIGRAMS.format("name")} AS a, {_TRIGRAMS.format("'widge'")} AS q FROM products),
s AS (SELECT *, len(list_intersect(a, q)) / len(list_distinct(list_concat(a, q)))::DOUBLE AS score FROM t)
SELECT product_id, source, name, alt_name, score FROM (SELECT *, row_number() OVER (PARTITION BY source, name ORDER BY product_id) AS nth FROM s WHERE contains(lower(name), 'widge') OR score >= 0.3) WHERE nth = 1 ORDER BY score DESC, name, source LIMIT 25"""
)
def autocomplete_trigram(spark: SparkSession, d: str) -> DataFrame:
    return search.autocomplete(b.products(spark, d), "widge", 25)


# --- sources, ranges, snapshots ----------------------------------------------------------------------

_MARKED = """WITH r AS (SELECT l_orderkey, l_partkey % 3 AS patent, l_shipdate::DATE AS day, l_linenumber AS line, l_suppkey, l_partkey, l_quantity, l_extendedprice, l_returnflag = 'R' AS ped FROM lineitem),
p AS (SELECT l_orderkey, patent, day FROM r WHERE NOT ped QUALIFY row_number() OVER (PARTITION BY l_orderkey, patent ORDER BY line, l_partkey, l_suppkey, l_extendedprice) = 1),
m AS (SELECT l_orderkey, patent, day FROM r WHERE ped QUALIFY row_number() OVER (PARTITION BY l_orderkey, patent ORDER BY line, l_partkey, l_suppkey, l_extendedprice) = 1)
SELECT coalesce(p.l_orderkey, m.l_orderkey) AS l_orderkey, coalesce(p.patent, m.patent) AS patent, coalesce(p.day, m.day) AS nominal, coalesce(m.day, p.day) AS effective, datediff('day', p.day, m.day)::INT AS days
FROM p FULL JOIN m ON p.l_orderkey = m.l_orderkey AND p.patent = m.patent"""


@query(_MARKED)
def ped_pivot_merge(spark: SparkSession, d: str) -> DataFrame:
    li = b.table(spark, d, "lineitem")
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = li.select("l_orderkey", (F.col("l_partkey") % 3).alias("patent"), place.alias("line"), F.lit("").alias("raw"), F.lit("").alias("expires"), F.to_date("l_shipdate").alias("date"), *[F.lit("").alias(c) for c in ("substance", "product", "submitted")], F.when(F.col("l_returnflag") == "R", "PED").otherwise("").alias("marker"))
    merged, _ = tilde.merge_marked(rows, ["l_orderkey", "patent"], "x")
    p, m = F.col("plain.date"), F.col("marked.date")
    return merged.select("l_orderkey", "patent", F.coalesce(p, m).alias("nominal"), F.coalesce(m, p).alias("effective"), F.datediff(m, p).alias("days"))


@query(
    """WITH i AS (SELECT user_id % 5 AS page, event_type AS str, value AS x, event_id % 500 + 0.5 AS y, event_id FROM events), bands AS (SELECT page, n * 50.0 AS y1, n * 50.0 + 30 AS y2, n AS band FROM (SELECT unnest(range(10)) AS n), (SELECT unnest(range(5)) AS page))
SELECT event_id, band, CASE WHEN x < 10 THEN 0 WHEN x < 25 THEN 1 WHEN x < 60 THEN 2 ELSE 2 END AS "column" FROM i JOIN bands USING (page) WHERE y BETWEEN y1 - 0.75 AND y2 + 0.75"""
)
def range_join_bands(spark: SparkSession, d: str) -> DataFrame:
    e = b.table(spark, d, "events").select((F.col("user_id") % 5).alias("page"), F.col("event_id").cast("string").alias("str"), F.col("value").alias("x"), (F.col("event_id") % 500 + 0.5).alias("y"))
    bands = spark.range(50).select((F.col("id") % 5).alias("page"), F.floor(F.col("id") / 5).alias("band")).select("page", (F.col("band") * 50.0).alias("y1"), (F.col("band") * 50.0 + 30).alias("y2"), "band")
    return layout.in_bands(e, bands, [0.0, 10.0, 25.0, 60.0]).select(F.col("str").cast("long").alias("event_id"), "band", "column")


@query(
    """WITH i AS (SELECT 'unknown ' || event_type || ' "…"' AS category, event_id, props FROM events UNION ALL SELECT 'no value', event_id, props FROM events WHERE value < 5),
n AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY event_id, props) AS nth FROM i)
SELECT category, count(*) AS n, string_agg(props, '|' ORDER BY nth) FILTER (nth <= 3) AS examples FROM n GROUP BY 1 ORDER BY n DESC, category LIMIT 20"""
)
def issue_categories(spark: SparkSession, d: str) -> DataFrame:
    e = b.table(spark, d, "events")
    said = e.select(F.lit("events").alias("file"), F.col("event_id").alias("line"), F.concat(F.lit("unknown "), F.col("event_type"), F.lit(' "'), F.col("user_id").cast("string"), F.lit('"')).alias("reason"), F.col("props").alias("raw"))
    empty = e.filter("value < 5").select(F.lit("events").alias("file"), F.col("event_id").alias("line"), F.lit("no value").alias("reason"), F.col("props").alias("raw"))
    return tilde.issue_categories(said.unionByName(empty)).select("category", "n", F.array_join("examples", "|").alias("examples"))


_NEW = "SELECT c_custkey + 700 AS c_custkey, upper(c_name) AS c_name, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS c_acctbal FROM customer"


@query(f"SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NOT NULL THEN n.c_name ELSE o.c_name END AS c_name, CASE WHEN o.c_acctbal > 5000 THEN o.c_acctbal WHEN n.c_custkey IS NOT NULL THEN n.c_acctbal ELSE o.c_acctbal END AS c_acctbal, o.c_mktsegment FROM customer o FULL JOIN ({_NEW}) n ON o.c_custkey = n.c_custkey")
def upsert_snapshot(spark: SparkSession, d: str) -> DataFrame:
    old = b.table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    new = old.select((F.col("c_custkey") + 700).alias("c_custkey"), F.upper("c_name").alias("c_name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("c_acctbal"))
    return store.upsert(old, new, ["c_custkey"], {"c_acctbal": F.col("o.c_acctbal") > 5000})


@query(f"SELECT n.c_custkey, CASE WHEN o.c_custkey IS NULL THEN 'inserted' ELSE 'updated' END AS change FROM ({_NEW}) n LEFT JOIN customer o ON o.c_custkey = n.c_custkey")
def upsert_changes(spark: SparkSession, d: str) -> DataFrame:
    old = b.table(spark, d, "customer").select("c_custkey", "c_name")
    return store.changes(old, old.select((F.col("c_custkey") + 700).alias("c_custkey"), F.upper("c_name").alias("c_name")), ["c_custkey"])


@query("SELECT p_partkey, p_name FROM part WHERE p_size <= 25 UNION ALL SELECT p_partkey, upper(p_name) FROM part WHERE p_size > 25 AND p_type = 'ECONOMY'")
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    p = b.table(spark, d, "part")
    new = p.filter("p_type = 'ECONOMY'").select("p_partkey", F.upper("p_name").alias("p_name"))
    return store.insert_if_absent(p.filter("p_size <= 25").select("p_partkey", "p_name"), new, ["p_partkey"])


@query("WITH o AS (SELECT DISTINCT o_custkey AS owner, o_orderkey AS item FROM orders WHERE o_orderstatus <> 'P'), n AS (SELECT DISTINCT o_custkey AS owner, o_orderkey + 1 AS item FROM orders WHERE o_orderpriority = '1-URGENT') SELECT * FROM o WHERE owner NOT IN (SELECT owner FROM n) UNION ALL SELECT * FROM n")
def link_rebuild(spark: SparkSession, d: str) -> DataFrame:
    o = b.table(spark, d, "orders")
    old = o.filter("o_orderstatus != 'P'").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("item")).distinct()
    return store.replace_links(old, o.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("owner"), (F.col("o_orderkey") + 1).alias("item")), "owner")


@query("SELECT o_custkey AS owner, o_orderpriority AS item FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O'")
def link_additive(spark: SparkSession, d: str) -> DataFrame:
    o = b.table(spark, d, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("item"), "o_orderstatus")
    return store.add_links(o.filter("o_orderstatus = 'F'").select("owner", "item"), o.filter("o_orderstatus = 'O'").select("owner", "item"))


@query("WITH a AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 60), z AS (SELECT DISTINCT user_id, event_type FROM events WHERE value < 3) (FROM a EXCEPT FROM z) UNION ALL (FROM z EXCEPT FROM a)")
def toggle_rows(spark: SparkSession, d: str) -> DataFrame:
    e = b.table(spark, d, "events")
    return store.toggle(e.filter("value > 60").select("user_id", "event_type").distinct(), e.filter("value < 3").select("user_id", "event_type"))


@query("SELECT event_type AS source, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS run_id, max(ts) AS started_at FROM events GROUP BY 1")
def latest_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = b.table(spark, d, "events").select(F.col("event_type").alias("source"), F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"))
    return store.latest_runs(runs)


@query("SELECT category, sum(bf)::BIGINT AS before, sum(af)::BIGINT AS after FROM (SELECT o_orderpriority AS category, 1 AS bf, 0 AS af FROM orders UNION ALL SELECT CASE WHEN o_orderstatus = 'P' THEN 'PENDING' ELSE o_orderpriority END, 0, 1 FROM orders) GROUP BY 1")
def before_after_histogram(spark: SparkSession, d: str) -> DataFrame:
    o = b.table(spark, d, "orders").select("o_orderpriority", F.when(F.col("o_orderstatus") == "P", "PENDING").otherwise(F.col("o_orderpriority")).alias("new"))
    return stats.before_and_after(o, "o_orderpriority", "new")


@query(
    """WITH p AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS patent_number, l_shipdate::DATE AS nominal, l_suppkey % 5 AS s, (l_quantity * 100)::INT AS days FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey ORDER BY l_suppkey, l_extendedprice) = 1)
SELECT patent_number, CASE s WHEN 0 THEN NULL WHEN 1 THEN CASE WHEN days % 200 = 0 THEN 'denied' ELSE 'error' END WHEN 2 THEN 'no_data' ELSE CASE WHEN days > 3650 THEN 'flagged' ELSE 'updated' END END AS outcome,
  CASE WHEN s >= 3 AND days <= 3650 THEN nominal + days ELSE nominal END AS expiry, CASE WHEN s >= 3 AND days <= 3650 THEN days END AS adjustment_days FROM p"""
)
def term_enrichment(spark: SparkSession, d: str) -> DataFrame:
    li = b.table(spark, d, "lineitem")
    one = estimate.first_seen(li, ["l_orderkey", "l_linenumber", "l_partkey"], ["l_suppkey", "l_extendedprice"])
    rows = one.select(F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")]).alias("patent_number"), F.to_date("l_shipdate").alias("day"), (F.col("l_suppkey") % 5).alias("s"), (F.col("l_quantity") * 100).cast("int").alias("days"))
    patents = rows.select("patent_number", F.col("day").alias("nominal_expiry"), F.col("day").alias("expiry"), F.lit(None).cast("int").alias("adjustment_days"), F.lit(None).cast("date").alias("filing_date"))
    answers = rows.filter("s > 0").select("patent_number", F.when((F.col("s") == 1) & (F.col("days") % 200 == 0), "denied").when(F.col("s") == 1, "error").when((F.col("s") == 2) & (F.col("days") % 200 == 0), "not_found").otherwise("ok").alias("status"), F.when(F.col("s") != 2, F.add_months("day", -240)).alias("filing"), "days")
    return enrich.outcomes(patents, answers).select("patent_number", "outcome", "expiry", "adjustment_days")


@query(
    """SELECT event_id AS patent_number, CASE event_id % 11 WHEN 0 THEN 'not_found' WHEN 1 THEN 'denied' WHEN 2 THEN 'error' WHEN 3 THEN 'error' WHEN 7 THEN 'ok' WHEN 8 THEN 'ok' WHEN 9 THEN 'error' WHEN 10 THEN 'ok' ELSE 'not_found' END AS status,
  CASE WHEN event_id % 11 IN (7, 10) THEN ts::DATE END AS filing, CASE WHEN event_id % 11 IN (7, 8, 10) THEN user_id::INT END AS days FROM events"""
)
def term_responses(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 11
    days = lambda c: F.struct(F.struct(c.alias("adjustmentTotalQuantity")).alias("patentTermAdjustmentData"), F.struct(F.to_date("ts").cast("string").alias("filingDate")).alias("applicationMetaData"))
    bag = lambda *entries: F.concat(F.lit('{"patentFileWrapperDataBag":['), F.concat_ws(",", *entries), F.lit("]}"))
    whole, as_text = F.to_json(days(F.col("user_id"))), F.to_json(days(F.col("user_id").cast("string")))
    no_date = F.to_json(F.struct(F.struct(F.col("user_id").alias("adjustmentTotalQuantity")).alias("patentTermAdjustmentData"), F.struct(F.lit(5).alias("filingDate")).alias("applicationMetaData")))
    other = F.lit('{"applicationMetaData":{"filingDate":"1999-01-01"},"patentTermAdjustmentData":null}')
    body = F.when(k == 3, whole).when(k == 4, "{}").when(k == 5, bag()).when(k == 6, bag(as_text)).when(k == 7, bag(other, whole, as_text)).when(k == 8, bag(no_date)).when(k == 9, "no JSON").when(k == 10, bag(whole))
    code = F.when(k == 0, 404).when(k == 1, 403).when(k == 2, 500).when(k == 3, 429).otherwise(200)
    return responses.terms(b.table(spark, d, "events").select(F.col("event_id").alias("patent_number"), code.alias("code"), body.alias("body")))


@query("SELECT s_suppkey, 'https://x.org/data/' || CASE WHEN s_suppkey = 0 THEN '0' ELSE s_suppkey::VARCHAR END || '/' || replace('0001-22-' || s_suppkey, '-', '') || '/a.htm' AS address FROM supplier")
def filing_addresses(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    rows = b.table(spark, d, "supplier")
    return rows.select("s_suppkey", responses.filing_address("https://x.org/data/", F.lpad(k, 10, "0"), F.concat(F.lit("0001-22-"), k), F.lit("a.htm")).alias("address"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'Pre-MMA' WHEN 'F' THEN 'Before ' || strftime(o_orderdate, '%b %-d, %Y') ELSE strftime(o_orderdate, '%b %-d, %Y') END AS label, last_day(o_orderdate::DATE) AS month_end FROM orders")
def submission_labels(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "P", "PRE_MMA").when(F.col("o_orderstatus") == "F", "RECEIVED_PRIOR_TO").otherwise("EXACT_DATE")
    day = F.to_date("o_orderdate")
    return b.table(spark, d, "orders").select("o_orderkey", display.submission_label(kind, day).alias("label"), display.month_end(day).alias("month_end"))


@query("SELECT e.user_id, event_id, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS source, coalesce(c_name, p_name) AS name, coalesce(c_mktsegment, p_brand) AS company FROM events e LEFT JOIN customer ON event_id % 2 = 0 AND c_custkey = user_id LEFT JOIN part ON event_id % 2 = 1 AND p_partkey = user_id")
def watchlist_join(spark: SparkSession, d: str) -> DataFrame:
    items = b.table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 2 == 0, "A").otherwise("B").alias("source"), F.col("user_id").cast("string").alias("product_id"))
    a = b.table(spark, d, "customer").select(F.lit("A").alias("source"), F.col("c_custkey").cast("string").alias("product_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("company"))
    z = b.table(spark, d, "part").select(F.lit("B").alias("source"), F.col("p_partkey").cast("string").alias("product_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("company"))
    return store.watchlist(items, a.unionByName(z)).select("user_id", "event_id", "source", "name", "company")
