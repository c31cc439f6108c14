"""The canonical tables bound to the star schema of the test data.

Products of source A are orders with their customers, those of source B are
parts. Line items are children of both: of status F patents, of status O
exclusivities. The SQL below says the same for DuckDB.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The day that stands for today.
AS_OF = dt.date(1999, 1, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.lit("A").alias("source"),
        F.col("o_orderkey").cast("string").alias("product_id"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"),
        F.col("c_mktsegment").alias("alt_name"),
        F.col("c_name").alias("company"),
        F.col("o_orderpriority").alias("modality"),
        F.lit(None).cast("string").alias("drug_class"),
        F.col("o_orderstatus").alias("application_type"),
        F.col("c_mktsegment").alias("dosage_form"),
        F.lit(None).cast("string").alias("route"),
    )
    b = table(spark, sf_dir, "part").select(
        F.lit("B").alias("source"),
        F.col("p_partkey").cast("string").alias("product_id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("alt_name"),
        F.col("p_brand").alias("company"),
        F.lit("UNCLASSIFIED").alias("modality"),
        F.when(F.col("p_size") < 25, "small").alias("drug_class"),
        F.lit(None).cast("string").alias("application_type"),
        F.col("p_type").alias("dosage_form"),
        F.col("p_size").cast("string").alias("route"),
    )
    return a.unionByName(b)


def _children(spark: SparkSession, sf_dir: str, status: str) -> DataFrame:
    """Line items of a status, once as a child of their order and once of their part; one scan."""
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_linestatus") == status)
    owner = F.explode(F.array(F.struct(F.lit("A").alias("source"), F.col("l_orderkey").alias("id")), F.struct(F.lit("B").alias("source"), F.col("l_partkey").alias("id"))))
    return rows.withColumn("_o", owner).withColumn("source", F.col("_o.source")).withColumn("product_id", F.col("_o.id").cast("string"))


def patents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _children(spark, sf_dir, "F")
    gap = F.when(F.col("l_quantity") < 25, F.col("l_quantity").cast("int"))
    return rows.select(
        "source",
        "product_id",
        F.concat_ws("-", F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string")).alias("patent_number"),
        F.when(F.col("l_tax") >= 0.04, F.concat(F.lit("U-"), F.col("l_linenumber").cast("string"))).otherwise("").alias("use_code"),
        F.date_sub(F.to_date("l_shipdate"), F.coalesce(gap, F.lit(0))).alias("nominal_expiry"),
        F.to_date("l_shipdate").alias("expiry"),
        gap.alias("adjustment_days"),
        (F.col("l_discount") < 0.03).alias("covers_substance"),
        (F.col("l_discount") > 0.07).alias("covers_product"),
        (F.col("l_returnflag") != "R").alias("live"),
    )


def exclusivities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _children(spark, sf_dir, "O").select("source", "product_id", F.col("l_returnflag").alias("code"), F.to_date("l_shipdate").alias("expiry"))


def marketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases, moved back 25 years, as marketing of the user's orders."""
    events = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.col("user_id"), F.to_date(F.col("ts") - F.expr("interval 25 years")).alias("marketing_date"))
    orders = table(spark, sf_dir, "orders").select(F.lit("A").alias("source"), F.col("o_orderkey").cast("string").alias("product_id"), F.col("o_custkey").alias("user_id"))
    return orders.join(events, "user_id").select("source", "product_id", "marketing_date")


#: The same in SQL: common table expressions products, patents, exclusivities, est, marketed.
SQL = """
WITH products AS (
  SELECT 'A' AS source, o_orderkey::VARCHAR AS product_id, 'order ' || o_orderkey AS name, c_mktsegment AS alt_name, c_name AS company, o_orderpriority AS modality,
    NULL::VARCHAR AS drug_class, o_orderstatus AS application_type, c_mktsegment AS dosage_form, NULL::VARCHAR AS route FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT 'B', p_partkey::VARCHAR, p_name, p_brand, p_brand, 'UNCLASSIFIED', CASE WHEN p_size < 25 THEN 'small' END, NULL, p_type, p_size::VARCHAR FROM part),
li AS (SELECT 'A' AS source, l_orderkey::VARCHAR AS product_id, * FROM lineitem UNION ALL SELECT 'B', l_partkey::VARCHAR, * FROM lineitem),
patents AS (SELECT source, product_id, l_suppkey || '-' || l_linenumber AS patent_number, CASE WHEN l_tax >= 0.04 THEN 'U-' || l_linenumber ELSE '' END AS use_code,
    l_shipdate::DATE AS expiry, CASE WHEN l_quantity < 25 THEN l_quantity::INT END AS adjustment_days, l_discount < 0.03 AS covers_substance, l_discount > 0.07 AS covers_product,
    l_returnflag <> 'R' AS live FROM li WHERE l_linestatus = 'F'),
exclusivities AS (SELECT source, product_id, l_returnflag AS code, l_shipdate::DATE AS expiry FROM li WHERE l_linestatus = 'O'),
ps AS (SELECT source, product_id, max(expiry) FILTER (live) AS patent_date, max(expiry) FILTER (live AND adjustment_days IS NOT NULL) AS verified_date, count(*) AS patent_count,
    max(adjustment_days) FILTER (live) AS max_gap_days FROM patents GROUP BY ALL),
es AS (SELECT source, product_id, max(expiry) AS exclusivity_date, count(*) AS exclusivity_count FROM exclusivities GROUP BY ALL),
est0 AS (SELECT p.*, patent_date, verified_date, coalesce(patent_count, 0) AS patent_count, max_gap_days, exclusivity_date, coalesce(exclusivity_count, 0) AS exclusivity_count,
    greatest(patent_date, exclusivity_date) AS estimate FROM products p LEFT JOIN ps USING (source, product_id) LEFT JOIN es USING (source, product_id)),
est AS (SELECT *, CASE WHEN estimate IS NULL THEN NULL WHEN exclusivity_date = estimate OR verified_date = estimate THEN 'confirmed' ELSE 'pending_verification' END AS confidence FROM est0),
marketed AS (SELECT 'A' AS source, o_orderkey::VARCHAR AS product_id, (ts - INTERVAL 25 YEAR)::DATE AS marketing_date FROM orders JOIN events ON o_custkey = user_id WHERE event_type = 'purchase')
"""
