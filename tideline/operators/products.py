"""Rows of either source as unified products: source-neutral columns, with typed nulls where a source has none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a unified product; a listed product has an application type, a licensed one a licence type.
COLUMNS = ["source", "product_id", "name", "alt_name", "company_id", "company", "application_type", "license_type", "dosage_form", "route", "strength", "approval_date", "modality", "drug_class"]


def _projected(rows: DataFrame, companies: DataFrame, source: str, only: str) -> DataFrame:
    named = rows.join(companies.select("company_id", F.col("name").alias("_company")), "company_id")
    own: dict[str, Column] = {"source": F.lit(source), "company": F.col("_company")}
    own |= {c: F.col(c) if c == only else F.lit(None).cast("string") for c in ("application_type", "license_type")}
    return named.select(*[own.get(c, F.col(c)).alias(c) for c in COLUMNS])


def listed(rows: DataFrame, companies: DataFrame, source: str = "A") -> DataFrame:
    """Products of the list of applications. Rows of a company that is not known are left out, as every product has one."""
    return _projected(rows, companies, source, "application_type")


def licensed(rows: DataFrame, companies: DataFrame, source: str = "B") -> DataFrame:
    """Products of the list of licences. These have no challenges and no cases; what asks for them finds none."""
    return _projected(rows, companies, source, "license_type")


def unified(listed_rows: DataFrame, licensed_rows: DataFrame, companies: DataFrame) -> DataFrame:
    """Both lists as one set of products."""
    return listed(listed_rows, companies).unionByName(licensed(licensed_rows, companies))
