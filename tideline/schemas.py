"""Schemas of the canonical tables and the integrity rules over them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRODUCT = "source string, product_id string, name string, alt_name string, company string, modality string, drug_class string, application_type string, dosage_form string, route string, strength string, application_number string, product_number string"
PATENT = "source string, product_id string, patent_number string, use_code string, nominal_expiry date, expiry date, adjustment_days int, filing_date date, covers_substance boolean, covers_product boolean, live boolean"
EXCLUSIVITY = "source string, product_id string, code string, expiry date"
CHALLENGE = "challenge_id string, name string, active_ingredient string, dosage_form string, strength string, submission_date date, history array<struct<status:string,posting_date:date,raw_text:string>>, current_status string, first_marketing date"
CHALLENGE_LINK = "challenge_id string, product_id string"
PROVENANCE = "source string, entity_kind string, entity_id string, external_ref string, change_note string, raw_payload string, entered_by string, verified_at timestamp, created_at timestamp"
RUN = "run_id string, source string, status string, started_at timestamp, finished_at timestamp, rows_upserted long, rows_skipped long, summary string"

#: Types that an application may have (fixed values).
APPLICATION_TYPES = ("NDA", "ANDA", "BLA")


def exactly_one(*cols: str) -> Column:
    """Is exactly one of the columns not null?"""
    return reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in cols]) == 1


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The rows that break a rule, with the rule's name; a rule that gives null is broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.withColumn("rule", F.explode(broken))


def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys with several rows, nulls compared as equal, and how many."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def natural_id(*cols: str) -> Column:
    """An id that is the same at every run: the hash of the natural key."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), 256)
