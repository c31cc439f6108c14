"""Patent terms from a second source: candidates, outcomes and the guarded update."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.dates import term_expiry

#: An effective date so many days beyond the nominal one is not believed.
MOST_DAYS = 3650


def candidates(patents: DataFrame, records: DataFrame, source: str, limit: int | None = None) -> DataFrame:
    """Patents without a record of that source, the soonest to expire first, by the date that is in effect."""
    seen = records.filter(F.col("source") == source).select(F.col("entity_id").alias("patent_number")).distinct()
    rows = patents.join(seen, "patent_number", "left_anti").orderBy("expiry", "patent_number")
    return rows if limit is None else rows.limit(limit)


def suspicious(patents: DataFrame, limit: int) -> DataFrame:
    """The largest adjustments beyond what is believed, to be checked again, whether there is a record of them or not."""
    return patents.filter(F.col("adjustment_days") > MOST_DAYS).orderBy(F.desc("adjustment_days"), "patent_number").limit(limit)


def outcomes(patents: DataFrame, responses: DataFrame) -> DataFrame:
    """Patents with the outcome of their response and the values that follow.

    responses: patent_number, status (ok, not_found, denied, error), filing, days. Outcomes:
    denied and error (nothing is known, to be asked again), no_data (not found, or found without
    a filing date), flagged (too long a term: dates go back to the nominal one and the adjustment
    to unknown) and updated: the adjustment is the days between the nominal and the new date.
    Without a response a patent stays as it is.
    """
    r = responses.select("patent_number", F.col("status").alias("_status"), F.col("filing").alias("_filing"), F.col("days").alias("_days"))
    joined = patents.join(r, "patent_number", "left")
    expiry = term_expiry(F.col("nominal_expiry"), F.col("_filing"), F.col("patent_number"), F.col("_days"))
    joined = joined.withColumn("_new", expiry)
    outcome = (
        F.when(F.col("_status").isNull(), None)
        .when(F.col("_status").isin("error", "denied"), F.col("_status"))
        .when((F.col("_status") == "not_found") | F.col("_filing").isNull(), "no_data")
        .when(F.datediff("_new", "nominal_expiry") > MOST_DAYS, "flagged")
        .otherwise("updated")
    )
    joined = joined.withColumn("outcome", outcome)
    updated, flagged = F.col("outcome") == "updated", F.col("outcome") == "flagged"
    return joined.withColumns(
        {
            "expiry": F.when(updated, F.col("_new")).when(flagged, F.col("nominal_expiry")).otherwise(F.col("expiry")),
            "adjustment_days": F.when(updated, F.datediff("_new", "nominal_expiry")).when(flagged, F.lit(None)).otherwise(F.col("adjustment_days")),
            "filing_date": F.when(updated, F.col("_filing")).otherwise(F.col("filing_date")),
        }
    ).drop("_status", "_filing", "_days", "_new")


def until_denied(responses: DataFrame, order: str) -> DataFrame:
    """The responses up to the first that was denied, which ends a run; all of them if none was."""
    stop = responses.filter("status = 'denied'").agg(F.min(order)).first()[0]
    return responses if stop is None else responses.filter(F.col(order) <= F.lit(stop))


def preview(responses: DataFrame) -> DataFrame:
    """What a person is shown before entering a patent: patent_number, status, filing, standard, nominal_expiry, expiry, adjustment_days.

    Dates are worked out for standard numbers alone; for others the days are told and the rest is theirs to enter.
    """
    found = (F.col("status") == "ok") & F.col("filing").isNotNull()
    standard = F.coalesce(F.col("patent_number").rlike("^[0-9]+$"), F.lit(False))
    days = F.coalesce("days", F.lit(0))
    nominal = F.when(found & standard, F.add_months("filing", 240))
    return responses.select(
        "patent_number",
        F.when(found, "found").when(F.col("status").isin("ok", "not_found"), "not_found").otherwise("error").alias("status"),
        F.when(found, F.col("filing")).alias("filing"),
        standard.alias("standard"),
        nominal.alias("nominal_expiry"),
        F.date_add(nominal, days).alias("expiry"),
        F.when(found, days).alias("adjustment_days"),
    )
