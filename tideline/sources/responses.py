"""Staged responses of other services: JSON texts in a table, read with explicit types.

Tasks never call a service. Whatever fetches them stores one row per request; a row
that is no JSON, or lacks what it must have, is an issue and not a failure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a variant's schema says of numbers.
NUMBERS = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"


def field(value: Column, name: str, kind: str) -> Column:
    """A field of a JSON value if it is of that kind, as it is there: ``string``, ``number`` (as double), ``object`` or ``array`` (of values).

    Nothing is cast from one kind to another; a field that is missing, null or of another kind is null.
    """
    inner = F.try_variant_get(value, f"$.{name}", "variant")
    said = F.schema_of_variant(inner)
    if kind == "string":
        return F.when(said == "STRING", F.try_variant_get(inner, "$", "string"))
    if kind == "number":
        return F.when(said.rlike(NUMBERS), F.try_variant_get(inner, "$", "double"))
    if kind == "array":
        return F.when(said.startswith("ARRAY"), F.try_variant_get(inner, "$", "array<variant>"))
    return F.when(said.startswith("OBJECT"), inner)


def _words(value: Column, name: str) -> Column:
    """A text field that is not empty."""
    return F.nullif(field(value, name, "string"), F.lit(""))


def terms(responses: DataFrame) -> DataFrame:
    """(patent_number, status, filing, days) from (patent_number, code, body).

    403 stops a run and is kept as denied; other codes than 200 and 404, and bodies that are no JSON, are error. The
    first entry of the bag that has term data counts, else its first. not_found: 404, no entry, or one whose days are
    no number, so that a date that was not checked is never shown as confirmed. A readable filing date may be missing.
    """
    body = F.try_parse_json("body")
    bag = field(body, "patentFileWrapperDataBag", "array")
    entry = F.coalesce(F.get(F.filter(bag, lambda e: field(e, "patentTermAdjustmentData", "object").isNotNull()), F.lit(0)), F.get(bag, F.lit(0)))
    days = field(field(entry, "patentTermAdjustmentData", "object"), "adjustmentTotalQuantity", "number")
    filing = field(field(entry, "applicationMetaData", "object"), "filingDate", "string")
    read = responses.select("patent_number", "code", body.isNotNull().alias("_json"), days.alias("_days"), filing.try_cast("date").alias("_filing"))
    status = (
        F.when(F.col("code") == 403, "denied")
        .when(F.col("code") == 404, "not_found")
        .when((F.coalesce("code", F.lit(0)) != 200) | ~F.col("_json"), "error")
        .when(F.col("_days").isNull(), "not_found")
        .otherwise("ok")
    )
    read = read.withColumn("status", status)
    ok = F.col("status") == "ok"
    return read.select("patent_number", "status", F.when(ok, F.col("_filing")).alias("filing"), F.when(ok, F.col("_days").cast("int")).alias("days"))


def hits(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Search hits of (company_id, body), and issues for those without a number as id, or without the texts of a caption, a docket number and a court.

    Texts that may be missing are null also where they are empty.
    """
    found = field(F.try_parse_json("body"), "results", "array")
    h = F.col("h")
    rows = responses.select("company_id", F.explode(found).alias("h")).select(
        "company_id",
        field(h, "docket_id", "number").cast("long").alias("docket_id"),
        field(h, "caseName", "string").alias("caption"),
        field(h, "docketNumber", "string").alias("docket_number"),
        field(h, "court_id", "string").alias("court_id"),
        field(h, "dateFiled", "string").try_cast("date").alias("filed"),
        field(h, "dateTerminated", "string").try_cast("date").alias("terminated"),
        _words(h, "assignedTo").alias("judge"),
        _words(h, "suitNature").alias("nature"),
        _words(h, "cause").alias("cause"),
    )
    whole = F.col("docket_id").isNotNull() & F.col("caption").isNotNull() & F.col("docket_number").isNotNull() & F.col("court_id").isNotNull()
    return rows.filter(whole), rows.filter(~whole).withColumn("reason", F.lit("a hit without an id, a caption, a docket number or a court"))


def first_entry(responses: DataFrame) -> DataFrame:
    """(docket_id, status, text): the text of each docket's first entry, and what came of asking for it.

    ``responses``: docket_id, code, body. The body is what was asked for by entry number, so its first result is that entry; the
    first of the entry's documents with a text counts. denied (401, 403) ends a run; error: any other code
    than 200, or no JSON; missing: no entry; empty: no document with a text.
    """
    body = F.try_parse_json("body")
    entry = F.get(field(body, "results", "array"), F.lit(0))
    texts = F.filter(F.transform(field(entry, "recap_documents", "array"), lambda e: _words(e, "plain_text")), lambda t: t.isNotNull())
    read = responses.select("docket_id", "code", body.isNotNull().alias("_json"), entry.isNotNull().alias("_entry"), F.get(texts, F.lit(0)).alias("_text"))
    told = (
        F.when(F.col("code").isin(401, 403), "denied")
        .when((F.coalesce("code", F.lit(0)) != 200) | ~F.col("_json"), "error")
        .when(~F.col("_entry"), "missing")
        .when(F.col("_text").isNull(), "empty")
        .otherwise("found")
    )
    return read.withColumn("status", told).select("docket_id", "status", F.when(F.col("status") == "found", F.col("_text")).alias("text"))


def case_texts(dockets: DataFrame, entries: DataFrame) -> DataFrame:
    """(case_id, status, docket_id, text): the text of each case, of the first of its dockets that has one.

    dockets: case_id, docket_id, filed; entries: what :func:`first_entry` gave. Dockets are asked in the order of their filing,
    those without a date last. denied: the asking was refused before any text was found. Without a text a case
    is empty if any docket was, else missing, also where asking failed.
    """
    asked = dockets.filter(F.col("docket_id").isNotNull()).join(entries, "docket_id", "left")
    place = F.struct(F.col("filed").isNull().alias("undated"), "filed", "docket_id")
    is_ = lambda s: F.col("status") == s
    cases = asked.groupBy("case_id").agg(
        F.min(F.when(is_("found"), F.struct(place.alias("p"), "docket_id", "text"))).alias("f"),
        F.min(F.when(is_("denied"), place)).alias("d"),
        F.coalesce(F.bool_or(is_("empty")), F.lit(False)).alias("e"),
    )
    refused = F.col("d").isNotNull() & (F.col("f").isNull() | (F.col("d") < F.col("f.p")))
    status = F.when(refused, "denied").when(F.col("f").isNotNull(), "found").when(F.col("e"), "empty").otherwise("missing")
    told = cases.withColumn("status", status)
    found = F.col("status") == "found"
    out = told.select("case_id", "status", F.when(found, F.col("f.docket_id")).alias("docket_id"), F.when(found, F.col("f.text")).alias("text"))
    return dockets.select("case_id").distinct().join(out, "case_id", "left").withColumn("status", F.coalesce("status", F.lit("missing")))


def filing_address(base: str, company_number: Column, accession: Column, file: Column) -> Column:
    """A filing's address: the company's number without leading zeros, the accession without dashes."""
    return F.concat_ws("/", F.lit(base.rstrip("/")), F.regexp_replace(company_number, "^0+(?=.)", ""), F.replace(accession, F.lit("-"), F.lit("")), file)
