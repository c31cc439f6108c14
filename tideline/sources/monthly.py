"""The monthly CSV of two sections, of which the last is the whole list, and a patent list in HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.dates import long_month_date, pivot_year_date
from tideline.functions.text import after, without_tags
from tideline.sources.tilde import divided

FIRST_CELL = "N/R/U"
TO_COME = "date tbd"
# Column of an exclusivity, its code, and whether a date to come is no issue.
EXCLUSIVITIES = [
    ("Ref. Product Exclusivity Exp. Date", "BPCIA_REF_PRODUCT", False),
    ("First Interchangeable Exclusivity Exp. Date", "BPCIA_FIRST_INTERCHANGEABLE", True),
    ("Orphan Exclusivity Exp. Date", "ORPHAN", False),
]
LICENSES = {"351(a)": "STANDARD", "351(k) Biosimilar": "BIOSIMILAR", "351(k) Interchangeable": "INTERCHANGEABLE"}


def cells(line: Column) -> Column:
    """The cells of a CSV line: quotes may hold commas and doubled quotes, but no line feed."""
    raw = F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(r'("(?:[^"]|"")*"[^,]*|[^,]*),'), 1)
    return F.transform(raw, lambda c: F.when(c.startswith('"'), F.replace(F.regexp_replace(c, r'^"((?:[^"]|"")*)"', "$1"), F.lit('""'), F.lit('"'))).otherwise(c))


def section(lines: DataFrame, expected: list[str], file: str = "products.csv") -> tuple[DataFrame, DataFrame]:
    """Rows after the last header as a map by column name, and issues.

    ``lines``: (line, raw). Without a header there are no rows and one issue; a header that
    differs from the expected one is an issue, and columns are found by name.
    """
    spark = lines.sparkSession
    split = lines.filter(F.trim("raw") != "").withColumn("cells", cells(F.col("raw")))
    head = split.filter(F.get("cells", F.lit(0)) == FIRST_CELL).agg(F.max_by(F.struct("line", "raw", "cells"), "line").alias("h")).first()["h"]
    schema = "file string, line long, reason string, raw string"
    if head is None:
        return split.limit(0).select("line", "raw", F.create_map(F.lit(""), F.lit("")).alias("cell")), spark.createDataFrame([(file, 1, "no header row", "")], schema)
    issues = [] if head["cells"] == expected else [(file, head["line"], f"columns differ: {' | '.join(head['cells'])}", head["raw"])]
    rows = split.filter(F.col("line") > head["line"])
    wide = F.size("cells") >= len(expected)
    narrow = rows.filter(~wide).select(F.lit(file).alias("file"), "line", F.concat(F.lit(f"expected {len(expected)} fields, got "), F.size("cells").cast("string")).alias("reason"), "raw")
    place = {name: head["cells"].index(name) for name in reversed(head["cells"])}
    cell = F.create_map(*[x for name, k in place.items() for x in (F.lit(name), F.trim(F.coalesce(F.get("cells", F.lit(k)), F.lit(""))))])
    return rows.filter(wide).select("line", "raw", cell.alias("cell")), narrow.unionByName(spark.createDataFrame(issues, schema))


def products(rows: DataFrame, file: str = "products.csv") -> tuple[DataFrame, DataFrame]:
    """Products of the section's rows, and issues."""
    c = lambda name: F.coalesce(F.col("cell")[name], F.lit(""))
    kind = F.coalesce(*[F.when(c("License Type") == k, F.lit(v)) for k, v in LICENSES.items()])
    center = F.upper(c("Center"))
    needed = ["BLA Number", "Product Number", "Proprietary Name", "Proper Name", "Applicant"]
    empty = F.greatest(*[c(n) == "" for n in needed])
    reason = (
        F.when(empty, "an empty number, name or applicant")
        .when(kind.isNull(), F.concat(F.lit('unknown license type "'), c("License Type"), F.lit('"')))
        .when(~center.isin("CDER", "CBER"), F.concat(F.lit('unknown center "'), c("Center"), F.lit('"')))
    )
    good, bad = divided(rows, reason, file)
    given = lambda name: F.when((c(name) != "") & (F.upper(c(name)) != "N/A"), c(name))
    out = good.select(
        "line",
        "raw",
        "cell",
        c("BLA Number").alias("application_number"),
        c("Product Number").alias("product_number"),
        c("Proprietary Name").alias("name"),
        c("Proper Name").alias("alt_name"),
        c("Applicant").alias("company"),
        kind.alias("license_type"),
        center.alias("center"),
        c("Dosage Form").alias("dosage_form"),
        c("Route of Administration").alias("route"),
        c("Strength").alias("strength"),
        F.when(c("Marketing Status") != "", c("Marketing Status")).alias("marketing_status"),
        pivot_year_date(c("Approval Date")).alias("approval_date"),
        given("Ref. Product Proprietary Name").alias("reference_name"),
        given("Ref. Product Proper Name").alias("reference_alt_name"),
    )
    return out, bad


def exclusivities(products_: DataFrame, file: str = "products.csv") -> tuple[DataFrame, DataFrame]:
    """The three exclusivity columns as rows, and issues for dates that do not parse."""
    c = lambda name: F.coalesce(F.col("cell")[name], F.lit(""))
    each = F.explode(F.array(*[F.struct(F.lit(code).alias("code"), c(name).alias("text"), F.lit(name).alias("column"), F.lit(quiet).alias("quiet")) for name, code, quiet in EXCLUSIVITIES]))
    rows = products_.select("line", "raw", "application_number", "product_number", each.alias("e")).select("*", pivot_year_date(F.col("e.text")).alias("expiry"))
    good = rows.filter("expiry IS NOT NULL").select("application_number", "product_number", F.col("e.code").alias("code"), "expiry")
    odd = rows.filter((F.col("e.text") != "") & F.col("expiry").isNull() & ~(F.col("e.quiet") & (F.lower("e.text") == TO_COME)))
    return good, odd.select(F.lit(file).alias("file"), "line", F.concat(F.lit("unreadable "), F.col("e.column"), F.lit(' "'), F.col("e.text"), F.lit('"')).alias("reason"), "raw")


def _elements(html: Column, tag: str) -> Column:
    """array<struct<head, body>> of the elements of a tag, none inside another: the rest of the opening tag, and what is before the closing one.

    By splits alone, each of which passes once over the text. An opening tag that nothing closes is no element.
    """
    pieces = F.split(html, rf"(?i)<{tag}(?=[\s>])")
    found = F.transform(F.slice(pieces, 2, F.size(pieces)), lambda p: F.struct(F.substring_index(p, ">", 1).alias("head"), after(p, ">").alias("rest")))
    closed = F.filter(found, lambda e: F.size(F.split(e["rest"], rf"(?i)</{tag}>", 2)) == 2)
    return F.transform(closed, lambda e: F.struct(e["head"].alias("head"), F.get(F.split(e["rest"], rf"(?i)</{tag}>", 2), F.lit(0)).alias("body")))


def patent_list(html: DataFrame, table_id: str, column: str = "html") -> DataFrame:
    """Rows of six cells of the table: application_number, company, name, alt_name, patent_number, expiry."""
    tables = F.split(F.col(column), r"(?i)<table(?=[\s>])")
    ours = F.filter(F.slice(tables, 2, F.size(tables)), lambda t: F.contains(F.substring_index(t, ">", 1), F.lit(f'id="{table_id}"')))
    table = F.get(F.split(F.get(ours, F.lit(0)), r"(?i)</table>", 2), F.lit(0))
    rows = F.filter(_elements(table, "tr"), lambda r: r["head"].rlike(r'(?i)^\s+valign="top"'))
    cells = F.transform(rows, lambda r: F.transform(_elements(r["body"], "td"), lambda c: F.trim(F.replace(without_tags(c["body"], ""), F.lit("&amp;"), F.lit("&")))))
    found = html.select(F.explode(cells).alias("td")).filter(F.size("td") == 6)
    cell = lambda k: F.col("td")[k]
    return found.select(
        F.regexp_replace(cell(0), r"\D", "").alias("application_number"),
        cell(1).alias("company"),
        cell(2).alias("name"),
        cell(3).alias("alt_name"),
        F.replace(cell(4), F.lit(","), F.lit("")).alias("patent_number"),
        long_month_date(cell(5)).alias("expiry"),
    )


def links(html: DataFrame, text: str, column: str = "html") -> DataFrame:
    """(href): targets of links whose text or title holds ``text``, in any case."""
    e = F.col("e")
    said = F.concat_ws(" ", without_tags(e["body"], " "), F.regexp_extract(e["head"], r'(?is)\btitle="([^"]*)"', 1))
    found = html.select(F.explode(_elements(F.col(column), "a")).alias("e")).filter(F.contains(F.lower(said), F.lit(text.lower())))
    return found.select(F.regexp_extract(e["head"], r'(?is)\bhref="([^"]*)"', 1).alias("href")).filter("href != ''")
