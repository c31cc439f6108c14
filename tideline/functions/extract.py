"""Facts out of legal prose and table cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.dates import long_month_date, rolling_date
from tideline.functions.text import leading_int

# Patterns of what complaints say.
_BLOCK = r"(?i)U\.S\.\s*Patent\s*Nos?\.?\s*([^.]{0,400})"
_NUMBER = r"\b(\d{1,2}(?:,\d{3}){2})\b"
_BRAND = r"(?i)generic versions? of\s+([A-Z][A-Za-z0-9'’-]*(?:\s+[A-Z][A-Za-z0-9'’-]*)?)\s*®?\s*\(([^,)]+),\s*([^)]+)\)"
_APPLICATION = r"(?i)\bANDA\s*No\.?\s*(\d+)"


def complaint_facts(text: Column) -> Column:
    """struct<patent_numbers, brand_name, strength, application_number>.

    Patent numbers count only within 400 characters without a full stop after they are
    announced, so that numbers cited elsewhere are not taken for those in suit.
    """
    blocks = F.regexp_extract_all(text, F.lit(_BLOCK), 1)
    numbers = F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(_NUMBER), 1)))
    none = lambda c: F.when(c != "", F.trim(c))
    return F.struct(
        F.array_distinct(F.transform(numbers, lambda n: F.replace(n, F.lit(","), F.lit("")))).alias("patent_numbers"),
        none(F.regexp_extract(text, _BRAND, 1)).alias("brand_name"),
        none(F.regexp_extract(text, _BRAND, 3)).alias("strength"),
        none(F.regexp_extract(text, _APPLICATION, 1)).alias("application_number"),
    )


# The pattern of a dispute's heading around a product's name, and what its block must say.
_HEADING = r"\s*®?\s*[\w\s]{0,20}?Patent Litigation\s*\(([^)]+)\)\s*-\s*"
_SETTLED = r"(?i)reached an agreement|settlement agreement|resolved the (?:existing )?litigation|entered into .*?agreement"
_DATE = r"[A-Z][a-z]+ \d{1,2}, \d{4}"
_ANNOUNCED = rf"(?i)({_DATE}),?\s+(?:we|the Company)\s+announced"
_BEGINS = rf"(?i)beginning\s+({_DATE})"
#: Characters that a heading's block has at most, and that an excerpt has.
BLOCK, EXCERPT = 2500, 1500


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def settlements(filings: DataFrame, text: str = "text", product: str = "product") -> DataFrame:
    """Every settled dispute under a heading ``<product> ... Patent Litigation (<counterparty>) -``, one row each.

    All columns of the filings but the text, and place (from 0 among the filing's headings), counterparty,
    licensed_entry, announced, earlier, confidence, note, excerpt. A heading's block goes on to the next heading;
    blocks without words of a settlement are of disputes still open and left out. A null or empty product has none.
    """
    quoted = F.concat(F.lit("(?i)\\Q"), F.replace(F.col(product), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E" + _HEADING))
    named = filings.filter((F.col(product) != "") & (F.col(text) != "")).withColumn("_pattern", quoted)
    parts = F.arrays_zip(F.regexp_extract_all(F.col(text), F.col("_pattern"), F.lit(1)).alias("who"), F.expr(f"slice(split(`{text}`, _pattern, -1), 2, 1000000)").alias("block"))
    each = named.select(*[c for c in filings.columns if c != text], F.posexplode(parts).alias("place", "_d"))
    each = each.withColumns({"counterparty": _trimmed(F.regexp_replace("_d.who", '^"|"$', "")), "_block": _trimmed(F.substring("_d.block", 1, BLOCK))})
    begins, said = F.regexp_extract("_block", _BEGINS, 1), F.regexp_extract("_block", _ANNOUNCED, 1)
    found = each.filter(F.col("_block").rlike(_SETTLED)).withColumns({"licensed_entry": long_month_date(begins), "announced": long_month_date(said)})
    tier = F.when(F.col("licensed_entry").isNotNull(), "HIGH").when(F.col("announced").isNotNull(), "MEDIUM").otherwise("LOW")
    note = (
        F.when(tier == "HIGH", F.concat(F.lit("the heading of "), F.col("counterparty"), F.lit(" and a licensed entry, beginning "), begins))
        .when(tier == "MEDIUM", F.concat(F.lit("a settlement with "), F.col("counterparty"), F.lit(", announced "), said, F.lit(", but no licensed entry that could be read")))
        .otherwise(F.concat(F.lit("words of a settlement near "), F.col("counterparty"), F.lit(", but no date that could be read")))
    )
    earlier = F.contains(F.lower("_block"), F.lit("or earlier under certain circumstances"))
    out = {"earlier": earlier, "confidence": tier, "note": note, "excerpt": _trimmed(F.substring("_block", 1, EXCERPT))}
    return found.withColumns(out).drop("_d", "_block")


def _lines(cell: Column) -> Column:
    return F.filter(F.transform(F.split(cell, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def one_line(cell: Column) -> Column:
    return F.trim(F.replace(cell, F.lit("\n"), F.lit(" ")))


def listed_product(cell: Column) -> Column:
    """struct<name, number, raw>: lines of a name and, last, a number of three to six digits; one of seven is kept raw."""
    lines = _lines(cell)
    last = F.when(F.size(lines) > 0, F.element_at(lines, -1))
    digits = F.trim(F.regexp_replace(last, r"(?i)^nda\s*", ""))
    numbered = F.coalesce(digits.rlike(r"^\d{3,7}$"), F.lit(False))
    before = F.trim(F.array_join(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), " "))
    name = F.when(numbered, F.when(before != "", before).otherwise(last)).otherwise(F.trim(F.array_join(lines, " ")))
    short = numbered & (F.length(digits) <= 6)
    return F.struct(name.alias("name"), F.when(short, F.concat(F.lit("NDA"), F.lpad(digits, 6, "0"))).alias("number"), F.when(numbered & ~short, last).alias("raw"))


def submission(cell: Column) -> Column:
    """struct<kind, date, issue>: a date, ``Pre-MMA``, or ``received prior to`` a date."""
    text = F.trim(F.regexp_replace(cell, r"(?U)\s+", " "))
    prior = F.regexp_extract(text, r"(?i)received\s*prior\s*to\s*([\d/]+)", 1)
    kind = F.when(text.rlike("(?i)^pre-mma$"), "PRE_MMA").when(prior != "", "RECEIVED_PRIOR_TO").otherwise("EXACT_DATE")
    date = F.when(kind == "RECEIVED_PRIOR_TO", rolling_date(prior)).when(kind == "EXACT_DATE", rolling_date(text))
    issue = F.when((kind != "PRE_MMA") & date.isNull(), F.concat(F.lit('unreadable date of submission: "'), text, F.lit('"')))
    return F.struct(kind.alias("kind"), date.alias("date"), issue.alias("issue"))


# Words in a status cell and the status that they mean, in order.
STATUSES = {"eligible": "ELIGIBLE", "deferred": "DEFERRED", "non-forfeiture": "NON_FORFEITURE", "extinguished": "EXTINGUISHED"}


def _status(line: Column) -> Column:
    flat = F.lower(F.regexp_replace(line, r"(?U)\s+", " "))
    return F.coalesce(*[F.when(flat.contains(k), F.lit(v)) for k, v in STATUSES.items()])


def decisions(status: Column, posting: Column) -> Column:
    """struct<history array<struct<status, posting_date, raw_text>>, ambiguous>.

    A line without a status belongs to the next line that has one. Statuses pair with
    posting dates by position. A status that is not known is held as ELIGIBLE and makes the
    cell ambiguous, as does a date that does not parse or one too many.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(acc: Column, line: Column) -> Column:
        joined = F.concat_ws(" ", acc["open"], line)
        known = _status(joined).isNotNull()
        return F.struct(F.when(known, F.array_append(acc["done"], joined)).otherwise(acc["done"]).alias("done"), F.when(~known, joined).alias("open"))

    entries = F.aggregate(_lines(status), start, step, lambda acc: F.when(acc["open"].isNotNull(), F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]))
    dates = _lines(posting)

    def entry(line: Column, i: Column) -> Column:
        return F.struct(F.coalesce(_status(line), F.lit("ELIGIBLE")).alias("status"), rolling_date(F.get(dates, i)).alias("posting_date"), line.alias("raw_text"))

    unclear = F.exists(F.transform(entries, lambda x, i: _status(x).isNull() | (F.get(dates, i).isNotNull() & rolling_date(F.get(dates, i)).isNull())), lambda x: x)
    return F.struct(F.transform(entries, entry).alias("history"), ((F.size(entries) > 0) & (unclear | (F.size(dates) > F.size(entries)))).alias("ambiguous"))


def single_date(cell: Column, label: str) -> Column:
    """struct<date, issue>: the one date in a cell; with several, none and an issue."""
    text = F.trim(cell)
    found = F.regexp_extract_all(text, F.lit(r"(\d{1,2}/\d{1,2}/\d{4})"), 1)
    issue = F.when(text == "", None).when(F.size(found) == 0, F.concat(F.lit(f'unreadable {label}: "'), text, F.lit('"'))).when(F.size(found) > 1, F.lit(f"{label} has several dates"))
    return F.struct(F.when(F.size(found) == 1, rolling_date(F.get(found, F.lit(0)))).alias("date"), issue.alias("issue"))


def challenge(c: dict[str, Column]) -> dict[str, Column]:
    """Columns of a challenge from the eleven text columns of a list's row; ``issues`` holds what did not fit."""
    listed, sent = listed_product(c["listed"]), submission(c["submitted"])
    history = decisions(c["status"], c["posting"])
    marketed, expires = single_date(c["marketing"], "first marketing"), single_date(c["expiration"], "last patent expiry")
    return {
        "active_ingredient": one_line(c["ingredient"]),
        "dosage_form": one_line(c["form"]),
        "strength": one_line(c["strength"]),
        "name": listed["name"],
        "application_number": listed["number"],
        "submission_kind": sent["kind"],
        "submission_date": sent["date"],
        "applicants": leading_int(c["applicants"]),
        "history": history["history"],
        "current_status": F.get(history["history"], F.lit(0))["status"],
        "first_approval": rolling_date(one_line(c["approval"])),
        "first_marketing": marketed["date"],
        "last_patent_expiry": expires["date"],
        "issues": F.array_compact(
            F.array(
                F.when(listed["number"].isNull(), F.when(listed["raw"].isNotNull(), F.lit("the application number is too long")).otherwise(F.lit("no application number"))),
                sent["issue"],
                F.when(history["ambiguous"], F.lit("statuses and posting dates do not pair")),
                marketed["issue"],
                expires["issue"],
            )
        ),
    }
