"""Names of companies, captions of cases, and how far a match can be trusted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words at the end of a company's name that say nothing about which it is.
SUFFIXES = ["inc", "incorporated", "corp", "corporation", "llc", "ltd", "limited", "co", "company", "usa", "pharmaceuticals", "pharmaceutical", "pharma"]


def company(raw: Column) -> Column:
    """Lower case, letters and digits, without trailing words of legal form; at least one word stays."""
    plain = F.trim(F.regexp_replace(F.lower(raw), r"[^a-z0-9]+", " "))
    return F.regexp_replace(plain, rf"(?<=[a-z0-9])( ({'|'.join(SUFFIXES)}))+$", "")


def sides(caption: Column) -> Column:
    """struct<plaintiff, defendant> of ``A v. B``; null unless there are exactly two, both named."""
    parts = F.split(caption, r"(?iU)\s+v\.?s?\.?\s+")
    a, b = F.trim(parts[0]), F.trim(F.get(parts, F.lit(1)))
    return F.when((F.size(parts) == 2) & (a != "") & (b != ""), F.struct(a.alias("plaintiff"), b.alias("defendant")))


def is_patent_case(nature: Column, cause: Column) -> Column:
    text = F.concat_ws(" ", nature, cause)
    return text.rlike(r"\b830\b") | text.rlike("(?i)patent")


def court(code: Column) -> Column:
    """The two courts that are followed; null for others."""
    return F.when(code == "deld", "DE").when(code == "njd", "NJ")


def role(searched: Column, plaintiff: Column, defendant: Column) -> Column:
    return F.when(plaintiff == searched, "plaintiff").when(defendant == searched, "defendant").otherwise("unmatched")


def confidence(role_: Column, plaintiff_match: Column, defendant_id: Column, products: Column, patent_case: Column) -> Column:
    """struct<tier, note> of a match made from a search hit."""
    sure = (role_ == "plaintiff") & (plaintiff_match == "exact") & patent_case
    reasons = F.concat_ws(
        "; ",
        F.when(role_ == "unmatched", "neither party is surely the company searched for"),
        F.when(plaintiff_match == "fuzzy", "the plaintiff matched in part only"),
        F.when(role_ == "defendant", "the company is the defendant"),
        F.when(~patent_case, "the filing does not say that it concerns a patent"),
    )
    tier = F.when(sure & defendant_id.isNotNull() & (products == 1), "HIGH").when(sure & ((products != 1) | defendant_id.isNull()), "MEDIUM").otherwise("LOW")
    note = (
        F.when(tier == "HIGH", "both parties match exactly, a patent case, and one product")
        .when(sure & (products == 0), "the plaintiff matches exactly in a patent case, but no product is linked")
        .when(sure & (products > 1), F.concat(F.lit("the plaintiff matches exactly in a patent case, but it may concern any of "), products.cast("string"), F.lit(" products")))
        .when(sure, "the plaintiff and one product match, but the defendant is not known")
        .otherwise(F.concat(F.lit("weak: "), F.when(reasons == "", "nothing further supports it").otherwise(reasons)))
    )
    return F.struct(tier.alias("tier"), note.alias("note"))


def manual_confidence(plaintiff_match: Column, defendant_match: Column, products: Column, patent_case: Column) -> Column:
    """struct<tier, note> of a match between parties that a person has entered: no role is known, and nothing matched gives NONE."""
    any_ = (plaintiff_match != "none") | (defendant_match != "none")
    exact = (plaintiff_match == "exact") & (defendant_match == "exact") & patent_case
    tier = F.when(~any_, "NONE").when(exact & (products == 1), "HIGH").when(patent_case, "MEDIUM").otherwise("LOW")
    note = (
        F.when(~any_, "neither party is a known company")
        .when(exact & (products == 1), "both parties match exactly, a patent case, and one product")
        .when(exact & (products == 0), "both parties match exactly in a patent case, but no product could be linked")
        .when(exact, F.concat(F.lit("both parties match exactly in a patent case, but it may concern any of "), products.cast("string"), F.lit(" products")))
        .when(patent_case, "a patent case, but not both parties match exactly")
        .otherwise("weak: the filing does not say that it concerns a patent")
    )
    return F.struct(tier.alias("tier"), note.alias("note"))


def filer_name(name: Column) -> Column:
    """A filer's name without the bracketed ticker and number that end it."""
    return F.trim(F.regexp_replace(name, r"(?i)\s*\([A-Z0-9.]{1,10}\)\s*\(CIK\s*\d+\)\s*$", ""))
