"""One product with everything that hangs on it, as nested columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.text import digits_only
from tideline.operators.estimate import KEY, controlling


def nested(children: DataFrame, key: list[str], name: str, by: str, columns: list[str], descending: bool = False) -> DataFrame:
    """Per key an array of structs ordered by ``by``; nulls last if ascending and first if descending."""
    blank = F.col(by).isNull().cast("int")
    days = F.unix_date(F.col(by).cast("date"))
    place = F.struct((-blank if descending else blank).alias("b"), (-days if descending else days).alias("d"), *[F.col(c) for c in columns])
    kept = F.array_sort(F.collect_list(place))
    return children.groupBy(*key).agg(F.transform(kept, lambda s: F.struct(*[s[c].alias(c) for c in columns])).alias(name))


def assemble(products: DataFrame, key: list[str], parts: list[DataFrame]) -> DataFrame:
    """Products with each part joined; arrays that are missing become empty."""
    for part in parts:
        new = [c for c in part.columns if c not in key]
        products = products.join(part, key, "left")
        for c in new:
            if products.schema[c].dataType.typeName() == "array":
                products = products.withColumn(c, F.coalesce(F.col(c), F.array().cast(products.schema[c].dataType)))
    return products


#: What is said of a product without any patent or exclusivity.
NO_BARRIER = "No patent and no exclusivity is listed, so nothing that is known stands in the way."


def product_details(products: DataFrame, patents: DataFrame, exclusivities: DataFrame, **more: DataFrame) -> DataFrame:
    """Every product with its patents, exclusivities, the child that controls the date, and why; ``more`` are parts by name."""
    p = nested(patents, KEY, "patents", "expiry", ["patent_number", "expiry", "adjustment_days", "live"])
    e = nested(exclusivities, KEY, "exclusivities", "expiry", ["code", "expiry"])
    c = controlling(patents, exclusivities).select(*KEY, F.struct("kind", "label", "expiry", "confidence", "basis").alias("controlling"))
    return assemble(products, KEY, [p, e, c, *more.values()]).withColumn("basis", F.coalesce("controlling.basis", F.lit(NO_BARRIER)))


def lookup(number: str, patents: DataFrame, products: DataFrame, exclusivities: DataFrame, links: DataFrame | None = None, challenges: DataFrame | None = None, case_links: DataFrame | None = None, cases: DataFrame | None = None, dockets: DataFrame | None = None) -> DataFrame:
    """Patents of this number, compared by digits alone, with their product and what hangs on that: exclusivities, challenges, cases with dockets.

    Challenges and cases are the product's, not proof that this patent was in suit; they are
    joined for the products found alone. Links have source and product_id; without them the arrays are empty.
    """
    wanted = "".join(ch for ch in number if ch.isdigit())
    found = patents.filter(digits_only(F.col("patent_number")) == wanted).join(products.select(*KEY, "name", "alt_name", "company"), KEY)
    keys = found.select(*KEY).distinct()
    parts = [nested(exclusivities.join(keys, KEY, "left_semi"), KEY, "exclusivities", "expiry", ["code", "expiry"])]
    if links is not None and challenges is not None:
        parts.append(nested(links.join(keys, KEY, "left_semi").join(challenges, "challenge_id"), KEY, "challenges", "submission_date", ["current_status", "submission_date", "submission_kind"], descending=True))
    if case_links is not None and cases is not None and dockets is not None:
        theirs = case_links.join(keys, KEY, "left_semi")
        with_dockets = cases.join(nested(dockets, ["case_id"], "dockets", "filed", ["docket_number", "court", "filed"]), "case_id", "left")
        parts.append(nested(theirs.join(with_dockets, "case_id"), KEY, "cases", "filed", ["outcome", "filed", "tier", "dockets"], descending=True))
    return assemble(found, KEY, parts)


def dispute_parts(links: DataFrame, challenges: DataFrame, case_links: DataFrame, cases: DataFrame, dockets: DataFrame, settlements: DataFrame) -> list[DataFrame]:
    """Parts for :func:`assemble` by product_id: challenges and cases, the latest first (cases with their dockets, the oldest first), and the latest disclosures."""
    ch = nested(links.join(challenges, "challenge_id"), ["product_id"], "challenges", "submission_date", ["challenge_id", "submission_date", "current_status", "history"], descending=True)
    with_dockets = cases.join(nested(dockets, ["case_id"], "dockets", "filed", ["docket_id", "filed", "terminated"]), "case_id", "left")
    ca = nested(case_links.join(with_dockets, "case_id"), ["product_id"], "cases", "filed", ["case_id", "filed", "outcome", "tier", "dockets"], descending=True)
    st = nested(latest_disclosures(settlements), ["product_id"], "settlements", "filed", ["counterparty", "licensed_entry", "filed"], descending=True)
    return [ch, ca, st]


def with_references(products: DataFrame) -> DataFrame:
    """Each product's reference by name and, in reverse, the products that refer to it."""
    names = products.select(F.col("product_id").alias("reference_id"), F.col("name").alias("reference"))
    back = products.filter("reference_id IS NOT NULL").groupBy("reference_id").agg(F.array_sort(F.collect_list(F.struct("name", "product_id"))).alias("referred_by")).withColumnRenamed("reference_id", "product_id")
    return products.join(names, "reference_id", "left").join(back, "product_id", "left")


def merged_cases(cases: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """Cases of the same two known companies as one, within ``key``; a case with a party that is not known stays alone.

    ONGOING if any is; else the outcome that all have, or UNCLEAR if they differ, with a note that says so.
    The surest tier, all notes once, and all dockets by their filing, those without a date last.
    cases: case_id, plaintiff, defendant, plaintiff_id, defendant_id, outcome, tier, note, dockets (array<struct<filed, ...>>), filed.
    """
    rank = F.create_map(*[x for k, t in enumerate(["LOW", "MEDIUM", "HIGH"]) for x in (F.lit(t), F.lit(k))])
    both = F.col("plaintiff_id").isNotNull() & F.col("defendant_id").isNotNull()
    party = F.when(both, F.struct(F.col("plaintiff_id").cast("string").alias("a"), F.col("defendant_id").cast("string").alias("b"), F.lit(None).cast("string").alias("c"))).otherwise(
        F.struct(F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b"), F.col("case_id").cast("string").alias("c"))
    )
    outcomes, n = F.collect_set("outcome"), F.count(F.lit(1))
    differ = F.size(outcomes) > 1
    placed = F.transform(F.flatten(F.collect_list("dockets")), lambda k: F.struct(k["filed"].isNull().alias("undated"), k["filed"].alias("filed"), k.alias("docket")))
    return cases.groupBy(*key, party.alias("_party")).agg(
        F.min_by("plaintiff", "case_id").alias("plaintiff"),
        F.min_by("defendant", "case_id").alias("defendant"),
        F.when(F.bool_or(F.col("outcome") == "ONGOING"), "ONGOING").when(differ, "UNCLEAR").otherwise(F.min("outcome")).alias("outcome"),
        F.when(differ, F.concat(F.lit("made of "), n.cast("string"), F.lit(" cases whose outcomes differ"))).alias("outcome_note"),
        F.max_by("tier", rank[F.col("tier")]).alias("tier"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_compact(F.array("note")))))).alias("notes"),
        F.transform(F.array_sort(placed), lambda p: p["docket"]).alias("dockets"),
        F.min("filed").alias("filed"),
        n.alias("n_cases"),
    ).drop("_party")


def latest_disclosures(settlements: DataFrame) -> DataFrame:
    """The latest disclosure of each product and counterparty, names compared without case."""
    best = F.max_by(F.struct("counterparty", "licensed_entry", "filed"), F.struct("filed", "disclosure_id"))
    return settlements.groupBy("product_id", F.lower("counterparty").alias("_party")).agg(best.alias("s")).select("product_id", "s.*")


def entry_facts(estimated: DataFrame, challenges: DataFrame, licences: DataFrame, as_of: dt.date) -> DataFrame:
    """Per product the date to show first: marketing that has begun, else a licensed entry, if it is before the estimate or there is none, else the estimate.

    challenges: key, first_marketing; licences: key, licensed_entry.
    """
    past = challenges.filter(F.col("first_marketing") <= F.lit(as_of))
    days = past.groupBy(*KEY, "first_marketing").agg(F.count(F.lit(1)).alias("_n"))  # ties are the rows of the first day
    ties = days.groupBy(*KEY).agg(F.min("first_marketing").alias("marketed"), F.min_by("_n", "first_marketing").alias("n_first"))
    early = licences.groupBy(*KEY).agg(F.min("licensed_entry").alias("licensed"))
    rows = estimated.join(ties, KEY, "left").join(early, KEY, "left").withColumn("licensed", F.when(F.col("estimate").isNull() | (F.col("licensed") < F.col("estimate")), F.col("licensed")))
    return rows.withColumn("entry_date", F.coalesce("marketed", "licensed", "estimate")).withColumn("basis", _basis())


def _basis() -> Column:
    return F.when(F.col("marketed").isNotNull(), "marketed").when(F.col("licensed").isNotNull(), "licensed").when(F.col("estimate").isNotNull(), "estimate")
