"""When may a product's protection end, and how sure is that?

Products of all sources are one ranked set. Each kind of dated child is
aggregated by product before it is joined, so children of two kinds never
multiply; the only shuffles are those of the two aggregations and their joins,
on the same key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["source", "product_id"]


def patent_kinds() -> dict[str, Column]:
    """What a patent may cover, by the columns that say so."""
    return {"substance": F.col("covers_substance"), "product": F.col("covers_product"), "use": F.col("use_code") != ""}


def patent_summary(patents: DataFrame) -> DataFrame:
    """Per product: latest live expiry, latest live and verified one, count (delisted too), largest live gap, and which kinds of live patents there are.

    The kinds (``has_substance_patent`` and so on) are there if the patents' columns tell them; Spark leaves out what no filter reads.
    """
    live = F.col("live")
    told = {"covers_substance", "covers_product", "use_code"} <= set(patents.columns)
    kinds = [F.bool_or(live & is_).alias(f"has_{kind}_patent") for kind, is_ in patent_kinds().items()] if told else []
    return patents.groupBy(*KEY).agg(
        F.max(F.when(live, F.col("expiry"))).alias("patent_date"),
        F.max(F.when(live & F.col("adjustment_days").isNotNull(), F.col("expiry"))).alias("verified_date"),
        F.count(F.lit(1)).alias("patent_count"),
        F.max(F.when(live, F.col("adjustment_days"))).alias("max_gap_days"),
        *kinds,
    )


def exclusivity_summary(exclusivities: DataFrame) -> DataFrame:
    """Per product: latest expiry, count, and the distinct codes, if there are codes."""
    codes = [F.collect_set("code").alias("exclusivity_codes")] if "code" in exclusivities.columns else []
    return exclusivities.groupBy(*KEY).agg(F.max("expiry").alias("exclusivity_date"), F.count(F.lit(1)).alias("exclusivity_count"), *codes)


def estimates(products: DataFrame, patents: DataFrame, exclusivities: DataFrame) -> DataFrame:
    """Every product with estimate, confidence and counts.

    The estimate is the later of the latest live patent and the latest exclusivity. It is
    confirmed if an exclusivity or a live patent with a known adjustment attains it.
    """
    joined = products.join(patent_summary(patents), KEY, "left").join(exclusivity_summary(exclusivities), KEY, "left")
    known = joined.withColumn("estimate", F.greatest("patent_date", "exclusivity_date"))
    attained = (F.col("exclusivity_date") == F.col("estimate")) | (F.col("verified_date") == F.col("estimate"))
    return known.withColumn(
        "confidence",
        F.when(F.col("estimate").isNull(), None).when(F.coalesce(attained, F.lit(False)), "confirmed").otherwise("pending_verification"),
    ).na.fill(0, ["patent_count", "exclusivity_count"])


def controlling(patents: DataFrame, exclusivities: DataFrame) -> DataFrame:
    """Per product the child that sets the date: the latest; of equals patents before exclusivities, then by label.

    The confidence is that of this one child, so on a tie of a patent and an
    exclusivity it may differ from that of :func:`estimates`.
    """
    p = patents.filter("live").select(
        *KEY, F.col("expiry"), F.lit(0).alias("rank"), F.lit("patent").alias("kind"), F.col("patent_number").alias("label"), F.col("use_code"), F.col("adjustment_days").isNotNull().alias("verified")
    )
    e = exclusivities.select(*KEY, F.col("expiry"), F.lit(1).alias("rank"), F.lit("exclusivity").alias("kind"), F.col("code").alias("label"), F.lit("").alias("use_code"), F.lit(True).alias("verified"))
    # the least of (days before, kind, label): a partial aggregate, no window over all children
    order = F.struct((-F.unix_date("expiry")).alias("d"), "rank", "label", F.coalesce("use_code", F.lit("")).alias("use_code"), (~F.col("verified")).alias("unverified"), "expiry", "kind")
    best = p.unionByName(e).filter(F.col("expiry").isNotNull()).groupBy(*KEY).agg(F.min(order).alias("b"))
    label = F.concat(F.initcap(F.col("b.kind")), F.lit(" "), F.col("b.label"), F.when(F.col("b.use_code") != "", F.concat(F.lit(" (use code "), F.col("b.use_code"), F.lit(")"))).otherwise(""))
    day = F.date_format("b.expiry", "yyyy-MM-dd")
    unsure = F.lit(", whose term has not been checked yet, so the date may still move")
    basis = F.concat(F.lit("The latest to expire is "), label, F.when(F.col("b.unverified"), unsure).otherwise(""), F.lit("; nothing else that is listed expires after "), day, F.lit("."))
    return best.select(
        *KEY,
        F.col("b.kind").alias("kind"),
        label.alias("label"),
        F.col("b.expiry").alias("expiry"),
        F.when(F.col("b.unverified"), "pending_verification").otherwise("confirmed").alias("confidence"),
        basis.alias("basis"),
    )


def latest_per_key(df: DataFrame, key: list[str], by: str, value: str) -> DataFrame:
    """The value of the latest row of each key."""
    return df.groupBy(*key).agg(F.max_by(value, by).alias(value), F.max(by).alias(by))


def first_seen(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order (which should leave no ties)."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def distinct_on(df: DataFrame, key: list[str], *order: object) -> DataFrame:
    """One row of each key: the first by ``order``."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")
