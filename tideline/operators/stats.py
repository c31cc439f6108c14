"""Counts over the unified set: horizons, calendar, portfolio, divergence and the activity feed."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.estimate import KEY

#: Rows of each kind of event that a feed is made of at most; days of confirmations.
POOL, DAYS = 300, 15


def horizon_counts(estimated: DataFrame, as_of: dt.date, days: tuple[int, ...] = (30, 90, 365)) -> DataFrame:
    """One row: how many estimates lie at most so many days after ``as_of``; those that have passed count."""
    return estimated.agg(*_horizons(as_of, days))


def _horizons(as_of: dt.date, days: tuple[int, ...] = (30, 90, 365)) -> list[Column]:
    ahead = F.datediff("estimate", F.lit(as_of))
    return [F.count(F.when(ahead <= d, 1)).alias(f"within_{d}") for d in days]


def timeline(estimated: DataFrame, as_of: dt.date, months: int = 12) -> DataFrame:
    """(month, n) for every month from that of ``as_of``, months without any included."""
    start = F.trunc(F.lit(as_of), "month")
    calendar = estimated.sparkSession.range(1).select(F.explode(F.sequence(start, F.add_months(start, months - 1), F.expr("interval 1 month"))).alias("month"))
    inside = estimated.filter((F.col("estimate") >= start) & (F.col("estimate") < F.add_months(start, months)))
    counts = inside.groupBy(F.trunc("estimate", "month").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return calendar.join(counts, "month", "left").na.fill(0, ["n"])


def bar_heights(counts: DataFrame) -> DataFrame:
    """Heights of the timeline's bars in percent of the highest, at least 8 where there is any and 4 where there is none."""
    top = F.max("n").over(Window.partitionBy())  # over the months of one calendar, a few dozen rows
    share = F.round(F.col("n") * 100 / F.greatest(top, F.lit(1)))
    return counts.withColumn("height", F.when(F.col("n") == 0, 4).otherwise(F.greatest(F.lit(8), share)).cast("int"))


def active_challenges(challenges: DataFrame) -> DataFrame:
    """How many challenges are undecided or in one of the three open states."""
    open_ = F.col("current_status").isNull() | F.col("current_status").isin("ELIGIBLE", "DEFERRED", "NON_FORFEITURE")
    return challenges.agg(F.count(F.when(open_, 1)).alias("n"))


def diverging(estimated: DataFrame, marketed: DataFrame) -> DataFrame:
    """(key, marketing_date): marketing that began before the estimate. One row per product and date.

    ``marketed``: key, marketing_date. A product with two such dates is two rows; count
    the rows for the portfolio's figure, or the distinct keys for products.
    """
    dates = marketed.filter(F.col("marketing_date").isNotNull()).distinct()
    return dates.join(estimated.select(*KEY, "estimate"), KEY).filter(F.col("marketing_date") < F.col("estimate"))


def portfolio(estimated: DataFrame, challenges: DataFrame, marketed: DataFrame, as_of: dt.date) -> DataFrame:
    """One row with all tiles."""
    parts = [
        estimated.agg(F.count(F.lit(1)).alias("tracked"), *_horizons(as_of)),
        active_challenges(challenges).withColumnRenamed("n", "active_challenges"),
        diverging(estimated, marketed).agg(F.count(F.lit(1)).alias("divergence")),
    ]
    rows = [p.select(F.explode(F.create_map(*[x for c in p.columns for x in (F.lit(c), F.col(c))])).alias("tile", "n")) for p in parts]
    tiles = [c for p in parts for c in p.columns]
    return reduce(DataFrame.unionByName, rows).agg(*[F.max(F.when(F.col("tile") == c, F.col("n"))).alias(c) for c in tiles])


def first_linked(links: DataFrame, key: str, value: str) -> DataFrame:
    """The smallest linked value of each key."""
    return links.groupBy(key).agg(F.min(value).alias(value))


def recent(events: DataFrame, kind: str, order: int, pool: int = POOL) -> DataFrame:
    """The latest ``pool`` of one kind of event: kind, date, product, detail."""
    rows = events.filter(F.col("date").isNotNull()).select(F.lit(kind).alias("kind"), F.lit(order).alias("kind_order"), "date", "product", "detail")
    return rows.orderBy(F.desc("date"), "product", "detail").limit(pool)


def confirmations(records: DataFrame, days: int = DAYS) -> DataFrame:
    """The latest days with confirmed terms: how many different products each."""
    daily = records.groupBy("date").agg(F.countDistinct("product_id").alias("n"))
    text = F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " product").otherwise(" products"))
    return daily.orderBy(F.desc("date")).limit(days).select("date", text.alias("product"), F.lit("Patent terms confirmed").alias("detail"))


def feed(parts: list[tuple[str, DataFrame]], limit: int = 30, offset: int = 0, pool: int = POOL) -> DataFrame:
    """Events of several kinds in one order: the latest first, then by the kinds' order. Each kind is bounded first."""
    pools = [recent(df, kind, k, pool) for k, (kind, df) in enumerate(parts)]
    return reduce(DataFrame.unionByName, pools).orderBy(F.desc("date"), "kind_order", "product", "detail").offset(offset).limit(limit).drop("kind_order")


def before_and_after(df: DataFrame, old: str, new: str) -> DataFrame:
    """(category, before, after): a histogram of two columns in one pass."""
    each = df.select(F.explode(F.array(F.struct(F.col(old).alias("c"), F.lit(1).alias("b"), F.lit(0).alias("a")), F.struct(F.col(new).alias("c"), F.lit(0).alias("b"), F.lit(1).alias("a")))).alias("e"))
    return each.groupBy(F.col("e.c").alias("category")).agg(F.sum("e.b").alias("before"), F.sum("e.a").alias("after"))


def progress(rows: DataFrame, kind: str, done: str) -> DataFrame:
    """(kind, total, done, percent), zero-safe."""
    g = rows.groupBy(kind).agg(F.count(F.lit(1)).alias("total"), F.count(done).alias("done"))
    return g.withColumn("percent", F.when(F.col("total") == 0, 0).otherwise(F.round(F.col("done") * 100 / F.col("total"))).cast("int"))


def tells_apart(df: DataFrame, key: list[str], column: str) -> DataFrame:
    """Per key: is the column different in every row?"""
    return df.groupBy(*key).agg((F.countDistinct(column) == F.count(F.lit(1))).alias("tells_apart"))


def capped_groups(df: DataFrame, key: str, order: str, groups: int) -> DataFrame:
    """Rows of the first ``groups`` keys by the keys' least ``order``: groups are capped, not rows."""
    first = df.groupBy(key).agg(F.min(order).alias("_first")).orderBy("_first", key).limit(groups)
    return df.join(F.broadcast(first.drop("_first")), key)  # at most ``groups`` rows


def queue(df: DataFrame, checked: str, as_of: dt.datetime, stale_days: int, limit: int, *ties: str) -> DataFrame:
    """What to look at next: never checked first, then the longest ago, if that is over ``stale_days``."""
    due = F.col(checked).isNull() | (F.col(checked) < F.lit(as_of - dt.timedelta(days=stale_days)))
    return df.filter(due).orderBy(F.asc_nulls_first(checked), *ties).limit(limit)


def running_number(df: DataFrame, key: list[str], *order: object) -> DataFrame:
    return df.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
