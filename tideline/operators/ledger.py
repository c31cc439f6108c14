"""What may be asked of a slow service next, from the table of what was asked before.

attempts: source, key, at (timestamp), status (ok, absent, limited, error, denied). Tasks never call a service;
whatever does asks this table what to fetch, and appends what came of it.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000


@dataclass(frozen=True)
class Limits:
    """How a service may be asked: seconds between requests, seconds to wait after it was too often, how often one key is tried again, and budgets by seconds."""

    apart: float
    back_off: float
    retries: int
    budgets: dict[int, int] = field(default_factory=dict)


# The limits of the two services.
TERMS = Limits(0.35, 5.0, 5)
DOCKETS = Limits(13.0, 65.0, 3, {60: 5, 3600: 50, 86400: 125})


def rolling(attempts: DataFrame, seconds: int, column: str) -> DataFrame:
    """attempts with how many of the same source were made in the ``seconds`` up to each, itself and those of the same moment included.

    A source's attempts are dealt out by stretches of time as long as the window; each also goes to the next stretch, where it is only
    looked back upon. So a source that holds most attempts is the work of many tasks. Moved on by the window, an attempt of the stretch
    before counts for those that are not later than it; so both numbers are running counts, and no frame is gone through for each row.
    """
    micros, window = F.unix_micros("at"), seconds * SECOND
    both = attempts.withColumn("_here", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("_m", micros + F.when(F.col("_here"), 0).otherwise(window))
    stretch = both.withColumn("_stretch", F.floor(F.col("_m") / F.lit(window)).cast("long"))
    of = Window.partitionBy("source", "_stretch")
    before = of.orderBy("_m")
    back = F.count_if(~F.col("_here"))
    so_far = F.count_if(F.col("_here")).over(before.rangeBetween(Window.unboundedPreceding, 0))
    gone = back.over(before.rangeBetween(Window.unboundedPreceding, -1))
    return stretch.withColumn(column, so_far + back.over(of) - gone).filter("_here").drop("_here", "_m", "_stretch")


def standing(attempts: DataFrame, limits: Limits) -> DataFrame:
    """(source, key, status, tries, at, due): the last status of each key, its failures since the last answer, and when it may be asked again.

    An answer (ok, absent) is never due again, nor is a key that has failed more often than the limits' retries, until an answer; after too many
    requests the wait doubles with every failure. One row a key; only each key's failures are gathered.
    """
    answered = F.col("status").isin("ok", "absent")
    keys = attempts.groupBy("source", "key").agg(F.max_by(F.struct("status", "at"), F.struct("at", "status")).alias("l"), F.max(F.when(answered, F.col("at"))).alias("_answer"))
    failures = attempts.filter(~answered).join(keys.select("source", "key", "_answer"), ["source", "key"]).filter(F.col("_answer").isNull() | (F.col("at") > F.col("_answer")))
    tries = failures.groupBy("source", "key").agg(F.count(F.lit(1)).alias("tries"))
    rows = keys.join(tries, ["source", "key"], "left").select("source", "key", F.col("l.status").alias("status"), F.coalesce("tries", F.lit(0)).alias("tries"), F.col("l.at").alias("at"))
    wait = F.when(F.col("status") == "limited", limits.back_off * F.pow(F.lit(2.0), F.least(F.col("tries"), F.lit(limits.retries)) - 1)).otherwise(F.lit(limits.apart))
    due = F.timestamp_micros(F.unix_micros("at") + F.round(wait * SECOND).cast("long"))
    return rows.withColumn("due", F.when(F.col("status").isin("ok", "absent", "denied") | (F.col("tries") > limits.retries), None).otherwise(due))


def allowance(attempts: DataFrame, limits: Limits, now: dt.datetime) -> DataFrame:
    """(source, left, next_at): how many requests the budgets leave now, and the earliest moment of the next one.

    A budget that is spent is open again when its oldest request that still counts leaves the window. Only attempts of
    the longest window are read.
    """
    longest = max([*limits.budgets, 1])
    recent = attempts.filter((F.col("at") > F.lit(now - dt.timedelta(seconds=longest))) & (F.col("at") <= F.lit(now)))
    lefts, opens = [], []
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("at"), "key"))
    placed = recent.select("source", "at", place.alias("_nth")).filter(F.col("_nth") <= max([*limits.budgets.values(), 1]))  # as many as a budget has, at most
    for seconds, most in limits.budgets.items():
        inside = F.col("at") > F.lit(now - dt.timedelta(seconds=seconds))
        lefts.append(most - F.count_if(inside & (F.col("_nth") <= most)))
        opens.append(F.max(F.when(inside & (F.col("_nth") == most), F.timestamp_micros(F.unix_micros("at") + seconds * SECOND))))
    opens.append(F.max(F.timestamp_micros(F.unix_micros("at") + round(limits.apart * SECOND))))
    left = F.least(*lefts) if len(lefts) > 1 else lefts[0] if lefts else F.lit(None).cast("long")
    return placed.groupBy("source").agg(left.alias("left"), F.greatest(F.lit(now), *opens).alias("next_at"))


def ask_next(candidates: DataFrame, attempts: DataFrame, limits: Limits, now: dt.datetime, order: list[Column]) -> DataFrame:
    """The candidates (source, key, ...) that may be asked now, in order: never asked or due again, and of each source as many as its budgets leave.

    A source that refused (denied) since its last answer is left alone.
    """
    state = standing(attempts, limits)
    refused = attempts.groupBy("source").agg(F.max(F.when(F.col("status") == "denied", F.col("at"))).alias("d"), F.max(F.when(F.col("status").isin("ok", "absent"), F.col("at"))).alias("a")).filter("d IS NOT NULL AND (a IS NULL OR a < d)")
    open_ = candidates.join(refused.select("source"), "source", "left_anti").join(state.select("source", "key", "status", "due"), ["source", "key"], "left")
    open_ = open_.filter(F.col("status").isNull() | (F.col("due") <= F.lit(now))).drop("status", "due")
    if not limits.budgets:
        return open_.orderBy(*order)
    # no source has more than its least budget, so only so many of each are ranked past their partition
    most = min(limits.budgets.values())
    left = allowance(attempts, limits, now).select("source", "left")
    nth = F.row_number().over(Window.partitionBy("source").orderBy(*order))
    ranked = open_.withColumn("_nth", nth).filter(F.col("_nth") <= most)
    return ranked.join(F.broadcast(left), "source", "left").filter(F.col("_nth") <= F.coalesce("left", F.lit(most))).drop("_nth", "left").orderBy(*order)
