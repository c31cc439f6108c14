"""Snapshot tables with natural keys, append-only provenance, link tables and runs.

Parquet has no update in place. An upsert is a full outer join of the old
snapshot and the new rows on the natural key; the result is a new snapshot that
replaces the old one when it is whole.
"""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def _outer(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Both sides as structs ``o`` and ``n``, met on the key; nulls in keys are equal."""
    a = old.select(F.struct(*old.columns).alias("o"))
    b = new.select(F.struct(*new.columns).alias("n"))
    return a.join(b, reduce(lambda x, y: x & y, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key]), "full")


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep_if: dict[str, Column] | None = None, counts: Observation | None = None) -> DataFrame:
    """The new row where there is one, else the old. New keys must be unique.

    ``keep_if``: columns whose old value stays if the condition (over ``o`` and ``n``) holds.
    Columns that the new rows lack keep their old value. ``counts`` gets upserted and inserted, the numbers of
    new rows and of those without an old one, while the result is computed.
    """
    keep_if = keep_if or {}
    out = []
    for c in old.columns:
        value = F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in new.columns else F.col(f"o.{c}")
        if c in keep_if:
            value = F.when(F.col("o").isNotNull() & F.coalesce(keep_if[c], F.lit(False)), F.col(f"o.{c}")).otherwise(value)
        out.append(value.alias(c))
    met = _outer(old, new, key)
    if counts is not None:
        is_new = F.col("n").isNotNull()
        met = met.observe(counts, F.count_if(is_new).alias("upserted"), F.count_if(is_new & F.col("o").isNull()).alias("inserted"))
    return met.select(*out)


def insert_if_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*key), key, "left_anti").select(*old.columns))


def changes(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(key, change): inserted or updated, for the rows that an upsert would touch."""
    rest = [c for c in new.columns if c not in key]
    differs = reduce(lambda a, b: a | b, [~F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in rest], F.lit(False))
    rows = _outer(old, new, key).filter(F.col("n").isNotNull())
    return rows.withColumn("change", F.when(F.col("o").isNull(), "inserted").when(differs, "updated")).filter("change IS NOT NULL").select(*[F.col(f"n.{k}").alias(k) for k in key], "change")


def reclassified(rows: DataFrame, new_values: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The rows with new values in some columns, and those of them that changed, with the old values."""
    olds = {f"old_{c}": F.col(c) for c in new_values}
    out = rows.withColumns(olds).withColumns(new_values)
    changed = out.filter(reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in new_values]))
    return out.drop(*olds), changed


def add_links(old: DataFrame, new: DataFrame) -> DataFrame:
    """Links that only ever grow."""
    return old.unionByName(new.select(*old.columns)).dropDuplicates(old.columns)


def replace_links(old: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """Links of the owners that the new ones confirm are replaced; all others stay."""
    stay = old.join(new.select(owner).distinct(), owner, "left_anti").select(*old.columns)
    return stay.unionByName(new.select(*old.columns).distinct())


def toggle(old: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows that are there go, rows that are not come."""
    key = old.columns
    return old.join(rows, key, "left_anti").unionByName(rows.select(*key).distinct().join(old, key, "left_anti"))


def insert_manual(table: DataFrame, row: dict, key: list[str], entered_by: str, source: str, now: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """The table with one more row, and its provenance; a key that is there already raises."""
    spark = table.sparkSession
    new = spark.createDataFrame([tuple(row.get(c) for c in table.columns)], table.schema)
    if not new.join(table.select(*key), key, "left_semi").isEmpty():
        raise ValueError(f"there is a row with {', '.join(f'{k}={row.get(k)}' for k in key)} already")
    record = provenance(new, source, "manual", F.concat_ws("/", *key), now, entered_by)
    return table.unionByName(new), record


def provenance(rows: DataFrame, source: str, kind: str, entity: Column, now: dt.datetime, entered_by: str | None = None, note: Column | None = None, payload: bool = True) -> DataFrame:
    """One record per row, to be appended; without ``payload`` it does not hold the row itself, as those of whole releases do not."""
    return rows.select(
        F.lit(source).alias("source"),
        F.lit(kind).alias("entity_kind"),
        entity.cast("string").alias("entity_id"),
        F.lit(None).cast("string").alias("external_ref"),
        (F.lit(None).cast("string") if note is None else note).alias("change_note"),
        (F.to_json(F.struct(*rows.columns)) if payload else F.lit(None).cast("string")).alias("raw_payload"),
        F.lit(entered_by).cast("string").alias("entered_by"),
        F.lit(now).cast("timestamp").alias("verified_at"),
        F.lit(now).cast("timestamp").alias("created_at"),
    )


def append(records: DataFrame, path: str) -> None:
    records.write.mode("append").partitionBy("source").parquet(path)


def replace_snapshot(rows: DataFrame, folder: str) -> str:
    """Write a snapshot under a new name; the path. Readers of the old one are not disturbed."""
    path = f"{folder.rstrip('/')}/snapshot-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return path


def latest_source(records: DataFrame) -> DataFrame:
    """(entity_kind, entity_id, source, verified_at, manual): who said it last."""
    g = records.groupBy("entity_kind", "entity_id").agg(F.max_by(F.struct("source", "entered_by"), F.struct("verified_at", "created_at", "source")).alias("l"), F.max("verified_at").alias("verified_at"))
    return g.select("entity_kind", "entity_id", F.col("l.source").alias("source"), "verified_at", F.col("l.entered_by").isNotNull().alias("manual"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """The last run of each source."""
    nth = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("started_at"), F.desc("run_id")))
    return runs.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def audit_log(records: DataFrame, users: DataFrame, limit: int = 50) -> DataFrame:
    """Manual records, the newest first, with their users' names."""
    rows = records.filter(F.col("entered_by").isNotNull()).join(users.select(F.col("id").alias("entered_by"), F.col("name").alias("user_name")), "entered_by", "left")
    return rows.orderBy(F.desc("created_at"), "entity_id").limit(limit)


def unlinked(rows: DataFrame, links: DataFrame, key: str) -> DataFrame:
    return rows.join(links.select(key).distinct(), key, "left_anti")


def link(links: DataFrame, owner: object, item: object, entered_by: str, now: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """One more link, and its provenance; a link that is there already is left as it is, without a record."""
    new = links.sparkSession.createDataFrame([(owner, item)], links.schema)
    fresh = new.join(links, links.columns, "left_anti")
    return links.unionByName(fresh), provenance(fresh, "manual", "link", F.concat_ws("/", *links.columns), now, entered_by)


def status(runs: DataFrame, records: DataFrame) -> DataFrame:
    """Per source its last run and how many entities its records know."""
    known = records.groupBy("source").agg(F.countDistinct("entity_id").alias("entities"), F.max("verified_at").alias("verified_at"))
    return latest_runs(runs).join(known, "source", "full")


def watchlist(items: DataFrame, products: DataFrame) -> DataFrame:
    """What a user watches, with the products' names; items of products that are gone stay, without a name."""
    return items.join(products.select("source", "product_id", "name", "company"), ["source", "product_id"], "left")


#: A run that has been open for so many hours may be taken over.
STALE_HOURS = 6


def may_start(runs: DataFrame, source: str, now: dt.datetime) -> bool:
    """No run of the source is open, or the open one is stale."""
    open_ = runs.filter((F.col("source") == source) & (F.col("status") == "RUNNING") & (F.col("started_at") > F.lit(now - dt.timedelta(hours=STALE_HOURS))))
    return open_.isEmpty()


def run_status(issues: int, skipped: int, failed: bool = False, cancelled: bool = False) -> str:
    """SUCCESS only without any issue or skip."""
    if failed:
        return "FAILED"
    if cancelled:
        return "CANCELLED"
    return "PARTIAL" if issues or skipped else "SUCCESS"


def run_row(spark: SparkSession, source: str, started: dt.datetime, finished: dt.datetime | None, upserted: int, issues: int, skipped: int, failed: bool = False, cancelled: bool = False, summary: str | None = None) -> DataFrame:
    status = "RUNNING" if finished is None else run_status(issues, skipped, failed, cancelled)
    return spark.createDataFrame([(uuid.uuid4().hex, source, status, started, finished, upserted, skipped, summary)], "run_id string, source string, status string, started_at timestamp, finished_at timestamp, rows_upserted long, rows_skipped long, summary string")


def chain(steps: list[tuple[str, object]]) -> list[tuple[str, str]]:
    """Run (name, callable) in order; each returns a status, and FAILED or CANCELLED ends the chain."""
    done = []
    for name, step in steps:
        status = step()  # type: ignore[operator]
        done.append((name, status))
        if status in ("FAILED", "CANCELLED"):
            break
    return done
