"""Loads of whole releases: parse, first seen, keys, match, upsert, provenance, counts.

A load reads the tables as of one commit and stages their next snapshots, which the run commits together
with its own end (``runs.run``). Numbers of rows upserted, repeated, skipped and left out are
observed while the tables are written, above the last exchange of each write, where a
task's rows count once however often it is tried; nothing is scanned to be counted.

As in the sources, a release is upserted and never deletes: rows that it lacks stay. Patents
and exclusivities belong to the products of the same release; those of others are skipped with an issue.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tideline.functions import classify, extract
from tideline.operators import keys, matching, store as tables
from tideline.operators.commits import Commit, Store
from tideline.operators.runs import Load, Loaded
from tideline.schemas import PROVENANCE
from tideline.session import written
from tideline.sources import monthly, tilde

_PRODUCT = "application_number string, product_number string, name string, alt_name string, company_id long"
_FORM = "dosage_form string, route string, strength string, approval_date date, modality string, drug_class string"
_PATENT = "product_id long, patent_number string, use_code string, nominal_expiry date, expiry date, adjustment_days int, filing_date date"
SCHEMAS = {
    "companies": "company_id long, name string",
    "products_a": f"product_id long, {_PRODUCT}, application_type string, {_FORM}",
    "patents_a": f"{_PATENT}, submitted_date date, covers_substance boolean, covers_product boolean",
    "exclusivities_a": "product_id long, code string, expiry date",
    "products_b": f"product_id long, {_PRODUCT}, license_type string, center string, marketing_status string, reference_name string, reference_id long, {_FORM}",
    "patents_b": _PATENT,
    "exclusivities_b": "product_id long, code string, expiry date",
    "challenges": "challenge_id long, natural_number string, active_ingredient string, dosage_form string, strength string, name string, application_number string, submission_kind string, submission_date date, applicants int, history array<struct<status:string,posting_date:date,raw_text:string>>, current_status string, first_approval date, first_marketing date, last_patent_expiry date",
    "challenge_links": "challenge_id long, product_id long",
    "records": PROVENANCE,
    "issues": "run_id string, file string, line long, reason string, raw string",
}
PRODUCT_KEY = ["application_number", "product_number"]


def _columns(table: str) -> list[str]:
    """The names of a table's columns; types here have no space after a comma."""
    return [f.split()[0] for f in SCHEMAS[table].split(", ")]


def _local_issue(rows: DataFrame, file: str, reason: str) -> DataFrame:
    return rows.sparkSession.createDataFrame([(file, -1, reason, "")], "file string, line long, reason string, raw string")


class _Work:
    """One load at work: its base, what it has staged, and its issues."""

    def __init__(self, store: Store, base: Commit, run_id: str, source: str, now: dt.datetime, check: Callable[[], None]) -> None:
        self.store, self.base, self.run_id, self.source, self.now, self.check = store, base, run_id, source, now, check
        self.done = Loaded()
        self.issues: list[tuple[DataFrame, bool]] = []
        self.touched: list[DataFrame] = []

    def old(self, table: str) -> DataFrame:
        return self.store.read(table, SCHEMAS[table], self.base)

    def now_(self, table: str) -> DataFrame:
        """A table as this load has staged it, or as it was."""
        path = self.done.replaced.get(table)
        return self.old(table) if path is None else self.store.spark.read.schema(SCHEMAS[table]).parquet(f"{self.store.folder}/{path}")

    def replace(self, table: str, rows: DataFrame) -> None:
        self.check()
        self.done.replaced[table] = self.store.stage(table, rows.select(*_columns(table)))

    def upsert(self, table: str, new: DataFrame, key: list[str], keep_if: dict[str, Column] | None = None) -> None:
        counts = Observation(f"upsert-{table}")
        self.replace(table, tables.upsert(self.old(table), new, key, keep_if, counts))
        self.done.upserted[table] = counts.get["upserted"]
        self.done.summary.setdefault("inserted", {})[table] = counts.get["inserted"]

    def firsts(self, rows: DataFrame, key: list[str], order: list[str], file: str) -> DataFrame:
        """The first row of each key, written once; repeats are one issue that says how many."""
        self.check()
        counts = Observation(f"first-{file}")
        first = rows.groupBy(*key).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_r"), F.count(F.lit(1)).alias("_n"))
        first = written(first.observe(counts, F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("keys")).select("_r.*"), "first")
        rows_, kept = counts.get["rows"] or 0, counts.get["keys"]
        self.done.summary.setdefault("parsed", {})[file] = rows_
        if rows_ > kept:
            self.issues.append((_local_issue(rows, file, f"{rows_ - kept} rows repeat a key that was seen before in this run"), False))
        return first

    def issue(self, rows: DataFrame, skipped: bool = False) -> None:
        self.issues.append((rows.select("file", F.col("line").cast("long").alias("line"), "reason", "raw"), skipped))

    def owned(self, rows: DataFrame, owners: DataFrame, key: list[str], file: str, raw: str) -> DataFrame:
        """rows with their product_id, written once; those of products that this run has not seen are skipped with an issue."""
        self.check()
        met = written(rows.join(owners.select(*key, "product_id"), key, "left"), "owned")
        reason = F.concat(F.lit('no product found for "'), F.concat_ws("/", *key), F.lit('"'))
        self.issue(met.filter("product_id IS NULL").select(F.lit(file).alias("file"), F.lit(-1).alias("line"), reason.alias("reason"), F.col(raw).alias("raw")), skipped=True)
        return met.filter("product_id IS NOT NULL")

    def touch(self, rows: DataFrame, kind: str, *key: str) -> None:
        self.touched.append(tables.provenance(rows, self.source, kind, F.concat_ws("/", *key), self.now, payload=False))

    def keyed_products(self, first: DataFrame, table: str, fallback: str) -> DataFrame:
        """The release's products with the ids of their companies and their own, new ones for new names, and their classes."""
        self.replace("companies", keys.assign(self.old("companies"), first.select(F.col("company").alias("name")), ["name"], "company_id"))
        ids = keys.assign(self.old(table).select(*PRODUCT_KEY, "product_id"), first, PRODUCT_KEY, "product_id")
        named = first.join(self.now_("companies").withColumnRenamed("name", "company"), "company").join(ids, PRODUCT_KEY)
        made = {"modality": classify.modality(F.col("alt_name"), fallback), "drug_class": classify.drug_class(F.col("alt_name"))}
        return written(named.withColumns(made), "products")

    def finish(self) -> Loaded:
        """Write records and issues, and count the issues."""
        self.check()
        self.done.appended["records"] = self.store.stage("records", reduce(DataFrame.unionByName, self.touched))
        counts = Observation("issues")
        rows = reduce(DataFrame.unionByName, [r.withColumn("_skipped", F.lit(s)) for r, s in self.issues])
        seen = rows.observe(counts, F.count(F.lit(1)).alias("issues"), F.count_if("_skipped").alias("skipped"))
        self.done.appended["issues"] = self.store.stage("issues", seen.select(F.lit(self.run_id).alias("run_id"), "file", "line", "reason", "raw"))
        self.done.issues, self.done.skipped = counts.get["issues"], counts.get["skipped"]
        staged = self.store.spark.read.schema(SCHEMAS["issues"]).parquet(f"{self.store.folder}/{self.done.appended['issues']}")
        self.done.summary["categories"] = [r.asDict() for r in tilde.issue_categories(staged).collect()]  # twenty at most
        return self.done


def tilde_load(lines: dict[str, DataFrame], source: str = "tilde") -> Load:
    """A load of the three tilde files: ``lines`` has (line, raw) of products, patents and exclusivities."""

    def load(store: Store, base: Commit, run_id: str, now: dt.datetime, check: Callable[[], None]) -> Loaded:
        w = _Work(store, base, run_id, source, now, check)
        products, odd = tilde.products(lines["products"])
        w.issue(odd)
        first = w.firsts(products, PRODUCT_KEY, ["line"], "products.txt")
        own = w.keyed_products(first, "products_a", "SMALL_MOLECULE")
        w.upsert("products_a", own.select(*_columns("products_a")), PRODUCT_KEY)
        w.touch(own, "product", "product_id")

        patents, odd = tilde.patents(lines["patents"])  # one row a key already
        w.issue(odd)
        patents = w.owned(patents, own, PRODUCT_KEY, "patent.txt", "patent_number").drop(*PRODUCT_KEY)
        # terms of a second source, which alone knows filing dates, stay
        enriched = F.col("o.filing_date").isNotNull()
        w.upsert("patents_a", patents, ["product_id", "patent_number", "use_code"], {"expiry": enriched, "adjustment_days": enriched})
        w.touch(patents, "patent", "product_id", "patent_number", "use_code")

        found, odd = tilde.exclusivities(lines["exclusivities"])
        w.issue(odd)
        found = w.firsts(found, [*PRODUCT_KEY, "code", "expiry"], ["line"], "exclusivity.txt")
        found = w.owned(found, own, PRODUCT_KEY, "exclusivity.txt", "code").select("product_id", "code", "expiry")
        w.upsert("exclusivities_a", found, ["product_id", "code", "expiry"])
        w.touch(found, "exclusivity", "product_id", "code", "expiry")
        return w.finish()

    return load


def monthly_load(lines: DataFrame, expected: list[str], patent_pages: DataFrame | None = None, table_id: str = "patents", source: str = "monthly") -> Load:
    """A load of the monthly CSV, (line, raw), and of the patent list's pages, (html), if they are given.

    References are resolved among the release's own products; those that are not stay as names, with an issue.
    """

    def load(store: Store, base: Commit, run_id: str, now: dt.datetime, check: Callable[[], None]) -> Loaded:
        w = _Work(store, base, run_id, source, now, check)
        rows, odd = monthly.section(lines, expected)
        w.issue(odd)
        products, odd = monthly.products(rows)
        w.issue(odd)
        first = w.firsts(products.drop("cell", "raw"), PRODUCT_KEY, ["line"], "products.csv")
        own = w.keyed_products(first, "products_b", "UNCLASSIFIED")
        found = written(matching.references(own), "references")
        w.issue(matching.unresolved_references(own, found, F.concat_ws("/", *PRODUCT_KEY), "products.csv"))
        # the stated name is the first of the two, and a reference that is not found now keeps the one of before
        stated = own.join(found.filter("reference_id IS NOT NULL"), "product_id", "left")
        w.upsert("products_b", stated.select(*_columns("products_b")), PRODUCT_KEY, {"reference_id": F.col("n.reference_id").isNull()})
        w.touch(own, "product", "product_id")

        dates, odd = monthly.exclusivities(products)
        w.issue(odd)
        dates = w.firsts(dates, [*PRODUCT_KEY, "code", "expiry"], ["code"], "exclusivities of products.csv")
        dates = w.owned(dates, own, PRODUCT_KEY, "products.csv", "code").select("product_id", "code", "expiry")
        w.upsert("exclusivities_b", dates, ["product_id", "code", "expiry"])
        w.touch(dates, "exclusivity", "product_id", "code", "expiry")

        if patent_pages is not None:
            listed = w.firsts(monthly.patent_list(patent_pages, table_id), ["application_number", "patent_number"], ["expiry", "name", "alt_name", "company"], "patent-list.html")
            patents = w.owned(listed, own, ["application_number"], "patent-list.html", "patent_number")  # every product of the application has it
            patents = patents.select("product_id", "patent_number", F.lit("").alias("use_code"), F.col("expiry").alias("nominal_expiry"), "expiry")
            enriched = F.col("o.filing_date").isNotNull()
            w.upsert("patents_b", patents, ["product_id", "patent_number"], {"expiry": enriched, "nominal_expiry": enriched})
            w.touch(patents, "patent", "product_id", "patent_number")
        return w.finish()

    return load


def challenges_load(cells: DataFrame, source: str = "challenges") -> Load:
    """A load of the printed list of challenges: eleven text columns as ``extract.challenge`` names them, and ``line``.

    The links of the challenges that the list confirms are made anew, to the products of source A as they are now; all others stay.
    """

    def load(store: Store, base: Commit, run_id: str, now: dt.datetime, check: Callable[[], None]) -> Loaded:
        w = _Work(store, base, run_id, source, now, check)
        read = extract.challenge({c: F.col(c) for c in cells.columns if c != "line"})
        rows = cells.select("line", *[c.alias(n) for n, c in read.items()])
        shown = F.concat_ws(" / ", "name", "active_ingredient", "dosage_form")
        w.issue(rows.select(F.lit("list").alias("file"), "line", F.explode("issues").alias("reason"), shown.alias("raw")))
        natural = ["natural_number", "active_ingredient", "dosage_form", "strength"]
        rows = rows.drop("issues").withColumn("natural_number", F.coalesce("application_number", F.concat(F.lit("none: "), F.col("name"))))
        first = w.firsts(rows, natural, ["line"], "list")
        ids = keys.assign(w.old("challenges").select(*natural, "challenge_id"), first, natural, "challenge_id")
        own = written(first.join(ids, natural), "challenges")
        w.upsert("challenges", own.select(*_columns("challenges")), natural)
        w.touch(own, "challenge", "challenge_id")

        products = w.old("products_a")
        notes = written(matching.challenge_notes(own, products), "notes")
        told = notes.filter("note IS NOT NULL").join(own, "challenge_id")
        w.issue(told.select(F.lit("list").alias("file"), F.lit(-1).alias("line"), F.col("note").alias("reason"), shown.alias("raw")))
        links = matching.challenge_links(own, products)  # many more than either side has rows, so they are written just once, below
        # a challenge that has no product any more loses its links as well
        stay = w.old("challenge_links").join(own.select("challenge_id"), "challenge_id", "left_anti")
        counts = Observation("links")
        w.replace("challenge_links", stay.unionByName(links.observe(counts, F.count(F.lit(1)).alias("n"))))
        w.done.summary |= {"links": counts.get["n"], "linked": {r["linked"]: r["count"] for r in notes.groupBy("linked").count().collect()}}
        return w.finish()

    return load


def canonical(store: Store, at: Commit | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(products, patents, exclusivities) of both sources, as the estimate and the lists take them, all as of one commit."""
    at = at or store.last()
    t = lambda name: store.read(name, SCHEMAS[name], at)
    named = t("companies").select("company_id", F.col("name").alias("company"))
    both = lambda kind: t(f"{kind}_a").withColumn("source", F.lit("A")).unionByName(t(f"{kind}_b").withColumn("source", F.lit("B")), allowMissingColumns=True).withColumn("product_id", F.col("product_id").cast("string"))
    patents = both("patents").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("covers_substance", "covers_product")}).withColumn("live", F.lit(True))
    return both("products").join(named, "company_id", "left"), patents, both("exclusivities")
