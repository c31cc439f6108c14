"""Tilde-delimited files with a header: products, patents and exclusivities.

Lines are read as text, as the raw line and its number of fields are needed to
report what was left out. Every reader returns (good, issues); issues have
file, line, reason and raw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions.dates import short_month_date
from tideline.session import written

ISSUES = ["file", "line", "reason", "raw"]


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, raw): the lines of a file that are not empty, numbered from 1.

    Numbers are positions among these lines in the order of the reader's splits; a
    running count inside each split follows one count per split, so no single task sees the file.
    """
    raw = spark.read.text(path).filter("value != ''").select(F.col("value").alias("raw"), F.monotonically_increasing_id().alias("_id")).withColumn("_part", F.shiftright("_id", 33))
    sizes = {r["_part"]: r["n"] for r in raw.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per split
    base, before = [], 0
    for part in sorted(sizes):
        base.append((part, before))
        before += sizes[part]
    bases = spark.createDataFrame(base or [(0, 0)], "_part long, _before long")
    return raw.join(F.broadcast(bases), "_part").select((F.col("_before") + (F.col("_id") - F.shiftleft(F.col("_part"), 33)) + 1).alias("line"), "raw")


def parsed(lines: DataFrame, names: list[str], file: str, columns: dict[str, Column], reason: Column, texts: bool = False) -> tuple[DataFrame, DataFrame]:
    """(line, raw, columns) of the lines that have one field per name and no ``reason``, without the header line; and issues for the rest.

    ``columns`` and ``reason`` are made of the fields. Everything is written once, so that each line is read and split once, whatever of it is
    asked later. Lines of another width are issues, the header too. ``texts``: is raw kept of good lines too?
    """
    n = F.size("_f")
    split = lines.select("line", "raw", F.split("raw", "~").alias("_f"))
    split = split.select("line", "raw", n.alias("_n"), *[F.get("_f", F.lit(k)).alias(name) for k, name in enumerate(names) if name])
    narrow = F.when(F.col("_n") != len(names), F.concat(F.lit(f"expected {len(names)} fields, got "), F.col("_n").cast("string")))
    made = split.select("line", "raw", "_n", F.coalesce(narrow, reason).alias("reason"), *[c.alias(k) for k, c in columns.items()])
    held = written(made if texts else made.withColumn("raw", F.when(F.col("reason").isNotNull(), F.col("raw"))), "parsed")
    first = held.agg(F.min("line")).first()[0] or 1
    head = held.filter((F.col("line") == first) & (F.col("_n") != len(names)))
    changed = F.concat(F.lit("header has "), F.col("_n").cast("string"), F.lit(f" columns, expected {len(names)}"))
    rows = held.filter(F.col("line") > first)
    issues = head.select(F.lit(file).alias("file"), "line", changed.alias("reason"), "raw").unionByName(rows.filter("reason IS NOT NULL").select(F.lit(file).alias("file"), "line", "reason", "raw"))
    return rows.filter("reason IS NULL").select("line", "raw", *columns), issues


def divided(rows: DataFrame, reason: Column, file: str) -> tuple[DataFrame, DataFrame]:
    """Rows without a reason against them, and issues for the rest."""
    judged = rows.withColumn("reason", reason)
    return judged.filter(F.col("reason").isNull()).drop("reason"), judged.filter(F.col("reason").isNotNull()).select(F.lit(file).alias("file"), "line", "reason", "raw")


def quoted(text: str, column: str) -> Column:
    return F.concat(F.lit(f'{text} "'), F.col(column), F.lit('"'))


PRODUCTS = ["ingredient", "form_route", "trade_name", "", "strength", "appl_type", "appl_no", "product_no", "", "approval", "", "", "", "applicant"]
PATENTS = ["appl_type", "appl_no", "product_no", "patent_no", "expires", "substance", "product", "use_code", "", "submitted"]
EXCLUSIVITIES = ["appl_type", "appl_no", "product_no", "code", "expires"]


def _application_type() -> Column:
    kind = F.trim("appl_type")
    return F.when(kind == "N", "NDA").when(kind == "A", "ANDA")


def _numbers() -> dict[str, Column]:
    return {"application_number": F.concat(_application_type(), F.trim("appl_no")), "product_number": F.trim("product_no")}


def products(lines: DataFrame, file: str = "products.txt") -> tuple[DataFrame, DataFrame]:
    parts = F.split("form_route", ";")
    half = lambda k: F.trim(F.get(parts, F.lit(k)))
    halves = (F.size(parts) == 2) & (half(0) != "") & (half(1) != "")
    reason = (
        F.when(_application_type().isNull(), quoted("unknown application type", "appl_type"))
        .when(~halves, quoted("no dosage form and route in", "form_route"))
        .when(F.trim("applicant") == "", "no applicant")
        .when((F.trim("appl_no") == "") | (F.trim("product_no") == ""), "no application or product number")
    )
    columns = {
        "name": F.trim("trade_name"),
        "alt_name": F.trim("ingredient"),
        "company": F.trim("applicant"),
        "application_type": _application_type(),
        **_numbers(),
        "dosage_form": half(0),
        "route": half(1),
        "strength": F.trim("strength"),
        "approval_date": short_month_date(F.col("approval")),
    }
    good, issues = parsed(lines, PRODUCTS, file, columns, reason)
    return good.drop("raw"), issues


def exclusivities(lines: DataFrame, file: str = "exclusivity.txt") -> tuple[DataFrame, DataFrame]:
    reason = (
        F.when(_application_type().isNull(), quoted("unknown application type", "appl_type"))
        .when((F.trim("appl_no") == "") | (F.trim("product_no") == "") | (F.trim("code") == ""), "no application number, product number or code")
        .when(short_month_date(F.col("expires")).isNull(), quoted("unreadable date", "expires"))
    )
    good, issues = parsed(lines, EXCLUSIVITIES, file, {**_numbers(), "code": F.trim("code"), "expiry": short_month_date(F.col("expires"))}, reason)
    return good.drop("raw"), issues


def patents(lines: DataFrame, file: str = "patent.txt") -> tuple[DataFrame, DataFrame]:
    """One row per product, patent and use code, from a plain line and one with the suffix ``*PED``.

    The first line of each kind counts. The plain line's date is the nominal one and the
    suffixed line's the effective one; the adjustment is known only if both are.
    """
    reason = F.when(_application_type().isNull(), quoted("unknown application type", "appl_type")).when(
        (F.trim("appl_no") == "") | (F.trim("product_no") == "") | (F.trim("patent_no") == ""), "no application, product or patent number"
    )
    number = F.trim("patent_no")
    marker = F.when(F.instr(number, "*") > 0, F.expr("substring(trim(patent_no), instr(trim(patent_no), '*') + 1)")).otherwise("")
    columns = {**_numbers(), "patent_number": F.substring_index(number, "*", 1), "use_code": F.trim("use_code"), "marker": marker, "expires": F.col("expires"), "date": short_month_date(F.col("expires"))}
    columns |= {c: F.col(c) for c in ("substance", "product", "submitted")}
    good, bad = parsed(lines, PATENTS, file, columns, reason, texts=True)
    odd = good.filter(~F.col("marker").isin("", "PED")).select(F.lit(file).alias("file"), "line", quoted("unknown suffix", "marker").alias("reason"), "raw")
    merged, issues = merge_marked(good, ["application_number", "product_number", "patent_number", "use_code"], file)
    yes = lambda c: F.upper(F.trim(c)) == "Y"
    out = merged.select(
        "application_number",
        "product_number",
        "patent_number",
        "use_code",
        F.coalesce(F.col("plain.date"), F.col("marked.date")).alias("nominal_expiry"),
        F.coalesce(F.col("marked.date"), F.col("plain.date")).alias("expiry"),
        F.datediff("marked.date", "plain.date").alias("adjustment_days"),
        F.coalesce(yes(F.coalesce("plain.substance", "marked.substance")), F.lit(False)).alias("covers_substance"),
        F.coalesce(yes(F.coalesce("plain.product", "marked.product")), F.lit(False)).alias("covers_product"),
        short_month_date(F.coalesce("plain.submitted", "marked.submitted")).alias("submitted_date"),
    )
    return out, bad.unionByName(odd).unionByName(issues)


def merge_marked(rows: DataFrame, key: list[str], file: str) -> tuple[DataFrame, DataFrame]:
    """(key, plain, marked): the first plain and the first marked row of each key, as structs.

    One grouped aggregate: the least struct by line of each kind. Keys without any usable
    date are left out. Issues: extra rows, dates that do not parse, a marked row alone.
    """
    held = F.struct("line", "raw", "expires", "date", "substance", "product", "submitted")
    ped = F.col("marker") == "PED"
    sides = rows.groupBy(*key).agg(
        F.min(F.when(~ped, held)).alias("plain"),
        F.min(F.when(ped, held)).alias("marked"),
        (F.count(F.lit(1)) - F.max((~ped).cast("int")) - F.max(ped.cast("int"))).alias("extra"),
        F.min("line").alias("line"),
    )
    unread = lambda s: F.when(F.col(s).isNotNull() & F.col(f"{s}.date").isNull(), F.concat(F.lit('unreadable date "'), F.col(f"{s}.expires"), F.lit('"')))
    said = F.array_compact(
        F.array(
            F.when(F.col("extra") > 0, F.concat(F.col("extra").cast("string"), F.lit(" rows beyond one plain and one marked were left out"))),
            unread("plain"),
            unread("marked"),
            F.when(F.col("plain").isNull(), "a marked row without a plain one: its date is used for both"),
            F.when(F.coalesce("plain.date", "marked.date").isNull(), "no usable date"),
        )
    )
    shown = F.when(F.size("_said") > 0, F.coalesce("plain.raw", "marked.raw"))
    told = sides.withColumn("_said", said).select(*key, *[F.col(s).dropFields("raw", "line", "expires").alias(s) for s in ("plain", "marked")], "line", "_said", shown.alias("raw"))
    groups = written(told, "merged")  # rows and issues come of one grouping
    issues = groups.select(F.lit(file).alias("file"), "line", F.explode("_said").alias("reason"), "raw")
    return groups.filter(F.coalesce("plain.date", "marked.date").isNotNull()).select(*key, "plain", "marked"), issues


def issue_categories(issues: DataFrame, top: int = 20, examples: int = 3) -> DataFrame:
    """(category, n, examples): like reasons together, the most frequent first, with their first lines."""
    from tideline.functions.text import without_quotes

    kinds = issues.select(without_quotes(F.col("reason")).alias("category"), "file", "line", "raw")
    nth = F.row_number().over(Window.partitionBy("category").orderBy("file", "line", "raw"))
    few = kinds.withColumn("_nth", nth).filter(F.col("_nth") <= examples).groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("_nth", "raw"))), lambda s: s["raw"]).alias("examples"))
    counts = kinds.groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category").limit(top)
    return counts.join(few, "category").orderBy(F.desc("n"), "category")
