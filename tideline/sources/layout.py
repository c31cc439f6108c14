"""Tables of printed pages: text items and rectangles by place, made into rows of cells.

Items: page, str, x, y. Rectangles: page, x1, y1, x2, y2. y grows upwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the printed list, in points.
#: The band in which a first page's header stands; the gap that begins a column; the least width of a row's band; slack.
HEADER, GAP, WIDTH, SLACK = (495.0, 550.0), 25, 400.0, 0.75


def cluster_starts(xs: Column, gap: float = GAP) -> Column:
    """Starts of clusters of sorted distinct numbers: one begins more than ``gap`` beyond the last start."""
    empty = F.array().cast("array<double>")
    sorted_xs = F.array_sort(F.array_distinct(xs))
    return F.aggregate(sorted_xs, empty, lambda acc, x: F.when(F.size(acc) == 0, F.array(x)).when(x - F.get(acc, F.size(acc) - 1) > gap, F.array_append(acc, x)).otherwise(acc))


def column_bounds(items: DataFrame, columns: int) -> list[float]:
    """Left bounds of the columns and the last one's right, from the header of page 1; raises on another number."""
    head = items.filter((F.col("page") == 1) & F.col("y").between(HEADER[0], HEADER[1]) & (F.col("y") < HEADER[1]))
    starts = head.agg(cluster_starts(F.collect_set(F.round("x").cast("double"))).alias("s")).first()["s"] or []
    if len(starts) != columns:
        raise ValueError(f"expected {columns} header columns, found {len(starts)}: {starts}")
    return [0.0, *[(a + b) / 2 for a, b in zip(starts, starts[1:], strict=False)], starts[-1] + 300]


def divider(items: DataFrame, rects: DataFrame) -> float:
    """The y under the header of page 1: the lowest edge of the rectangles around its lowest text."""
    low = items.filter((F.col("page") == 1) & F.col("y").between(HEADER[0], HEADER[1]) & (F.col("y") < HEADER[1])).agg(F.min("y")).first()[0]
    around = rects.filter((F.col("page") == 1) & (F.col("y1") < F.lit(low)) & (F.col("y2") > F.lit(low)) & (F.col("y2") - F.col("y1") < 100)).agg(F.min("y1")).first()[0]
    if around is None:
        raise ValueError("no rectangle around the header")
    return around


def row_bands(rects: DataFrame, below: float) -> DataFrame:
    """(page, y1, y2, band): the widest rectangle of each height on a page, numbered from the top."""
    fit = rects.filter((F.col("y2") <= below + 0.5) & (F.col("y1") >= 45) & ((F.col("y2") - F.col("y1")).between(8.000001, 99.999999)) & (F.col("x2") - F.col("x1") > WIDTH))
    widest = fit.groupBy("page", F.round("y1", 1).alias("_a"), F.round("y2", 1).alias("_b")).agg(F.max_by(F.struct("y1", "y2"), F.col("x2") - F.col("x1")).alias("r"))
    number = F.row_number().over(Window.partitionBy("page").orderBy(F.desc("y2"), "y1"))
    return widest.select("page", F.col("r.y1").alias("y1"), F.col("r.y2").alias("y2")).withColumn("band", number)


def in_bands(items: DataFrame, bands: DataFrame, bounds: list[float], slack: float = SLACK) -> DataFrame:
    """Items with the bands that hold their y and their column: an equi-join on the page and a range condition."""
    b = bands.withColumnRenamed("page", "_page")
    joined = items.filter(F.trim("str") != "").join(b, (F.col("page") == F.col("_page")) & (F.col("y") >= F.col("y1") - slack) & (F.col("y") <= F.col("y2") + slack))
    last = len(bounds) - 2
    column = F.lit(last)
    for k in range(last, -1, -1):
        column = F.when((F.col("x") >= bounds[k]) & (F.col("x") < bounds[k + 1]), F.lit(k)).otherwise(column)
    return joined.select("page", "band", column.alias("column"), "str", "x", "y")


def cell_text(placed: DataFrame) -> DataFrame:
    """(page, band, column, text): lines from the top, words from the left, a space where a gap is wider than 1.5."""
    line = F.array_sort(F.collect_list(F.struct("x", "str")))
    start = F.struct(F.lit("").alias("text"), F.lit(None).cast("double").alias("end"))

    def step(acc: Column, item: Column) -> Column:
        apart = acc["end"].isNotNull() & (item["x"] - acc["end"] > 1.5) & ~acc["text"].endswith(" ") & ~item["str"].startswith(" ")
        return F.struct(F.concat(acc["text"], F.when(apart, " ").otherwise(""), item["str"]).alias("text"), (item["x"] + F.length(item["str"]) * 4).cast("double").alias("end"))

    joined = F.aggregate(line, start, step, lambda acc: F.trim(F.regexp_replace(acc["text"], r"(?U)\s+", " ")))
    lines = placed.withColumn("_y", F.round("y")).groupBy("page", "band", "column", "_y").agg(joined.alias("text"))
    return lines.groupBy("page", "band", "column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_y")).alias("o"), "text"))), lambda s: s["text"]), "\n").alias("text"))


def table(items: DataFrame, rects: DataFrame, names: list[str]) -> DataFrame:
    """(page, band, one column per name): every row of the printed table; empty cells are empty texts."""
    bounds = column_bounds(items, len(names))
    bands = row_bands(rects, divider(items, rects))
    cells = cell_text(in_bands(items, bands, bounds))
    wide = cells.groupBy("page", "band").agg(*[F.max(F.when(F.col("column") == k, F.col("text"))).alias(n) for k, n in enumerate(names)])
    return bands.select("page", "band").join(wide, ["page", "band"], "left").na.fill("", names)
