"""Connected components of a graph given as edges, by large and small stars.

Alternating star operations (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014). Every pass is a grouped minimum and a join in
Spark; each pass ends in a reliable checkpoint, so a lost executor costs one
pass. A node with many edges is a skewed key of one join, which AQE splits:
the other side has one row for each node. Nodes of a fixed size (numbers) are
aggregated in hash tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.session import cut

#: Passes after which something must be wrong: the method needs about log2 of the nodes, squared at worst.
MOST_PASSES = 200


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each node with an edge can reach.

    Self loops and repeated edges are allowed; edges with a null end are
    dropped. No edges: no rows.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
    e = cut(e.distinct())
    before = _state(e)
    for _ in range(MOST_PASSES):
        if not before[0]:
            break
        # large star: the larger neighbours of u go to the smallest of u and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        # small star: the smaller neighbours of u, and u, go to the smallest
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
        now = _state(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {MOST_PASSES} passes")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(e: DataFrame) -> tuple:
    row = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]
