"""Connected components of a graph of longs, by hooking to the least neighbour and pointer jumping.

Each round every vertex hooks to its least neighbour, chains are shortened to their roots, and the edges between
roots go on to the next round; so the rounds are logarithmic in the number of vertices. Nothing is collected: only
counts reach the driver. Every round ends in the shared folder, in few partitions once few rows are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import compact


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, root) for the vertices of ``edges``; root is the least vertex of the component.

    Nulls at either end and edges from a vertex to itself are dropped; no edges give no rows.
    """
    rest = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    rest = compact(rest.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    whole = None
    while not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = compact(both.groupBy(F.col("a").alias("vertex")).agg(F.min("b").alias("m")).select("vertex", F.least("vertex", "m").alias("root")))
        while True:
            up = hook.select(F.col("vertex").alias("root"), F.col("root").alias("above"))
            hook = compact(hook.join(up, "root").select("vertex", F.col("above").alias("root"), (F.col("above") < F.col("root")).alias("moved")))
            if hook.filter("moved").isEmpty():
                break
            hook = hook.drop("moved")
        hook = hook.select("vertex", "root")
        if whole is None:
            whole = hook
        else:
            later = hook.select(F.col("vertex").alias("root"), F.col("root").alias("above"))
            whole = compact(whole.join(later, "root", "left").select("vertex", F.coalesce("above", "root").alias("root")))
        ends = hook.select(F.col("vertex"), F.col("root"))
        rest = (
            rest.join(ends.select(F.col("vertex").alias("a"), F.col("root").alias("ra")), "a")
            .join(ends.select(F.col("vertex").alias("b"), F.col("root").alias("rb")), "b")
            .filter("ra <> rb")
            .select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b"))
        )
        rest = compact(rest.distinct())
    if whole is None:
        return rest.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    return whole
