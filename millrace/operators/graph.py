"""Read side of the code graph: nodes, edges, literals as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import short_hash


def node_order() -> list[Column]:
    """Exported first, then complex, then by place."""
    return [F.desc("is_exported"), F.desc("complexity"), F.asc("file_path"), F.asc("start_line")]


def find_symbol(nodes: DataFrame, name: str) -> DataFrame:
    """Exact, case-sensitive name."""
    return nodes.filter(F.col("name") == name)


def find_symbol_fuzzy(nodes: DataFrame, name: str, limit: int = 10) -> DataFrame:
    """Names that contain ``name`` in any case, but are not it."""
    found = nodes.filter(F.contains(F.lower("name"), F.lit(name.lower())) & (F.col("name") != name))
    return found.orderBy(*node_order()).limit(limit)


def impact(edges: DataFrame, symbol: str, depth: int = 2) -> DataFrame:
    """(symbol, depth): callers of ``symbol`` and their callers up to ``depth``, each at its least depth.

    One semi-join of the edges with the last level for each hop; a level is distinct, so hubs aren't repeated.
    """
    calls = edges.filter("source_symbol IS NOT NULL AND target_symbol IS NOT NULL").select("source_symbol", "target_symbol")
    level = calls.filter(F.col("target_symbol") == symbol).select(F.col("source_symbol").alias("symbol")).distinct()
    found = level.withColumn("depth", F.lit(1))
    for d in range(2, depth + 1):
        level = calls.join(level.withColumnRenamed("symbol", "target_symbol"), "target_symbol", "left_semi").select(F.col("source_symbol").alias("symbol")).distinct()
        found = found.unionByName(level.withColumn("depth", F.lit(d)))
    return found.groupBy("symbol").agg(F.min("depth").alias("depth"))


def innermost(points: DataFrame, spans: DataFrame, file: str, line: str, start: str, end: str, name: str, width: int = 64) -> DataFrame:
    """Each point with the shortest span of its file that contains its line; the least start, then name among equals.

    A range join by buckets of ``width`` lines: a span goes to each bucket that it touches, a point to its own, so it
    is an equi-join on (file, bucket).
    """
    cut = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    at = points.withColumn("_b", F.floor(F.col(line) / width))
    joined = at.join(cut.select(file, "_b", start, end, name), [file, "_b"], "left")
    inside = (F.col(start) <= F.col(line)) & (F.col(line) <= F.col(end))
    best = F.min(F.when(inside, F.struct((F.col(end) - F.col(start)).alias("span"), F.col(start).alias("s"), F.col(name).alias("n"))))
    keys = points.columns
    return joined.groupBy(*keys).agg(best["n"].alias("container"))


def neighbourhood(edges: DataFrame, symbol: str, most: int = 3) -> DataFrame:
    """Up to ``most`` callers and ``most`` callees of ``symbol``, by name."""
    sides = []
    for side, mine, other in (("caller", "target_symbol", "source_symbol"), ("callee", "source_symbol", "target_symbol")):
        found = edges.filter(F.col(mine) == symbol).select(F.lit(side).alias("side"), F.col(other).alias("symbol")).distinct()
        sides.append(found)
    ranked = sides[0].unionByName(sides[1]).withColumn("k", F.row_number().over(Window.partitionBy("side").orderBy("symbol")))
    return ranked.filter(F.col("k") <= most).drop("k")


def edge_id(file: Column, source: Column, target: Column, relation: Column, line: Column) -> Column:
    """The key of an edge: a field without a value is an empty one."""
    fields = [F.coalesce(c.cast("string"), F.lit("")) for c in (file, source, target, relation, line)]
    return short_hash(F.concat_ws("|", *fields))


def candidate_score(name: Column, asked: Column, preferred: Column, exported: Column, complexity: Column, fuzzy: Column) -> Column:
    """How well a candidate answers a query (in lower case): match of the name, index that the kind of query prefers, export, complexity; guesses lose."""
    low = F.lower(name)
    match = F.when(low == asked, 1.0).when(F.startswith(low, asked), 0.7).when(F.contains(low, asked), 0.5).otherwise(0.2)
    bonus = F.when(preferred, 0.15).otherwise(0.0) + F.when(exported, 0.05).otherwise(0.0)
    depth = F.when(complexity > 0, F.least(F.lit(0.1), F.log(complexity + 1) * 0.03)).otherwise(0.0)
    return F.least(F.lit(2.0), match + bonus + depth - F.when(fuzzy, 0.15).otherwise(0.0))
