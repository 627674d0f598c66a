"""Prefixes of routes along chains of mounted routers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mount_prefixes(mounts: DataFrame, max_depth: int = 32) -> DataFrame:
    """(path, prefix, depth): the prefix of every file from the files that nobody mounts downwards.

    ``mounts`` (parent, child, prefix, place): of a child's mounts that with the greatest place counts, then the greatest prefix and parent. Depth
    is 0 for files that are mounted nowhere. Files in a circle of mounts are below no such file and have no row; a chain longer than
    ``max_depth`` raises an error rather than being cut.
    """
    spark = mounts.sparkSession
    last = mounts.filter("parent IS NOT NULL AND child IS NOT NULL").groupBy("child").agg(F.max(F.struct("place", "prefix", "parent")).alias("m")).select(F.col("m.parent").alias("parent"), "child", F.col("m.prefix").alias("prefix"))
    return spark.sql(
        f"""WITH RECURSIVE last AS (SELECT * FROM {{last}}),
        walk(path, prefix, depth) MAX RECURSION LEVEL {max_depth + 2} AS (
          SELECT DISTINCT parent, cast('' AS string), 0 FROM last l LEFT ANTI JOIN (SELECT child FROM last) c ON l.parent = c.child
          UNION ALL SELECT l.child, concat(w.prefix, l.prefix), w.depth + 1 FROM walk w JOIN last l ON l.parent = w.path)
        SELECT path, prefix, CASE WHEN depth > {max_depth} THEN raise_error('a chain of mounts is longer than {max_depth}') ELSE depth END AS depth FROM walk""",
        last=last,
    )
