"""Terminal output, and prefixes of mounted routers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mounts, terminal
from ..sources.tables import table
from .registry import query

#: every turn as a terminal would show it: a coloured line of its text, a bar that grows by its turn, a spinner, a line drawn over, log lines
SHOWN = """concat(chr(27), '[1;32m', replace(coalesce(text, ''), chr(10), ' '), chr(27), '[0m', chr(10), chr(27), ']0;title', chr(7), repeat(concat('[####....] 40%', chr(10)), cast(turn AS int)), 'a', chr(13), 'b', chr(13), 'done  ', chr(10),
 repeat(concat('⠋ wait ', cast(conv_id AS varchar(20)), chr(10)), cast(conv_id % 5 AS int)), 'npm verb x', chr(10), chr(10), chr(10), chr(10), 'end', chr(10), repeat(concat('⠙', chr(10)), 3), '  ', chr(10))"""


@query(
    "collapse_progress",
    """WITH r AS (SELECT conv_id, turn, trim(replace(coalesce(text, ''), chr(10), ' '), ' ') AS t, CASE WHEN turn >= 3 THEN '[####....] 40%  [' || (turn - 1) || ' progress lines collapsed]' || chr(10) ELSE repeat('[####....] 40%' || chr(10), turn::INTEGER) END AS bars,
      CASE WHEN conv_id % 5 >= 3 THEN 'wait ' || conv_id || '  [' || (conv_id % 5 - 1) || ' progress lines collapsed]' || chr(10) ELSE repeat('⠋ wait ' || conv_id || chr(10), (conv_id % 5)::INTEGER) END AS spin FROM conversations)
    SELECT conv_id, turn, trim(t || chr(10) || bars || 'done' || chr(10) || spin || chr(10) || 'end' || chr(10) || '[3 progress lines collapsed]', ' ' || chr(10)) AS text FROM r""",
)
def collapse_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(SHOWN).alias("text"))
    return terminal.scrub(shown, ["conv_id", "turn"], "text")


MOUNTS = {
    "parent": "concat('r', cast(l_suppkey AS varchar(20)), '.js')",
    "child": "concat('r', cast(l_suppkey * 2 + 1 + l_partkey % 2 AS varchar(20)), '.js')",
    "prefix": "concat('/p', cast(l_partkey % 7 AS varchar(20)))",
    "place": "l_orderkey * 10 + l_linenumber",
}
_MOUNTS = ", ".join(f"{v} AS {k}" for k, v in MOUNTS.items())


@query(
    "mounted_routes",
    f"""WITH RECURSIVE m AS (SELECT {_MOUNTS} FROM lineitem), last AS (SELECT parent, child, prefix FROM m QUALIFY row_number() OVER (PARTITION BY child ORDER BY place DESC, prefix DESC, parent DESC) = 1),
    walk AS (SELECT DISTINCT parent AS path, '' AS prefix, 0 AS depth FROM last WHERE parent NOT IN (SELECT child FROM last) UNION ALL SELECT l.child, w.prefix || l.prefix, w.depth + 1 FROM walk w JOIN last l ON l.parent = w.path)
    SELECT path, depth::INTEGER AS depth, prefix || '/orders' AS route FROM walk""",
)
def mounted_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The route of each router file, with the prefixes of all that mount it; a supplier's file mounts two others."""
    found = mounts.mount_prefixes(table(spark, sf_dir, "lineitem").selectExpr(*[f"{v} AS {k}" for k, v in MOUNTS.items()]))
    return found.select("path", "depth", F.concat("prefix", F.lit("/orders")).alias("route"))
