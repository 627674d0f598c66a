"""What each user's message may use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import request_plan, signals
from .conversation import MESSAGES_SQL, by_turn, messages
from .registry import query


def _sql() -> str:
    parts: dict[str, list[str]] = {k: [] for k in signals.INTENT_ORDER}
    for name, weight, pattern, longest in signals.INTENTS:
        parts[name].append(f"(regexp_matches(text, {signals.sql_literal('(?i)' + pattern)})" + (f" AND length(text) <= {longest}" if longest else "") + f")::INT * {weight}")
    sums = ", ".join(f"{' + '.join(v)} AS {k.lower()}" for k, v in parts.items())
    return f"""WITH {MESSAGES_SQL}, h AS (SELECT *, coalesce(bool_or(is_tool) OVER b, false) AS tools, coalesce(bool_or(role = 'assistant') OVER b, false) AS goes_on FROM m WINDOW b AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    s AS (SELECT conv_id, turn, text, tools, goes_on, {sums}, regexp_matches(text, '(?i)\\badd\\b')::INT * 2 AS plain FROM h WHERE role = 'user'),
    o AS (SELECT *, list_reverse(list_sort([debug, search, "create", patch, chat])) AS v, greatest(patch, debug, search, "create") AS top FROM s),
    w AS (SELECT *, CASE WHEN v[1] = 0 THEN 'CHAT' WHEN debug = v[1] THEN 'DEBUG' WHEN search = v[1] THEN 'SEARCH' WHEN "create" = v[1] THEN 'CREATE' WHEN patch = v[1] THEN 'PATCH' ELSE 'CHAT' END AS won,
      CASE WHEN v[1] = 0 THEN 0 ELSE (v[1] - v[2]) / v[1]::DOUBLE END AS sure FROM o),
    d AS (SELECT *, CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'empty_message' WHEN sure >= 0.5 THEN 'regex' WHEN won = 'CHAT' AND regexp_matches(text, {signals.sql_literal(request_plan.REFERENCE)}) THEN 'context_signal'
      WHEN won = 'CHAT' AND debug + search + "create" + patch + chat < 3 THEN 'safe_fallback' ELSE 'regex_fallback' END AS method FROM w),
    i AS (SELECT *, CASE method WHEN 'empty_message' THEN 'TRIVIAL' WHEN 'context_signal' THEN 'SEARCH' ELSE won END AS f FROM d),
    j AS (SELECT *, CASE WHEN f = 'CHAT' AND tools AND top > 0 THEN CASE top WHEN patch THEN 'PATCH' WHEN debug THEN 'DEBUG' WHEN search THEN 'SEARCH' ELSE 'CREATE' END ELSE f END AS intent FROM i),
    c AS (SELECT *, CASE WHEN intent = 'DEBUG' OR (f = 'CREATE' AND (patch > plain OR search > 0)) THEN 'GRAPH PATCH READ' WHEN intent IN ('PATCH', 'CREATE') THEN 'PATCH' WHEN intent = 'SEARCH' THEN CASE WHEN tools OR goes_on THEN 'GRAPH PATCH READ' ELSE 'GRAPH READ' END ELSE '' END AS capabilities FROM j)
    SELECT conv_id, turn, intent, method, capabilities, capabilities = '' AS bypass FROM c"""


@query("request_plan", _sql())
def request_plan_of_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's message, with the messages before it: tool results among them, and whether an assistant has spoken."""
    before = by_turn().rowsBetween(Window.unboundedPreceding, -1)
    w = messages(spark, sf_dir).withColumns({"prior_tools": F.bool_or("is_tool").over(before), "spoken": F.bool_or(F.col("role") == "assistant").over(before)}).filter("role = 'user'")
    rows = w.select("conv_id", "turn", "text", "prior_tools", F.when(F.col("spoken"), "CONTINUATION").otherwise("HUMAN_TASK").alias("origin"), F.lit(None).cast("string").alias("near_intent"), F.lit(None).cast("double").alias("near_score"))
    return request_plan.plan(rows).select("conv_id", "turn", "intent", "method", F.array_join("capabilities", " ").alias("capabilities"), "bypass")
