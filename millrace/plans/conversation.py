"""Conversation queries over ``conversations``; assistant rows of odd turns stand for tool results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions import policy, signals
from ..functions.text import char_tokens, short_hash
from ..sources.tables import table
from .registry import query

MESSAGES_SQL = """m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, role = 'assistant' AND turn % 2 = 1 AS is_tool, conv_id % 7 AS file_key FROM conversations)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), ((F.col("role") == "assistant") & (F.col("turn") % 2 == 1)).alias("is_tool"), (F.col("conv_id") % 7).alias("file_key")
    )


def by_turn() -> WindowSpec:
    return Window.partitionBy("conv_id").orderBy("turn")


@query(
    "age_gate",
    f"""WITH {MESSAGES_SQL}, a AS (SELECT *, coalesce(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS n FROM m)
    SELECT conv_id, turn, n::BIGINT AS assistants_after, n < 2 AS recent FROM a WHERE is_tool""",
)
def age_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tool result is recent while fewer than two assistant messages follow it."""
    n = F.coalesce(F.sum((F.col("role") == "assistant").cast("int")).over(by_turn().rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    return messages(spark, sf_dir).withColumn("n", n).filter("is_tool").select("conv_id", "turn", F.col("n").alias("assistants_after"), (F.col("n") < 2).alias("recent"))


@query(
    "system_dedup",
    f"""WITH {MESSAGES_SQL}, r AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, role = 'system', CASE WHEN role = 'system' THEN text ELSE turn::VARCHAR END ORDER BY turn) AS k FROM m)
    SELECT conv_id, turn, role FROM r WHERE k = 1""",
)
def system_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal system messages of a conversation, the first; others pass."""
    m = messages(spark, sf_dir)
    key = F.when(F.col("role") == "system", F.sha2("text", 256)).otherwise(F.col("turn").cast("string"))
    w = Window.partitionBy("conv_id", F.col("role") == "system", key).orderBy("turn")
    return m.withColumn("k", F.row_number().over(w)).filter("k = 1").select("conv_id", "turn", "role")


@query("last_user_turn", f"WITH {MESSAGES_SQL} SELECT conv_id, max(CASE WHEN role = 'user' THEN turn END) AS last_user, max(CASE WHEN is_tool THEN turn END) AS last_tool FROM m GROUP BY conv_id")
def last_user_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = lambda cond: F.max(F.when(cond, F.col("turn")))
    return messages(spark, sf_dir).groupBy("conv_id").agg(last(F.col("role") == "user").alias("last_user"), last(F.col("is_tool")).alias("last_tool"))


def _status_sql() -> str:
    return signals.sql_literal("(?i)" + "|".join(f"(?:{p})" for p in signals.STATUS))


@query(
    "message_origin",
    f"""WITH {MESSAGES_SQL}, w AS (SELECT *, bool_or(is_tool) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS tools,
      last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM m)
    SELECT conv_id, turn, CASE WHEN is_tool THEN 'TOOL_FOLLOWUP' WHEN coalesce(tools, false) THEN 'CONTINUATION'
      WHEN prior IS NOT NULL AND regexp_matches(substr(trim(prior), 1, 200), {_status_sql()}) AND length(trim(text)) < 150 AND NOT regexp_matches(text, {signals.sql_literal('(?i)' + signals.TASK)}) THEN 'AGENT_STATUS'
      WHEN prior IS NOT NULL THEN 'CONTINUATION' ELSE 'HUMAN_TASK' END AS origin FROM w""",
)
def message_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message judged as the current one: tool result, tools in the six before, reply to a status, or a task."""
    before = by_turn().rowsBetween(-6, -1)
    w = messages(spark, sf_dir).withColumns(
        {
            "tools": F.coalesce(F.bool_or("is_tool").over(before), F.lit(False)),
            "prior": F.last(F.when(F.col("role") == "assistant", F.col("text")), ignorenulls=True).over(by_turn().rowsBetween(Window.unboundedPreceding, -1)),
        }
    )
    status = F.col("prior").isNotNull() & signals.is_status(F.col("prior")) & (F.length(F.trim("text")) < 150) & ~F.col("text").rlike("(?i)" + signals.TASK)
    origin = F.when(F.col("is_tool"), "TOOL_FOLLOWUP").when(F.col("tools"), "CONTINUATION").when(status, "AGENT_STATUS").when(F.col("prior").isNotNull(), "CONTINUATION").otherwise("HUMAN_TASK")
    return w.select("conv_id", "turn", origin.alias("origin"))


#: Messages that fire the signals of each intent, ties and none.
PROBES = [
    "Rename the helper instead of copying it", "fix typo in the heading", "Please refactor this and convert it", "update this function", "modify or tweak it", "wrap it", "remove the old flag", "clean up the module",
    "add a field", "fix bug in the login", "fix the database", "why is it slow", "the page is not working", "it throws an exception", "debug and trace it", "the handler is not being called, a memory leak",
    "what's wrong here", "it returns null", "make it better", "find the place where is the route", "which file holds it", "what does it depend on internally", "what imports this", "what exports this symbol",
    "where is it defined", "create a scaffold", "build and implement it", "make a shiny new thing", "new module please", "explain and describe it", "translate this; how does it run", "tell me about it", "ok thanks, done",
    "looks good, never mind", "fix bug and create a file", "find and create", "", "12345", "EXPLAIN WHY IS IT BROKEN",
]


def _intent_sql() -> str:
    parts = {i: [] for i in signals.INTENT_ORDER}
    for intent, weight, pattern, longest in signals.INTENTS:
        cond = f"regexp_matches(text, {signals.sql_literal('(?i)' + pattern)})" + (f" AND length(text) <= {longest}" if longest else "")
        parts[intent].append(f"CASE WHEN {cond} THEN {weight} ELSE 0 END")
    sums = ", ".join(f"{' + '.join(v)} AS s_{k.lower()}" for k, v in parts.items())
    ranks = " UNION ALL ".join(f"SELECT conv_id, turn, '{k}' AS intent, s_{k.lower()} AS s, {n} AS k FROM f" for n, k in enumerate(signals.INTENT_ORDER))
    probes = ", ".join(map(signals.sql_literal, PROBES))
    return f"""WITH {MESSAGES_SQL}, q AS (SELECT conv_id, turn, text FROM m WHERE role = 'user' UNION ALL SELECT -1, n - 1, t FROM (SELECT unnest([{probes}]) AS t, generate_subscripts([{probes}], 1) AS n)),
    f AS (SELECT conv_id, turn, {sums} FROM q), u AS ({ranks}),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY s DESC, k) AS n FROM u),
    p AS (SELECT conv_id, turn, max(CASE WHEN n = 1 THEN intent END) AS intent, max(CASE WHEN n = 1 THEN s END) AS w, max(CASE WHEN n = 2 THEN s END) AS x FROM r GROUP BY ALL)
    SELECT conv_id, turn, CASE WHEN w > 0 THEN intent ELSE 'CHAT' END AS intent, w::BIGINT AS score, round(CASE WHEN w = 0 THEN 0 ELSE (w - x) / w::DOUBLE END, 6) AS confidence FROM p"""


@query("intent", _intent_sql())
def intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, score, confidence = signals.intent(F.col("text"))
    like = table(spark, sf_dir, "conversations").select("conv_id", "turn").schema
    probes = spark.createDataFrame([(-1, k, t) for k, t in enumerate(PROBES)], f"conv_id {like['conv_id'].dataType.simpleString()}, turn {like['turn'].dataType.simpleString()}, text string")
    users = messages(spark, sf_dir).filter("role = 'user'").select("conv_id", "turn", "text").unionByName(probes)
    return users.select("conv_id", "turn", name.alias("intent"), score.cast("long").alias("score"), F.round(confidence, 6).alias("confidence"))


@query(
    "history_prune",
    f"""WITH {MESSAGES_SQL}, w AS (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS lu, max(CASE WHEN is_tool THEN turn END) OVER (PARTITION BY conv_id) AS lt FROM m)
    SELECT conv_id, turn, is_tool AND length(text) > 200 AND turn <> lt AND turn < lu AS pruned FROM w""",
)
def history_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long tool results go once a human message has followed, but for the most recent one."""
    last = lambda cond: F.max(F.when(cond, F.col("turn"))).over(Window.partitionBy("conv_id"))
    w = messages(spark, sf_dir).withColumns({"lu": last(F.col("role") == "user"), "lt": last(F.col("is_tool"))})
    return w.select("conv_id", "turn", F.expr("is_tool AND length(text) > 200 AND turn <> lt AND turn < lu").alias("pruned"))


@query("token_counts", f"WITH {MESSAGES_SQL} SELECT conv_id, sum(4 + ceil(length(text) / 4))::BIGINT AS tokens, count(*) AS messages FROM m GROUP BY conv_id")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).groupBy("conv_id").agg(F.sum(4 + char_tokens(F.col("text"))).alias("tokens"), F.count("*").alias("messages"))


@query(
    "pressure",
    f"""WITH {MESSAGES_SQL}, t AS (SELECT conv_id, sum(4 + ceil(length(text) / 4))::BIGINT AS tokens FROM m GROUP BY conv_id)
    SELECT conv_id, CASE WHEN tokens < 500 THEN 'low' WHEN tokens < 1500 THEN 'medium' ELSE 'high' END AS pressure, CASE WHEN tokens < 500 THEN 3 WHEN tokens < 1500 THEN 2 ELSE 1 END AS keep_recent FROM t""",
)
def pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations here are short, so the bounds that are passed are lower than the defaults."""
    level = policy.pressure(F.col("tokens"), medium=500, high=1500)
    return token_counts(spark, sf_dir).select("conv_id", level.alias("pressure"), policy.setting(level, F.lit(False), "keep_recent").alias("keep_recent"))


@query(
    "compression_policy",
    f"""WITH {MESSAGES_SQL}, t AS (SELECT conv_id, sum(4 + ceil(length(text) / 4))::BIGINT AS tokens FROM m GROUP BY conv_id),
    p AS (SELECT conv_id, conv_id % 2 = 0 AS local, CASE WHEN tokens < 500 THEN 'low' WHEN tokens < 1500 THEN 'medium' ELSE 'high' END AS pressure FROM t),
    s(pressure, local, compress, keep_recent, least_lines, vault_at, body_lines) AS (VALUES ('low', true, false, 3, 120, 100000, 8), ('low', false, true, 3, 60, 60000, 6), ('medium', true, true, 2, 60, 60000, 4),
      ('medium', false, true, 2, 40, 30000, 4), ('high', true, true, 1, 30, 24000, 3), ('high', false, true, 1, 30, 16000, 2))
    SELECT conv_id, pressure, local, compress, keep_recent, least_lines, vault_at, body_lines FROM p JOIN s USING (pressure, local)""",
)
def compression_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The settings of each conversation's pressure and upstream."""
    level = policy.pressure(F.col("tokens"), medium=500, high=1500)
    rows = token_counts(spark, sf_dir).select("conv_id", level.alias("pressure"), (F.col("conv_id") % 2 == 0).alias("local"))
    return rows.select("conv_id", "pressure", "local", *[policy.setting(F.col("pressure"), F.col("local"), k).alias(k) for k in policy.SETTINGS])


@query(
    "stall",
    "SELECT user_id, event_id, row_number() OVER w AS nth, row_number() OVER w >= 3 AS stalled FROM events WINDOW w AS (PARTITION BY user_id, event_type, props ORDER BY ts, event_id)",
)
def stall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of a session by tool (the type) and arguments (the whole of its properties, by digest): the third with the same ones is a stall."""
    arguments = F.sha2(F.concat_ws("\x1f", "event_type", F.coalesce("props", F.lit("\x00"))), 256)
    n = F.row_number().over(Window.partitionBy("user_id", "_a").orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", arguments.alias("_a"))
    return rows.withColumn("nth", n.cast("long")).select("user_id", "event_id", "nth", (F.col("nth") >= 3).alias("stalled"))


@query(
    "failure_runs",
    """WITH f AS (SELECT user_id, event_id, ts, event_type = 'error' AS bad, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events),
    r AS (SELECT user_id, island, count(*) AS n FROM f WHERE bad GROUP BY ALL) SELECT user_id, max(n) AS longest_run, max(n) >= 3 AS tripped FROM r GROUP BY user_id""",
)
def failure_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive failures of a client; three trip the breaker."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bad = F.col("event_type") == "error"
    e = table(spark, sf_dir, "events").withColumn("island", F.sum((~bad).cast("int")).over(w)).filter(bad)
    runs = e.groupBy("user_id", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("user_id").agg(F.max("n").alias("longest_run"), (F.max("n") >= 3).alias("tripped"))


@query(
    "retrieve_state",
    f"""WITH {MESSAGES_SQL}, d AS (SELECT conv_id, file_key, substr(sha256(text), 1, 16) AS vault, min(turn) AS first_turn FROM m WHERE is_tool GROUP BY ALL),
    c AS (SELECT conv_id, max(turn) AS now FROM m GROUP BY conv_id), r AS (SELECT DISTINCT conv_id, substr(sha256(text), 1, 16) AS vault FROM m WHERE role = 'user')
    SELECT d.conv_id, d.vault, d.first_turn, c.now - d.first_turn AS age FROM d JOIN c USING (conv_id) ANTI JOIN r USING (conv_id, vault) WHERE c.now - d.first_turn <= 3""",
)
def retrieve_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vault entries discovered in a conversation, not yet retrieved and at most three turns old."""
    m = messages(spark, sf_dir).withColumn("vault", short_hash(F.col("text")))
    found = m.filter("is_tool").groupBy("conv_id", "vault").agg(F.min("turn").alias("first_turn"))
    now = m.groupBy("conv_id").agg(F.max("turn").alias("now"))
    seen = m.filter("role = 'user'").select("conv_id", "vault").distinct()
    return found.join(now, "conv_id").join(seen, ["conv_id", "vault"], "left_anti").withColumn("age", F.col("now") - F.col("first_turn")).filter("age <= 3").drop("now")


@query(
    "compression_decision",
    f"""WITH {MESSAGES_SQL}, t AS (SELECT conv_id, sum(4 + ceil(length(text) / 4))::BIGINT AS tokens, bool_or(is_tool AND length(text) > 100) AS fat FROM m GROUP BY conv_id)
    SELECT conv_id, CASE WHEN conv_id % 11 = 0 THEN 'bypass' WHEN conv_id % 13 = 0 THEN 'disabled' WHEN tokens = 0 THEN 'empty' WHEN tokens < 200 THEN 'small' ELSE 'compress' END AS decision, fat AS compressible FROM t""",
)
def compression_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precedence of the compression gate, with bypass and disabled clients taken from the conversation's number."""
    t = messages(spark, sf_dir).groupBy("conv_id").agg(F.sum(4 + char_tokens(F.col("text"))).alias("tokens"), F.bool_or(F.expr("is_tool AND length(text) > 100")).alias("compressible"))
    c = F.col
    decision = policy.decision(bypass=c("conv_id") % 11 == 0, disabled=c("conv_id") % 13 == 0, tokens=c("tokens"), least=200)
    return t.select("conv_id", decision.alias("decision"), "compressible")


@query(
    "tool_activity",
    f"WITH {MESSAGES_SQL} SELECT conv_id, turn, bool_or(is_tool) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS active FROM m",
)
def tool_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("conv_id", "turn", F.bool_or("is_tool").over(by_turn().rowsBetween(-5, 0)).alias("active"))


@query(
    "call_result_join",
    f"""WITH {MESSAGES_SQL}, calls AS (SELECT conv_id, turn + 1 AS result_turn, text AS call_text FROM m WHERE role = 'user')
    SELECT r.conv_id, r.turn, length(c.call_text) AS call_chars, length(r.text) AS result_chars FROM m r LEFT JOIN calls c ON c.conv_id = r.conv_id AND c.result_turn = r.turn WHERE r.is_tool""",
)
def call_result_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool results with the call before them; results without a call stay."""
    m = messages(spark, sf_dir)
    calls = m.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.length("text").cast("long").alias("call_chars"))
    return m.filter("is_tool").join(calls, ["conv_id", "turn"], "left").select("conv_id", "turn", "call_chars", F.length("text").cast("long").alias("result_chars"))


@query(
    "session_identity",
    f"""WITH {MESSAGES_SQL}, f AS (SELECT conv_id, arg_min(text, turn) AS t FROM m WHERE role = 'user' AND trim(text) <> '' GROUP BY conv_id)
    SELECT conv_id, substr(sha256(substr(regexp_replace(t, '\\s+', ' ', 'g'), 1, 500)), 1, 16) AS session_id FROM f""",
)
def session_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of the first user text with white space collapsed."""
    first = messages(spark, sf_dir).filter("role = 'user' AND trim(text) <> ''").groupBy("conv_id").agg(F.min_by("text", "turn").alias("t"))
    return first.select("conv_id", short_hash(F.substring(F.regexp_replace("t", r"\s+", " "), 1, 500)).alias("session_id"))
