"""Queries on requests: decisions, call arguments, names, budgets, retrieval by tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import requests as rq
from ..functions.signals import sql_literal
from ..functions.text import short_hash
from ..sources.tables import table
from . import graph as g
from .registry import query

CALLS_SQL = """calls AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN '{"operation": "create", "mode": 1, "filename": "f' || o_custkey || '.js"}'
 WHEN 1 THEN '{"command": "echo x > out' || o_custkey || '.txt"}' WHEN 2 THEN '{"command": "rm -f tmp' || o_custkey || '.log"}' ELSE '{"command": "ls src"}' END AS payload FROM orders)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_custkey").cast("string")
    kind = F.col("o_orderkey") % 4
    payload = (
        F.when(kind == 0, F.concat(F.lit('{"operation": "create", "mode": 1, "filename": "f'), c, F.lit('.js"}')))
        .when(kind == 1, F.concat(F.lit('{"command": "echo x > out'), c, F.lit('.txt"}')))
        .when(kind == 2, F.concat(F.lit('{"command": "rm -f tmp'), c, F.lit('.log"}')))
        .otherwise('{"command": "ls src"}')
    )
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), payload.alias("payload"))


def _mutation_sql() -> str:
    parts = ", ".join(f"nullif(regexp_extract(payload, {sql_literal(p)}, {n}), '')" for p, n in rq.MUTATIONS)
    return f"WITH {CALLS_SQL}, m AS (SELECT id, coalesce({parts}) AS file FROM calls) SELECT id, file IS NOT NULL AS is_mutation, file FROM m"


@query("mutation_detection", _mutation_sql())
def mutation_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = calls(spark, sf_dir).select("id", rq.mutated_file(F.col("payload")).alias("file"))
    return found.select("id", F.col("file").isNotNull().alias("is_mutation"), "file")


@query(
    "local_upstream",
    """WITH m AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'Ollama' WHEN 1 THEN 'cloud' ELSE 'my-localhost' END AS provider, CASE WHEN o_custkey % 2 = 0 THEN 'coder:14b' ELSE 'gpt-x:1' END AS model FROM orders)
    SELECT id, (contains(lower(provider), 'ollama') OR contains(lower(provider), 'lm-studio') OR contains(lower(provider), 'llama.cpp') OR contains(lower(provider), 'localhost') OR contains(lower(provider), 'llamacpp')
      OR (regexp_matches(lower(model), ':[a-z0-9._-]+$') AND NOT starts_with(lower(model), 'claude') AND NOT starts_with(lower(model), 'gpt'))) AS is_local FROM m""",
)
def local_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.col("o_orderkey") % 3
    provider = F.when(third == 0, "Ollama").when(third == 1, "cloud").otherwise("my-localhost")
    model = F.when(F.col("o_custkey") % 2 == 0, "coder:14b").otherwise("gpt-x:1")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), rq.is_local(provider, model).alias("is_local"))


MEMORY_DECISION = """CASE WHEN o_orderkey % 17 = 0 THEN 'bypass_header' WHEN o_orderkey % 19 = 0 THEN 'no_handler' WHEN o_orderpriority = '5-LOW' THEN 'mode_disabled' WHEN o_orderpriority = '1-URGENT' THEN 'mode_tool' END"""


@query("memory_decision", """WITH rules AS (SELECT o_orderkey AS id, unnest([{'p': 1, 'r': 'bypass_header', 'hit': o_orderkey % 17 = 0}, {'p': 2, 'r': 'no_handler', 'hit': o_orderkey % 19 = 0}, {'p': 3, 'r': 'mode_disabled', 'hit': o_orderpriority LIKE '5%'}, {'p': 4, 'r': 'mode_tool', 'hit': o_orderpriority LIKE '1%'}]) AS rule FROM orders),
    f AS (SELECT id, arg_min(rule.r, rule.p) AS reason FROM rules WHERE rule.hit GROUP BY id) SELECT o_orderkey AS id, reason, reason IS NULL AS inject, CASE WHEN o_custkey % 5 = 0 THEN 'anonymous' ELSE 'u' || o_custkey END AS user_id FROM orders LEFT JOIN f ON id = o_orderkey""")
def memory_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precedence of reasons against injecting memories; without a user the default one is read and written."""
    reason = F.expr(MEMORY_DECISION)
    user = F.when(F.col("o_custkey") % 5 == 0, "anonymous").otherwise(F.concat(F.lit("u"), F.col("o_custkey").cast("string")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), reason.alias("reason"), reason.isNull().alias("inject"), user.alias("user_id"))


@query("memory_content", "SELECT conv_id, bool_or(regexp_matches(coalesce(text, ''), '\\bmem_[0-9a-f]{16}\\b') OR turn % 7 = 6) AS has_memory FROM conversations GROUP BY conv_id")
def memory_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that show a memory's id, or use a memory tool (here every seventh turn)."""
    hit = F.coalesce(F.col("text"), F.lit("")).rlike(r"\bmem_[0-9a-f]{16}\b") | (F.col("turn") % 7 == 6)
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.bool_or(hit).alias("has_memory"))


@query("tool_name_alias", "WITH t AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'mcp__srv__read_chunk' WHEN 1 THEN 'read_chunk' ELSE 'xread_chunk' END AS tool FROM orders) SELECT id, regexp_matches(tool, '(^|__)read_chunk$') AS is_alias FROM t")
def tool_name_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.col("o_orderkey") % 3
    tool = F.when(third == 0, "mcp__srv__read_chunk").when(third == 1, "read_chunk").otherwise("xread_chunk")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), tool.rlike("(^|__)read_chunk$").alias("is_alias"))


@query(
    "concept_keys",
    r"""WITH s AS (SELECT p_partkey, replace(p_name, ' ', '_') || 'HTTPRequest' AS q FROM part), w AS (SELECT p_partkey, q, list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(q, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[-_\s.]+'), lambda x: x <> '') AS t FROM s)
    SELECT p_partkey, CASE WHEN len(t) = 1 AND length(t[1]) < 5 THEN lower(q) ELSE array_to_string(list_sort(t), '') END AS key FROM w""",
)
def concept_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("HTTPRequest"))
    return table(spark, sf_dir, "part").select("p_partkey", rq.concept_key(q).alias("key"))


_STOP_SQL = ", ".join(sql_literal(w) for w in rq.STOPWORDS)


@query(
    "query_terms",
    f"""WITH u AS (SELECT conv_id, turn, coalesce(text, '') || CASE turn % 4 WHEN 0 THEN ' See src/app-' || conv_id || '.js, then <System-Reminder>never' || chr(10) || 'said</system-reminder> a_b' ELSE '' END AS text FROM conversations WHERE role = 'user'),
    w AS (SELECT conv_id, turn, list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '(?s)<system-reminder>.*?</system-reminder>', '', 'g'), '[^a-z0-9_./-]+'), lambda x: length(x) >= 3 AND x NOT IN ({_STOP_SQL})))) AS t FROM u),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM w WHERE len(t) > 0)
    SELECT conv_id, turn, array_to_string(t, ' ') AS terms FROM r WHERE k = 1""",
)
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of each conversation's last user text that has any; some texts get a path and a reminder block."""
    more = F.concat(F.lit(" See src/app-"), F.col("conv_id").cast("string"), F.lit(".js, then <System-Reminder>never\nsaid</system-reminder> a_b"))
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("turn") % 4 == 0, more).otherwise(F.lit("")))
    users = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", rq.query_terms(text).alias("t")).filter("size(t) > 0")
    return users.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.array_join(F.max_by("t", "turn"), " ").alias("terms"))


def _file_sql() -> str:
    parts = ", ".join(f"nullif(trim(regexp_extract(substr(t, 1, 500), {sql_literal(p)}, 1)), '')" for p in rq.FILENAMES)
    return f"WITH s AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'File: src/a' || doc_id || '.js' || chr(10) || text WHEN 1 THEN 'see ./lib/b' || doc_id || '.py now' || text ELSE text END AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, coalesce({parts}) AS file FROM s"


@query("file_names", _file_sql())
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, text = F.col("doc_id").cast("string"), F.col("text")
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("File: src/a"), i, F.lit(".js\n"), text)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("see ./lib/b"), i, F.lit(".py now"), text)).otherwise(text)
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", rq.file_name(t).alias("file"))


@query(
    "token_budget",
    r"""SELECT doc_id, md5(CASE WHEN length(text) <= 1200 THEN text WHEN regexp_extract(substr(text, 1, 1200), '(?s)^(.*)\n', 1) <> '' THEN regexp_extract(substr(text, 1, 1200), '(?s)^(.*)\n', 1) ELSE substr(text, 1, 1200) END) AS digest FROM documents WHERE text IS NOT NULL""",
)
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.md5(rq.token_budget(F.col("text"), 300)).alias("digest"))


@query(
    "relative_time",
    """WITH s AS (SELECT event_id, (epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(ts)))::BIGINT AS s FROM events)
    SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd ago' END AS seen FROM s""",
)
def relative_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.unix_timestamp(F.lit("2024-02-01 00:00:00").cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", rq.relative_time(seconds).alias("seen"))


QUERIES_SQL = """q AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'GET /api/' || p_size WHEN 1 THEN '/r/' || p_size WHEN 2 THEN 'api/v' || p_size WHEN 3 THEN 'process.env.KEY_' || p_size WHEN 4 THEN 'MAX_SIZE' WHEN 5 THEN 'loadUser' WHEN 6 THEN 'some words here' ELSE 'a.b' END AS q FROM part)"""


@query(
    "query_kinds",
    f"""WITH {QUERIES_SQL} SELECT p_partkey, CASE WHEN regexp_matches(q, '(?i)^(GET|POST|PUT|PATCH|DELETE|ANY)\\s+(/\\S*)') THEN 'route' WHEN starts_with(q, '/') AND length(q) > 1 THEN 'route' WHEN contains(q, '/') AND regexp_matches(q, '^[a-zA-Z0-9_\\-/]+$') THEN 'route'
      WHEN regexp_matches(q, '^process\\.env\\.([A-Z_][A-Z0-9_]*)$') THEN 'env_var' WHEN regexp_matches(q, '^[A-Z][A-Z0-9_]{{2,}}$') THEN 'env_var' WHEN regexp_matches(q, '^[a-zA-Z_$][a-zA-Z0-9_$]*$') THEN 'symbol' WHEN regexp_matches(q, '[-\\s.]') THEN 'literal' ELSE 'symbol' END AS kind FROM q""",
)
def query_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 8
    q = (
        F.when(k == 0, F.concat(F.lit("GET /api/"), n)).when(k == 1, F.concat(F.lit("/r/"), n)).when(k == 2, F.concat(F.lit("api/v"), n)).when(k == 3, F.concat(F.lit("process.env.KEY_"), n))
        .when(k == 4, "MAX_SIZE").when(k == 5, "loadUser").when(k == 6, "some words here").otherwise("a.b")
    )
    return table(spark, sf_dir, "part").select("p_partkey", rq.query_kind(q).alias("kind"))


@query("enum_slice", "SELECT o_custkey, len(v) AS total, array_to_string(v[1:5], ' ') AS shown FROM (SELECT o_custkey, list_sort(list(o_orderkey)) AS v FROM orders GROUP BY o_custkey) WHERE len(v) >= 6")
def enum_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long enumerations show their first values and their number."""
    v = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("v")).filter(F.size("v") >= 6)
    return v.select("o_custkey", F.size("v").cast("long").alias("total"), F.array_join(F.transform(F.slice("v", 1, 5), lambda x: x.cast("string")), " ").alias("shown"))


@query("call_cache_key", "SELECT substr(sha256('tool|a=' || o_custkey || '|b=' || o_orderpriority), 1, 16) AS key, count(*) AS calls FROM orders GROUP BY 1")
def call_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call's key has its arguments in order of their names, however they were given."""
    args = F.map_from_arrays(F.array(F.lit("b"), F.lit("a")), F.array("o_orderpriority", F.col("o_custkey").cast("string")))
    sorted_args = F.array_join(F.transform(F.array_sort(F.map_entries(args)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return table(spark, sf_dir, "orders").groupBy(short_hash(F.concat(F.lit("tool|"), sorted_args)).alias("key")).agg(F.count("*").alias("calls"))


@query(
    "retrieval_tiers",
    f"""WITH {g.NODES_SQL}, {g.LITERALS_SQL}, n AS (SELECT {g.FIRST} AS q),
    a AS (SELECT 1 AS tier, 'symbol' AS type, node_id AS ref, 0.9 AS confidence FROM nodes, n WHERE name = q), b AS (SELECT 2, 'symbol', node_id, 0.65 FROM nodes, n WHERE contains(lower(name), lower(substr(q, 1, 5)))),
    c AS (SELECT 3, 'literal', value || ':' || start_line, 0.5 FROM literals, n WHERE contains(lower(value), lower(substr(q, 1, 5)))),
    u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c), m AS (SELECT min(tier) AS t FROM u WHERE confidence >= 0.8)
    SELECT tier, type, ref FROM u, m WHERE tier <= coalesce(t, 3)""",
)
def retrieval_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of each tier, up to the first tier that is sure enough (0.8)."""
    name = g._name(spark, sf_dir)
    head = F.lit(name[:5].lower())
    n, lit = g.nodes(spark, sf_dir), g.literals(spark, sf_dir)
    tiers = [
        n.filter(F.col("name") == name).select(F.lit(1).alias("tier"), F.lit("symbol").alias("type"), F.col("node_id").alias("ref"), F.lit(0.9).alias("confidence")),
        n.filter(F.contains(F.lower("name"), head)).select(F.lit(2).alias("tier"), F.lit("symbol").alias("type"), F.col("node_id").alias("ref"), F.lit(0.65).alias("confidence")),
        lit.filter(F.contains(F.lower("value"), head)).select(F.lit(3).alias("tier"), F.lit("literal").alias("type"), F.concat_ws(":", "value", F.col("start_line").cast("string")).alias("ref"), F.lit(0.5).alias("confidence")),
    ]
    out = None
    for tier in tiers:
        out = tier if out is None else out.unionByName(tier)
        if not tier.filter("confidence >= 0.8").isEmpty():
            break
    return out.select("tier", "type", "ref")


@query(
    "best_answer",
    """WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) SELECT o_custkey, o_orderkey AS answer FROM r WHERE k = 1""",
)
def best_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence with the highest score; the earlier wins among equals."""
    best = F.max_by("o_orderkey", F.struct("o_totalprice", (-F.col("o_orderkey")).alias("e")))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(best.alias("answer"))


@query(
    "context_preview",
    """WITH r AS (SELECT conv_id, turn, role, substr(coalesce(text, ''), 1, 40) AS p, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS k FROM conversations)
    SELECT conv_id, substr(string_agg(role || ': ' || p, chr(10) ORDER BY turn), 1, 200) AS context FROM r WHERE (role = 'user' AND k = 1) OR (role = 'assistant' AND k <= 2) GROUP BY conv_id""",
)
def context_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query that memories are searched with: the last user text and two assistant texts before, cut."""
    rank = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy(F.desc("turn")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.substring(F.coalesce("text", F.lit("")), 1, 40).alias("p"), rank.alias("k"))
    kept = rows.filter("(role = 'user' AND k = 1) OR (role = 'assistant' AND k <= 2)").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "p"))).alias("m"))
    lines = F.transform("m", lambda x: F.concat(x["role"], F.lit(": "), x["p"]))
    return kept.select("conv_id", F.substring(F.array_join(lines, "\n"), 1, 200).alias("context"))


@query(
    "line_splice",
    "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL) SELECT doc_id, md5(array_to_string(list_concat(l[1:1], ['replaced'], l[4:]), chr(10))) AS digest FROM l WHERE len(l) > 4",
)
def line_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch as a splice: lines 2 and 3 give way to one new line."""
    rows = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.split("text", "\n").alias("l")).filter("size(l) > 4")
    new = F.concat(F.slice("l", 1, 1), F.array(F.lit("replaced")), F.slice("l", F.lit(4), F.size("l")))
    return rows.select("doc_id", F.md5(F.array_join(new, "\n")).alias("digest"))
