"""Code-graph queries: parts are symbols, brands their files, distinct supplier-to-part links the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import short_hash
from ..operators import graph, resolver
from ..sources.tables import table
from .registry import query

NODES_SQL = """nodes AS (SELECT p_brand || ':' || p_partkey || ':' || p_name AS node_id, lower(replace(p_brand, '#', '/')) AS file_path, p_name AS name, split_part(p_type, ' ', 1) AS kind,
 p_partkey AS start_line, p_partkey + p_size AS end_line, p_partkey % 3 = 0 AS is_exported, p_partkey % 5 = 0 AS is_async, p_size AS complexity, p_type AS body_text FROM part)"""
EDGES_SQL = """edges AS (SELECT DISTINCT 'f' || (l_suppkey % 10) AS source_file, lower(replace(p_brand, '#', '/')) AS target_file, 's' || l_suppkey AS source_symbol,
 CASE WHEN l_partkey % 4 = 0 THEN 's' || (l_partkey % 100) ELSE 'p' || l_partkey END AS target_symbol, CASE l_returnflag WHEN 'A' THEN 'calls' WHEN 'N' THEN 'imports' ELSE 'routes' END AS relation FROM lineitem JOIN part ON p_partkey = l_partkey)"""
LITERALS_SQL = """literals AS (SELECT lower(replace(p_brand, '#', '/')) AS file_path, p_name AS value, split_part(p_type, ' ', 2) AS kind, p_brand || ':' || (p_partkey - p_partkey % 2) AS containing_fn, p_partkey AS start_line FROM part)"""
CONFIG_SQL = """config AS (SELECT DISTINCT o_orderpriority AS key, 'env.' || o_orderpriority AS raw_text, 'f' || (o_custkey % 5) AS file_path FROM orders)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "part").select(
        F.concat_ws(":", "p_brand", c("p_partkey").cast("string"), "p_name").alias("node_id"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("/"))).alias("file_path"),
        c("p_name").alias("name"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("kind"), c("p_partkey").alias("start_line"), (c("p_partkey") + c("p_size")).alias("end_line"),
        (c("p_partkey") % 3 == 0).alias("is_exported"), (c("p_partkey") % 5 == 0).alias("is_async"), c("p_size").alias("complexity"), c("p_type").alias("body_text"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("/"))).alias("target_file"))
    target = F.when(F.col("l_partkey") % 4 == 0, F.concat(F.lit("s"), (F.col("l_partkey") % 100).cast("string"))).otherwise(F.concat(F.lit("p"), F.col("l_partkey").cast("string")))
    relation = F.when(F.col("l_returnflag") == "A", "calls").when(F.col("l_returnflag") == "N", "imports").otherwise("routes")
    links = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", relation.alias("relation")).distinct()
    return links.join(files, "l_partkey").select(
        F.concat(F.lit("f"), (F.col("l_suppkey") % 10).cast("string")).alias("source_file"), "target_file", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source_symbol"), target.alias("target_symbol"), "relation"
    ).distinct()


def literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "part").select(
        F.lower(F.replace("p_brand", F.lit("#"), F.lit("/"))).alias("file_path"), c("p_name").alias("value"), F.split_part("p_type", F.lit(" "), F.lit(2)).alias("kind"),
        F.concat_ws(":", "p_brand", (c("p_partkey") - c("p_partkey") % 2).cast("string")).alias("containing_fn"), c("p_partkey").alias("start_line"),
    )


def config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("key"), F.concat(F.lit("env."), "o_orderpriority").alias("raw_text"), F.concat(F.lit("f"), (F.col("o_custkey") % 5).cast("string")).alias("file_path")
    ).distinct()


FIRST = "(SELECT p_name FROM part WHERE p_partkey = 7)"
ORDER = "is_exported DESC, complexity DESC, file_path, start_line"


def _name(spark: SparkSession, sf_dir: str, key: int = 7) -> str:
    row = table(spark, sf_dir, "part").filter(F.col("p_partkey") == key).select("p_name").first()
    return row[0] if row else ""


@query("find_symbol", f"WITH {NODES_SQL} SELECT node_id, file_path, kind, start_line, is_exported, is_async, complexity FROM nodes WHERE name = {FIRST}")
def find_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.find_symbol(nodes(spark, sf_dir), _name(spark, sf_dir)).select("node_id", "file_path", "kind", "start_line", "is_exported", "is_async", "complexity")


@query("find_symbol_fuzzy", f"WITH {NODES_SQL} SELECT node_id, name FROM nodes WHERE contains(lower(name), lower(substr({FIRST}, 1, 6))) AND name <> substr({FIRST}, 1, 6) ORDER BY {ORDER} LIMIT 10")
def find_symbol_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.find_symbol_fuzzy(nodes(spark, sf_dir), _name(spark, sf_dir)[:6]).select("node_id", "name")


@query("symbol_index", f"WITH {NODES_SQL}, r AS (SELECT *, CASE WHEN name = {FIRST} THEN 0 ELSE 1 END AS rank FROM nodes WHERE name = {FIRST} OR contains(lower(name), lower({FIRST}))), b AS (SELECT min(rank) AS m FROM r) SELECT node_id, rank FROM r, b WHERE rank = m")
def symbol_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact matches, and fuzzy ones only where there is no exact one."""
    name = _name(spark, sf_dir)
    found = nodes(spark, sf_dir).filter(F.contains(F.lower("name"), F.lit(name.lower()))).withColumn("rank", F.when(F.col("name") == name, 0).otherwise(1))
    best = found.agg(F.min("rank").alias("m"))
    return found.join(F.broadcast(best), F.col("rank") == F.col("m")).select("node_id", "rank")


@query("exports_of_file", f"WITH {NODES_SQL} SELECT name, kind, start_line FROM nodes WHERE file_path = 'brand/1' AND is_exported")
def exports_of_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).filter("file_path = 'brand/1' AND is_exported").select("name", "kind", "start_line")


@query("imports_of_file", f"WITH {EDGES_SQL} SELECT target_symbol, target_file FROM edges WHERE relation = 'imports' AND source_file = 'f3'")
def imports_of_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).filter("relation = 'imports' AND source_file = 'f3'").select("target_symbol", "target_file")


@query("who_imports", f"WITH {EDGES_SQL} SELECT DISTINCT source_file, target_symbol FROM edges WHERE relation = 'imports' AND target_symbol = 's8'")
def who_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).filter("relation = 'imports' AND target_symbol = 's8'").select("source_file", "target_symbol").distinct()


@query("who_depends_on_file", f"WITH {EDGES_SQL} SELECT DISTINCT source_file, relation FROM edges WHERE target_file = 'brand/1'")
def who_depends_on_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).filter("target_file = 'brand/1'").select("source_file", "relation").distinct()


@query("show_callers", f"WITH {EDGES_SQL} SELECT DISTINCT source_symbol, source_file FROM edges WHERE target_symbol = 's8' AND relation = 'calls'")
def show_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).filter("target_symbol = 's8' AND relation = 'calls'").select("source_symbol", "source_file").distinct()


@query("show_callees", f"WITH {EDGES_SQL} SELECT DISTINCT target_symbol, target_file FROM edges WHERE source_symbol = 's3' AND relation = 'calls'")
def show_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).filter("source_symbol = 's3' AND relation = 'calls'").select("target_symbol", "target_file").distinct()


@query(
    "show_dependencies",
    f"""WITH {EDGES_SQL}, {NODES_SQL}, n AS (SELECT 'p' || start_line AS symbol, file_path, kind FROM nodes)
    SELECT e.target_symbol, e.target_file, e.relation, coalesce(n.kind, 'unknown') AS kind FROM edges e LEFT JOIN n ON n.symbol = e.target_symbol AND n.file_path = e.target_file WHERE e.source_symbol = 's3'""",
)
def show_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = nodes(spark, sf_dir).select(F.concat(F.lit("p"), F.col("start_line").cast("string")).alias("target_symbol"), F.col("file_path").alias("target_file"), "kind")
    found = edges(spark, sf_dir).filter("source_symbol = 's3'").join(known, ["target_symbol", "target_file"], "left")
    return found.select("target_symbol", "target_file", "relation", F.coalesce("kind", F.lit("unknown")).alias("kind"))


@query(
    "analyze_impact",
    f"""WITH RECURSIVE {EDGES_SQL}, i(symbol, depth) AS (SELECT source_symbol, 1 FROM edges WHERE target_symbol = 's8' UNION SELECT e.source_symbol, i.depth + 1 FROM edges e JOIN i ON e.target_symbol = i.symbol WHERE i.depth < 2)
    SELECT symbol, min(depth) AS depth FROM i GROUP BY symbol""",
)
def analyze_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.impact(edges(spark, sf_dir), "s8", 2)


@query("find_route", f"WITH {EDGES_SQL} SELECT target_symbol, count(*) AS n FROM edges WHERE relation = 'routes' AND contains(lower(target_symbol), 's1') GROUP BY target_symbol ORDER BY target_symbol LIMIT 50")
def find_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = edges(spark, sf_dir).filter((F.col("relation") == "routes") & F.contains(F.lower("target_symbol"), F.lit("s1")))
    return routes.groupBy("target_symbol").agg(F.count("*").alias("n")).orderBy("target_symbol").limit(50)


@query("find_literal", f"WITH {LITERALS_SQL} SELECT file_path, value, start_line FROM literals WHERE contains(lower(value), 'an') ORDER BY CASE WHEN value = 'an' THEN 0 ELSE 1 END, length(value), value, start_line LIMIT 10")
def find_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact first, then shorter values."""
    found = literals(spark, sf_dir).filter(F.contains(F.lower("value"), F.lit("an")))
    return found.orderBy(F.when(F.col("value") == "an", 0).otherwise(1), F.length("value"), "value", "start_line").limit(10).select("file_path", "value", "start_line")


@query("find_config", f"WITH {CONFIG_SQL} SELECT key, raw_text, file_path FROM config WHERE key = '1-URGENT' OR contains(lower(key), 'urg') ORDER BY CASE WHEN key = '1-URGENT' THEN 0 ELSE 1 END, key, file_path LIMIT 10")
def find_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = config(spark, sf_dir).filter((F.col("key") == "1-URGENT") | F.contains(F.lower("key"), F.lit("urg")))
    return found.orderBy(F.when(F.col("key") == "1-URGENT", 0).otherwise(1), "key", "file_path").limit(10)


@query(
    "graph_stats",
    f"""WITH {NODES_SQL}, {EDGES_SQL}, {LITERALS_SQL}, {CONFIG_SQL} SELECT (SELECT count(DISTINCT file_path) FROM nodes) AS files, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges,
    (SELECT count(*) FROM edges WHERE relation = 'routes') AS routes, (SELECT count(*) FROM literals) AS literals, (SELECT count(*) FROM config) AS config_refs""",
)
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir).agg(F.countDistinct("file_path").alias("files"), F.count("*").alias("nodes"))
    e = edges(spark, sf_dir).agg(F.count("*").alias("edges"), F.count_if(F.col("relation") == "routes").alias("routes"))
    rest = literals(spark, sf_dir).agg(F.count("*").alias("literals")).crossJoin(config(spark, sf_dir).agg(F.count("*").alias("config_refs")))
    return n.crossJoin(e).crossJoin(rest)  # of one row each


@query(
    "innermost_container",
    f"""WITH {NODES_SQL}, {LITERALS_SQL}, j AS (SELECT l.file_path, l.start_line AS line, n.name, row_number() OVER (PARTITION BY l.file_path, l.start_line ORDER BY n.end_line - n.start_line, n.start_line, n.name) AS k
      FROM literals l JOIN nodes n ON n.file_path = l.file_path AND l.start_line BETWEEN n.start_line AND n.end_line)
    SELECT file_path, line, name AS container FROM j WHERE k = 1""",
)
def innermost_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = literals(spark, sf_dir).select("file_path", F.col("start_line").alias("line"))
    return graph.innermost(points, nodes(spark, sf_dir), "file_path", "line", "start_line", "end_line", "name").filter("container IS NOT NULL")


@query("node_at_line", f"WITH {NODES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY file_path, start_line ORDER BY name) AS k FROM nodes) SELECT file_path, start_line, name FROM r WHERE k = 1")
def node_at_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One node for each file and line."""
    return nodes(spark, sf_dir).groupBy("file_path", "start_line").agg(F.min("name").alias("name"))


@query("refs_in_function", f"WITH {LITERALS_SQL} SELECT containing_fn, file_path, list(value ORDER BY start_line)[1:10] AS vals FROM literals GROUP BY ALL")
def refs_in_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten literals of each function, ranked before they are gathered."""
    rank = F.row_number().over(Window.partitionBy("containing_fn", "file_path").orderBy("start_line", "value"))
    first = literals(spark, sf_dir).withColumn("k", rank).filter("k <= 10").groupBy("containing_fn", "file_path").agg(F.array_sort(F.collect_list(F.struct("k", "value"))).alias("v"))
    return first.select("containing_fn", "file_path", F.transform("v", lambda x: x["value"]).alias("vals"))


@query("embeddable_nodes", f"WITH {NODES_SQL} SELECT node_id, kind FROM nodes WHERE kind IN ('STANDARD', 'SMALL', 'ECONOMY', 'PROMO') AND NOT starts_with(name, '__module_')")
def embeddable_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).filter(F.col("kind").isin("STANDARD", "SMALL", "ECONOMY", "PROMO") & ~F.col("name").startswith("__module_")).select("node_id", "kind")


@query("graph_identities", """WITH e AS (SELECT DISTINCT 'f' || (l_suppkey % 10) AS source_file, CASE WHEN l_suppkey % 7 <> 0 THEN 's' || l_suppkey END AS source_symbol, 'p' || l_partkey AS target_symbol, CASE l_returnflag WHEN 'A' THEN 'calls' WHEN 'N' THEN 'imports' ELSE 'routes' END AS relation,
      CASE WHEN l_returnflag <> 'N' THEN l_linenumber END AS line FROM lineitem)
    SELECT substr(sha256(source_file || '|' || coalesce(source_symbol, '') || '|' || target_symbol || '|' || relation || '|' || coalesce(line::VARCHAR, '')), 1, 16) AS edge_id, substr(sha256(source_file), 1, 16) AS file_id, relation, line FROM e""")
def graph_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge's id is of its file, symbols, relation and source line, with empty fields where it has none; two calls on two lines are two edges."""
    c = F.col
    relation = F.when(c("l_returnflag") == "A", "calls").when(c("l_returnflag") == "N", "imports").otherwise("routes")
    e = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("f"), (c("l_suppkey") % 10).cast("string")).alias("source_file"), F.when(c("l_suppkey") % 7 != 0, F.concat(F.lit("s"), c("l_suppkey").cast("string"))).alias("source_symbol"),
        F.concat(F.lit("p"), c("l_partkey").cast("string")).alias("target_symbol"), relation.alias("relation"), F.when(c("l_returnflag") != "N", c("l_linenumber")).alias("line"),
    ).distinct()
    return e.select(graph.edge_id(c("source_file"), c("source_symbol"), c("target_symbol"), c("relation"), c("line")).alias("edge_id"), short_hash(c("source_file")).alias("file_id"), "relation", "line")


@query(
    "call_neighbourhood",
    f"""WITH {EDGES_SQL}, u AS (SELECT DISTINCT 'caller' AS side, source_symbol AS symbol FROM edges WHERE target_symbol = 's8' UNION ALL SELECT DISTINCT 'callee', target_symbol FROM edges WHERE source_symbol = 's8'),
    r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY symbol) AS k FROM u) SELECT side, symbol FROM r WHERE k <= 3""",
)
def call_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbourhood(edges(spark, sf_dir), "s8")


#: queries of every kind; a name of each index, and some that aren't there
QUERY = """CASE p_partkey % 6 WHEN 0 THEN split_part(p_name, ' ', 1) WHEN 1 THEN p_name WHEN 2 THEN concat('process.env.LIMIT_', cast(p_partkey % 7 AS varchar(20)))
 WHEN 3 THEN concat('GET /orders/', cast(p_partkey * 7 + 1000 AS varchar(20))) WHEN 4 THEN concat('LIMIT_', cast(p_size % 7 AS varchar(20))) ELSE concat('orders/', cast(p_size + 500 AS varchar(20))) END"""
ENTRIES_SQL = """entries AS (SELECT 'symbol' AS type, name, kind AS node_kind, file_path AS file, start_line AS line, is_exported, complexity FROM nodes UNION ALL SELECT 'literal', value, kind, file_path, start_line, NULL, NULL FROM literals
   UNION ALL SELECT DISTINCT 'env_var', 'LIMIT_' || o_orderkey % 5, NULL, 'c' || o_custkey % 20, 0, NULL, NULL FROM orders UNION ALL SELECT 'route', '/orders/' || o_orderkey, NULL, 'c' || o_custkey, o_orderkey, NULL, NULL FROM orders)"""
CANDIDATES_SQL = f"""asked AS (SELECT DISTINCT {QUERY} AS q FROM part),
 k AS (SELECT q, CASE WHEN starts_with(q, 'GET /') OR contains(q, '/') THEN 'route' WHEN starts_with(q, 'process.env.') OR regexp_matches(q, '^[A-Z][A-Z0-9_]{{2,}}$') THEN 'env_var' WHEN regexp_matches(q, '^[a-zA-Z_$][a-zA-Z0-9_$]*$') THEN 'symbol' ELSE 'literal' END AS kind,
   CASE WHEN starts_with(q, 'GET ') THEN substr(q, 5) WHEN contains(q, '/') THEN '/' || q WHEN starts_with(q, 'process.env.') THEN substr(q, 13) ELSE q END AS search FROM asked),
 lookup AS (SELECT *, kind AS type, 0 AS step FROM k UNION ALL SELECT *, CASE kind WHEN 'symbol' THEN 'literal' ELSE 'symbol' END, 1 FROM k WHERE kind <> 'route' UNION ALL SELECT *, 'literal', 2 FROM k WHERE starts_with(q, 'process.env.')),
 hits AS (SELECT l.*, name, node_kind, file, line, coalesce(is_exported, false) AS is_exported, coalesce(complexity, 0) AS complexity, name = search AS exact FROM lookup l JOIN entries e ON e.type = l.type AND contains(lower(name), lower(search))),
 flagged AS (SELECT *, bool_or(exact) OVER (PARTITION BY q, step) AS any_exact FROM hits),
 numbered AS (SELECT *, row_number() OVER (PARTITION BY q, step ORDER BY CASE type WHEN 'symbol' THEN 1 - is_exported::INT WHEN 'route' THEN 0 ELSE 1 - exact::INT END, CASE type WHEN 'symbol' THEN -complexity WHEN 'literal' THEN length(name) ELSE 0 END, file, line, name, node_kind) AS n
   FROM flagged WHERE type <> 'symbol' OR exact OR NOT any_exact),
 chosen AS (SELECT * FROM numbered WHERE n <= 10 OR type = 'route' OR (type = 'symbol' AND any_exact)),
 ends AS (SELECT *, bool_or(step = 0 AND lower(name) IN (lower(q), lower(search))) OVER o AS first, bool_or(step = 1 AND lower(name) IN (lower(q), lower(search))) OVER o AS second, bool_or(step = 0) OVER o AS found FROM chosen WINDOW o AS (PARTITION BY q)),
 kept AS (SELECT * FROM ends WHERE step = 0 OR (NOT first AND (step = 1 OR NOT (found AND second)))),
 scored AS (SELECT *, least(2.0, CASE WHEN lower(name) = lower(search) THEN 1.0 WHEN starts_with(lower(name), lower(search)) THEN 0.7 WHEN contains(lower(name), lower(search)) THEN 0.5 ELSE 0.2 END + CASE WHEN type = kind OR (kind = 'env_var' AND type = 'symbol') THEN 0.15 ELSE 0 END
   + CASE WHEN is_exported THEN 0.05 ELSE 0 END + CASE WHEN complexity > 0 THEN least(0.1, 0.03 * ln(complexity + 1)) ELSE 0 END - CASE WHEN type = 'symbol' AND NOT exact THEN 0.15 ELSE 0 END) AS score,
   CASE type WHEN 'symbol' THEN coalesce(node_kind, type) ELSE type END AS nk FROM kept),
 s AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY q, name, file, line, nk ORDER BY step, n) = 1)"""


def resolver_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four indexes as one table."""
    c, none = F.col, [F.lit(None).cast("boolean").alias("is_exported"), F.lit(None).cast("int").alias("complexity")]
    found = nodes(spark, sf_dir).select(F.lit("symbol").alias("type"), "name", c("kind").alias("node_kind"), c("file_path").alias("file"), c("start_line").alias("line"), "is_exported", c("complexity").cast("int").alias("complexity"))
    found = found.unionByName(literals(spark, sf_dir).select(F.lit("literal").alias("type"), c("value").alias("name"), c("kind").alias("node_kind"), c("file_path").alias("file"), c("start_line").alias("line"), *none))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.lit(None).cast("string").alias("node_kind"))
    limits = orders.select(F.concat(F.lit("LIMIT_"), (c("o_orderkey") % 5).cast("string")).alias("name"), F.concat(F.lit("c"), (c("o_custkey") % 20).cast("string")).alias("file"), "node_kind").distinct()
    found = found.unionByName(limits.select(F.lit("env_var").alias("type"), "name", "node_kind", "file", F.lit(0).cast("long").alias("line"), *none))
    return found.unionByName(orders.select(F.lit("route").alias("type"), F.concat(F.lit("/orders/"), c("o_orderkey").cast("string")).alias("name"), "node_kind", F.concat(F.lit("c"), c("o_custkey").cast("string")).alias("file"), c("o_orderkey").alias("line"), *none))


def resolver_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.expr(QUERY).alias("text")).distinct().select(F.col("text").alias("query_id"), "text")


@query("candidate_scores", f"WITH {NODES_SQL}, {LITERALS_SQL}, {ENTRIES_SQL}, {CANDIDATES_SQL} SELECT q AS query_id, type, name, file, line, round(score, 6) AS score FROM s")
def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact hits of the indexes a query asks, or names that contain it; guesses of symbols lose a little."""
    found = resolver.candidates(resolver_queries(spark, sf_dir), resolver_entries(spark, sf_dir))
    return found.select("query_id", "type", "name", "file", "line", F.round("score", 6).alias("score"))


@query(
    "resolve",
    f"""WITH {NODES_SQL}, {LITERALS_SQL}, {ENTRIES_SQL}, {CANDIDATES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, step, n) AS rank, least(max(score) OVER (PARTITION BY q) / 1.15, 1.0) AS confidence FROM s)
    SELECT q AS query_id, k.kind, coalesce(rank, 0)::INTEGER AS rank, type, name, file, line, round(score, 6) AS score, round(coalesce(confidence, 0), 6) AS confidence, coalesce(confidence, 0) < 0.4 AS needs_fallback FROM k LEFT JOIN (SELECT q, rank, type, name, file, line, score, confidence FROM r) USING (q)""",
)
def resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every query's answers, best first, and how sure the best one is."""
    found = resolver.resolve(resolver_queries(spark, sf_dir), resolver_entries(spark, sf_dir))
    return found.withColumns({"score": F.round("score", 6), "confidence": F.round("confidence", 6)})


@query(
    "nodes_with_summaries",
    f"""WITH {NODES_SQL}, summaries AS (SELECT ps_partkey AS start_line, count(*) AS suppliers, min(ps_suppkey) AS first_supplier FROM (SELECT DISTINCT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey FROM lineitem) GROUP BY ps_partkey)
    SELECT node_id, file_path, coalesce(suppliers, 0) AS suppliers, first_supplier FROM nodes LEFT JOIN summaries USING (start_line)""",
)
def nodes_with_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node with what is known of it, or none."""
    known = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("start_line")).agg(F.count_distinct("l_suppkey").alias("suppliers"), F.min("l_suppkey").alias("first_supplier"))
    return nodes(spark, sf_dir).join(known, "start_line", "left").select("node_id", "file_path", F.coalesce("suppliers", F.lit(0)).alias("suppliers"), "first_supplier")


@query(
    "literals_with_nodes",
    f"""WITH {NODES_SQL}, {LITERALS_SQL}, n AS (SELECT split_part(node_id, ':', 1) || ':' || split_part(node_id, ':', 2) AS fn, file_path, name FROM nodes)
    SELECT l.file_path, l.start_line, l.value, n.name AS within FROM literals l LEFT JOIN n ON n.fn = l.containing_fn AND n.file_path = l.file_path""",
)
def literals_with_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every literal with the node that contains it, if the file has that node."""
    fn = F.concat_ws(":", F.split_part("node_id", F.lit(":"), F.lit(1)), F.split_part("node_id", F.lit(":"), F.lit(2)))
    n = nodes(spark, sf_dir).select(fn.alias("containing_fn"), "file_path", F.col("name").alias("within"))
    return literals(spark, sf_dir).join(n, ["containing_fn", "file_path"], "left").select("file_path", "start_line", "value", "within")


@query(
    "body_budget",
    f"""WITH {NODES_SQL}, q AS (SELECT lower(split_part(p_name, ' ', 1)) AS q FROM part WHERE p_partkey = 7),
    r AS (SELECT file_path, name, start_line, CASE WHEN lower(name) = q THEN 0 WHEN starts_with(lower(name), q) THEN 1 WHEN contains(lower(name), q) THEN 2 ELSE 3 END AS rank FROM nodes, q),
    k AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY rank, start_line, name) AS n FROM r) SELECT file_path, name, rank FROM k WHERE n <= 3""",
)
def body_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each file the three symbols whose names match best are shown with their bodies."""
    asked = table(spark, sf_dir, "part").filter("p_partkey = 7").select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("q"))
    low = F.lower("name")
    rank = F.when(low == F.col("q"), 0).when(F.startswith(low, F.col("q")), 1).when(F.contains(low, F.col("q")), 2).otherwise(3)
    rows = nodes(spark, sf_dir).crossJoin(F.broadcast(asked)).withColumn("rank", rank)
    best = F.row_number().over(Window.partitionBy("file_path").orderBy("rank", "start_line", "name"))
    return rows.withColumn("n", best).filter("n <= 3").select("file_path", "name", "rank")


@query("top_complexity", f"WITH {NODES_SQL} SELECT node_id, complexity FROM nodes ORDER BY complexity DESC, node_id LIMIT 5")
def top_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).orderBy(F.desc("complexity"), "node_id").limit(5).select("node_id", "complexity")


@query("calls_known_symbols", f"WITH {EDGES_SQL} SELECT relation, count(*) AS known FROM edges WHERE target_symbol IN (SELECT source_symbol FROM edges) GROUP BY relation")
def calls_known_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    known = e.select(F.col("source_symbol").alias("target_symbol")).distinct()
    return e.join(known, "target_symbol", "left_semi").groupBy("relation").agg(F.count("*").alias("known"))
