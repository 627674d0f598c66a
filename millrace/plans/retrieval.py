"""Retrieval queries: BM25, vectors, fusion, memories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import breadcrumb, cosine
from ..operators import ranking
from ..sources.tables import table
from .registry import query

QUERY = ["the", "than", "thand"]
TOKENS = "list_transform(regexp_extract_all(text, '[A-Za-z0-9_-]{2,}'), lambda x: lower(x))"
BM25_SQL = f"""
WITH t AS (SELECT doc_id, {TOKENS} AS toks FROM documents),
r AS (SELECT doc_id, len(toks) AS dl, len(list_filter(toks, lambda x: x = 'the')) AS f0, len(list_filter(toks, lambda x: x = 'than')) AS f1, len(list_filter(toks, lambda x: x = 'thand')) AS f2 FROM t),
s AS (SELECT count(*) AS n, avg(dl) AS a, count_if(f0 > 0) AS d0, count_if(f1 > 0) AS d1, count_if(f2 > 0) AS d2 FROM r),
bm AS (SELECT doc_id, ln((n - d0 + 0.5) / (d0 + 0.5) + 1) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * dl / a))
     + ln((n - d1 + 0.5) / (d1 + 0.5) + 1) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * dl / a))
     + ln((n - d2 + 0.5) / (d2 + 0.5) + 1) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * dl / a)) AS score FROM r, s)
"""
VECTOR_SQL = "q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0), v AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], qe::DOUBLE[]) AS sim FROM embeddings, q)"
NOW = "2024-02-01 00:00:00"


@query("bm25_top20", BM25_SQL + "SELECT doc_id, round(score, 6) AS score FROM bm WHERE score > 0 ORDER BY bm.score DESC, doc_id LIMIT 20")
def bm25_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ranking.bm25(table(spark, sf_dir, "documents"), QUERY)
    return ranking.top(scored, "score", 20, "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query("bm25_sparse_search", BM25_SQL + "SELECT doc_id, round(score, 6) AS score FROM bm WHERE score > 0.5")
def bm25_sparse_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.bm25(table(spark, sf_dir, "documents"), QUERY).filter("score > 0.5").select("doc_id", F.round("score", 6).alias("score"))


@query(
    "term_statistics",
    f"""WITH t AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents), f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL)
    SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, max(tf) AS max_tf FROM f GROUP BY term""",
)
def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    tf = ranking.term_frequencies(table(spark, sf_dir, "documents"), "doc_id", "text")
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """One row by its key: the vector that is asked for."""
    row = table(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").first()
    return list(row[0]) if row else [0.0]


def _similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.similar(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), "embedding")


@query("dense_topk", f"WITH {VECTOR_SQL} SELECT vec_id, round(sim, 6) AS sim FROM v ORDER BY v.sim DESC, vec_id LIMIT 10")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top(_similar(spark, sf_dir), "sim", 10, "vec_id").select("vec_id", F.round("sim", 6).alias("sim"))


@query("vector_threshold", f"WITH {VECTOR_SQL} SELECT vec_id, label, round(sim, 6) AS sim FROM v WHERE sim >= 0.2")
def vector_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similar(spark, sf_dir).filter("sim >= 0.2").select("vec_id", "label", F.round("sim", 6).alias("sim"))


@query(
    "hybrid_fusion",
    BM25_SQL
    + f""", {VECTOR_SQL},
    d AS (SELECT vec_id AS id, sim FROM v WHERE sim >= 0.1 ORDER BY sim DESC, vec_id LIMIT 30),
    s2 AS (SELECT doc_id AS id, score FROM bm WHERE score > 0),
    u AS (SELECT id, sim, score FROM d FULL JOIN s2 USING (id)), m AS (SELECT max(sim) AS dm, max(score) AS sm FROM u),
    f AS (SELECT id, 0.3 * coalesce(sim / dm, 0) + 0.7 * coalesce(score / sm, 0) AS fused FROM u, m)
    SELECT id, round(fused, 6) AS fused FROM f ORDER BY f.fused DESC, id LIMIT 10""",
)
def hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector of a document is the row of ``embeddings`` with its number."""
    dense = ranking.top(_similar(spark, sf_dir).filter("sim >= 0.1"), "sim", 30, "vec_id").withColumnRenamed("vec_id", "id")
    sparse = ranking.bm25(table(spark, sf_dir, "documents"), QUERY).withColumnRenamed("doc_id", "id")
    return ranking.top(ranking.fuse(dense, sparse, "id", 0.3), "score", 10, "id").select("id", F.round("score", 6).alias("fused"))


MEMORIES_SQL = f"""memories AS (SELECT e.vec_id AS id, e.label AS user_id, d.source AS workspace, d.text AS content, e.embedding,
 TIMESTAMP '{NOW}' - to_hours(e.vec_id * 5) AS created_at FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id)"""


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with the document of their number as content, the label as user, five hours apart."""
    e, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("workspace"), F.col("text").alias("content"))
    created = F.timestamp_seconds(F.unix_timestamp(F.lit(NOW).cast("timestamp")) - F.col("id") * 5 * 3600)
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("user_id"), "embedding").join(d, "id").withColumn("created_at", created)


RECENT = f"WITH q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0), {MEMORIES_SQL}, h AS (SELECT id, user_id, created_at, list_cosine_similarity(embedding::DOUBLE[], qe::DOUBLE[]) AS sim FROM memories, q WHERE user_id = 1)"


@query("memory_search", RECENT + " SELECT id, round(sim, 6) AS sim FROM h WHERE sim >= 0.05 ORDER BY h.sim DESC, id LIMIT 10")
def memory_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User first, then exact top-k, so that other users' memories can't crowd a user's out."""
    mine = memories(spark, sf_dir).filter("user_id = 1")
    return ranking.top(ranking.similar(mine, _query_vector(spark, sf_dir), "embedding").filter("sim >= 0.05"), "sim", 10, "id").select("id", F.round("sim", 6).alias("sim"))


@query(
    "recency_rank",
    RECENT
    + f""", t AS (SELECT * FROM h ORDER BY sim DESC, id LIMIT 20)
    SELECT id, round(sim, 6) AS sim, round(sim * exp(-(epoch(TIMESTAMP '{NOW}') - epoch(created_at)) / 86400.0 / 30), 6) AS boosted FROM t
    ORDER BY sim * exp(-(epoch(TIMESTAMP '{NOW}') - epoch(created_at)) / 86400.0 / 30) DESC, id LIMIT 10""",
)
def recency_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = memories(spark, sf_dir).filter("user_id = 1")
    found = ranking.top(ranking.similar(mine, _query_vector(spark, sf_dir), "embedding"), "sim", 20, "id")
    days = (F.unix_timestamp(F.lit(NOW).cast("timestamp")) - F.unix_timestamp("created_at")) / 86400
    boosted = found.withColumn("boosted", F.col("sim") * F.exp(-days / 30))
    return ranking.top(boosted, "boosted", 10, "id").select("id", F.round("sim", 6).alias("sim"), F.round("boosted", 6).alias("boosted"))


@query("memory_list", f"WITH {MEMORIES_SQL} SELECT id, workspace, substr(content, 1, 200) AS preview FROM memories WHERE user_id = 1 ORDER BY created_at DESC, id LIMIT 50")
def memory_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).filter("user_id = 1").orderBy(F.desc("created_at"), "id").limit(50).select("id", "workspace", F.substring("content", 1, 200).alias("preview"))


@query("memory_count", f"WITH {MEMORIES_SQL} SELECT user_id, workspace, count(*) AS n FROM memories GROUP BY ALL")
def memory_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).groupBy("user_id", "workspace").agg(F.count("*").alias("n"))


@query("namespace_counts", "SELECT label AS namespace, count(*) AS n FROM embeddings GROUP BY label HAVING count(*) > 0")
def namespace_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("namespace")).agg(F.count("*").alias("n"))


@query(
    "breadcrumb",
    """SELECT doc_id, substr(CASE WHEN regexp_extract(text, '(?s)^(.{11}[^.!?]{0,488}?[.!?])', 1) <> '' THEN regexp_extract(text, '(?s)^(.{11}[^.!?]{0,488}?[.!?])', 1) ELSE text END, 1, 150) AS breadcrumb FROM documents""",
)
def breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", breadcrumb(F.col("text")).alias("breadcrumb"))


@query(
    "anchor_vote",
    """WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS anchor_id, b.label, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim
      FROM embeddings a, embeddings b WHERE b.vec_id < 54 AND b.vec_id <> a.vec_id),
    n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, anchor_id) AS r FROM p),
    c AS (SELECT query_id, label, count(*) AS votes, max(sim) AS best FROM n WHERE r <= 5 GROUP BY ALL),
    w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, label) AS r FROM c)
    SELECT query_id, label AS voted, votes FROM w WHERE r = 1""",
)
def anchor_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector asks the 54 anchors, a fixed set, so it is broadcast; 5 nearest vote, ties by label."""
    e = table(spark, sf_dir, "embeddings")
    anchors = F.broadcast(e.filter("vec_id < 54").select(F.col("vec_id").alias("anchor_id"), "label", F.col("embedding").alias("ae")))
    asked = e.select(F.col("vec_id").alias("query_id"), "embedding").join(anchors, F.col("query_id") != F.col("anchor_id"))
    near = asked.withColumn("sim", cosine(F.col("embedding"), F.col("ae"))).withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "anchor_id"))).filter("r <= 5")
    votes = near.groupBy("query_id", "label").agg(F.count("*").alias("votes"))
    best = Window.partitionBy("query_id").orderBy(F.desc("votes"), "label")
    return votes.withColumn("r", F.row_number().over(best)).filter("r = 1").select("query_id", F.col("label").alias("voted"), "votes")
