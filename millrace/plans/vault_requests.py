"""Requests to the vault, one for each turn of ``conversations``, answered tier by tier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup, vault_retrieval
from ..operators.best_texts import best_texts
from ..sources.tables import table
from .index import search_sql
from .registry import query
from .store import CHUNKS_SQL

#: a turn asks for a document's vault, names a file and a line, or only says something; the same expressions in both dialects
REQUEST = {
    "request_id": "conv_id * 100 + turn",
    "vault_id": "CASE WHEN (conv_id + turn) % 5 = 0 THEN concat('v', cast(conv_id * 3 + turn AS varchar(20))) WHEN (conv_id + turn) % 5 = 1 THEN 'v-gone' END",
    "query": "CASE WHEN (conv_id + turn) % 5 = 2 THEN concat('see docs/', cast(conv_id AS varchar(20)), '.txt at line: ', cast(turn * 2 AS varchar(20))) WHEN (conv_id + turn) % 5 <> 3 THEN substr(text, 1, 40) END",
    "context": "CASE WHEN (conv_id + turn) % 5 = 3 AND turn > 3 THEN '' ELSE substr(text, 41, 300) END",
}
#: chunks of 20 lines; vaults with a multiple of 7 have lost theirs, and the search still knows them
STORE_SQL = f"""{CHUNKS_SQL}, known AS (SELECT 'v' || doc_id AS vault_id, doc_id, doc_id * 100000 + chunk_index AS chunk_id, chunk_index, chunk_text AS text FROM chunks),
held AS (SELECT * FROM known WHERE doc_id % 7 <> 0), searched AS (SELECT chunk_id AS id, text FROM known)"""
_SCORE = "cast(cast(floor(score * 100 + 0.5) AS BIGINT) AS VARCHAR)"
_REQUESTS = ", ".join(f"{v} AS {k}" for k, v in REQUEST.items())
VAULT_SQL = f"""WITH {STORE_SQL}, requests AS (SELECT {_REQUESTS} FROM conversations WHERE text IS NOT NULL),
whole AS (SELECT vault_id, string_agg('[Chunk ' || chunk_index || chr(93) || chr(10) || text, chr(10) || chr(10) ORDER BY chunk_index) AS whole FROM held GROUP BY vault_id),
hint AS (SELECT request_id, regexp_extract(query, '(?i)\\bline[:\\s]+(\\d+)\\b', 1)::INTEGER AS line, regexp_extract(query, 'docs/(\\d+)\\.txt', 1)::BIGINT AS doc FROM requests WHERE query LIKE 'see docs/%'),
file AS (SELECT request_id, 'docs/' || doc || '.txt' AS path, line, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM hint JOIN documents ON doc_id = doc),
slice AS (SELECT request_id, '[File slice: ' || path || ' lines ' || greatest(line - 15, 1) || '–' || least(len(l), line + 25) || ']' || chr(10) || chr(10) ||
  array_to_string([lpad(i::VARCHAR, greatest(4, length(i::VARCHAR))::INTEGER, ' ') || ' | ' || l[i] FOR i IN range(greatest(line - 15, 1), least(len(l), line + 25) + 1)], chr(10)) AS slice FROM file WHERE line >= 1 AND line <= len(l)),
direct AS (SELECT r.*, CASE WHEN length(whole) > 0 THEN 0 WHEN length(d.text) > 0 THEN 1 WHEN slice IS NOT NULL THEN 2 END AS tier,
  CASE WHEN length(whole) > 0 THEN '[Vault ' || r.vault_id || ']' || chr(10) || chr(10) || whole WHEN length(d.text) > 0 THEN '[Vault ' || r.vault_id || ']' || chr(10) || chr(10) || d.text ELSE slice END AS answer
  FROM requests r LEFT JOIN whole USING (vault_id) LEFT JOIN documents d ON r.vault_id = 'v' || d.doc_id LEFT JOIN slice USING (request_id)),
todo AS (SELECT request_id AS query_id, vault_id, CASE WHEN substr(coalesce(context, ''), 1, 200) <> '' AND NOT contains(coalesce(query, ''), substr(context, 1, 200)) THEN trim(coalesce(query, '') || ' ' || substr(context, 1, 200)) ELSE coalesce(query, '') END AS text FROM direct WHERE tier IS NULL),
{search_sql("searched", "todo")},
best AS (SELECT query_id, id, 0.7 * score / max(score) OVER (PARTITION BY query_id) AS score FROM scores),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS k FROM best QUALIFY k <= 5),
near AS (SELECT a.chunk_id, string_agg(substr(b.text, 1, 200), chr(10) || '...' || chr(10) ORDER BY b.chunk_index) AS near FROM held a JOIN held b ON a.vault_id = b.vault_id AND abs(a.chunk_index - b.chunk_index) = 1 GROUP BY 1),
pieces AS (SELECT query_id, string_agg('[Chunk ' || chunk_index || ' (score: ' || {_SCORE} || '%)]' || chr(10) || text || coalesce(chr(10) || chr(10) || '[Surrounding Context]' || chr(10) || near, ''), chr(10) || repeat('=', 50) || chr(10) ORDER BY k) AS p FROM top JOIN held ON chunk_id = id LEFT JOIN near USING (chunk_id) GROUP BY 1),
snippets AS (SELECT query_id, string_agg('[Chunk ' || k || ' (score: ' || {_SCORE} || '%)]' || chr(10) || substr(text, 1, 500), chr(10) || repeat('=', 50) || chr(10) ORDER BY k) AS p FROM top JOIN searched USING (id) WHERE text <> '' GROUP BY 1)
SELECT request_id, coalesce(tier, CASE WHEN p.p IS NOT NULL THEN 3 WHEN s.p IS NOT NULL THEN 4 ELSE 6 END)::INTEGER AS tier, vault_id,
  coalesce(answer, CASE WHEN vault_id IS NOT NULL THEN '[Vault ' || vault_id || ' — retrieved via semantic search]' ELSE '[Semantic search results]' END || chr(10) || chr(10) || coalesce(p.p, s.p)) AS text
FROM direct LEFT JOIN pieces p ON p.query_id = request_id LEFT JOIN snippets s ON s.query_id = request_id"""


@query("vault_requests", VAULT_SQL)
def vault_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without vectors for turns, search is by terms alone, and only the best of each request are found; a search with both is in the tests."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    known = dedup.line_chunks(docs, "doc_id", "text").select(
        F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("vault_id"), "doc_id", (F.col("doc_id") * 100000 + F.col("chunk_index")).alias("chunk_id"), "chunk_index", F.col("chunk_text").alias("text")
    )
    searched = known.select(F.col("chunk_id").alias("id"), "text")
    requests = table(spark, sf_dir, "conversations").filter("text IS NOT NULL").selectExpr(*[f"{v} AS {k}" for k, v in REQUEST.items()])
    files = docs.select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    raw = docs.select(F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("vault_id"), "text")
    # all terms of the second step are in the first, and what is found has a text inline: where the first step finds nothing, neither does the second
    search = lambda asked: best_texts(spark, asked.filter("query_id.step = 1"), searched, vault_retrieval.Tiers().first_k)
    return vault_retrieval.retrieve(requests, known.filter("doc_id % 7 <> 0").drop("doc_id"), raw, files, search, inline=searched)
