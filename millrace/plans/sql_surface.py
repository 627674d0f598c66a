"""Queries in SQL through the registered functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.sql import register
from ..sources.derived_code import js_files
from ..sources.tables import table
from .extraction import SYMBOLS_SQL
from .registry import query
from .retrieval import TOKENS


@query(
    "sql_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 60 MINUTE THEN 1 ELSE 0 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
    SELECT user_id::VARCHAR AS session_key, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM s GROUP BY user_id, n""",
)
def sql_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function over partitions of the events."""
    register(spark)
    return spark.sql("SELECT * FROM gap_sessions(TABLE(SELECT user_id, cast(ts AS timestamp_ntz) AS ts FROM {events}) PARTITION BY user_id ORDER BY (ts), 60)", events=table(spark, sf_dir, "events"))


@query(
    "sql_functions",
    f"""SELECT doc_id, substr(sha256(text), 1, 16) AS hash, ceil(length(text) / 4)::BIGINT AS tokens, len({TOKENS}) AS terms, ((length(text) - length(replace(text, 'the', ''))) // 3)::BIGINT AS n_the,
    md5(CASE WHEN length(text) <= 400 THEN text WHEN regexp_extract(text[1:400], '(?s)^(.*)\\n', 1) <> '' THEN regexp_extract(text[1:400], '(?s)^(.*)\\n', 1) ELSE text[1:400] END) AS head FROM documents WHERE text IS NOT NULL""",
)
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    return spark.sql(
        "SELECT doc_id, short_hash(text) AS hash, char_tokens(text) AS tokens, cast(size(search_terms(text)) AS bigint) AS terms, occurrences(text, 'the') AS n_the, md5(token_budget(text, 100)) AS head FROM {docs} WHERE text IS NOT NULL", docs=table(spark, sf_dir, "documents")
    )


@query("sql_symbols", f"WITH {SYMBOLS_SQL} SELECT path, name, kind, start_line0, end_line0, is_exported FROM symbols")
def sql_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function called for each file."""
    register(spark)
    return spark.sql("SELECT f.path, s.* FROM {files} f, LATERAL extract_symbols(f.language, f.source) s", files=js_files(spark, sf_dir))
