"""The package's functions under names in SQL: expressions as SQL functions, which the optimiser sees through, and two table functions in Python."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from ..operators.extract import BODY_LINES, SYMBOLS
from ..session import ship

#: name and arguments, type, body
SCALARS = [
    ("canonical_path(path STRING)", "STRING", r"lower(replace(path, '\\', '/'))"),
    ("short_hash(text STRING)", "STRING", "substr(sha2(text, 256), 1, 16)"),
    ("char_tokens(text STRING)", "BIGINT", "cast(ceil(length(text) / 4) AS BIGINT)"),
    ("search_terms(text STRING)", "ARRAY<STRING>", "transform(regexp_extract_all(text, '[A-Za-z0-9_-]{2,}', 0), t -> lower(t))"),
    ("occurrences(text STRING, needle STRING)", "BIGINT", "cast((length(text) - length(replace(text, needle, ''))) / nullif(length(needle), 0) AS BIGINT)"),
    ("token_budget(text STRING, tokens INT)", "STRING", r"CASE WHEN length(text) <= 4 * tokens THEN text WHEN regexp_extract(substr(text, 1, 4 * tokens), '(?s)^(.*)\n', 1) <> '' THEN regexp_extract(substr(text, 1, 4 * tokens), '(?s)^(.*)\n', 1) ELSE substr(text, 1, 4 * tokens) END"),
    ("hamming64(a BIGINT, b BIGINT)", "INT", "bit_count(a ^ b)"),
    ("week_start(ts TIMESTAMP)", "DATE", "date_sub(to_date(ts), dayofweek(to_date(ts)) - 1)"),
]
TABLES = [("text_lines(text STRING)", "line INT, content STRING", r"SELECT pos + 1, col FROM posexplode(split(text, '\n'))")]


@udtf(returnType="session_key: string, started: timestamp_ntz, ended: timestamp_ntz, events: bigint")
class GapSessions:
    """Of a table PARTITION BY its first column ORDER BY its second: runs of rows with no gap over ``minutes``. It holds one run, however long."""

    def __init__(self):
        self.key, self.started, self.ended, self.n = None, None, None, 0

    def eval(self, row: Row, minutes: int):
        key, at = str(row[0]), row[1]
        if self.n and at is not None and self.ended is not None and at - self.ended > timedelta(minutes=minutes):
            yield self.key, self.started, self.ended, self.n
            self.started, self.n = None, 0
        self.key, self.ended = key, at
        self.started = at if self.n == 0 else self.started
        self.n += 1

    def terminate(self):
        if self.n:
            yield self.key, self.started, self.ended, self.n


@udtf(returnType="name: string, kind: string, start_line0: int, end_line0: int, is_exported: boolean")
class ExtractSymbols:
    """The symbols that the lines of a source show, each name at its first place by the first pattern that finds it; a language without patterns has none."""

    def eval(self, language: str, source: str):
        found: dict[str, tuple] = {}
        lines = (source or "").split("\n")
        for k, (pattern, kind, exported) in enumerate(SYMBOLS.get(language, [])):
            for i, line in enumerate(lines):
                m = re.search(pattern, line, re.ASCII)
                if m and m[1] and (m[1] not in found or (k, i) < found[m[1]][:2]):
                    found[m[1]] = (k, i, kind, exported)
        for name, (_, i, kind, exported) in found.items():
            yield name, kind, i, min(i + BODY_LINES, len(lines) - 1), exported


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL, for as long as it lives."""
    ship(spark)
    for signature, kind, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
    for signature, columns, body in TABLES:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS TABLE({columns}) RETURN {body}")
    spark.udtf.register("gap_sessions", GapSessions)
    spark.udtf.register("extract_symbols", ExtractSymbols)
