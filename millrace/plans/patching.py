"""Patches of documents as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import patches
from ..sources.tables import table
from .registry import query

BODY = "concat('  new ', cast(doc_id AS varchar(20)), chr(10), chr(10), '    more ')"


def _bare(x: str) -> str:
    return f"regexp_replace({x}, '{patches.SPACE}', '', 'g')"


def _indent(x: str) -> str:
    return f"regexp_extract({x}, '^{patches.SPACE}*')"


#: a patch for each document, in turn of the operations; every other search has its white space changed
SQL = f"""WITH t AS (SELECT doc_id, text, string_split(text, chr(10)) AS l, {BODY} AS body, [{", ".join(f"'{x}'" for x in patches.OPERATIONS)}][doc_id % 7 + 1] AS op FROM documents),
 p AS (SELECT *, CASE WHEN op <> 'create_file' OR doc_id % 2 = 1 THEN text END AS src, len(l) AS n, string_split(body, chr(10)) AS b,
   CASE WHEN doc_id % 2 = 1 THEN l[1] ELSE replace(l[1], ' ', '  ') || chr(10) || chr(10) || coalesce(l[2], '') END AS search FROM t),
 f AS (SELECT doc_id, l, n, {_bare("search")} AS need, len(string_split(search, chr(10))) AS asked FROM p WHERE op = 'replace_string' AND NOT contains(text, search)),
 w AS (SELECT doc_id, l, need, unnest(range(greatest(1, asked - 3), asked + 4)) AS size, n FROM f WHERE need <> ''),
 v AS (SELECT doc_id, l, need, size, unnest(range(0, n - size + 1)) AS start FROM w),
 z AS (SELECT doc_id, array_to_string(l[start + 1:start + size], chr(10)) AS found FROM v WHERE {_bare("array_to_string(l[start + 1:start + size], '')")} = need QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY size, start) = 1),
 k AS (SELECT p.*, CASE WHEN contains(text, search) AND {_bare("search")} <> '' THEN search ELSE found END AS key, {_indent("l[2]")} AS base,
   list_min(list_transform(list_filter(b, lambda x: {_bare("x")} <> ''), lambda x: len({_indent("x")}))) AS least FROM p LEFT JOIN z USING (doc_id)),
 r AS (SELECT *, CASE WHEN base = '' THEN b ELSE list_transform(b, lambda x: CASE WHEN {_bare("x")} = '' THEN '' ELSE base || substr(x, least + 1) END) END AS new,
   CASE WHEN op = 'create_file' THEN CASE WHEN src IS NOT NULL THEN 'file exists' END WHEN text IS NULL THEN 'missing file' WHEN op = 'replace_string' THEN CASE WHEN key IS NULL THEN 'not found' WHEN len(string_split(text, key)) > 2 THEN 'ambiguous' END
     WHEN op = 'insert_at_line' THEN CASE WHEN n < 1 THEN 'range' END WHEN n < 3 THEN 'range' END AS error FROM k),
 a AS (SELECT doc_id, op, error, CASE op WHEN 'create_file' THEN body WHEN 'replace_string' THEN replace(text, key, body) WHEN 'delete' THEN array_to_string(list_concat(l[1:1], l[4:]), chr(10))
   WHEN 'insert_at_line' THEN array_to_string(list_concat(l[1:1], string_split(rtrim(body), chr(10)), l[2:]), chr(10)) WHEN 'replace_body' THEN array_to_string(list_concat(l[1:1], new, l[4:]), chr(10))
   WHEN 'insert_after' THEN array_to_string(list_concat(l[1:3], new, l[4:]), chr(10)) ELSE array_to_string(list_concat(l[1:1], new, l[2:]), chr(10)) END AS text FROM r)
 SELECT doc_id, op AS operation, error, CASE WHEN error IS NULL THEN len(text) END AS n_chars, CASE WHEN error IS NULL THEN md5(text) END AS digest FROM a"""


@query("patched", SQL)
def patched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a file with a patch of its own; half of the new files have the path of a document."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    files = docs.select(path.alias("path"), "text")
    operation = F.element_at(F.array(*map(F.lit, patches.OPERATIONS)), (F.col("doc_id") % 7 + 1).cast("int"))
    line = lambda k: F.get(patches.lines_of(F.col("text")), k)
    loose = F.concat(F.replace(line(0), F.lit(" "), F.lit("  ")), F.lit("\n\n"), F.coalesce(line(1), F.lit("")))
    last = F.when(operation == "insert_at_line", None).otherwise(3)
    asked = docs.select(
        F.col("doc_id").alias("patch_id"), F.when((operation == "create_file") & (F.col("doc_id") % 2 == 0), F.concat(F.lit("new/"), path)).otherwise(path).alias("path"), operation.alias("operation"),
        F.lit(2).alias("first"), last.alias("last"), F.when(F.col("doc_id") % 2 == 1, line(0)).otherwise(loose).alias("search"), F.expr(BODY).alias("body"),
    )
    done = patches.apply(files, asked)
    return done.select(F.col("patch_id").alias("doc_id"), "operation", "error", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))
