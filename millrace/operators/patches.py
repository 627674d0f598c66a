"""Patches of files, as tables: (patch_id, path, operation, first, last, search, body) on (path, text).

Every patch is applied to its file as it stands, and gives its own text or an error; nothing is written. Operations:

* replace_body, insert_before, insert_after, delete: on the lines ``first`` to ``last``, counted from 1; the body is indented as the first of them is.
  A body under a ``least_share`` of what it replaces is taken as incomplete where that is over ``long`` lines.
* insert_at_line: the body, without white space at its end, before line ``first``; one past the last line appends.
* replace_string: ``search``, which must occur once. If it doesn't occur, the lines that equal it without regard to white space stand for it.
* create_file: only where there is no file.

Errors: "operation", "missing file", "file exists", "range", "incomplete", "not found", "ambiguous"; null where the patch holds. Null body counts as
empty; null or blank search is never found; a null text is no file. CRLF ends stay. ``patch_id`` and the paths of files are unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .once import once

# What counts as white space, operations, and how many lines a match may have more or less than what is sought.
SPACE = r"[\x{09}-\x{0d}\x{20}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
OPERATIONS = ["replace_body", "insert_after", "insert_before", "delete", "replace_string", "insert_at_line", "create_file"]
SLACK = 3


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def bare(text: Column) -> Column:
    """``text`` without white space."""
    return F.regexp_replace(text, SPACE, "")


def reindent(body: Column, line: Column) -> Column:
    """The lines of ``body``, moved as one so that the least indented stands as ``line`` does; as they are if ``line`` isn't indented."""
    indent = lambda x: F.regexp_extract(x, f"^{SPACE}*", 0)
    lines, base = lines_of(body), indent(line)
    least = F.coalesce(F.array_min(F.transform(F.filter(lines, lambda x: bare(x) != ""), lambda x: F.length(indent(x)))), F.lit(0))
    return F.when(base == "", lines).otherwise(F.transform(lines, lambda x: F.when(bare(x) == "", "").otherwise(F.concat(base, F.substr(x, least + 1)))))


def fuzzy_places(rows: DataFrame) -> DataFrame:
    """(patch_id, start, size): for ``rows`` (patch_id, source, search), the lines that equal ``search`` without white space, from 0.

    Windows of up to three lines more or less count; the shortest wins, then the first. Bounds between lines are keyed by the length of the
    bare text before them. A window starts at a bound and ends where the bare length of what is sought has been added, so one aggregate by
    (patch, length) meets both ends. Bounds that blank lines part are one run, so that blank lines give no pairs.
    """
    rows = once(rows.select("patch_id", "source", "search"), need=bare(F.col("search")))
    rows = rows.filter("need <> ''")
    sizes = F.concat(F.array(F.lit(0)), F.transform(lines_of(F.col("source")), lambda x: F.length(bare(x))))
    bounds = rows.select("patch_id", F.length("need").alias("need"), F.size(lines_of(F.col("search"))).alias("asked"), F.posexplode(sizes).alias("k", "n"))
    upto = Window.partitionBy("patch_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = bounds.withColumn("at", F.sum("n").over(upto)).groupBy("patch_id", "at", "need", "asked").agg(F.struct(F.min("k").alias("lo"), F.max("k").alias("hi")).alias("run"))
    none = F.lit(None).cast("struct<lo: int, hi: int>")
    ends = F.array(F.struct(F.col("at").alias("meet"), none.alias("a"), F.col("run").alias("b")), F.struct((F.col("at") + F.col("need")).alias("meet"), F.col("run").alias("a"), none.alias("b")))
    met = runs.select("patch_id", "need", "asked", F.inline(ends)).groupBy("patch_id", "need", "asked", "meet").agg(F.max("a").alias("a"), F.max("b").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    size = F.greatest(F.col("asked") - SLACK, F.col("b.lo") - F.col("a.hi"), F.lit(1))
    met = met.withColumn("size", size).filter(F.col("size") <= F.least(F.col("asked") + SLACK, F.col("b.hi") - F.col("a.lo")))
    window = F.struct("size", F.greatest("a.lo", F.col("b.lo") - F.col("size")).alias("start"), (F.col("meet") - F.col("need") + 1).cast("int").alias("at"))
    windows = met.groupBy("patch_id").agg(F.collect_list(window).alias("windows"))  # fewer than the lines of one text
    judged = once(rows.join(windows, "patch_id").select("patch_id", "need", "windows", bare(F.col("source")).alias("flat")))
    same = F.filter("windows", lambda w: F.substr(F.col("flat"), w["at"], F.length("need")) == F.col("need"))
    return judged.select("patch_id", F.array_min(same).alias("w")).filter("w IS NOT NULL").select("patch_id", "w.start", "w.size")


def apply(files: DataFrame, patches: DataFrame, long: int = 20, least_share: float = 0.3) -> DataFrame:
    """(patch_id, path, operation, error, text): a row for each patch; text is null where there is an error."""
    texts = files.select("path", F.col("text").alias("_text"))
    rows = patches.select("patch_id", "path", "operation", "first", "last", "search", F.coalesce("body", F.lit("")).alias("body")).join(texts, "path", "left")
    crlf = F.coalesce(F.contains("_text", F.lit("\r\n")), F.lit(False))
    rows = rows.withColumn("source", F.replace("_text", F.lit("\r\n"), F.lit("\n"))).withColumn("crlf", crlf).withColumn("search", F.replace("search", F.lit("\r\n"), F.lit("\n"))).drop("_text")
    inexact = rows.filter("operation = 'replace_string' AND source IS NOT NULL AND search IS NOT NULL AND NOT contains(source, search)")
    rows = rows.join(fuzzy_places(inexact), "patch_id", "left")
    rows = once(rows, lines=lines_of(F.col("source")))
    lines, source = F.col("lines"), F.col("source")
    first, last, n = F.col("first"), F.col("last"), F.size("lines")
    exact = (bare(F.col("search")) != "") & F.contains(source, F.col("search"))
    key = F.when(exact, F.col("search")).when(F.col("start").isNotNull(), F.array_join(F.slice("lines", F.col("start") + 1, F.col("size")), "\n"))
    rows = once(rows, key=key)
    times = (F.length(source) - F.length(F.replace(source, F.col("key"), F.lit("")))) / F.length("key")
    by_lines = F.col("operation").isin("replace_body", "insert_after", "insert_before", "delete")
    inside = F.coalesce((first >= 1) & (first <= last) & (last <= n), F.lit(False))
    replaced = last - first + 1
    error = (
        F.when(~F.coalesce(F.col("operation").isin(OPERATIONS), F.lit(False)), "operation")
        .when((F.col("operation") == "create_file") & source.isNotNull(), "file exists")
        .when((F.col("operation") != "create_file") & source.isNull(), "missing file")
        .when(by_lines & ~inside, "range")
        .when((F.col("operation") == "insert_at_line") & ~F.coalesce(first.between(1, n + 1), F.lit(False)), "range")
        .when((F.col("operation") == "replace_body") & (replaced > long) & (F.size(lines_of(F.col("body"))) < least_share * replaced), "incomplete")
        .when((F.col("operation") == "replace_string") & F.col("key").isNull(), "not found")
        .when((F.col("operation") == "replace_string") & (times > 1), "ambiguous")
    )
    rows = once(rows, error=error)
    new = reindent(F.col("body"), F.element_at(lines, F.greatest(first, F.lit(1))))
    upto = lambda k: F.slice("lines", 1, F.greatest(k, F.lit(0)))
    rest = lambda k: F.slice("lines", F.greatest(k, F.lit(0)) + 1, n)
    trimmed = lines_of(F.regexp_replace("body", SPACE + r"+\z", ""))
    parts = (
        F.when(F.col("operation") == "replace_body", F.concat(upto(first - 1), new, rest(last)))
        .when(F.col("operation") == "insert_after", F.concat(upto(last), new, rest(last)))
        .when(F.col("operation") == "insert_before", F.concat(upto(first - 1), new, rest(first - 1)))
        .when(F.col("operation") == "delete", F.concat(upto(first - 1), rest(last)))
        .when(F.col("operation") == "insert_at_line", F.concat(upto(first - 1), trimmed, rest(first - 1)))
    )
    text = F.when(F.col("operation") == "create_file", F.col("body")).when(F.col("operation") == "replace_string", F.replace(source, F.col("key"), F.col("body"))).otherwise(F.array_join(parts, "\n"))
    text = F.when(F.col("crlf"), F.replace(text, F.lit("\n"), F.lit("\r\n"))).otherwise(text)
    return rows.select("patch_id", "path", "operation", "error", F.when(F.col("error").isNull(), text).alias("text"))
