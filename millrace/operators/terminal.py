"""What a terminal printed, without its colours, titles, progress bars and spinners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .once import once

# Control sequences that go, glyphs of spinners, lines that show progress, lines of a package manager's log.
CONTROL = [r"\x1b\[[0-9;:?<=>]*[ -/]*[@-~]", r"\x1b\][^\x07\x1b]*(?:\x07|\x1b\\)", r"\x1b[()][0-9a-zA-Z]", r"\x1b"]
GLYPHS = "⠋⠙⠹⠸⠼⠴⠦⠧⠇⠏⣾⣽⣻⢿⡿⣟⣯⣷"
PROGRESS = [rf"^\s*[{GLYPHS}]", r"^\[[#=\-.\s]{8,}\]\s+\d+%.*", r"^\s*[\[(]?[#=\-█▓▒░.\s]{6,}[\])]?\s*\d{1,3}\s*%", r"^\s*\d{1,3}\s*%\s*(?:\([^)]*\))?\s*$"]
NOISE = r"(?i)^\s*npm\s+(verb|sill|timing|notice\s+http)"


def is_progress(line: Column) -> Column:
    return F.trim(line).rlike(r"\S") & line.rlike("|".join(f"(?:{p})" for p in PROGRESS))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _redrawn(line: Column) -> Column:
    """Of a line that was drawn over, what stood there last."""
    parts = F.filter(F.split(line, "\r"), lambda s: s != "")
    return F.when(F.contains(line, F.lit("\r")) & (F.size(parts) > 1), _strip(F.element_at(parts, -1))).otherwise(line)


def scrub(rows: DataFrame, id_cols: list[str], text_col: str, least_run: int = 3) -> DataFrame:
    """``id_cols`` and text, scrubbed: runs of ``least_run`` and more progress lines are one line that says how many there were.

    Runs are gaps and islands over lines, and only texts that have enough progress lines are split into rows for it; ``id_cols`` must tell rows apart.
    Null stays null.
    """
    text = F.col(text_col)
    for p in CONTROL:
        text = F.regexp_replace(text, p, "")
    drawn = lambda line: (F.size(F.filter(F.split(line, "\r"), lambda s: s != "")) > 1) & F.contains(line, F.lit("\r"))
    # a line that was drawn over is no member of a run, and goes if nothing is left of it
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.struct(_redrawn(x).alias("x"), drawn(x).alias("d"))), lambda s: ~(s["d"] & (s["x"] == "")))
    marked = F.transform(lines, lambda s: F.struct(s["x"].alias("x"), (~s["d"] & is_progress(s["x"])).alias("p")))
    split = once(rows.select(*id_cols, F.col(text_col)), _lines=marked).drop(text_col)
    busy = F.coalesce(F.size(F.filter("_lines", lambda s: s["p"])) >= least_run, F.lit(False))
    plain = split.filter(~busy).select(*id_cols, F.col("_lines.x").alias("_lines"))

    order = Window.partitionBy(*id_cols).orderBy("i")
    long = split.filter(busy).select(*id_cols, F.posexplode("_lines").alias("i", "s")).select(*id_cols, "i", F.col("s.x").alias("x"), F.col("s.p").alias("p"))
    long = long.withColumn("island", F.when(F.col("p"), F.col("i") - F.sum(F.col("p").cast("int")).over(order)).otherwise(-1 - F.col("i")))
    runs = long.groupBy(*id_cols, "p", "island").agg(F.min("i").alias("i"), F.count("*").alias("n"), F.max_by("x", "i").alias("last"), F.when(F.count("*") < least_run, F.sort_array(F.collect_list(F.struct("i", "x")))).alias("xs"))
    said = _strip(F.regexp_replace(_strip(F.col("last")), f"[{GLYPHS}]", ""))
    mark = F.when(said != "", F.concat(said, F.lit("  ["), (F.col("n") - 1).cast("string"), F.lit(" progress lines collapsed]"))).otherwise(F.concat(F.lit("["), F.col("n").cast("string"), F.lit(" progress lines collapsed]")))
    kept = F.when(F.col("p") & (F.col("n") >= least_run), F.array(mark)).otherwise(F.col("xs.x"))
    joined = runs.groupBy(*id_cols).agg(F.sort_array(F.collect_list(F.struct("i", kept.alias("k")))).alias("k")).select(*id_cols, F.flatten("k.k").alias("_lines"))

    whole = F.array_join(F.filter("_lines", lambda x: ~x.rlike(NOISE)), "\n")
    whole = F.regexp_replace(whole, r"\n{3,}", "\n\n")
    tidy = F.array_join(F.transform(F.split(whole, "\n"), lambda x: F.regexp_replace(x, r"\s+$", "")), "\n")
    return plain.unionByName(joined).select(*id_cols, _strip(tidy).alias("text"))
