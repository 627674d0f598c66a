"""Event logs: deltas of running totals, rollups, sessions, streaks, compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import week_start


def bucket_start(ts: Column, unit: str) -> Column:
    """Start of the hour, day, month or (from Sunday) week of ``ts``, as a timestamp."""
    return week_start(ts).cast("timestamp") if unit == "week" else F.date_trunc(unit, ts)


def rollup(history: DataFrame, unit: str, partition: list[str], ts: str, totals: list[str], order: list[str]) -> DataFrame:
    """Deltas of running ``totals`` summed by bucket, with the last value of each total in the bucket.

    The window is over ``partition``, so that a log of any length is spread by its key.
    """
    w = Window.partitionBy(*partition).orderBy(ts, *order)
    deltas = history.select(*partition, bucket_start(F.col(ts), unit).alias("bucket"), F.struct(ts, *order).alias("_at"), *totals, *[(F.col(t) - F.lag(t, 1, 0.0).over(w)).alias(f"delta_{t}") for t in totals])
    return deltas.groupBy(*partition, "bucket").agg(*[F.sum(f"delta_{t}").alias(f"delta_{t}") for t in totals], *[F.max_by(t, "_at").alias(f"last_{t}") for t in totals])


def gap_sessions(events: DataFrame, key: str, ts: str, minutes: int) -> DataFrame:
    """(key, started, ended, n): events of a key with no gap over ``minutes``; a gap of exactly that joins."""
    w = Window.partitionBy(key).orderBy(ts)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = micros - F.lag(micros).over(w) > minutes * 60_000_000
    marked = events.select(key, ts, F.coalesce(gap.cast("int"), F.lit(0)).alias("_new"))
    numbered = marked.withColumn("_session", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(key, "_session").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n")).drop("_session")


def streaks(rows: DataFrame, partition: str, order: list[str], value: str) -> DataFrame:
    """Adds streak (how many rows in a row had this value) and hit (1 if it equals the row before)."""
    w = Window.partitionBy(partition).orderBy(*order)
    same = F.coalesce((F.col(value) == F.lag(value).over(w)).cast("int"), F.lit(0))
    marked = rows.withColumn("hit", same)
    marked = marked.withColumn("_island", F.sum(1 - F.col("hit")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.withColumn("streak", F.row_number().over(Window.partitionBy(partition, "_island").orderBy(*order))).drop("_island")


def compact(history: DataFrame, partition: str, order: list[str], most: int) -> DataFrame:
    """The latest third of ``most`` rows (50 at least) of each partition, and evenly spaced older ones up to ``most``."""
    w = Window.partitionBy(partition)
    recent = max(50, most // 3)
    slots = most - recent
    rows = history.withColumns({"_n": F.count("*").over(w), "_i": F.row_number().over(w.orderBy(*order)) - 1})
    older = F.col("_n") - recent
    step = (older - 1) / F.lit(max(1, slots - 1))
    nearest = F.floor(F.round(F.col("_i") / step, 9) + 0.5)
    on_slot = F.floor(nearest * step + 0.5) == F.col("_i")
    keep = (F.col("_n") <= most) | (F.col("_i") >= older) | (older <= slots) | on_slot & (nearest < slots)
    return rows.filter(keep).drop("_n", "_i")
