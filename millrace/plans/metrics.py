"""Usage metrics over ``events``: user_id is the client, value the tokens, ``error`` events are failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import timeseries as ts
from ..sources.tables import table
from .registry import query

HISTORY_SQL = """history AS (SELECT user_id, event_id, ts, sum(value) OVER w AS total_before, sum(CASE WHEN event_type = 'error' THEN 0 ELSE value * 0.25 END) OVER w AS total_saved
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))"""
BUCKET_SQL = {
    "hour": "date_trunc('hour', ts)",
    "day": "date_trunc('day', ts)::TIMESTAMP",
    "week": "(ts::DATE - CAST(dayofweek(ts) AS INTEGER))::TIMESTAMP",
    "month": "date_trunc('month', ts)::TIMESTAMP",
}


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals of each client; one number is partitioned by client, never the whole log."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    saved = F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value") * 0.25)
    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.sum("value").over(w).alias("total_before"), F.sum(saved).over(w).alias("total_saved"))


def _rollup(unit: str) -> None:
    sql = f"""WITH {HISTORY_SQL}, d AS (SELECT user_id, {BUCKET_SQL[unit]} AS bucket, ts, event_id, total_before, total_saved,
      total_before - lag(total_before, 1, 0) OVER w AS db, total_saved - lag(total_saved, 1, 0) OVER w AS ds FROM history WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, bucket, round(sum(db), 4) AS delta_before, round(sum(ds), 4) AS delta_saved, round(arg_max(total_before, (ts, event_id)), 4) AS last_before, round(arg_max(total_saved, (ts, event_id)), 4) AS last_saved FROM d GROUP BY ALL"""

    @query(f"rollup_{unit}", sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rolled = ts.rollup(history(spark, sf_dir), unit, ["user_id"], "ts", ["total_before", "total_saved"], ["event_id"])
        names = {"delta_total_before": "delta_before", "delta_total_saved": "delta_saved", "last_total_before": "last_before", "last_total_saved": "last_saved"}
        return rolled.select("user_id", F.col("bucket").cast("timestamp_ntz").alias("bucket"), *[F.round(a, 4).alias(b) for a, b in names.items()])


for _unit in BUCKET_SQL:
    _rollup(_unit)


@query(
    "lifetime_totals",
    """SELECT user_id, count(*) AS requests, count_if(event_type = 'error') AS failures, round(sum(value), 4) AS total_before, round(sum(CASE WHEN event_type <> 'error' THEN value * 0.25 END), 4) AS total_saved,
    round(CASE WHEN sum(value) > 0 THEN sum(CASE WHEN event_type <> 'error' THEN value * 0.25 ELSE 0 END) / sum(value) * 100 ELSE 0 END, 3) AS saved_percent FROM events GROUP BY user_id""",
)
def lifetime_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("event_type") != "error"
    before, saved = F.sum("value"), F.sum(F.when(ok, F.col("value") * 0.25))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").alias("requests"), F.count_if(~ok).alias("failures"), F.round(before, 4).alias("total_before"), F.round(saved, 4).alias("total_saved"),
        F.round(F.when(before > 0, F.coalesce(saved, F.lit(0.0)) / before * 100).otherwise(0.0), 3).alias("saved_percent"),
    )


@query(
    "gap_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 60 MINUTE THEN 1 ELSE 0 END AS b FROM events),
    s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
    SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM s GROUP BY user_id, n""",
)
def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ts.gap_sessions(table(spark, sf_dir, "events"), "user_id", "ts", 60)
    return found.withColumnRenamed("n", "events")


@query(
    "streak_hit_rate",
    """WITH h AS (SELECT user_id, event_id, ts, event_type, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS hit FROM events),
    i AS (SELECT *, sum(1 - hit) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM h),
    s AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS streak FROM i)
    SELECT user_id, max(streak) AS longest, round(avg(hit) * 100, 4) AS hit_rate FROM s GROUP BY user_id""",
)
def streak_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ts.streaks(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")
    return rows.groupBy("user_id").agg(F.max("streak").cast("long").alias("longest"), F.round(F.avg("hit") * 100, 4).alias("hit_rate"))


@query(
    "history_compact",
    """WITH r AS (SELECT user_id, event_id, ts, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
    k AS (SELECT *, (n - 50 - 1) / 9.0 AS step FROM r),
    f AS (SELECT *, CASE WHEN step > 0 THEN floor(round(i / step, 9) + 0.5) ELSE 0 END AS slot FROM k)
    SELECT user_id, event_id, ts FROM f WHERE n <= 60 OR i >= n - 50 OR n - 50 <= 10 OR (floor(slot * step + 0.5) = i AND slot < 10)""",
)
def history_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.compact(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"], 60)


@query(
    "history_trim",
    """WITH r AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
    SELECT user_id, event_id, ts FROM r WHERE k = 1 OR (k <= 20 AND ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 14 DAY)""",
)
def history_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 20 of each client that are 14 days old at most; the newest stays whatever its age."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    young = F.col("ts") >= F.expr("TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 14 DAY")
    return table(spark, sf_dir, "events").withColumn("k", F.row_number().over(w)).filter((F.col("k") == 1) | (F.col("k") <= 20) & young).select("user_id", "event_id", "ts")


@query(
    "stage_stats",
    """SELECT event_type AS stage, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(arg_max(value, (ts, event_id)), 6) AS last FROM events GROUP BY event_type""",
)
def stage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max_by("value", F.struct("ts", "event_id"))
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage")).agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.round(last, 6).alias("last")
    )


@query("recent_events", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "ts", "event_type")


@query(
    "session_means",
    """SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 9) AS running_mean FROM events""",
)
def session_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.round(F.avg("value").over(w), 9).alias("running_mean"))


@query("cache_hit_rate", "SELECT round(count_if(event_type = 'view') * 100.0 / nullif(count_if(event_type IN ('view', 'click')), 0), 4) AS hit_rate FROM events")
def cache_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views are hits, clicks are misses."""
    hits, all_ = F.count_if(F.col("event_type") == "view"), F.count_if(F.col("event_type").isin("view", "click"))
    return table(spark, sf_dir, "events").agg(F.round(hits * 100.0 / F.when(all_ != 0, all_), 4).alias("hit_rate"))


@query("action_counts", "SELECT event_type AS action, count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'purchase', 'error') GROUP BY event_type")
def action_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.col("event_type").isin("click", "view", "purchase", "error")
    return table(spark, sf_dir, "events").filter(kept).groupBy(F.col("event_type").alias("action")).agg(F.count("*").alias("n"))


@query(
    "live_session",
    """WITH l AS (SELECT user_id, max(ts) AS last_seen, count(*) AS n FROM events GROUP BY user_id)
    SELECT user_id, CASE WHEN TIMESTAMP '2024-01-31 00:00:00' - last_seen > INTERVAL 60 MINUTE THEN 0 ELSE n END AS live FROM l""",
)
def live_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.unix_micros(F.lit("2024-01-31 00:00:00").cast("timestamp"))
    seen = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("last_seen"), F.count("*").alias("n"))
    return seen.select("user_id", F.when(now - F.unix_micros("last_seen") > 3_600_000_000, 0).otherwise(F.col("n")).cast("long").alias("live"))
