"""Which stored texts a session is still offered, as state for each session: a stream, and the same over a table that is complete.

Rows have session_id, ts, row_id, tokens, vault (visible in the request) and retrieved (a vault that was fetched, in rows that are no requests). A
request of ``least_tokens`` and more is a turn. A vault is offered from the turn that first shows it for ``most_turns`` turns more, until it was
retrieved. A session that is idle for longer than ``idle`` is forgotten: what comes after it begins a new one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..session import ship

MIN_TOKENS, MOST_TURNS, IDLE_MS = 18_000, 3, 2 * 60 * 60 * 1000
OFFERS = "row_id long, session_id long, turn long, vault string, offered boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Offers(StatefulProcessor):
    """A session's turn and last activity, the turn that first showed each vault (a map), and the vaults retrieved (a list)."""

    def __init__(self, least_tokens: int = MIN_TOKENS, most_turns: int = MOST_TURNS, idle_ms: int = IDLE_MS):
        self.least_tokens, self.most_turns, self.idle_ms = least_tokens, most_turns, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        long, text = (lambda n: StructType([StructField(n, LongType())])), (lambda n: StructType([StructField(n, StringType())]))
        self.handle = handle
        self.clock = handle.getValueState("clock", StructType([StructField("turn", LongType()), StructField("last", LongType())]))
        self.found = handle.getMapState("found", text("vault"), long("turn"))
        self.fetched = handle.getListState("fetched", text("vault"))

    def forget(self) -> None:
        for state in (self.clock, self.found, self.fetched):
            state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turn, last = self.clock.get() if self.clock.exists() else (0, None)
        fetched = {v for (v,) in self.fetched.get()} if self.fetched.exists() else set()
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts", "row_id"]).itertuples():
            now = int(r.ts.timestamp() * 1000)
            if last is not None and now - last > self.idle_ms:
                self.forget()
                turn, fetched = 0, set()
            last = now if last is None else max(last, now)
            if pd.notna(r.retrieved) and r.retrieved not in fetched:
                fetched.add(r.retrieved)
                self.fetched.appendValue((r.retrieved,))
            if pd.notna(r.vault) and r.tokens >= self.least_tokens:
                turn += 1
                if not self.found.containsKey((r.vault,)):
                    self.found.updateValue((r.vault,), (turn,))
                first = self.found.getValue((r.vault,))[0]
                out.append((r.row_id, key[0], turn, r.vault, r.vault not in fetched and turn - first <= self.most_turns))
        self.clock.update((turn, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(last, timerValues.getCurrentWatermarkInMs()) + self.idle_ms + 1)
        if out:
            yield pd.DataFrame(out, columns=["row_id", "session_id", "turn", "vault", "offered"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.forget()
        return iter([])

    def close(self) -> None:
        pass


def offers_stream(rows: DataFrame, late: str = "1 hour", processor: Offers | None = None) -> DataFrame:
    """``OFFERS`` of a stream of rows. Rows behind the watermark are dropped, rows that come again within it count once.

    State lives in RocksDB, which the session's setting of the state store must name.
    """
    spark = rows.sparkSession
    if spark.conf.get(PROVIDER, "") != ROCKS:
        raise ValueError(f"{PROVIDER} must be {ROCKS}")
    ship(spark)
    seen = rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["row_id"])
    return seen.groupBy("session_id").transformWithStateInPandas(processor or Offers(), outputStructType=OFFERS, outputMode="Append", timeMode="EventTime")


def offers(rows: DataFrame, least_tokens: int = MIN_TOKENS, most_turns: int = MOST_TURNS, idle_ms: int = IDLE_MS) -> DataFrame:
    """``OFFERS`` of a whole table, by windows; only the place of the gaps needs all of a session's rows in order."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    by_time = Window.partitionBy("session_id").orderBy("ts", "row_id")
    rows = rows.dropDuplicates(["row_id"]).withColumn("gap", F.coalesce((ms - F.lag(ms).over(by_time)) > idle_ms, F.lit(False)).cast("int"))
    rows = rows.withColumn("epoch", F.sum("gap").over(by_time)).withColumn("big", F.coalesce((F.col("tokens") >= least_tokens) & F.col("vault").isNotNull(), F.lit(False)))
    ordered = Window.partitionBy("session_id", "epoch").orderBy("ts", "row_id")
    rows = rows.withColumn("turn", F.sum(F.col("big").cast("long")).over(ordered)).withColumn("_v", F.coalesce("vault", "retrieved"))
    of_vault = Window.partitionBy("session_id", "epoch", "_v").orderBy("ts", "row_id")
    first, fetched = F.min(F.when(F.col("big"), F.col("turn"))).over(of_vault), F.coalesce(F.max(F.col("retrieved").isNotNull()).over(of_vault), F.lit(False))
    return rows.withColumns({"first": first, "fetched": fetched}).filter("big").select("row_id", "session_id", "turn", "vault", (~F.col("fetched") & (F.col("turn") - F.col("first") <= most_turns)).alias("offered"))
