"""What sessions are still offered, over the whole table of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from ..streaming import vault_sessions
from .registry import query

#: purchases fetch a vault, all else shows one; a request has a thousand tokens for each unit of its value
ROWS = {
    "session_id": "user_id",
    "ts": "ts",
    "row_id": "event_id",
    "tokens": "cast(floor(value * 1000) AS bigint)",
    "vault": "CASE WHEN event_type <> 'purchase' THEN concat('v', cast(event_id % 9 AS varchar(20))) END",
    "retrieved": "CASE WHEN event_type = 'purchase' THEN concat('v', cast(event_id % 9 AS varchar(20))) END",
}
_ROWS = ", ".join(f"{v} AS {k}" for k, v in ROWS.items())


def rows(events: DataFrame) -> DataFrame:
    return events.selectExpr(*[f"{v} AS {k}" for k, v in ROWS.items()])


@query(
    "session_offers",
    f"""WITH r AS (SELECT {_ROWS} FROM events), g AS (SELECT *, coalesce(epoch_ms(ts) - lag(epoch_ms(ts)) OVER w > 7200000, false)::INT AS gap FROM r WINDOW w AS (PARTITION BY session_id ORDER BY ts, row_id)),
    e AS (SELECT *, sum(gap) OVER (PARTITION BY session_id ORDER BY ts, row_id) AS epoch, vault IS NOT NULL AND tokens >= 18000 AS big FROM g),
    t AS (SELECT *, sum(big::INT) OVER (PARTITION BY session_id, epoch ORDER BY ts, row_id) AS turn FROM e),
    f AS (SELECT a.row_id, a.session_id, a.turn, a.vault, (SELECT min(b.turn) FROM t b WHERE b.session_id = a.session_id AND b.epoch = a.epoch AND b.vault = a.vault AND b.big) AS first,
      (SELECT count(*) FROM t b WHERE b.session_id = a.session_id AND b.epoch = a.epoch AND b.retrieved = a.vault AND (b.ts, b.row_id) < (a.ts, a.row_id)) AS fetched FROM t a WHERE a.big)
    SELECT row_id, session_id, turn::BIGINT AS turn, vault, fetched = 0 AND turn - first <= 3 AS offered FROM f""",
)
def session_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vault_sessions.offers(rows(table(spark, sf_dir, "events")))
