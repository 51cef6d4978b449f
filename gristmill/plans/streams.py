"""Windows over events, in batch what the streaming operators compute."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import load
from ..streaming import ledger

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2, 3""")
def stream_windows(spark, d):
    return ledger.windowed_counts(load(spark, d, "events"), "ts", "1 hour", "10 minutes", ["event_type"]).withColumn("value", F.round("value", 4))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM n GROUP BY user_id, k
""")
def stream_sessions(spark, d):
    return ledger.sessions(load(spark, d, "events"), "ts", "30 minutes", "user_id")
