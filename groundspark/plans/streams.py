"""Streaming queries, an extension: the batch SQL over the same windows is their oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import table
from ..streaming import requests as R


def queries() -> dict:
    q = {}
    q["stream_tumbling"] = lambda s, d: R.drained(R.tumbling(R.requests_stream(s, d)), "complete")
    q["stream_sliding"] = lambda s, d: R.drained(R.sliding(R.requests_stream(s, d)), "complete")
    q["stream_sessions"] = lambda s, d: R.drained(R.sessions(R.requests_stream(s, d)), "complete")
    q["stream_dedup"] = lambda s, d: R.drained(R.first_of_each(R.requests_stream(s, d, "40 days")))
    q["stream_static_join"] = lambda s, d: R.drained(R.requests_stream(s, d).join(table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment"), "user_id").select("event_id", "c_mktsegment"))
    return q


def oracle_sql() -> dict[str, str]:
    return {
        "stream_tumbling": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
        "stream_sliding": "SELECT (date_trunc('day', ts) - to_days(k::INT))::TIMESTAMP AS start, count(*) AS n FROM events, range(2) t(k) GROUP BY 1",
        "stream_sessions": "WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM a) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", count(*) AS n FROM b GROUP BY user_id, g",
        "stream_dedup": "SELECT event_id, event_type FROM events",
        "stream_static_join": "SELECT event_id, c_mktsegment FROM events JOIN customer ON user_id = c_custkey",
    }
