"""Streaming forms."""

from __future__ import annotations

from cohortlake.plans.aggregates import stats_sql, tidy
from cohortlake.plans.catalog import query
from cohortlake.streaming.sessions import stream_sessions
from cohortlake.streaming.stats import read_stream, run_to_table, stream_basic_stats


def _events(t):
    # as a pattern the path may be one file as well as a folder of files
    return read_stream(t.spark, f"{t.folder}/events.parque[t]")


@query("stream_basic_stats", "M1", stats_sql("value", "events", "event_type"))
def _(t):
    return tidy(run_to_table(stream_basic_stats(_events(t), "event_type", "value"), "stream-stats", "update", keys=["event_type"]))


@query(
    "stream_sessions",
    "M2",
    """WITH l AS (SELECT user_id, event_type, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS p FROM events),
       s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p > INTERVAL 12 HOUR THEN 1 ELSE 0 END)
             OVER (PARTITION BY user_id, event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM l)
       SELECT user_id, event_type, count(*) AS rows, min(ts) AS first, max(ts) AS last FROM s GROUP BY user_id, event_type, n
       HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
)
def _(t):
    stream = _events(t).select("user_id", "event_type", "ts")
    out = run_to_table(stream_sessions(stream, ["user_id", "event_type"], "ts", "12 hours", "1 hour"), "stream-sessions")
    return out.withColumns({c: out[c].cast("timestamp_ntz") for c in ("first", "last")})
