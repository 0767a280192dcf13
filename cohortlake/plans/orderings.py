"""Cumulative counts, series, sessions, segments and lags."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlake.operators import histogram as h
from cohortlake.operators import ordered, quantiles
from cohortlake.plans.aggregates import group_histogram_sql, histogram_sql
from cohortlake.plans.catalog import query, rounded
from cohortlake.plans.edits import GAPS, gappy


@query(
    "cumulative_counts",
    "G1",
    "SELECT value, CAST(sum(n) OVER (ORDER BY value) AS BIGINT) AS count FROM (SELECT l_extendedprice AS value, count(*) AS n FROM lineitem GROUP BY 1)",
)
def _(t):
    return quantiles.cumulative_counts(t.lineitem, "l_extendedprice")


@query(
    "cumulative_counts_text",
    "G1",
    "SELECT value, CAST(sum(n) OVER (ORDER BY value) AS BIGINT) AS count FROM (SELECT p_name AS value, count(*) AS n FROM part GROUP BY 1)",
)
def _(t):
    return quantiles.cumulative_counts(t.part, "p_name")


@query(
    "group_cumulative_counts",
    "G2",
    """SELECT "group", value, CAST(sum(n) OVER (PARTITION BY "group" ORDER BY value) AS BIGINT) AS count FROM
       (SELECT nullif(event_type, 'view') AS "group", value, count(*) AS n FROM events GROUP BY 1, 2)""",
)
def _(t):
    rows = t.events.withColumn("kind", F.nullif("event_type", F.lit("view")))
    return quantiles.cumulative_counts(rows, "value", "kind")


@query(
    "cumulative_bins",
    "G3",
    f"SELECT bin, x, CAST(sum(count) OVER (ORDER BY bin) AS BIGINT) AS count FROM ({histogram_sql('o_totalprice', 'orders', 12)})",
)
def _(t):
    return rounded(h.cumulative_bins(h.numeric_distribution(t.orders, "o_totalprice", 12)))


@query(
    "group_cumulative_bins",
    "G4",
    f"""SELECT "group", bin, x, CAST(sum(count) OVER (PARTITION BY "group" ORDER BY bin) AS BIGINT) AS count
        FROM ({group_histogram_sql('o_orderstatus', 'o_totalprice', 'orders', 9, True)})""",
)
def _(t):
    return rounded(h.cumulative_bins(h.group_numeric_distribution(t.orders, "o_orderstatus", "o_totalprice", 9), "group"))


@query("x_series", "G5", f"SELECT * FROM (SELECT {GAPS} AS value, user_id, event_id FROM events) WHERE value IS NOT NULL")
def _(t):
    return ordered.x_series(gappy(t), "value", ["user_id", "event_id"])


@query("x_ordered_series", "G6", "SELECT o_totalprice, o_orderkey, o_orderdate FROM orders ORDER BY o_totalprice")
def _(t):
    return ordered.x_series(t.orders, "o_totalprice", ["o_orderkey", "o_orderdate"], ordered=True)


@query("group_x_series", "G7", f"SELECT * FROM (SELECT event_type, {GAPS} AS value, event_id FROM events) WHERE value IS NOT NULL")
def _(t):
    return ordered.x_series(gappy(t), "value", ["event_id"], "event_type", ordered=True)


@query(
    "fill_from_previous",
    "G8",
    f"""WITH e AS (SELECT event_id, user_id, {GAPS} AS value FROM events)
        SELECT event_id, user_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM e""",
)
def _(t):
    return ordered.fill_from_previous(gappy(t).select("event_id", "user_id", "value"), "user_id", "event_id", ["value"])


@query(
    "fill_from_previous_enum_order",
    "G8",
    """WITH o AS (SELECT o_custkey, o_orderpriority, CASE WHEN min(o_orderstatus) <> 'F' THEN min(o_orderstatus) END AS s
                  FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1, 2)
       SELECT o_custkey, o_orderpriority, last_value(s IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM o""",
)
def _(t):
    low = F.min("o_orderstatus")
    visits = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.when(low != "F", low).alias("s"))
    order = ["4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]
    return ordered.fill_from_previous(visits, "o_custkey", "o_orderpriority", ["s"], order)


@query(
    "session_ids",
    "G9",
    """WITH l AS (SELECT event_id, user_id, event_type, ts, lag(ts) OVER w AS p FROM events
                  WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
       SELECT event_id, user_id, event_type, CAST(1 + sum(CASE WHEN ts - p > INTERVAL 2 DAY THEN 1 ELSE 0 END)
       OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS BIGINT) AS session_id FROM l""",
)
def _(t):
    rows = t.events.select("event_id", "user_id", "event_type", "ts")
    return ordered.session_ids(rows, ["user_id", "event_type"], "ts", F.expr("INTERVAL 2 DAYS"), "event_id").drop("ts")


def segments_sql(size: int, step: int, allow_last: bool) -> str:
    kept = f"(s = 0 OR s * {step} - {step} + {size} < n)" if allow_last else f"s * {step} + {size} <= n"
    return f"""WITH o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k,
                  count(*) OVER (PARTITION BY user_id) AS n FROM events)
        SELECT user_id, event_id, s AS segment_id FROM o CROSS JOIN range((SELECT max(n) FROM o)) r(s)
        WHERE s * {step} <= k AND k < s * {step} + {size} AND {kept}"""


@query("segments", "G10", segments_sql(8, 5, False))
def _(t):
    return ordered.segments(t.events.select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], 8, 5).drop("ts")


@query("segments_short_last", "G10", segments_sql(6, 9, True))
def _(t):
    rows = t.events.select("user_id", "event_id", "ts")
    return ordered.segments(rows, ["user_id"], ["ts", "event_id"], 6, 9, allow_last=True).drop("ts")


@query(
    "ordered_alternations",
    "G11",
    """WITH w AS (SELECT doc_id, string_split(text, ' ') AS a FROM documents),
       l AS (SELECT doc_id, list_transform(a, lambda x: length(x) > 4) AS b FROM w)
       SELECT doc_id, CAST(coalesce(list_sum(list_transform(range(1, len(b)), lambda i: CASE WHEN b[i] <> b[i + 1] THEN 1 ELSE 0 END)), 0) AS INTEGER) AS alternations FROM l""",
)
def _(t):
    long_word = F.transform(F.split("text", " ", -1), lambda w: F.length(w) > 4)
    return t.documents.select("doc_id", long_word.alias("b")).select("doc_id", ordered.alternations(F.col("b")).alias("alternations"))


@query(
    "lag_features",
    "G13",
    """SELECT user_id, k - 1 AS "index", v2 AS value_lag2, v1 AS value_lag1, v0 AS value_lag0, value AS label FROM
         (SELECT user_id, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n, value,
          lag(value, 1) OVER w AS v0, lag(value, 2) OVER w AS v1, lag(value, 3) OVER w AS v2
          FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n >= 60 AND k >= 3""",
)
def _(t):
    return ordered.lag_features(t.events, ["value"], "value", ["ts", "event_id"], 3, group="user_id", min_rows=60)
