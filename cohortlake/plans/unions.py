"""Set operations and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlake.operators import merge
from cohortlake.plans.catalog import query
from cohortlake.plans.edits import GAPS, gappy


@query(
    "merge_mapped",
    "E1",
    """SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, 0 AS source_data_set_id FROM customer
       UNION ALL SELECT s_suppkey, s_name, NULL, 1 FROM supplier""",
)
def _(t):
    mapping = {"id": ["c_custkey", "s_suppkey"], "name": ["c_name", "s_name"], "segment": ["c_mktsegment", None]}
    return merge.merge_mapped([t.customer, t.supplier], mapping, add_source=True)


@query(
    "merge_fully",
    "E2",
    """SELECT doc_id, quality, toxic, NULL AS lang, 0 AS source_data_set_id FROM labels
       UNION ALL SELECT doc_id, NULL, NULL, lang, 1 FROM documents""",
)
def _(t):
    return merge.merge_fully([t.labels, t.documents.select("doc_id", "lang")], add_source=True)


@query(
    "merge_reinfer",
    "E3",
    """SELECT id, CAST(dense_rank() OVER (ORDER BY kind) - 1 AS INTEGER) AS kind FROM
       (SELECT c_custkey AS id, c_mktsegment AS kind FROM customer UNION ALL SELECT p_partkey, p_type FROM part)""",
)
def _(t):
    return merge.merge_reinfer([t.customer, t.part], {"id": ["c_custkey", "p_partkey"], "kind": ["c_mktsegment", "p_type"]})


@query("count_distinct_values", "E4", "SELECT o_orderstatus, o_orderpriority, count(*) AS count FROM orders GROUP BY 1, 2")
def _(t):
    return merge.count_distinct_values(t.orders, ["o_orderstatus", "o_orderpriority"])


@query(
    "find_duplicates",
    "E5",
    "SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def _(t):
    return merge.find_duplicates(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("find_duplicate_texts", "E5", "SELECT text, lang, count(*) AS count FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return merge.find_duplicates(t.documents, ["text", "lang"])


@query(
    "remove_duplicates",
    "E6",
    """SELECT event_id, ts, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1""",
)
def _(t):
    return merge.remove_duplicates(t.events.select("event_id", "ts", "user_id", "event_type"), ["user_id", "event_type"], "event_id")


@query(
    "duplicates_identical",
    "E7",
    """SELECT l_orderkey, l_linenumber, CAST(sum(n) AS BIGINT) AS rows, count(*) AS versions FROM
         (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL)
       GROUP BY 1, 2 HAVING count(*) > 1""",
)
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_tax")
    return merge.duplicates_identical(rows, ["l_orderkey", "l_linenumber"], ["l_tax"])


@query(
    "coalesce_rows",
    "E8",
    f"""WITH e AS (SELECT user_id, event_id, event_type, {GAPS} AS value FROM events)
        SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type,
        arg_max(value, event_id) FILTER (value IS NOT NULL) AS value FROM e GROUP BY 1""",
)
def _(t):
    return merge.coalesce_rows(gappy(t).select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id")


@query(
    "append_activities",
    "E9",
    """WITH a AS (SELECT o_custkey AS c_custkey, o_totalprice AS amount, 'order' AS activity FROM orders
                 UNION ALL SELECT user_id, value, 'event' FROM events)
       SELECT a.c_custkey, amount, activity, c_nationkey FROM a JOIN customer USING (c_custkey)""",
)
def _(t):
    orders = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("amount"))
    events = t.events.select(F.col("user_id").alias("c_custkey"), F.col("value").alias("amount"))
    return merge.append_activities({"order": orders, "event": events}, t.customer.select("c_custkey", "c_nationkey"), "c_custkey")


@query("sanity_count", "E10", "SELECT count(*) AS rows, count(DISTINCT l_orderkey) AS ids FROM lineitem")
def _(t):
    return merge.sanity_count(t.lineitem, "l_orderkey")


@query(
    "fill_single_value_distinct",
    "E11",
    """WITH r AS (SELECT l_orderkey, CASE WHEN l_linenumber < 4 THEN l_returnflag END AS l_returnflag, l_linestatus FROM lineitem),
       s AS (SELECT l_orderkey, min(l_returnflag) lo, max(l_returnflag) hi FROM r GROUP BY 1)
       SELECT DISTINCT r.l_orderkey, CASE WHEN lo = hi THEN lo ELSE l_returnflag END AS l_returnflag, l_linestatus
       FROM r JOIN s ON r.l_orderkey = s.l_orderkey""",
)
def _(t):
    rows = t.lineitem.select("l_orderkey", F.when(F.col("l_linenumber") < 4, F.col("l_returnflag")).alias("l_returnflag"), "l_linestatus")
    return merge.fill_single_value_distinct(rows, "l_orderkey", ["l_returnflag"])
