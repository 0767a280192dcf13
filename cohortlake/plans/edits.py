"""Filters, projections and cell edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlake.functions.parsing import FieldType
from cohortlake.operators import cells
from cohortlake.operators.criteria import Condition, count_where, filter_dataset, match_aggregate, multi_count_where, non_null_counts, table_page, where_all
from cohortlake.plans.catalog import query, rounded

# a value column with gaps, as the tables themselves have none
GAPS = "CASE WHEN event_type IN ('error', 'signup') THEN NULL ELSE value END"


def gappy(t):
    return t.events.withColumn("value", F.when(~F.col("event_type").isin("error", "signup"), F.col("value")))


@query(
    "criteria",
    "C1 F20",
    f"""WITH e AS (SELECT event_id, event_type, {GAPS} AS value FROM events)
        SELECT '=' AS op, count(*) FILTER (event_type = 'view') AS count FROM e
        UNION ALL SELECT '!=', count(*) FILTER (value IS DISTINCT FROM 10.0) FROM e
        UNION ALL SELECT 'is null', count(*) FILTER (value IS NULL) FROM e
        UNION ALL SELECT 'is not null', count(*) FILTER (value IS NOT NULL) FROM e
        UNION ALL SELECT 'in', count(*) FILTER (event_type IN ('view', 'click')) FROM e
        UNION ALL SELECT 'not in', count(*) FILTER (value IS NULL OR value NOT IN (1.0, 2.0)) FROM e
        UNION ALL SELECT '>', count(*) FILTER (value > 50) FROM e
        UNION ALL SELECT '>=', count(*) FILTER (value >= 50) FROM e
        UNION ALL SELECT '<', count(*) FILTER (value < 50) FROM e
        UNION ALL SELECT '<=', count(*) FILTER (value <= 50) FROM e
        UNION ALL SELECT 'regex', count(*) FILTER (regexp_matches(event_type, '(?i)C[LH]')) FROM e
        UNION ALL SELECT 'not regex', count(*) FILTER (NOT regexp_matches(event_type, '(?i)C[LH]')) FROM e""",
)
def _(t):
    e = gappy(t)
    conditions = [
        Condition("event_type", "=", "view"),
        Condition("value", "!=", 10.0),
        Condition("value", "is null"),
        Condition("value", "is not null"),
        Condition("event_type", "in", ["view", "click"]),
        Condition("value", "not in", [1.0, 2.0]),
        Condition("value", ">", 50.0),
        Condition("value", ">=", 50.0),
        Condition("value", "<", 50.0),
        Condition("value", "<=", 50.0),
        Condition("event_type", "regex", "C[LH]"),
        Condition("event_type", "not regex", "C[LH]"),
    ]
    return multi_count_where(e, {c.op: [c] for c in conditions}).withColumnRenamed("filter", "op")


@query(
    "filter_dataset",
    "C2",
    """SELECT o_orderkey, o_totalprice, o_orderdate FROM orders
       WHERE o_totalprice >= 150000 AND o_orderdate < TIMESTAMP '1997-01-01' AND o_orderstatus IN ('F', 'O')""",
)
def _(t):
    conditions = [
        Condition("o_totalprice", ">=", " 150000 "),
        Condition("o_orderdate", "<", "1997-01-01"),
        Condition("o_orderstatus", "in", ["F", "O"]),
    ]
    kinds = {"o_totalprice": FieldType("double"), "o_orderdate": FieldType("date"), "o_orderstatus": FieldType("string")}
    return filter_dataset(t.orders.select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus"), conditions, kinds).drop("o_orderstatus")


@query("drop_fields", "C3", "SELECT p_partkey, p_brand, p_size FROM part")
def _(t):
    return cells.drop_fields(t.part, drop=["p_name", "p_type", "p_retailprice"])


@query("keep_fields", "C3", "SELECT p_partkey, p_retailprice FROM part")
def _(t):
    return cells.drop_fields(t.part, keep=["p_partkey", "p_retailprice"])


@query("rename_fields", "C4", "SELECT p_partkey AS id, p_name, p_brand AS brand, p_type, p_size, p_retailprice FROM part")
def _(t):
    return cells.rename_fields(t.part, [("p_partkey", "id"), ("p_brand", "brand")])


@query("fix_names", "C6", "SELECT s_suppkey AS supplier_key, s_name AS name_of_supplier, s_acctbal AS s_acctbal FROM supplier")
def _(t):
    odd = t.supplier.select(F.col("s_suppkey").alias("supplier key"), F.col("s_name").alias("name.of-supplier"), "s_acctbal")
    return cells.clean_names(odd)


@query("replace_number", "C7", "SELECT p_partkey, CASE WHEN p_size = 7 THEN 700 ELSE p_size END AS p_size FROM part")
def _(t):
    return cells.replace_number(t.part.select("p_partkey", "p_size"), "p_size", 7, 700)


@query(
    "replace_value_with_null",
    "C8",
    """SELECT l_orderkey, l_linenumber, nullif(l_quantity, 10) AS l_quantity, nullif(l_discount, 10) AS l_discount FROM lineitem""",
)
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return cells.replace_value_with_null(rows, 10, ["l_quantity", "l_discount"])


@query("replace_zero_with_null", "C9", "SELECT l_orderkey, l_linenumber, nullif(l_discount, 0) AS l_discount FROM lineitem")
def _(t):
    return cells.replace_zero_with_null(t.lineitem.select("l_orderkey", "l_linenumber", "l_discount"), "l_discount")


@query("replace_null_with_number", "C10", f"SELECT event_id, coalesce({GAPS}, -1) AS value FROM events")
def _(t):
    return cells.replace_null_with_number(gappy(t).select("event_id", "value"), "value", -1)


@query("replace_string", "C11", "SELECT p_partkey, replace(p_name, 'ring', 'RING') AS p_name, replace(p_brand, 'Brand#', '') AS p_brand FROM part")
def _(t):
    rows = cells.replace_string(t.part.select("p_partkey", "p_name", "p_brand"), ["p_name"], "ring", "RING")
    return cells.replace_string(rows, ["p_brand"], "Brand#", "")


@query(
    "trim_fraction",
    "C12",
    """SELECT event_id, CASE WHEN instr(s, '.') > 1 THEN substr(s, 1, instr(s, '.') + 3) ELSE s END AS s
       FROM (SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS s FROM events)""",
)
def _(t):
    text = t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("s"))
    return cells.trim_fraction(text, "s")


@query(
    "remap_codes",
    "C14",
    """SELECT p_partkey, p_size FROM part UNION ALL
       SELECT p_partkey, CASE p_size WHEN 1 THEN 101 WHEN 2 THEN 102 ELSE 103 END FROM part WHERE p_size IN (1, 2, 3)""",
)
def _(t):
    return cells.remap_codes(t.part.select("p_partkey", "p_size"), "p_size", {1: 101, 2: 102, 3: 103})


@query(
    "derive_recode",
    "C15",
    f"""SELECT event_id, CASE event_type WHEN 'view' THEN 'look' WHEN 'click' THEN 'act' WHEN 'purchase' THEN 'act' ELSE 'other' END AS kind,
        coalesce({GAPS}, 0) > 0 OR user_id < 10 AS any_flag FROM events""",
)
def _(t):
    e = gappy(t).withColumn("early", F.col("user_id") < 10)
    mapping = {"view": "look", "click": "act", "purchase": "act", "error": "other", "signup": "other"}
    return cells.derive_recode(e, "event_type", mapping, ["early"], ["value"], "kind", "any_flag").select("event_id", "kind", "any_flag")


@query(
    "max_normalise",
    "C16",
    f"""WITH e AS (SELECT event_id, user_id, {GAPS} AS value FROM events), c AS (SELECT * FROM e WHERE value IS NOT NULL)
        SELECT event_id, round(user_id / (SELECT max(user_id) FROM c), 9) AS user_id,
        round(value / (SELECT max(value) FROM c), 9) AS value FROM c""",
)
def _(t):
    return rounded(cells.max_normalise(gappy(t).select("event_id", "user_id", "value"), ["user_id", "value"]), 9)


@query(
    "table_page",
    "C17",
    """SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM
       (SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 60)""",
)
def _(t):
    rows, total = table_page(
        t.orders, 3, 20, [("o_totalprice", False), ("o_orderkey", True)], ["o_orderkey", "o_totalprice"], [Condition("o_orderstatus", "=", "F")]
    )
    return rows.withColumn("total", total.scalar())


@query(
    "set_field_by_ids",
    "C18",
    """SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'flagged' ELSE d.source END AS source
       FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) l ON d.doc_id = l.doc_id""",
)
def _(t):
    ids = t.labels.where("toxic = 1").select("doc_id")
    return cells.set_field_by_ids(t.documents.select("doc_id", "source"), "doc_id", ids, "source", "flagged")


@query(
    "non_null_counts",
    "F20",
    f"""WITH e AS (SELECT event_id, ts, user_id, {GAPS} AS value FROM events)
        SELECT 'event_id' AS field, count(event_id) AS count FROM e UNION ALL SELECT 'ts', count(ts) FROM e
        UNION ALL SELECT 'user_id', count(user_id) FROM e UNION ALL SELECT 'value', count(value) FROM e""",
)
def _(t):
    return non_null_counts(gappy(t).select("event_id", "ts", "user_id", "value"))


@query("count_where", "F20", f"SELECT count(*) AS count FROM (SELECT {GAPS} AS value, event_type FROM events) WHERE value IS DISTINCT FROM 5.0 AND event_type <> 'view'")
def _(t):
    return count_where(gappy(t), [Condition("value", "!=", 5.0), Condition("event_type", "!=", "view")])


@query(
    "match_agg_pipeline",
    "F26",
    """SELECT role, word, count(*) AS count FROM
         (SELECT role, unnest(string_split(text, ' ')) AS word FROM conversations WHERE turn < 6) WHERE word > 'M'
       GROUP BY role, word""",
)
def _(t):
    words = t.conversations.select("role", "turn", F.split("text", " ").alias("word"))
    return match_aggregate(
        words,
        [Condition("turn", "<", 6)],
        ["role", "turn", "word"],
        unwind="word",
        sub=[Condition("word", ">", "M")],
        group_by=["role", "word"],
        aggregates={"count": F.count(F.lit(1))},
    )


@query("filter_scan_counts", "A8 C1", "SELECT l_returnflag, count(*) AS count FROM lineitem WHERE l_quantity >= 25 AND l_shipdate < TIMESTAMP '1998-01-01' GROUP BY 1")
def _(t):
    kept = where_all(t.lineitem, [Condition("l_quantity", ">=", 25.0), Condition("l_shipdate", "<", F.lit("1998-01-01").cast("timestamp_ntz"))])
    return kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("count"))
