"""Links between data sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.operators import link
from cohortlake.operators.link import LinkSide
from cohortlake.operators.match import match_confounders
from cohortlake.plans.catalog import query
from cohortlake.plans.edits import GAPS
from cohortlake.session import settle


@query(
    "link_two",
    "D1",
    """SELECT o_orderkey, o_custkey, o_totalprice, c_name AS "tpch_customer-c_name", c_mktsegment AS "tpch_customer-c_mktsegment"
       FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_mktsegment <> 'BUILDING'""",
)
def _(t):
    right = t.customer.where("c_mktsegment <> 'BUILDING'")
    return link.link_two(
        t.orders, right, [("o_custkey", "c_custkey")], ["o_orderkey", "o_totalprice"], ["c_name", "c_mktsegment"], "tpch.customer"
    )


@query(
    "link_multi",
    "D2",
    """SELECT n_nationkey, n_name, c_custkey, s_suppkey, r_name FROM
         (SELECT nullif(n_nationkey, 4) AS n_nationkey, n_name, n_regionkey FROM nation) n
       LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey
       LEFT JOIN region ON CAST(r_regionkey AS VARCHAR) = CAST(n_nationkey AS VARCHAR)""",
)
def _(t):
    nation = t.nation.withColumn("n_nationkey", F.nullif("n_nationkey", F.lit(4)))
    sides = [
        LinkSide(t.customer, ["c_nationkey"], ["c_custkey"]),
        LinkSide(t.supplier, ["s_nationkey"], ["s_suppkey"]),
        LinkSide(t.region.withColumn("r_regionkey", F.col("r_regionkey").cast("string")), ["r_regionkey"], ["r_name"]),
    ]
    return link.link_multi(nation, ["n_nationkey"], sides, ["n_name"])


@query(
    "link_sorted",
    "D3",
    """SELECT o_custkey, o_orderkey, c_mktsegment, n FROM orders LEFT JOIN customer ON o_custkey = c_custkey
       LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) e ON o_custkey = user_id""",
)
def _(t):
    per_user = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    sides = [LinkSide(t.customer, ["c_custkey"], ["c_mktsegment"]), LinkSide(per_user, ["user_id"], ["n"])]
    return link.link_sorted(t.orders, ["o_custkey"], sides, ["o_orderkey"])


@query(
    "self_link",
    "D4",
    """SELECT arg_max(turn, turn) FILTER (role = 'user') AS user_turn, arg_max(text, turn) FILTER (role = 'user') AS user_text,
       arg_max(conv_id, turn) FILTER (role = 'user') AS user_conv_id, arg_max(role, turn) FILTER (role = 'user') AS user_role,
       arg_max(turn, turn) FILTER (role = 'assistant') AS assistant_turn, arg_max(text, turn) FILTER (role = 'assistant') AS assistant_text,
       arg_max(conv_id, turn) FILTER (role = 'assistant') AS assistant_conv_id, arg_max(role, turn) FILTER (role = 'assistant') AS assistant_role,
       arg_max(turn, turn) FILTER (role = 'system') AS system_turn, arg_max(text, turn) FILTER (role = 'system') AS system_text,
       arg_max(conv_id, turn) FILTER (role = 'system') AS system_conv_id, arg_max(role, turn) FILTER (role = 'system') AS system_role
       FROM (SELECT nullif(conv_id, 5) AS conv_id, turn + conv_id * 1000 AS turn, role, text FROM conversations) GROUP BY conv_id""",
)
def _(t):
    rows = t.conversations.select(
        F.nullif("conv_id", F.lit(5)).alias("conv_id"), (F.col("turn") + F.col("conv_id") * 1000).alias("turn"), "role", "text"
    )
    return link.self_link(rows, ["conv_id"], "role", link.distinct_labels(rows, "role"), "turn")


@query(
    "inherit_from_first",
    "D6",
    """WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber IN (1, 4) THEN l_returnflag END AS flag FROM lineitem),
       f AS (SELECT l_orderkey, min(flag) AS first FROM r WHERE l_linenumber = 1 GROUP BY 1)
       SELECT r.l_orderkey, l_linenumber, coalesce(flag, first) AS flag FROM r LEFT JOIN f ON r.l_orderkey = f.l_orderkey""",
)
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber").isin(1, 4), F.col("l_returnflag")).alias("flag"))
    return link.inherit_from_first(rows, "l_orderkey", "l_linenumber", 1, ["flag"])


@query(
    "compare_datasets",
    "D7",
    """WITH a AS (SELECT c_custkey AS id, c_nationkey AS nation, c_acctbal AS balance FROM customer),
       b AS (SELECT s_suppkey + 20 AS id, s_nationkey AS nation, nullif(s_acctbal, 73.0) AS balance FROM supplier),
       j AS (SELECT a.id AS ia, b.id AS ib, a.nation AS na, b.nation AS nb, a.balance AS ba, b.balance AS bb FROM a FULL JOIN b ON a.id = b.id)
       SELECT 'nation' AS field, count(*) FILTER (ia IS NOT NULL AND ib IS NOT NULL AND na IS DISTINCT FROM nb) AS differences FROM j
       UNION ALL SELECT 'balance', count(*) FILTER (ia IS NOT NULL AND ib IS NOT NULL AND ba IS DISTINCT FROM bb) FROM j
       UNION ALL SELECT 'only in first', count(*) FILTER (ib IS NULL) FROM j
       UNION ALL SELECT 'only in second', count(*) FILTER (ia IS NULL) FROM j""",
)
def _(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    b = t.supplier.select(
        (F.col("s_suppkey") + 20).alias("id"), F.col("s_nationkey").alias("nation"), F.nullif("s_acctbal", F.lit(73.0)).alias("balance")
    )
    return link.compare_datasets(a, b, "id")


@query(
    "key_difference",
    "D8",
    """SELECT DISTINCT o_custkey AS key, 'second' AS missing_in FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events)
       UNION ALL SELECT DISTINCT user_id, 'first' FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders)""",
)
def _(t):
    return link.key_difference(t.orders, t.events, "o_custkey", "user_id")


@query(
    "flag_after_event",
    "D9",
    """WITH v AS (SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_quantity < 30 THEN 1 + CAST(l_quantity AS INTEGER) % 7 END AS ev FROM lineitem),
       e AS (SELECT l_orderkey, max(ev) AS ev FROM v WHERE l_linenumber = 1 AND ev IS NOT NULL GROUP BY 1)
       SELECT v.l_orderkey, l_linenumber, l_quantity, coalesce(l_linenumber = e.ev, false) AS converted, coalesce(l_linenumber >= e.ev, false) AS is_case
       FROM v LEFT JOIN e ON v.l_orderkey = e.l_orderkey""",
)
def _(t):
    event = F.when(F.col("l_quantity") < 30, 1 + F.col("l_quantity").cast("int") % 7)
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", event.alias("event"))
    out = link.flag_after_event(rows, "l_orderkey", "l_linenumber", "event", 1, [1, 2, 3, 4, 5, 6, 7], "converted", "is_case")
    return out.drop("event")


@query(
    "inner_link_by_prefix",
    "D10",
    """SELECT s.kit, s.c_nationkey, c.c_acctbal, o.o_orderkey, o.sample FROM
         (SELECT substr(c_name, 4, 15) AS kit, c_nationkey, c_custkey FROM customer) s JOIN customer c USING (c_custkey)
       JOIN (SELECT o_orderkey, 'tomer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || CASE WHEN o_orderstatus = 'P' THEN '' ELSE '-B1' END AS sample
             FROM orders WHERE o_orderstatus <> 'O') o ON substr(o.sample, 1, 15) = s.kit AND length(o.sample) >= 15""",
)
def _(t):
    kits = t.customer.select(F.substring("c_name", 4, 15).alias("kit"), "c_nationkey", "c_acctbal")
    tail = F.when(F.col("o_orderstatus") == "P", "").otherwise("-B1")
    sample = F.concat(F.lit("tomer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), tail)
    sample = F.when(F.col("o_orderstatus") == "O", "short").otherwise(sample)
    return link.inner_link_by_prefix(kits, t.orders.select("o_orderkey", sample.alias("sample")), "kit", "sample", 15)


@query(
    "update_from_lookup",
    "D12",
    """SELECT s_suppkey, coalesce(c_name, s_name) AS s_name, coalesce(c_acctbal, s_acctbal) AS s_acctbal FROM supplier
       LEFT JOIN (SELECT s_suppkey AS id, s_suppkey + 10 AS via FROM supplier WHERE s_nationkey < 12) m ON s_suppkey = id
       LEFT JOIN customer ON via = c_custkey""",
)
def _(t):
    ids = t.supplier.where("s_nationkey < 12").select("s_suppkey", (F.col("s_suppkey") + 10).alias("via"))
    source = t.customer.select("c_custkey", F.col("c_name").alias("s_name"), F.col("c_acctbal").alias("s_acctbal"))
    return link.update_from_lookup(t.supplier.drop("s_nationkey"), "s_suppkey", ids, source, "c_custkey", ["s_name", "s_acctbal"])


@query(
    "verify_lookup",
    "D13",
    """SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'missing' WHEN o_custkey % 25 = c_nationkey AND o_orderstatus = upper(substr(c_mktsegment, 1, 1))
       THEN 'ok' ELSE 'inconsistent' END AS status
       FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'MACHINERY') ON o_custkey = c_custkey""",
)
def _(t):
    rows = t.orders.select("o_orderkey", "o_custkey", (F.col("o_custkey") % 25).cast("int").alias("nation"), F.col("o_orderstatus").alias("initial"))
    other = t.customer.where("c_mktsegment <> 'MACHINERY'").withColumn("first", F.upper(F.substring("c_mktsegment", 1, 1)))
    out = link.verify_lookup(rows, other, "o_custkey", "c_custkey", [("nation", "c_nationkey"), ("initial", "first")])
    return out.select("o_orderkey", "status")


@query(
    "consistency_sample",
    "D11",
    """SELECT 'customer' AS source, field, CAST(CASE WHEN field IN ('c_name', 'c_acctbal')
         THEN least(500, (SELECT count(DISTINCT o_custkey) FROM orders)) ELSE 0 END AS BIGINT) AS differences
       FROM (VALUES ('c_name'), ('c_nationkey'), ('c_acctbal'), ('c_mktsegment'), ('only in first'), ('only in second')) v(field)""",
)
def _(t):
    wide = link.link_two(t.orders.select(F.col("o_custkey").alias("id")).distinct(), t.customer, [("id", "c_custkey")], right_name="customer")
    # two columns of the source have since changed in every row, so each sampled key must differ there and nowhere else
    changed = {"c_name": F.concat(F.coalesce("c_name", F.lit("")), F.lit("?")), "c_acctbal": F.coalesce("c_acctbal", F.lit(0.0)) + 1}
    source = t.customer.withColumns(changed).withColumnRenamed("c_custkey", "id")
    return link.consistency_sample(wide, {"customer": source}, "id", 500)


@query(
    "asof_visit",
    "G12",
    f"""WITH a AS (SELECT event_id, user_id, ts FROM events),
        v AS (SELECT user_id, ts AS vt, event_id AS visit_no, {GAPS} AS age FROM events WHERE event_type IN ('view', 'signup') AND value > 150),
        d AS (SELECT a.event_id, arg_max(visit_no, vt) AS visit_no FROM a JOIN v ON a.user_id = v.user_id AND v.vt <= a.ts GROUP BY 1),
        f AS (SELECT user_id, arg_min(visit_no, vt) AS first_no, arg_min(age, vt) FILTER (age IS NOT NULL) AS first_age FROM v GROUP BY 1)
        SELECT a.event_id, a.user_id, a.ts, coalesce(d.visit_no, first_no) AS visit_visit_no, first_age
        FROM a JOIN f ON a.user_id = f.user_id LEFT JOIN d ON a.event_id = d.event_id""",
)
def _(t):
    chosen = t.events.where("event_type IN ('view', 'signup') AND value > 150")
    age = F.when(F.col("event_type") == "view", F.col("value"))
    visits = chosen.select("user_id", F.col("ts").alias("vt"), F.col("event_id").alias("visit_no"), age.alias("age"))
    acts = t.events.select("event_id", "user_id", "ts")
    return link.asof_visit(acts, visits, "user_id", "ts", "vt", ["visit_no"], ["age"])


@query(
    "match_confounders",
    "D5",
    """WITH r AS (SELECT c_custkey, c_name, c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) - 1 AS k
                  FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE')),
       n AS (SELECT c_nationkey, least(count(*) FILTER (c_mktsegment = 'BUILDING'), count(*) FILTER (c_mktsegment = 'MACHINERY') // 2,
             count(*) FILTER (c_mktsegment = 'FURNITURE')) AS served FROM r GROUP BY 1),
       u AS (SELECT r.*, CASE WHEN c_mktsegment = 'MACHINERY' THEN k // 2 ELSE k END AS nr, served FROM r JOIN n USING (c_nationkey))
       SELECT u.c_custkey, u.c_nationkey, u.c_mktsegment, c.c_custkey AS matched_case FROM u
       JOIN u c ON c.c_nationkey = u.c_nationkey AND c.nr = u.nr AND c.c_mktsegment = 'BUILDING' WHERE u.nr < u.served""",
)
def _(t):
    rows = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment").withColumn("place", F.col("c_nationkey").cast("string"))
    ratios = {"BUILDING": 1, "MACHINERY": 2, "FURNITURE": 1}
    return match_confounders(rows, "c_custkey", "c_mktsegment", ratios, ["place"], order="c_custkey").drop("place")


NUMERIC_TOLERANCE = 0.02


def _numeric_match(t):
    rows = t.customer.withColumn("place", F.concat(F.lit("n"), F.col("c_nationkey") % 5))
    ratios = {"BUILDING": 1, "MACHINERY": 1, "FURNITURE": 1}
    return rows.where(F.col("c_mktsegment").isin(*ratios)), match_confounders(rows, "c_custkey", "c_mktsegment", ratios, ["place", "c_acctbal"], NUMERIC_TOLERANCE)


@query("match_confounders_numeric", "D5")
def _(t):
    return _numeric_match(t)[1].select("c_custkey", "c_mktsegment", "c_acctbal", "matched_case")


@query(
    "match_confounders_numeric_checks",
    "D5",
    """SELECT name, CAST(CASE WHEN name = 'matched and left over' THEN (SELECT count(*) FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE'))
         ELSE 0 END AS BIGINT) AS value FROM (VALUES ('matched and left over'), ('used twice'), ('case not complete'), ('place differs'), ('too far'), ('left over but servable')) v(name)""",
)
def _(t):
    """What a right and complete matching must satisfy, counted over all rows."""
    rows, out = _numeric_match(t)
    out = settle(out, "matched-rows")
    ends = rows.agg(F.struct(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi")).alias("e"))
    scaled = rows.withColumn("e", ends.scalar()).withColumn("x", (F.col("c_acctbal") - F.col("e.lo")) / (F.col("e.hi") - F.col("e.lo"))).drop("e")
    x = settle(scaled.select("c_custkey", "c_mktsegment", "place", "x"), "matched-scaled")
    case = x.select(F.col("c_custkey").alias("matched_case"), F.col("place").alias("case_place"), F.col("x").alias("case_x"))
    both = out.select("c_custkey", "matched_case").join(x, "c_custkey").join(case, "matched_case")
    left = x.join(out.select("c_custkey"), "c_custkey", "left_anti").withColumn("cell", F.floor(F.col("x") / NUMERIC_TOLERANCE))
    asking = left.where("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("asking"), "place", F.col("x").alias("y"), F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell")
    )
    near = asking.join(left.where("c_mktsegment <> 'BUILDING'"), ["place", "cell"]).where(F.abs(F.col("x") - F.col("y")) < NUMERIC_TOLERANCE)
    servable = near.groupBy("asking").agg(F.count_distinct("c_mktsegment").alias("groups")).where("groups = 2")
    per_case = out.groupBy("matched_case").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c_mktsegment").alias("groups"))
    counted = {
        "matched and left over": out.select("c_custkey").union(left.select("c_custkey")),
        "used twice": out.groupBy("c_custkey").count().where("count > 1"),
        "case not complete": per_case.where("n <> 3 OR groups <> 3"),
        "place differs": both.where("place <> case_place"),
        "too far": both.where(F.abs(F.col("x") - F.col("case_x")) >= NUMERIC_TOLERANCE),
        "left over but servable": servable,
    }
    return reduce(DataFrame.unionByName, [d.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("value")) for n, d in counted.items()])
