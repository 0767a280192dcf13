"""Nested documents, series and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlake.functions.parsing import item_name
from cohortlake.functions.series import SCALERS, extract_peaks, process_series, scale_series
from cohortlake.operators import ordered, series
from cohortlake.plans.catalog import query, rounded

LIST = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


def _documents(t):
    """Orders as nested documents: customer object and an array of line objects."""
    lines = t.lineitem.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", F.struct("l_tax", "l_discount").alias("rates")))).alias("lines")
    )
    orders = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return orders.select("o_orderkey", F.struct(F.struct(F.col("o_custkey").alias("id"), F.lit("x").alias("kind")).alias("customer"), "lines", "o_totalprice").alias("doc"))


@query(
    "json_traverse",
    "K1",
    """SELECT o_orderkey, count(l_tax) AS n, round(coalesce(sum(l_tax), 0), 6) AS total, max(o_custkey) AS customer
       FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""",
)
def _(t):
    docs = _documents(t)
    taxes = series.traverse(docs, "doc.lines.rates.l_tax")
    out = docs.select("o_orderkey", taxes.alias("a"), series.traverse(docs, "doc.customer.id").alias("c"))
    total = F.aggregate("a", F.lit(0.0), lambda x, y: x + y)
    return rounded(out.select("o_orderkey", F.size("a").cast("long").alias("n"), total.alias("total"), F.get("c", F.lit(0)).alias("customer")))


@query(
    "json_flatten",
    "K2",
    """SELECT o_orderkey, o_custkey AS "doc.customer.id", 'x' AS "doc.customer.kind", o_totalprice AS "doc.o_totalprice" FROM orders""",
)
def _(t):
    return series.flatten_struct(_documents(t)).drop("doc.lines")


@query(
    "json_deflatten",
    "K3",
    """SELECT o_orderkey, o_totalprice, o_custkey AS id, o_orderstatus AS status FROM orders""",
)
def _(t):
    flat = t.orders.select(F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("c.ref.id"), F.col("o_orderstatus").alias("c.status"), "o_orderkey")
    nested = series.nest_columns(flat)
    return nested.select("o_orderkey", F.col("price").alias("o_totalprice"), F.col("c.ref.id").alias("id"), F.col("c.status").alias("status"))


def _steps(t, column, key="vec_id", digits=5):
    rows = t.embeddings.select(key, F.posexplode(column).alias("pos", "value"))
    return rounded(rows, digits)


def difference_sql(expr: str, past: int = 1, pad: int = 0, digits: int = 5) -> str:
    """Iterated two-value operation by a recursive window over (vec_id, pos)."""
    inner = f"SELECT vec_id, k, v FROM (SELECT vec_id, {LIST} AS a FROM embeddings), LATERAL (SELECT k, a[k + 1] AS v FROM range(64) r(k))"
    for _ in range(past):
        inner = f"SELECT vec_id, k - 1 AS k, {expr} AS v FROM (SELECT vec_id, k, v AS b, lag(v) OVER (PARTITION BY vec_id ORDER BY k) AS a FROM ({inner})) WHERE k > 0"
    padded = f" UNION ALL SELECT vec_id, CAST(k AS INTEGER), 0.0 FROM embeddings, range({pad}) r(k)" if pad else ""
    return f"SELECT vec_id, CAST(k + {pad} AS INTEGER) AS pos, round(v, {digits}) AS value FROM ({inner}){padded}"


@query("series_diff", "K4", difference_sql("b - a"))
def _(t):
    return _steps(t, process_series(F.col("embedding"), "diff"))


@query("series_diff_twice_padded", "K4", difference_sql("b - a", 2, 2))
def _(t):
    return _steps(t, process_series(F.col("embedding"), "diff", 2, pad=True))


@query("series_relative_diff", "K4", difference_sql("(b - a) / nullif(a, 0)", digits=3))
def _(t):
    return _steps(t, process_series(F.col("embedding"), "relative_diff"), digits=3)


@query("series_ratio", "K4", difference_sql("b / nullif(a, 0)", digits=3))
def _(t):
    return _steps(t, process_series(F.col("embedding"), "ratio"), digits=3)


@query("series_log_ratio", "K4", difference_sql("CASE WHEN b / nullif(a, 0) > 0 THEN ln(b / a) END"))
def _(t):
    return _steps(t, process_series(F.col("embedding"), "log_ratio"))


def moving_sql(fn: str, past: int) -> str:
    return f"""SELECT vec_id, CAST(k AS INTEGER) AS pos, round({fn}(a[k + 1 : k + {past + 1}]), 5) AS value
        FROM (SELECT vec_id, {LIST} AS a FROM embeddings), range({64 - past}) r(k)"""


@query("series_moving_min", "K5", moving_sql("list_min", 4))
def _(t):
    return _steps(t, process_series(F.col("embedding"), "min", 4))


@query("series_moving_max", "K5", moving_sql("list_max", 4))
def _(t):
    return _steps(t, process_series(F.col("embedding"), "max", 4))


@query("series_moving_mean", "K5", moving_sql("list_avg", 6))
def _(t):
    return _steps(t, process_series(F.col("embedding"), "mean", 6))


SCALE_SQL = {
    "l1": "CASE WHEN x = 0 THEN 0.0 ELSE sign(x) END",
    "l2": "CASE WHEN x = 0 THEN 0.0 ELSE sign(x) END",
    "standard": "(x - m) / sd",
    "min_max_01": "(x - lo) / (hi - lo)",
    "min_max_11": "(x - lo) / (hi - lo) * 2 - 1",
    "max_abs": "x / greatest(abs(lo), abs(hi))",
}


@query(
    "series_scale",
    "K6",
    """WITH s AS (SELECT vec_id, k, CAST(embedding[k + 1] AS DOUBLE) AS x FROM embeddings, range(64) r(k)),
       b AS (SELECT vec_id, min(x) AS lo, max(x) AS hi, avg(x) AS m, stddev_samp(x) AS sd FROM s GROUP BY 1)
       SELECT vec_id, CAST(k AS INTEGER) AS pos, """
    + ", ".join(f"round(CAST({e} AS DOUBLE), 5) AS {n}" for n, e in SCALE_SQL.items())
    + " FROM s JOIN b USING (vec_id)",
)
def _(t):
    rows = t.embeddings.select("vec_id", *[scale_series(F.col("embedding"), k).alias(k) for k in SCALERS])
    packed = rows.select("vec_id", F.posexplode(F.arrays_zip(*SCALERS)).alias("pos", "z"))
    return rounded(packed.select("vec_id", "pos", *[F.col(f"z.{k}").alias(k) for k in SCALERS]), 5)


@query(
    "extract_peaks",
    "K7",
    """WITH s AS (SELECT vec_id, k, CAST(embedding[k + 1] AS DOUBLE) AS v, CAST(embedding[k] AS DOUBLE) AS p, CAST(embedding[k + 2] AS DOUBLE) AS nx
                  FROM embeddings, range(1, 63) r(k)),
       m AS (SELECT vec_id, k, row_number() OVER (PARTITION BY vec_id ORDER BY v, k) AS rank, count(*) OVER (PARTITION BY vec_id) AS n FROM s WHERE v < p AND nx >= v),
       c AS (SELECT vec_id, k, row_number() OVER (PARTITION BY vec_id ORDER BY k) - 1 AS i FROM m WHERE rank <= floor(n * 0.5)),
       e AS (SELECT vec_id, max(k) FILTER (i = 0) AS first, max(k) FILTER (i = 4) AS last FROM c GROUP BY 1)
       SELECT vec_id, CAST(k - first AS INTEGER) AS pos, round(CAST(embedding[k + 1] AS DOUBLE), 6) AS value
       FROM embeddings JOIN e USING (vec_id), range(64) r(k) WHERE k >= first AND k < last""",
)
def _(t):
    return _steps(t, extract_peaks(F.col("embedding"), 4, 0.5), digits=6)


@query(
    "io_series",
    "K8",
    """SELECT vec_id, CAST(k AS INTEGER) AS "index", round(CAST(embedding[k + 4] AS DOUBLE), 6) AS in_1, round(CAST(embedding[k + 4] AS DOUBLE) * 2, 6) AS in_2,
       round(CAST(embedding[k + 4] AS DOUBLE) - 1, 6) AS label FROM embeddings, range(40) r(k)""",
)
def _(t):
    v = F.col("embedding").cast("array<double>")
    rows = t.embeddings.select(
        "vec_id", F.struct(v.alias("a"), F.transform(v, lambda x: x * 2).alias("b")).alias("in"), F.transform(v, lambda x: x - 1).alias("out")
    )
    return rounded(series.io_series(rows, "vec_id", ["in.a", "in.b"], "out", drop_left=3, length=40))


@query(
    "series_errors",
    "K9",
    """WITH e AS (SELECT vec_id, label, k, abs(CAST(embedding[k + 1] AS DOUBLE)) AS v FROM embeddings, range(64) r(k)),
       r AS (SELECT vec_id, avg(v) FILTER (k >= 54) AS e, sqrt(avg(v * v) FILTER (k >= 54) / nullif(label, 0)) AS r FROM e GROUP BY vec_id, label)
       SELECT round(avg(e), 7) AS mean_error, round(avg(r), 7) AS mean_rnmse FROM r""",
)
def _(t):
    v = F.transform(F.col("embedding").cast("array<double>"), F.abs)
    rows = t.embeddings.select(v.alias("e"), F.transform(v, lambda x: x * x).alias("s"), F.col("label").cast("double").alias("var"))
    return rounded(series.series_errors(rows, "e", "s", "var", 10), 7)


@query(
    "segments_to_arrays",
    "K10",
    """WITH o AS (SELECT user_id, event_id, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k,
                  count(*) OVER (PARTITION BY user_id) AS n FROM events),
       g AS (SELECT user_id, s AS segment_id, event_id, value, k, event_type FROM o CROSS JOIN range((SELECT max(n) FROM o)) r(s) WHERE s * 10 <= k AND k < s * 10 + 10 AND s * 10 + 10 <= n)
       SELECT user_id, segment_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY k) AS ids, round(sum(value), 4) AS total, min(event_type) AS event_type FROM g GROUP BY 1, 2""",
)
def _(t):
    rows = t.events.select("user_id", "event_id", "ts", "value", "event_type")
    cut = ordered.segments(rows, ["user_id"], ["ts", "event_id"], 10, 10)
    packed = series.segments_to_arrays(cut.withColumnRenamed("event_id", "id"), ["user_id", "segment_id"], ["ts", "id"], ["value"], "event_type", ["id"])
    total = F.aggregate("value", F.lit(0.0), lambda a, x: a + x)
    return rounded(packed.select("user_id", "segment_id", F.array_join(F.col("id").cast("array<string>"), ",").alias("ids"), total.alias("total"), "event_type"), 4)


@query(
    "string_utils",
    "K11",
    """SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_]', '_', 'g') AS name, lower(trim(url)) AS low, split_part(url, '/', 3) AS host,
       replace(url, 'http', 'HTTP') AS loud FROM pages""",
)
def _(t):
    url = F.col("url")
    return t.pages.select(
        "page_id",
        item_name(url).alias("name"),
        F.lower(F.trim(url)).alias("low"),
        F.split(url, "/")[2].alias("host"),
        F.replace(url, F.lit("http"), F.lit("HTTP")).alias("loud"),
    )


@query("filter_sort_docs", "K12", "SELECT doc_id, source, n_chars FROM documents WHERE contains(lower(text), 'the ') ORDER BY n_chars DESC")
def _(t):
    return series.filter_sort(t.documents, "text", "The ", "n_chars", ascending=False).select("doc_id", "source", "n_chars")
