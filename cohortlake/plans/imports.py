"""Sources, sinks and field types."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlake.functions.parsing import FieldType, display
from cohortlake.operators import fieldtypes as ft
from cohortlake.operators import merge
from cohortlake.operators.cells import copy_dataset
from cohortlake.operators.criteria import Condition, all_ids, rows_by_ids, scan
from cohortlake.plans.catalog import query, rounded
from cohortlake.session import scratch_path
from cohortlake.sources import clinical, delimited, documents, matrices

# ---- sources and sinks


@query(
    "read_delimited",
    "A1 A14",
    """SELECT p_partkey, p_name, p_brand, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS p_type,
       CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part""",
)
def _(t):
    path = scratch_path(t.spark, "part-csv")
    delimited.export_delimited(t.part, path, ";")
    return delimited.read_delimited(t.spark, path, ";")


@query(
    "read_delimited_text",
    "A1",
    "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier",
)
def _(t):
    path = scratch_path(t.spark, "supplier-text")
    labels = ["s_suppkey", "s_name", "s_nationkey"]
    t.supplier.select(F.concat_ws("||", *[F.col(c).cast("string") for c in labels])).write.option("lineSep", "<-->").text(path)
    return delimited.read_delimited(t.spark, path, "||", eol="<-->", infer=False, labels=labels)


@query(
    "read_delimited_quoted",
    "A1",
    """SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role,
       '"' || text || '", ' || chr(10) || role AS said FROM conversations""",
)
def _(t):
    """Every text holds delimiters, quotes and line breaks, and its own line breaks too."""
    path = scratch_path(t.spark, "quoted-csv")
    said = F.concat(F.lit('"'), "text", F.lit('", \n'), "role")
    delimited.export_delimited(t.conversations.select("conv_id", "turn", "role", said.alias("said")), path, quote_text=True)
    return delimited.read_delimited(t.spark, path, infer=False, multi_line=True)


@query("repair_lines", "A2", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def _(t):
    path = scratch_path(t.spark, "broken-lines")
    c = t.customer
    head = F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name", F.lit(""))
    tail = F.concat_ws("|", F.col("c_nationkey").cast("string"), "c_mktsegment")
    whole = F.array(F.concat(head, tail))
    broken = F.when(F.col("c_mktsegment") == "BUILDING", F.array(head, tail)).when(
        F.col("c_mktsegment") == "MACHINERY", F.array(F.col("c_custkey").cast("string"), F.concat(F.lit("|"), "c_name"), F.concat(F.lit("|"), tail))
    )
    c.select(F.explode(F.coalesce(broken, whole))).write.text(path)
    items = delimited.repair_lines(t.spark, path, 4, "|", header=False)
    return items.select(
        F.col("items")[0].cast("bigint").alias("c_custkey"),
        F.col("items")[1].alias("c_name"),
        F.col("items")[2].cast("int").alias("c_nationkey"),
        F.col("items")[3].alias("c_mktsegment"),
    )


@query(
    "normalise_columns",
    "A3",
    """SELECT CAST(s_suppkey AS VARCHAR) AS supplier_key, s_name AS s_name_0, CAST(s_nationkey AS VARCHAR) AS s_name_1
       FROM supplier""",
)
def _(t):
    path = scratch_path(t.spark, "odd-names")
    odd = t.supplier.select(F.col("s_suppkey").alias("supplier key"), F.col("s_name").alias("s-name"), F.col("s_nationkey").alias("s.name"))
    delimited.export_delimited(odd, path)
    return delimited.read_delimited(t.spark, path, infer=False)


@query(
    "read_json_array",
    "A4",
    """SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal,
       CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS c_mktsegment FROM customer""",
)
def _(t):
    path = scratch_path(t.spark, "json-arrays")
    t.customer.select(F.to_json(F.array(F.struct("*")))).write.text(path)
    return documents.read_json_array(t.spark, path, one_document=False).select(*t.customer.columns)


@query(
    "read_json_document",
    "A4",
    """SELECT o_custkey, o_orderkey AS first, n, 'a "quoted" } ] \\ text' AS note FROM
         (SELECT o_custkey, min(o_orderkey) AS o_orderkey, count(*) AS n FROM orders GROUP BY 1)""",
)
def _(t):
    """One array per file, of objects with nested arrays, whose texts hold braces, quotes and backslashes."""
    path = scratch_path(t.spark, "json-documents")
    note = F.lit('a "quoted" } ] \\ text')
    per = t.orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("orders")).withColumn("note", note)
    part = F.floor(F.col("o_custkey") / 500).alias("part")
    per.groupBy(part).agg(F.to_json(F.collect_list(F.struct("o_custkey", "orders", "note"))).alias("v")).write.partitionBy("part").text(path)
    got = documents.read_json_array(t.spark, f"{path}/*", infer=False)
    return got.select(F.col("o_custkey").cast("bigint"), F.col("orders")[0]["o_orderkey"].cast("bigint").alias("first"), F.size("orders").cast("bigint").alias("n"), "note")


@query(
    "expand_file_column",
    "A5",
    "SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
)
def _(t):
    e = t.events
    files = e.select(F.col("event_id").alias("file_id"), F.col("props").alias("body"))
    out = documents.expand_file_column(e.select("event_id", "event_type", F.col("event_id").alias("file")), "file", files)
    return out.select("event_id", "event_type", F.variant_get("file", "$.k", "bigint").alias("k"))


@query(
    "expand_file_column_table",
    "A5",
    """SELECT conv_id, turn, role FROM conversations""",
)
def _(t):
    c = t.conversations
    files = c.select(
        F.concat_ws("-", "conv_id", "turn").alias("file_id"),
        F.concat(F.lit("turn\trole\n"), F.col("turn").cast("string"), F.lit("\t"), "role", F.lit("\n")).alias("body"),
    )
    out = documents.expand_file_column(c.select("conv_id", F.concat_ws("-", "conv_id", "turn").alias("file")), "file", files)
    return out.select(
        "conv_id",
        F.variant_get("file", "$[0].turn", "string").cast("bigint").alias("turn"),
        F.variant_get("file", "$[0].role", "string").alias("role"),
    )


@query(
    "merge_enum_on_reimport",
    "A6",
    """WITH o AS (SELECT c_mktsegment AS label, CAST(row_number() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS code
                  FROM (SELECT DISTINCT c_mktsegment FROM customer)),
       n AS (SELECT DISTINCT p_type AS label FROM part WHERE p_type NOT IN (SELECT label FROM o))
       SELECT code, label FROM o UNION ALL
       SELECT CAST((SELECT max(code) FROM o) + row_number() OVER (ORDER BY label) AS INTEGER), label FROM n""",
)
def _(t):
    old = ft.enum_codes(t.customer, "c_mktsegment")
    fresh = t.part.select(F.col("p_type").alias("label")).unionByName(t.customer.select(F.col("c_mktsegment").alias("label")))
    return ft.merge_enum(old, fresh)


@query(
    "read_with_mapping_file",
    "A7 A16",
    """SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS c_mktsegment, c_acctbal,
       CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer""",
)
def _(t):
    data, mapping = scratch_path(t.spark, "clinical-data"), scratch_path(t.spark, "clinical-mapping")
    categories = {"c_acctbal": "Account / Balance", "c_nationkey": "Account / Place"}
    clinical.export_clinical_pair(t.customer, data, mapping, "c_custkey", "c_mktsegment", categories)
    return clinical.read_with_mapping(t.spark, data, mapping)[0]


@query(
    "mapping_dictionary",
    "A7 A16",
    """SELECT * FROM (VALUES ('c_custkey', 'SUBJ_ID', ''), ('c_mktsegment', 'VISIT_NAME', ''),
       ('c_acctbal', 'c_acctbal', 'Account / Balance'), ('c_nationkey', 'c_nationkey', 'Account / Place'))
       AS v(field, label, category) WHERE (SELECT count(*) FROM customer) > 0""",
)
def _(t):
    data, mapping = scratch_path(t.spark, "clinical-data"), scratch_path(t.spark, "clinical-mapping")
    categories = {"c_acctbal": "Account / Balance", "c_nationkey": "Account / Place"}
    clinical.export_clinical_pair(t.customer, data, mapping, "c_custkey", "c_mktsegment", categories)
    return clinical.read_with_mapping(t.spark, data, mapping, infer=False)[1]


@query(
    "scan",
    "A8",
    """SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders
       WHERE o_totalprice > 100000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')
       ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 10""",
)
def _(t):
    return scan(
        t.orders,
        [Condition("o_totalprice", ">", 100000.0), Condition("o_orderpriority", "in", ["1-URGENT", "2-HIGH"])],
        [("o_totalprice", False), ("o_orderkey", True)],
        ["o_orderkey", "o_totalprice", "o_orderpriority"],
        limit=50,
        skip=10,
    )


@query(
    "get_by_ids",
    "A9",
    "SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
)
def _(t):
    return rows_by_ids(t.orders, "o_custkey", t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey")).select(*t.orders.columns)


@query(
    "get_except_ids",
    "A9",
    "SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
)
def _(t):
    ids = t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return rows_by_ids(t.orders, "o_custkey", ids, exclude=True).select(*t.orders.columns)


@query("all_ids", "A9", "SELECT p_partkey FROM part ORDER BY p_partkey")
def _(t):
    return all_ids(t.part, "p_partkey")


@query("save_derived", "A10", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def _(t):
    rows = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    saved = documents.save_derived(rows, scratch_path(t.spark, "derived"), ["o_orderstatus"])
    return saved.select("o_orderkey", "o_totalprice", F.col("o_orderstatus").cast("string").alias("o_orderstatus"))


UPSERT_NEW = "SELECT s_suppkey AS k, s_name AS name, s_acctbal AS balance FROM supplier"
UPSERT_OLD = "SELECT c_custkey AS k, c_name AS name, c_acctbal AS balance FROM customer WHERE c_mktsegment <> 'MACHINERY'"


def _upsert_sides(t):
    old = t.customer.where("c_mktsegment <> 'MACHINERY'")
    old = old.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return old, t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))


@query(
    "upsert_by_key",
    "A11",
    f"WITH n AS ({UPSERT_NEW}), o AS ({UPSERT_OLD}) SELECT * FROM n UNION ALL SELECT * FROM o WHERE k NOT IN (SELECT k FROM n)",
)
def _(t):
    old, new = _upsert_sides(t)
    return merge.upsert_by_key(old, new, "k")


@query(
    "insert_new_keys",
    "A11",
    f"WITH n AS ({UPSERT_NEW}), o AS ({UPSERT_OLD}) SELECT * FROM o UNION ALL SELECT * FROM n WHERE k NOT IN (SELECT k FROM o)",
)
def _(t):
    old, new = _upsert_sides(t)
    return merge.upsert_by_key(old, new, "k", update_existing=False)


@query("retain_keys", "A12", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(t):
    kept = merge.retain_keys(t.documents.select("doc_id", "lang", "n_chars"), "doc_id", t.labels.where("quality = 1").select("doc_id"))
    return kept


@query("copy_delta", "A13", "SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return merge.copy_delta(t.documents.select("doc_id", "lang", "source"), t.labels, "doc_id")


@query(
    "export_delimited",
    "A14",
    """SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, replace(p_name, ' ', '_') AS p_name, replace(p_brand, '#', '') AS p_brand
       FROM part""",
)
def _(t):
    path = scratch_path(t.spark, "export")
    rows = t.part.select("p_partkey", "p_name", "p_brand")
    delimited.export_delimited(rows, path, "\t", replacements=[(" ", "_"), ("#", "")], quote_text=True, order=["p_partkey"])
    return t.spark.read.options(sep="\t", header=True).schema("p_partkey string, p_name string, p_brand string").csv(path)


@query("export_json", "A15", "SELECT event_id, event_type, value FROM events")
def _(t):
    path = scratch_path(t.spark, "export-json")
    documents_rows = t.events.select("event_id", "event_type", "value")
    delimited.export_json(documents_rows, path)
    return t.spark.read.schema(documents_rows.schema).json(path)


@query(
    "export_many",
    "A17 A20",
    """SELECT 'customer' AS source, CAST(count(*) AS BIGINT) AS rows FROM customer
       UNION ALL SELECT 'supplier', CAST(count(*) AS BIGINT) FROM supplier UNION ALL SELECT 'part', CAST(count(*) AS BIGINT) FROM part""",
)
def _(t):
    folder = scratch_path(t.spark, "export-many")
    delimited.export_many({n: getattr(t, n) for n in ("customer", "supplier", "part")}, folder)
    text = t.spark.read.option("header", True).option("recursiveFileLookup", True).csv(folder)
    name = F.regexp_extract("_metadata.file_path", r"/([a-z]+)/[^/]+$", 1)
    return text.select(name.alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "read_folder",
    "A20",
    """SELECT s_nationkey AS source, CAST(s_suppkey AS BIGINT) AS s_suppkey, s_acctbal FROM supplier""",
)
def _(t):
    folder = scratch_path(t.spark, "folder")
    rows = t.supplier.select("s_suppkey", "s_acctbal", "s_nationkey")
    rows.write.partitionBy("s_nationkey").option("header", True).csv(folder)
    out = delimited.read_folder(t.spark, folder, pattern="*/*.csv", source=r"s_nationkey=([0-9]+)/")
    return out.select(F.col("source").cast("int").alias("source"), "s_suppkey", "s_acctbal")


@query(
    "matrix_io",
    "A18",
    """SELECT o_orderpriority AS i, 'price.' || o_orderstatus AS j, max(o_totalprice) AS value FROM orders GROUP BY ALL""",
)
def _(t):
    path = scratch_path(t.spark, "matrix")
    long = t.orders.groupBy(F.col("o_orderpriority").alias("i"), F.concat(F.lit("price."), "o_orderstatus").alias("j")).agg(
        F.max("o_totalprice").alias("value")
    )
    matrices.save_matrix(long, path, ["price.F", "price.O", "price.P"])
    return matrices.load_matrix(t.spark, path)


# ---- field types


@query(
    "parse_display",
    "B1",
    "SELECT event_id, ts, value, event_type FROM (SELECT event_id, date_trunc('second', ts) AS ts, value, event_type FROM events)",
)
def _(t):
    e = t.events
    text = e.select(
        F.concat(F.lit(" "), F.col("event_id").cast("string")).alias("event_id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
        F.col("value").cast("string").alias("value"),
        "event_type",
    )
    kinds = {"event_id": "integer", "ts": "date", "value": "double", "event_type": "string"}
    out = ft.retype(text, {c: FieldType(k) for c, k in kinds.items()})
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _types_sql(table: str, rows: list[tuple[str, str, str, str]]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{f}' AS field, {kind} AS type, {arr} AS is_array, {labels} AS labels FROM {table}""" for f, kind, arr, labels in rows
    )


def _enum_sql(c: str) -> tuple[str, str, str, str]:
    small = f"(count(DISTINCT {c}) <= 20 AND 1.5 * count(DISTINCT {c}) <= count({c}))"
    labels = f"CASE WHEN {small} THEN array_to_string(list_sort(list(DISTINCT CAST({c} AS VARCHAR))), '|') ELSE '' END"
    return c, f"CASE WHEN {small} THEN 'enum' ELSE 'string' END", "false", labels


def _number_sql(c: str) -> tuple[str, str, str, str]:
    text = f"CAST({c} AS VARCHAR)"
    kind = (
        f"CASE WHEN bool_and({text} IN ('0', '1')) THEN 'boolean' WHEN bool_and(regexp_full_match({text}, '[+-]?[0-9]+')) "
        f"THEN 'integer' WHEN bool_and(TRY_CAST({text} AS DOUBLE) IS NOT NULL) THEN 'double' ELSE 'string' END"
    )
    return c, kind, "false", "''"


@query(
    "infer_types",
    "B2 B4",
    _types_sql("part", [_number_sql("p_partkey"), _enum_sql("p_name"), _enum_sql("p_brand"), _enum_sql("p_type"), _number_sql("p_size"), _number_sql("p_retailprice")]),
)
def _(t):
    return ft.type_report(t.part, ft.infer_types(t.part))


@query(
    "infer_types_events",
    "B2",
    _types_sql(
        "events",
        [
            _number_sql("event_id"),
            ("ts", "CASE WHEN count(ts) > 0 THEN 'date' ELSE 'null' END", "false", "''"),
            _number_sql("user_id"),
            _enum_sql("event_type"),
            _number_sql("value"),
            ("props", "CASE WHEN bool_and(json_valid(props)) THEN 'json' ELSE 'string' END", "false", "''"),
        ],
    ),
)
def _(t):
    return ft.type_report(t.events, ft.infer_types(t.events))


@query(
    "infer_array_types",
    "B2",
    """SELECT 'members' AS field, 'integer' AS type, true AS is_array, '' AS labels
       UNION ALL SELECT 'states', 'enum', true, (SELECT string_agg(DISTINCT v, '|' ORDER BY v) FROM
       (SELECT o_orderstatus AS v FROM orders UNION ALL SELECT o_orderpriority FROM orders
        UNION ALL SELECT 'M' || month(o_orderdate) FROM orders))""",
)
def _(t):
    rows = t.orders.select(
        F.concat_ws(", ", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.lit("na")).alias("members"),
        F.concat_ws(",", "o_orderstatus", "o_orderpriority", F.concat(F.lit("M"), F.month("o_orderdate"))).alias("states"),
    )
    return ft.type_report(rows, ft.infer_types(rows))


@query(
    "to_display",
    "B3",
    """SELECT o_orderkey, CAST(round(CAST(o_totalprice AS DECIMAL(18,2)), 1) AS VARCHAR) AS price,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS ordered, CASE WHEN o_totalprice > 200000 THEN 'big' ELSE 'small' END AS size,
       o_orderstatus AS status FROM orders""",
)
def _(t):
    code = FieldType("enum", enum_values=("F", "O", "P"))
    return t.orders.select(
        "o_orderkey",
        display(F.col("o_totalprice"), FieldType("double", decimals=1)).alias("price"),
        display(F.col("o_orderdate"), FieldType("date")).alias("ordered"),
        display(F.col("o_totalprice") > 200000, FieldType("boolean", true_label="big", false_label="small")).alias("size"),
        display(F.array_position(F.array(*map(F.lit, code.enum_values)), F.col("o_orderstatus")).cast("int") - 1, code).alias("status"),
    )


@query(
    "infer_enum",
    "B4",
    """SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS code, count FROM
       (SELECT c_mktsegment AS label, count(*) AS count FROM customer GROUP BY 1)
       WHERE (SELECT count(DISTINCT c_mktsegment) <= 20 AND 1.5 * count(DISTINCT c_mktsegment) <= count(*) FROM customer)""",
)
def _(t):
    return ft.infer_enum(t.customer, "c_mktsegment")


@query(
    "reinfer_dataset",
    "B5",
    """SELECT o_orderkey, o_custkey, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS o_orderstatus, o_totalprice,
       o_orderdate, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS o_orderpriority FROM orders""",
)
def _(t):
    out = ft.reinfer_dataset(t.orders)
    return out.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


@query(
    "change_types",
    "B6",
    """SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, CAST(p_retailprice AS VARCHAR) AS p_retailprice,
       CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS p_type FROM part""",
)
def _(t):
    labels = tuple(r["label"] for r in ft.enum_codes(t.part, "p_type").orderBy("code").collect())
    kinds = {"p_size": FieldType("double"), "p_retailprice": FieldType("string"), "p_type": FieldType("enum", enum_values=labels)}
    return ft.change_types(t.part.select("p_partkey", "p_size", "p_retailprice", "p_type"), kinds)


@query(
    "change_enum_labels",
    "B7",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'first' ELSE o_orderpriority END AS o_orderpriority FROM orders""",
)
def _(t):
    changes = [("o_orderstatus", "F", "done"), ("o_orderstatus", "O", "open"), ("o_orderpriority", "1-URGENT", "first"), ("o_orderpriority", "2-HIGH", "first")]
    return ft.change_enum_labels(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), changes)


@query(
    "translate",
    "B9",
    """SELECT c.c_custkey, CAST(dense_rank() OVER (ORDER BY coalesce(r.r_name, c.c_mktsegment)) - 1 AS INTEGER) AS c_mktsegment
       FROM customer c LEFT JOIN (VALUES (0, 'BUILDING'), (1, 'MACHINERY'), (2, 'FURNITURE')) m(rk, seg) ON c.c_mktsegment = m.seg
       LEFT JOIN region r ON r.r_regionkey = m.rk""",
)
def _(t):
    code = F.element_at(F.create_map(F.lit(0), F.lit("BUILDING"), F.lit(1), F.lit("MACHINERY"), F.lit(2), F.lit("FURNITURE")), F.col("r_regionkey"))
    words = t.region.where("r_regionkey < 3").select(code.alias("from"), F.col("r_name").alias("to"))
    rows = t.customer.select("c_custkey", "c_mktsegment", F.lit("na").alias("never"))
    return ft.translate(rows, ["c_mktsegment"], words)


@query(
    "to_double",
    "B10",
    """SELECT event_id, CAST(user_id AS DOUBLE) AS user_id, CAST(epoch_us(ts) // 1000 AS DOUBLE) AS ts, value,
       CAST(NULL AS DOUBLE) AS event_type FROM events""",
)
def _(t):
    return ft.to_doubles(t.events.drop("props"), ["user_id", "ts", "value", "event_type"])


@query("array_head_to_double", "B10", "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS embedding FROM embeddings")
def _(t):
    return rounded(ft.to_doubles(t.embeddings.select("vec_id", "embedding"), ["embedding"]))


@query(
    "concept_enum_map",
    "B13",
    "SELECT c_custkey, c_nationkey, n_name AS c_nationkey_label FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
)
def _(t):
    return ft.concept_enum_map(t.customer.select("c_custkey", "c_nationkey"), "c_nationkey", t.nation, "n_nationkey", "n_name")


@query("copy_dataset", "C5", "SELECT * FROM supplier")
def _(t):
    return copy_dataset(t.supplier, scratch_path(t.spark, "copy"))
