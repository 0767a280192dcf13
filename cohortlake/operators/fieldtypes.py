"""Field types: inference, re-typing, enum codes, translation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlake.functions.common import require, to_double
from cohortlake.functions.parsing import (
    ARRAY_DELIMITER,
    MAX_ENUM_VALUES,
    MIN_AVG_VALUES_PER_ENUM,
    FieldType,
    clean_text,
    display,
    parse,
    try_parse,
)
from cohortlake.operators.scan import global_index

# Fixed order in which the types are tried; the first that accepts every value wins.
# Enum and its array form come between the static types and plain text.
STATIC_PRIORITY = (
    ("null", False),
    ("null", True),
    ("boolean", False),
    ("integer", False),
    ("double", False),
    ("date", False),
    ("json", False),
    ("boolean", True),
    ("integer", True),
    ("double", True),
    ("date", True),
    ("json", True),
)
SCALARS = ("null", "boolean", "integer", "double", "date", "json")
SMALL = 1000  # columns with more distinct values (by the sketch) are no enum candidates


def _text_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns])


def _value_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, part, text): part 0 a plain value, 1 a value with a delimiter, 2 an item of such a value."""

    pairs = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]
    value = F.col("value")

    def row(part: int, text):
        return F.struct(F.lit(part).alias("part"), clean_text(text).alias("text"))

    items = F.transform(F.split(clean_text(value), ARRAY_DELIMITER), lambda x: row(2, x))
    many = F.contains(value, F.lit(ARRAY_DELIMITER))
    rows = F.when(many, F.concat(F.array(row(1, value)), items)).otherwise(F.array(row(0, value)))
    return df.select(F.inline(F.array(*pairs))).select("column", F.inline(rows))


def infer_types(
    df: DataFrame,
    columns: list[str] | None = None,
    max_enum_values: int = MAX_ENUM_VALUES,
    min_avg_per_enum: float = MIN_AVG_VALUES_PER_ENUM,
    boolean_numbers: bool = True,
) -> dict[str, FieldType]:
    """Type per column from all its values, in one aggregate over (column, value) rows.

    The rows are combined on the map side into one flag per column and type, so thousands of
    columns shuffle thousands of small rows. The exact value counts an enum needs are taken
    afterwards, only for columns a distinct-count sketch shows to be small.
    """
    columns = columns or df.columns
    require(df, columns)
    kinds = [FieldType(k, boolean_numbers=boolean_numbers) for k in SCALARS]
    rows = _value_rows(df, columns)
    tested = rows.select("*", *[(F.col("text").isNull() | try_parse(F.col("text"), t).isNotNull()).alias(t.kind) for t in kinds])
    plain, item = F.col("part") < 2, F.col("part") != 1
    flags = [F.bool_and(F.col(k) | ~plain).alias(f"{k}_False") for k in SCALARS]
    flags += [F.bool_and(F.col(k) | ~item).alias(f"{k}_True") for k in SCALARS]
    sketches = [F.approx_count_distinct(F.when(plain, F.col("text"))).alias("values"), F.approx_count_distinct(F.when(item, F.col("text"))).alias("items")]
    verdicts = {r["column"]: r for r in tested.groupBy("column").agg(*flags, *sketches).collect()}  # one row per column
    found, open_columns = {}, []
    for c in columns:
        row = verdicts.get(c)
        hit = next(((k, a) for k, a in STATIC_PRIORITY if row is None or row[f"{k}_{a}"]), None)
        if hit:
            found[c] = FieldType(*hit, boolean_numbers=boolean_numbers)
        elif min(row["values"], row["items"]) <= SMALL * max(1, max_enum_values // MAX_ENUM_VALUES):
            open_columns.append(c)
        else:
            found[c] = FieldType("string")
    if open_columns:
        labels = _enum_labels(df, open_columns, max_enum_values, min_avg_per_enum)
        for c in open_columns:
            one, many = labels.get((c, False)), labels.get((c, True))
            found[c] = FieldType("enum", False, one) if one else FieldType("enum", True, many) if many else FieldType("string")
    return {c: found[c] for c in columns}


def _enum_labels(df: DataFrame, columns: list[str], max_values: int, min_avg: float) -> dict[tuple[str, bool], tuple[str, ...]]:
    """Sorted labels of the columns that qualify as an enum (False) or an enum array (True)."""
    counts = (
        _value_rows(df, columns).where("text IS NOT NULL").groupBy("column", "part", "text").agg(F.count(F.lit(1)).alias("n"))
    )
    forms = F.array_compact(F.array(F.when(F.col("part") < 2, F.lit(False)), F.when(F.col("part") != 1, F.lit(True))))
    per_value = counts.select("column", F.explode(forms).alias("array"), "text", "n").groupBy("column", "array", "text").agg(F.sum("n").alias("n"))
    sizes = per_value.groupBy("column", "array").agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("n"))
    fitting = sizes.where((F.col("distinct") <= max_values) & (F.col("distinct") * F.lit(min_avg) <= F.col("n")))
    # at most max_values labels per column reach the driver
    rows = (
        per_value.join(fitting.select("column", "array"), ["column", "array"], "left_semi")
        .groupBy("column", "array")
        .agg(F.array_sort(F.collect_list("text")).alias("labels"))
        .collect()
    )
    return {(r["column"], r["array"]): tuple(r["labels"]) for r in rows}


def type_report(df: DataFrame, types: dict[str, FieldType]) -> DataFrame:
    """Dictionary of a data set as a table: column, type, array flag, enum labels."""
    return df.sparkSession.createDataFrame(
        [(c, t.kind, t.is_array, "|".join(t.enum_values)) for c, t in types.items()],
        "field string, type string, is_array boolean, labels string",
    )


def retype(df: DataFrame, types: dict[str, FieldType], strict: bool = True) -> DataFrame:
    """Parse the listed text columns; the dictionary goes into the column metadata."""
    require(df, list(types))
    out = []
    for c in df.columns:
        col = F.col(f"`{c}`")
        if c not in types:
            out.append(col)
            continue
        t = types[c]
        meta = {"type": t.kind, "isArray": t.is_array, "enumValues": list(t.enum_values)}
        out.append(parse(col.cast("string"), t, strict, c).alias(c, metadata=meta))
    return df.select(*out)


def reinfer_dataset(df: DataFrame, **options) -> DataFrame:
    """Infer every column again from its text and re-parse."""
    text = _text_columns(df, df.columns)
    return retype(text, infer_types(text, **options))


def change_types(df: DataFrame, types: dict[str, FieldType], current: dict[str, FieldType] | None = None) -> DataFrame:
    """Re-parse the given fields through their display text."""
    current = current or {}
    shown = {c: display(F.col(f"`{c}`"), current[c]) if c in current else F.col(f"`{c}`").cast("string") for c in types}
    return retype(df.withColumns(shown), types)


def enum_codes(df: DataFrame, column: str) -> DataFrame:
    """(label, code) with labels sorted and codes from 0."""
    labels = df.select(clean_text(F.col(column).cast("string")).alias("label")).where("label IS NOT NULL").distinct()
    return global_index(labels, ["label"], "code").select("label", F.col("code").cast("int").alias("code"))


def infer_enum(
    df: DataFrame, column: str, max_values: int = MAX_ENUM_VALUES, min_avg: float = MIN_AVG_VALUES_PER_ENUM
) -> DataFrame:
    """(label, code, count) if the text column qualifies as an enum, else no rows."""
    counts = (
        df.select(clean_text(F.col(column).cast("string")).alias("label"))
        .where("label IS NOT NULL")
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    verdict = counts.agg(
        ((F.count(F.lit(1)) <= max_values) & (F.count(F.lit(1)) * F.lit(min_avg) <= F.sum("count"))).alias("ok")
    ).scalar()
    # filtered first, so the unpartitioned window sees at most max_values rows
    return counts.where(verdict).select(
        "label", (F.row_number().over(W.orderBy("label")) - 1).cast("int").alias("code"), "count"
    )


def encode_enum(df: DataFrame, column: str, t: FieldType, strict: bool = True) -> DataFrame:
    return retype(df, {column: t}, strict)


def change_enum_labels(df: DataFrame, changes: list[tuple[str, str, str]]) -> DataFrame:
    """Relabel values by (field, from, to); two labels mapped to one are merged."""
    by_field: dict[str, dict[str, str]] = {}
    for name, old, new in changes:
        by_field.setdefault(name, {})[old] = new
    require(df, list(by_field))
    out = {}
    for name, mapping in by_field.items():
        table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
        out[name] = F.coalesce(F.try_element_at(table, F.col(name)), F.col(name))
    return df.withColumns(out)


def merge_enum(old: DataFrame, new_labels: DataFrame) -> DataFrame:
    """Extend an enum (code, label): new labels, sorted, get the codes after the largest old one."""
    fresh = new_labels.select("label").where("label IS NOT NULL").distinct().join(old, "label", "left_anti")
    top = old.agg(F.coalesce(F.max("code"), F.lit(-1)).alias("m")).scalar()
    added = global_index(fresh, ["label"], "at").select((top + F.col("at") + 1).cast("int").alias("code"), "label")
    return old.select("code", "label").unionByName(added)


def translate(df: DataFrame, columns: list[str], translations: DataFrame, reinfer: bool = True) -> DataFrame:
    """Map texts of the columns through (from, to), drop all-null columns and empty rows, re-infer."""
    require(df, columns)
    out = df
    for i, c in enumerate(columns):
        one = translations.select(F.col("from").alias(f"_f{i}"), F.col("to").alias(f"_t{i}"))
        out = out.join(one, out[c].cast("string") == F.col(f"_f{i}"), "left")
        out = out.withColumn(c, F.coalesce(f"_t{i}", F.col(c).cast("string"))).drop(f"_f{i}", f"_t{i}")
    cleaned = out.select(*[clean_text(F.col(c).cast("string")).alias(c) for c in out.columns])
    used = cleaned.agg(*[F.count(c).alias(c) for c in cleaned.columns]).first()
    kept = cleaned.select(*[c for c in cleaned.columns if used[c] > 0])
    kept = kept.where(F.coalesce(*kept.columns).isNotNull())
    return retype(kept, infer_types(kept, boolean_numbers=False)) if reinfer else kept


def to_doubles(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: to_double(df, c) for c in columns})


def concept_enum_map(df: DataFrame, code: str, concepts: DataFrame, concept_id: str, label: str) -> DataFrame:
    """Attach the concept label to a code column; a code without a concept is an error."""
    lookup = concepts.select(F.col(concept_id).alias("_id"), F.col(label).alias(f"{code}_label"), F.lit(True).alias("_hit"))
    joined = df.join(lookup, F.col(code) == F.col("_id"), "left")
    checked = F.when(
        F.col(code).isNotNull() & F.col("_hit").isNull(),
        F.raise_error(F.concat(F.lit(f"{code}: unknown concept "), F.col(code).cast("string"))).cast("string"),
    ).otherwise(F.col(f"{code}_label"))
    return joined.withColumn(f"{code}_label", checked).drop("_id", "_hit")
