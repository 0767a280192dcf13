"""Delimited files: reading, line repair, export, folders."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.functions.parsing import FieldType, display
from cohortlake.operators.fieldtypes import infer_types, retype
from cohortlake.session import settle
from cohortlake.sources.pieces import quoted_lines

# The name of a column without one and the longest name accepted.
EMPTY_NAME = "_empty_"
MAX_NAME_LENGTH = 100


def column_names(labels: list[str | None]) -> list[tuple[str, str]]:
    """(name, label) of header items: trimmed, unquoted, safe characters, made unique by an index."""
    pairs = []
    for raw in labels:
        label = (raw or "").strip().replace('"', "") or EMPTY_NAME
        if len(label) > MAX_NAME_LENGTH:
            raise ValueError(f"column name too long: {label}")
        pairs.append((re.sub(r"[^A-Za-z0-9_]", "_", label), label))
    names = [n for n, _ in pairs]
    seen: dict[str, int] = {}
    out = []
    for name, label in pairs:
        if names.count(name) > 1:
            k = seen[name] = seen.get(name, -1) + 1
            out.append((f"{name}_{k}", f"{label} {k}"))
        else:
            out.append((name, label))
    return out


def _options(delimiter, charset, quote, eol, multi_line):
    options = {"sep": delimiter, "encoding": charset, "quote": quote, "multiLine": multi_line, "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
    if quote:
        options["escape"] = quote
    if eol:
        options["lineSep"] = eol
    return options


def _schema(pairs: list[tuple[str, str]]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType(), True, {"label": label}) for n, label in pairs])


def _cells(spark: SparkSession, line: str, options: dict) -> list[str | None]:
    """The items of one line."""
    shape = spark.range(1).select(F.schema_of_csv(F.lit(line), options)).first()[0]
    names = re.findall(r"_c\d+(?=:)", shape)
    return list(spark.range(1).select(F.from_csv(F.lit(line), ", ".join(f"{n} string" for n in names), options).alias("c")).first()["c"])


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    delimiter: str = ",",
    quote: str = '"',
    charset: str = "UTF-8",
    eol: str | None = None,
    infer: bool = True,
    multi_line: bool = False,
    labels: list[str] | None = None,
    **inference,
) -> DataFrame:
    """Text table with a header; all columns as text, then typed from their values if asked.

    ``labels`` names the columns of files without a header.

    A large file is split between tasks, with ``multi_line`` too: quoted fields may then hold line
    breaks, and a scan of the quotes finds the lines that end a row (see ``pieces``). Only charsets other than UTF-8 are
    then read by one task per file. A row separator of more than two characters is split as text.
    """
    if eol and len(eol) > 2:
        raw = spark.read.option("lineSep", eol).text(path).withColumns(
            {"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_at": F.monotonically_increasing_id()}
        )
        items = F.split("value", "\\Q" + delimiter + "\\E", -1)
        header = labels or raw.select(items.alias("h")).first()["h"]
        pairs = column_names(header)
        # only the first line of a file is its header: a later row may have the same text
        first = raw.where("_block = 0").groupBy("_file").agg(F.min("_at").alias("_head"))
        body = raw if labels else raw.join(first, "_file", "left").where("_block > 0 OR _at > _head")
        text = body.select(*[F.trim(F.get(items, F.lit(k))).alias(n, metadata={"label": lab}) for k, (n, lab) in enumerate(pairs)])
    elif multi_line and quote and charset.upper().replace("-", "") == "UTF8":
        rows = quoted_lines(spark, path, delimiter, quote, eol or "\n")
        rows = rows.withColumn("text", F.regexp_replace(F.regexp_replace("text", "\r$", ""), "\r\n", "\n")).where(F.trim("text") != "")
        options = {k: str(v) for k, v in _options(delimiter, charset, quote, None, True).items()}
        if labels:
            pairs = column_names(labels)
        else:
            first = rows.groupBy("file").agg(F.min(F.struct("row", "text")).alias("h"))
            first = settle(first.select(F.col("file").alias("_file"), F.col("h.row").alias("_head"), F.col("h.text").alias("head")), "headers")
            head = [r["head"] for r in first.orderBy("_file").select("head").limit(1).collect()]  # the first file's
            pairs = column_names(_cells(spark, head[0], options)) if head else []
            rows = rows.join(first.drop("head"), F.col("file") == F.col("_file")).where(F.col("row") > F.col("_head"))
        names = ", ".join(f"`{n}` string" for n, _ in pairs)
        read = rows.select(F.from_csv("text", names, options).alias("c")) if pairs else rows.select(F.struct().alias("c"))
        text = read.select(*[F.col(f"c.`{n}`").alias(n, metadata={"label": label}) for n, label in pairs])
    else:
        options = _options(delimiter, charset, quote, eol, multi_line)
        header = [labels] if labels else spark.read.options(**options).csv(path).limit(1).collect()
        pairs = column_names(list(header[0])) if header else []
        text = spark.read.options(**options, header=not labels).schema(_schema(pairs)).csv(path)
    return retype(text, infer_types(text, **inference)) if infer else text


FILE_NAME = r"([^/]+?)(\.[A-Za-z]+)?$"


def read_folder(
    spark: SparkSession, folder: str, delimiter: str = ",", pattern: str = "*.csv", infer: bool = True, source: str = FILE_NAME
) -> DataFrame:
    """All files of a folder; ``source`` is the file name, or the part of the path the given pattern
    captures. Write the result partitioned by source.

    Files whose headers differ are read by their own column names and put together by name, so the order of
    columns may change from file to file and columns a file lacks are null."""
    path = f"{folder.rstrip('/')}/{pattern}"
    files: dict[str, list[str]] = {}
    for row in _first_lines(spark, path).collect():  # a row per file
        files.setdefault(row["head"], []).append(unquote(row["file"]))
    groups = [path] if len(files) < 2 else [files[h] for h in sorted(files)]
    parts = [read_delimited(spark, g, delimiter, infer=False).withColumn("source", F.regexp_extract("_metadata.file_path", source, 1)) for g in groups]
    named = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    named = named.select(*[c for c in named.columns if c != "source"], "source")
    return retype(named, infer_types(named.drop("source"))) if infer else named


def _first_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, head): the first line of every file."""
    lines = spark.read.text(path).select(
        F.col("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")
    )
    return lines.where("block = 0").groupBy("file").agg(F.min_by("value", "at").alias("head"))


def repair_lines(
    spark: SparkSession, path: str, columns: int, delimiter: str = ",", header: bool = True, strict: bool = True
) -> DataFrame:
    """Rows broken over several lines, put together: one array ``items`` per row.

    A line with too few items is joined with the following ones. Every row has ``columns`` - 1
    delimiters, so a running count of delimiters tells which row a line belongs to; the count is
    kept per file block and one number per block is carried to the next. A line that overflows
    its row is an error (or a row with ``overflow`` set).
    """
    lines = spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    if header:
        # the first line of a file is the first one of its first block
        first = lines.where("block = 0").groupBy("file").agg(F.min("at").alias("_head"))
        lines = lines.join(first, "file", "left").where("block > 0 OR at > _head").drop("_head")
    marks = lines.withColumn("marks", (F.size(F.split("line", "\\Q" + delimiter + "\\E", -1)) - 1).cast("long"))
    per_block = marks.groupBy("file", "block").agg(F.sum("marks").alias("n"))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_block.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = W.partitionBy("file", "block").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    placed = marks.withColumn("before", F.coalesce(F.sum("marks").over(inside), F.lit(0))).join(offsets, ["file", "block"])
    before = F.col("before") + F.col("offset")
    if columns > 1:
        width = F.lit(columns - 1)
        row, overflow = F.floor(before / width), before % width + F.col("marks") > width
        row = F.struct(row.alias("r"))
    else:
        row, overflow = F.struct(F.col("block"), F.col("at")), F.col("marks") > 0
    placed = placed.withColumns({"row": row, "overflow": overflow})
    if strict:
        bad = F.raise_error(F.concat(F.lit("too many items in line: "), "line")).cast("boolean")
        placed = placed.withColumn("overflow", F.when(F.col("overflow"), bad).otherwise(False))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "line"))), lambda p: p["line"])
    rows = placed.groupBy("file", "row").agg(F.array_join(pieces, "").alias("text"), F.bool_or("overflow").alias("overflow"))
    items = F.transform(F.split("text", "\\Q" + delimiter + "\\E", -1), lambda x: F.trim(x))
    out = rows.select(items.alias("items"), "overflow")
    # an unfinished last row is left out
    return out.where((F.size("items") == columns) | F.col("overflow"))


def display_columns(df: DataFrame, types: dict[str, FieldType]) -> DataFrame:
    """Typed columns as their display text."""
    return df.withColumns({c: display(F.col(f"`{c}`"), t) for c, t in types.items()})


def export_delimited(
    df: DataFrame,
    path: str,
    delimiter: str = ",",
    eol: str = "\n",
    replacements: list[tuple[str, str]] = (),
    types: dict[str, FieldType] | None = None,
    quote_text: bool = False,
    order: list[str] = (),
) -> None:
    """CSV with a header: display values if types are given, literal replacements, text quoted on request."""
    out = display_columns(df, types) if types else df
    text = [c for c, t in out.dtypes if t == "string"]
    for old, new in replacements:
        out = out.withColumns({c: F.replace(F.col(f"`{c}`"), F.lit(old), F.lit(new)) for c in text})
    if order:
        out = out.orderBy(*order)
    options = {"sep": delimiter, "lineSep": eol, "header": True, "quoteAll": quote_text, "escape": '"', "emptyValue": ""}
    out.write.options(**options).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def export_many(data_sets: dict[str, DataFrame], folder: str, delimiter: str = ",") -> dict[str, str]:
    """Every data set as CSV with its columns sorted by name; returns the paths."""
    paths = {}
    for name, df in data_sets.items():
        paths[name] = f"{folder.rstrip('/')}/{name}"
        export_delimited(df.select(*sorted(df.columns)), paths[name], delimiter)
    return paths
