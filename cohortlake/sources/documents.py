"""JSON files, file columns, derived data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.operators.fieldtypes import infer_types, retype
from cohortlake.session import scratch_path
from cohortlake.sources.pieces import json_objects


def read_json_array(
    spark: SparkSession, path: str, charset: str = "UTF-8", infer: bool = True, one_document: bool = True
) -> DataFrame:
    """JSON arrays of objects; the union of the keys, typed from their values.

    With ``one_document`` each file is one array or object. A file is cut at its closing braces and read by
    many tasks (see ``pieces``); its objects go to the shared folder, one per line, from where they are typed. Other
    charsets than UTF-8 are read by one task per file. A file that ends inside an object is an error.
    Without ``one_document`` every line is an object or array.
    """
    if one_document and charset.upper().replace("-", "") == "UTF8":
        found = json_objects(spark, path)
        lines = scratch_path(spark, "json-objects")
        object_ = F.concat(F.regexp_replace("text", "^[\\s\ufeff\\[,]+", ""), F.lit("}"))
        broken = F.raise_error(F.concat(F.lit("unfinished JSON in "), "file")).cast("string")
        whole = F.when(~F.col("sound"), broken).when(F.col("done"), F.translate(object_, "\r\n", "  "))
        found.select(whole.alias("value")).where("value is not null").write.text(lines)
        path, one_document = lines, False
    text = spark.read.options(multiLine=one_document, primitivesAsString=True, encoding=charset).json(path)
    plain = [c for c, t in text.dtypes if t == "string"]
    return retype(text, infer_types(text, plain)) if infer and plain else text


def expand_file_column(df: DataFrame, column: str, contents: DataFrame) -> DataFrame:
    """Replace file ids by the file contents (file_id, body): JSON, else tab-separated text.

    Either way the result is a variant: the JSON value, or an array with an object per text row.
    """
    lines = F.filter(F.split("body", "\r?\n"), lambda x: F.length(x) > 0)
    head = F.split(F.get(lines, F.lit(0)), "\t", -1)
    rows = F.transform(
        F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))),
        lambda x: F.map_from_arrays(head, F.slice(F.concat(F.split(x, "\t", -1), F.array_repeat(F.lit(""), F.size(head))), F.lit(1), F.size(head))),
    )
    body = F.coalesce(F.try_parse_json("body"), F.parse_json(F.to_json(rows)))
    files = contents.select(F.col("file_id").alias("_file"), body.alias("_body"))
    joined = df.join(files, df[column].cast("string") == F.col("_file").cast("string"), "left")
    return joined.withColumn(column, F.col("_body")).drop("_file", "_body")


def save_derived(df: DataFrame, path: str, partition_by: list[str] = (), mode: str = "overwrite") -> DataFrame:
    """Store a result as a data set; the dictionary travels in the column metadata."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.parquet(path)
