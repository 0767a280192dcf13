"""Numeric matrices as delimited files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.sources.delimited import export_delimited

ESCAPED_DOT = "u002e"  # fixed value: dots in names are stored like this
ID_COLUMN = "featureName"


def save_matrix(matrix: DataFrame, path: str, columns: list[str], delimiter: str = ",") -> None:
    """Long (i, j, value) as a wide file with the row name in the first column."""
    aggs = [F.max(F.when(F.col("j") == c, F.col("value"))).alias(c.replace(".", ESCAPED_DOT)) for c in columns]
    export_delimited(matrix.groupBy(F.col("i").alias(ID_COLUMN)).agg(*aggs), path, delimiter, order=[ID_COLUMN])


def load_matrix(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """Wide file with the row name first as long (i, j, value); missing cells are left out."""
    header = spark.read.csv(path, sep=delimiter).limit(1).collect()[0]
    schema = T.StructType([T.StructField(header[0], T.StringType())] + [T.StructField(h, T.DoubleType()) for h in header[1:]])
    wide = spark.read.csv(path, sep=delimiter, header=True, schema=schema)
    long = wide.unpivot([header[0]], list(header[1:]), "j", "value").where("value IS NOT NULL")
    return long.select(F.col(header[0]).alias("i"), F.replace("j", F.lit(ESCAPED_DOT), F.lit(".")).alias("j"), "value")
