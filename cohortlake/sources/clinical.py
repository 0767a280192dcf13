"""Data file with a mapping file that names, labels and categorises its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.operators.fieldtypes import infer_types, retype
from cohortlake.sources.delimited import export_delimited, read_delimited

# The columns of the mapping file and the separator of category paths.
MAPPING_COLUMNS = ("filename", "category_cd", "col_nbr", "data_label")
PATH_SEPARATOR = "+"


def read_with_mapping(
    spark: SparkSession, data_path: str, mapping_path: str, delimiter: str = "\t", infer: bool = True
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(data, dictionary, category tree).

    ``col_nbr`` counts from 1; a number outside the data file is an error. Category paths are
    split at ``+`` and underscores become blanks. A column without a mapping has an empty label.
    """
    data = read_delimited(spark, data_path, delimiter, infer=False)
    mapping = read_delimited(spark, mapping_path, delimiter, infer=False)
    rows = mapping.select("category_cd", F.col("col_nbr").cast("int").alias("nr"), "data_label").collect()  # one row per column
    unknown = [r["nr"] for r in rows if r["nr"] is None or not 1 <= r["nr"] <= len(data.columns)]
    if unknown:
        raise ValueError(f"column numbers outside the data file: {unknown}")
    by_nr = {r["nr"]: r for r in rows}
    fields, edges = [], set()
    for k, c in enumerate(data.columns, 1):
        r = by_nr.get(k)
        path = [p.replace("_", " ") for p in (r["category_cd"] or "").split(PATH_SEPARATOR) if p] if r else []
        fields.append((c, r["data_label"] if r else "", " / ".join(path)))
        edges |= {(" / ".join(path[: d + 1]), p, " / ".join(path[:d]) or None) for d, p in enumerate(path)}
    if infer:
        data = retype(data, infer_types(data))
    data = data.select(*[F.col(c).alias(c, metadata={**data.schema[c].metadata, "label": lab, "category": cat}) for c, lab, cat in fields])
    dictionary = spark.createDataFrame(fields, "field string, label string, category string")
    tree = spark.createDataFrame(sorted(edges, key=str), "category string, name string, parent string")
    return data, dictionary, tree


def export_clinical_pair(
    df: DataFrame, data_path: str, mapping_path: str, key: str, visit: str, categories: dict[str, str], labels: dict[str, str] | None = None
) -> None:
    """Data file (key, visit, categorised fields by name) and its mapping file."""
    labels = labels or {}
    fields = [key, visit, *sorted(c for c in categories if c not in (key, visit))]
    export_delimited(df.select(*fields), data_path, "\t")
    fixed = {key: "SUBJ_ID", visit: "VISIT_NAME"}
    rows = [
        ("data.txt", categories.get(c, "").replace(" ", "_").replace("_/_", PATH_SEPARATOR), str(k), fixed.get(c) or labels.get(c, c))
        for k, c in enumerate(fields, 1)
    ]
    mapping = df.sparkSession.createDataFrame(rows, list(MAPPING_COLUMNS)).coalesce(1)
    export_delimited(mapping, mapping_path, "\t")


