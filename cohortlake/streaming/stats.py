"""Statistics that keep up with a growing table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.functions.common import to_double
from cohortlake.operators.stats import stats_columns
from cohortlake.session import scratch_path


def read_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Parquet files as a stream with the schema of those already there."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def stream_basic_stats(stream: DataFrame, group: str, column: str) -> DataFrame:
    """Updating statistics per group; the state is one small row per group."""
    aggs = [c.alias(n) for n, c in stats_columns(to_double(stream, column)).items()]
    return stream.groupBy(group).agg(*aggs)


def run_to_table(result: DataFrame, label: str, mode: str = "append", folder: str | None = None, keys: list[str] = ()) -> DataFrame:
    """Run the stream over all data available now and return what it wrote so far.

    Append goes to a parquet sink. In update mode a micro-batch writes only the rows it changed, to a version of
    its own, and the last version of every row, told by ``keys``, is read; when a run has ended its versions are
    merged into one. In complete mode each micro-batch writes the whole updated
    result to a version of its own and the last version is read. The table and the checkpoint of the
    query lie in ``folder``, which must be shared: a later call with the same folder goes on where
    the one before stopped. Without it the call has a new folder of its own.
    """
    spark = result.sparkSession
    folder = folder or scratch_path(spark, label)
    path, checkpoint = f"{folder}/table", f"{folder}/checkpoint"
    writer = result.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer.outputMode("append").format("parquet").start(path).awaitTermination()
        return spark.read.schema(result.schema).parquet(path)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    nothing = spark.createDataFrame([], result.schema)
    nothing.write.mode("ignore").parquet(f"{path}/version=-1")
    writer.outputMode(mode).foreachBatch(write).start().awaitTermination()
    if mode == "update":
        return _merged(spark, path, result, keys)
    last = spark.read.parquet(path).agg(F.max("version")).first()[0]
    return nothing if last is None else spark.read.schema(result.schema).parquet(f"{path}/version={last}")


def _merged(spark: SparkSession, path: str, result: DataFrame, keys: list[str]) -> DataFrame:
    """The last version of every row. Several versions are merged into a new one half a step after the last of them."""
    versions = spark.read.schema(f"{result.schema.toDDL()}, version double").parquet(path)
    merged = F.max(F.when(F.col("version") % 1 == 0.5, F.col("version"))).alias("merged")
    seen = versions.agg(merged, F.min("version").alias("first"), F.max("version").alias("last")).first()
    if seen["last"] is None:
        return versions.drop("version")
    start = seen["first"] if seen["merged"] is None else seen["merged"]
    name = lambda v: f"{path}/version={int(v) if v % 1 == 0 else v}"
    if start == seen["last"]:
        return spark.read.schema(result.schema).parquet(name(start))
    names = [c for c in result.columns if c not in keys]
    newest = versions.where(F.col("version") >= start).groupBy(*keys).agg(F.max_by(F.struct(*names), "version").alias("r"))
    newest.select(*keys, "r.*").select(*result.columns).write.mode("overwrite").parquet(name(seen["last"] + 0.5))
    return spark.read.schema(result.schema).parquet(name(seen["last"] + 0.5))
