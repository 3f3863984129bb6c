"""Resumable work: a state table of results, and a stream that takes what is new and ends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATE = "input_path string, status string, error string, at long"


def latest(state: DataFrame) -> DataFrame:
    """The last entry of every path; of entries of one time a success."""
    w = Window.partitionBy("input_path").orderBy(F.desc("at"), F.desc(F.col("status") == "success"), "error")
    return state.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def pending(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files (column path) that have not succeeded: failed ones are tried again."""
    done = latest(state).filter("status = 'success'").select(F.col("input_path").alias("path"))
    return files.join(done, "path", "left_anti")


def without_output(tasks: DataFrame, existing: DataFrame, overwrite: bool = False) -> DataFrame:
    """Tasks with status: `skipped` where the output path exists already, unless it may be overwritten."""
    if overwrite:
        return tasks.withColumn("status", F.lit("pending"))
    there = existing.select(F.col("path").alias("output_path"), F.lit(True).alias("there")).distinct()
    return tasks.join(there, "output_path", "left").withColumn("status", F.when(F.col("there"), "skipped").otherwise("pending")).drop("there")


def summary(state: DataFrame) -> DataFrame:
    """n_done, n_failed, n_total by the latest entry of each path."""
    return latest(state).agg(F.count_if(F.col("status") == "success").alias("n_done"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.count(F.lit(1)).alias("n_total"))


def redact_available(
    spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, files_per_batch: int = 100
) -> None:
    """Redacts the Parquet files that have come since the last call, then ends. Each micro-batch overwrites its own partition of the target, so a batch that runs twice leaves one copy."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
