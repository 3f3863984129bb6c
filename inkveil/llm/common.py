"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The white space between words: blank and the controls 9 to 13, as a character class.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """Array of the runs of characters other than white space."""
    return F.array_remove(F.split(text, SPACE_CLASS + "+", -1), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: the session's spark.checkpoint.dir.

    Only where that is unset (tests on one machine) a temporary folder takes its place.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The folder of all tables and models that this application writes; `clear` drops it."""
    return f"{shared_dir(spark)}/inkveil-{spark.sparkContext.applicationId}"


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the application's folder."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a path; one that is not there is left alone."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Deletes all tables and models that the operators wrote in this application: call it when their results have been saved."""
    discard(spark, run_dir(spark))


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends there, and lost executors cost nothing."""
    path = path or fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 4000, megabytes: int = 8) -> None:
    """Bounds what a Python worker gets at once, whatever the length of the texts. The session's limits are only ever lowered."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", megabytes << 20)):
        now = re.sub(r"(?i)b$", "", spark.conf.get(f"spark.sql.execution.arrow.{key}"))
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


#: A key with at least one of so many rows is hot: there are no more hot keys than that, so that they can be broadcast.
HOT_SHARE = 1000


def joined_by_key(rows: DataFrame, one: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Inner join of stored `rows` with a stored table that has one row for each key and, in column `size`, about how many rows the key has.

    Hot keys (at most HOT_SHARE) are broadcast, so that a key with a third of all rows is joined where its rows are; the others are shuffled.
    """
    total = one.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    cut = max(HOT_SHARE, total // HOT_SHARE)
    hot, rest = one.filter(F.col(size) >= cut), one.filter(F.col(size) < cut)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(cold.join(rest, keys))


def decided_by_key(rows: DataFrame, one: DataFrame, key: str, value: str, size: str) -> DataFrame:
    """Left join that adds column `value` (null: no such key) from a stored table with one row for each key and, in column `size`, about how many rows the key has.

    Rows of hot keys (at most HOT_SHARE) are decided by a broadcast. In the join of the others they, and rows without a key, take keys of their own, so that
    they do not meet in one task.
    """
    total = one.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    cut = max(HOT_SHARE, total // HOT_SHARE)
    hot = one.filter(F.col(size) >= cut).select(F.col(key).alias("__hot"), F.col(value).alias("__hot_value"))
    cold = one.filter(F.col(size) < cut).select(F.col(key).alias("__cold"), F.col(value).alias("__cold_value"))
    rows = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    open_key = F.when(F.col("__hot").isNull() & F.col(key).isNotNull(), F.concat(F.lit("+"), F.col(key))).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string")))
    rows = rows.withColumn("__open", open_key).join(cold.withColumn("__cold", F.concat(F.lit("+"), "__cold")), F.col("__open") == F.col("__cold"), "left")
    return rows.withColumn(value, F.coalesce("__hot_value", "__cold_value")).drop("__hot", "__hot_value", "__open", "__cold", "__cold_value")


def fold(id_col: Column, mod: int = 5) -> Column:
    """crc32 of the id as text, modulo `mod`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % mod


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """At the end of a task, or before one that needs much: returns freed memory to the system, since workers live on beside later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
