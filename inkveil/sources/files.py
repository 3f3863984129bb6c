"""Files as a table: scan, type, output path."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions import lexicon as lx
from inkveil.functions.packs import filename_g3
from inkveil.sources import store


def scan(spark: SparkSession, *paths: str) -> DataFrame:
    """path, modificationTime, length, content of all files below the paths; `content` is read only where it is selected."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))


#: What a task lists goes on after so many files.
LISTED = 50_000
_FOUND = pa.schema([("path", pa.string()), ("length", pa.int64()), ("folder", pa.bool_())])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FOUND, strict=True)], schema=_FOUND)
    for b in batches:
        for folder in b.column(0).to_pylist():
            for name, size, is_folder in store.children(store.plain(folder)):
                if name and (name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")):
                    continue
                rows.append((f"{folder.rstrip('/')}/{name}" if name else folder, size, is_folder))
                if len(rows) >= LISTED:
                    yield batch()
                    rows = []
    if rows:
        yield batch()


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, length of the files that `scan` finds below a path. Tasks list the folders, a level at a time, so that the driver holds no file; what tasks cannot reach (patterns, file systems
    that only Spark knows) is scanned."""
    if not store.is_there(path):
        return gathered(scan(spark, path).select("path", "length"))
    root = re.sub("^/+|^file:/+", "file:/", path)
    level, found = spark.createDataFrame([(root,)], "path string"), None
    while True:
        level = store.stored(level.mapInArrow(_listed, "path string, length long, folder boolean"), "listing")
        # empty files are none, as in a scan
        rows = level.filter("not folder and length > 0").select("path", "length")
        found = rows if found is None else found.unionByName(rows)
        folders = level.filter("folder").select("path")
        n = folders.count()
        if not n:
            return found
        level = folders.repartition(min(n, 8 * spark.sparkContext.defaultParallelism))


#: Rows of a costly expression for each task.
TASK_ROWS = 100_000


def spread(rows: DataFrame, most: int = TASK_ROWS) -> DataFrame:
    """Rows for costly expressions, dealt out where they would be read by fewer tasks than there are cores or than hold `most` rows each (a table with few row groups), so that no task grows with the table."""
    parts, cores = rows.rdd.getNumPartitions(), rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, -(-rows.count() // most))  # tables are counted by their footers
    return rows.repartition(tasks) if parts < tasks else rows


#: Partitions of a scan of files for each task.
SCAN_PARTS = 16


def gathered(scan: DataFrame, most: int = SCAN_PARTS) -> DataFrame:
    """A scan of files in fewer tasks, where there are many more than cores: Spark puts no more than 32 small files into a partition, and each task's shuffle files and fetches cost more than those."""
    parts, cores = scan.rdd.getNumPartitions(), scan.sparkSession.sparkContext.defaultParallelism
    tasks = max(4 * cores, -(-parts // most))
    return scan.coalesce(tasks) if tasks < parts else scan


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether a path is one file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.exists(where) and store.getFileStatus(where).isFile()


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def file_type(path: Column) -> Column:
    """word, excel, ppt, pdf or image by the ending; null for others."""
    found = F.lit(None).cast("string")
    for kind, endings in lx.FILE_TYPES.items():
        found = F.when(suffix(path).isin(endings), F.lit(kind)).otherwise(found)
    return found


def output_path(path: Column, folder: str, mark: str = lx.OUTPUT_SUFFIX, root: str | None = None) -> Column:
    """<folder>/<stem><mark>.<ending>; with `root`, below the folder that the file has under it, so that files of one name in different folders stay apart."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    below = F.lit("")
    if root is not None:
        inside = F.regexp_replace(path, r"[^/\\]*$", "")
        start = root.rstrip("/") + "/"
        below = F.when(inside.startswith(start), F.substring(inside, len(start) + 1, 2**31 - 1)).otherwise(F.lit(""))
    return F.concat(F.lit(folder.rstrip("/") + "/"), below, F.regexp_replace(name, r"(\.[^.]*)?$", ""), F.lit(mark), F.regexp_extract(name, r"(\.[^.]*)$", 1))


def picture_path(path: Column) -> Column:
    """The path with the ending of the form in which pictures are saved."""
    return F.concat(F.regexp_replace(path, r"\.[^./\\]*$", ""), F.lit(".png"))


def routed(files: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Files of known type (of `types`, if given), with file_type."""
    rows = files.withColumn("file_type", file_type(F.col("path"))).filter("file_type is not null")
    return rows.filter(F.col("file_type").isin(types)) if types and not any("all" in t for t in types) else rows


def media_name(name: Column) -> Column:
    """A media file's name with its stem redacted and its ending kept."""
    return F.concat(filename_g3(F.regexp_replace(name, r"(\.[^.]*)?$", "")), F.regexp_extract(name, r"(\.[^.]*)$", 1))


def is_logo(name: Column) -> Column:
    return F.lower(name).rlike("bank|logo|银行|brand|icon")


def readable_size(size: Column, largest: str = "TB") -> Column:
    """1.5 KB and the like, rounded half to even; `largest` is the unit of all that is too large for those before it."""
    units = ("B", "KB", "MB", "GB", "TB")
    shown = lambda power, unit: F.format_string(f"%.1f {unit}", F.bround(size / F.lit(1024.0**power), 1))
    last = units.index(largest)
    text = shown(last, largest)
    for power, unit in reversed(list(enumerate(units[:last]))):
        text = F.when(size < 1024 ** (power + 1), shown(power, unit)).otherwise(text)
    return text
