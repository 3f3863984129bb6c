"""Exact deduplication by content sort (Spark expressions only).

Sampled splitters range-partition the rows by their normalised text (its head and a 64-bit hash of all
of it stand for the bytes, so that a splitter stays small), the external sort of each partition
puts equal texts next to each other by their full bytes, and the comparison of each row's full text with its neighbour's
ends a group. Of each group the row with the largest (or smallest) identifier stays.

A text with at least 1/`hot_share` of all rows is dealt out over all partitions by a salt from the
identifier. At most `hot_share` texts can be that frequent, so that their group totals are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm.common import ascii_lower, partitions


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", hot_share: int = 1000) -> DataFrame:
    """One row for each row of `docs`: row (struct of all its columns), keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. A null text counts as empty. A null id is
    never kept before another id; if all ids of a group are null, keep_id is null and one row is kept. Of rows
    with the same text and id one is kept. Other columns may have any name. An empty table gives no rows.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    row_id, text = F.col("row")[id_col], F.col("row")[text_col]
    body = ascii_lower(F.coalesce(text.cast("string"), F.lit("")))
    best = F.max if keep == "largest" else F.min

    keyed = docs.select(F.struct("*").alias("row")).select("row", F.substring(body, 1, 24).alias("head"), F.xxhash64(body).alias("h"))
    cut = max(100, docs.count() // hot_share)
    hot = keyed.groupBy("h").count().filter(F.col("count") >= cut).select("h", F.lit(True).alias("hot"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64(row_id), F.lit(parts))).otherwise(F.lit(0)).cast("int")
    dealt = keyed.join(F.broadcast(hot), "h", "left").withColumn("salt", salt)

    order = row_id.desc_nulls_last() if keep == "largest" else row_id.asc_nulls_last()
    run = Window.partitionBy("head", "h", "salt", "body").orderBy(order)
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = (
        dealt.repartitionByRange(parts, "head", "h", "salt")
        .withColumn("body", body)
        .select(
            "row", "h",
            F.row_number().over(run).alias("rank"),
            F.first(row_id).over(whole).alias("run_keep"),
            F.count(F.lit(1)).over(whole).alias("run_size"),
            F.sha2("body", 256).alias("text_sha256"),
        )
    )
    totals = (
        dealt.filter("hot")
        .select("h", F.sha2(body, 256).alias("text_sha256"), row_id.alias("id"))
        .groupBy("h", "text_sha256")
        .agg(best("id").alias("hot_keep"), F.count(F.lit(1)).alias("hot_size"))
    )
    keep_id = F.when(F.col("hot_size").isNotNull(), F.col("hot_keep")).otherwise(F.col("run_keep"))
    return runs.join(F.broadcast(totals), ["h", "text_sha256"], "left").select(
        "row",
        keep_id.alias("keep_id"),
        F.coalesce("hot_size", "run_size").alias("group_size"),
        (row_id.eqNullSafe(keep_id) & (F.col("rank") == 1)).alias("kept"),
        "text_sha256",
    )


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    found = exact_groups(docs.select(id_col, text_col), id_col, text_col, keep)
    return found.select(F.col("row")[id_col].alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The kept rows, with the columns of `docs`."""
    return exact_groups(docs, id_col, text_col, keep).filter("kept").select("row.*")
