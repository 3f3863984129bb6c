"""Results and manifests: aggregates as tables, Markdown from the aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.operators.detect import preview
from inkveil.sources.files import file_type, readable_size


def totals(results: DataFrame) -> DataFrame:
    """One row over all results (input_path, status, duration_ms, entities_count, file_size)."""
    ok = F.col("status") == "success"
    return results.agg(
        F.count(F.lit(1)).alias("n_total"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("success", "failed", "skipped")],
        F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("duration_ms"),
        F.coalesce(F.sum(F.when(ok, F.col("entities_count"))), F.lit(0)).alias("entities"),
        F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"),
    )


def by_type(results: DataFrame) -> DataFrame:
    """file_type, n, entities, bytes over successful results."""
    ok = results.filter("status = 'success'").withColumn("file_type", file_type(F.col("input_path")))
    return ok.groupBy("file_type").agg(F.count(F.lit(1)).alias("n"), F.sum("entities_count").alias("entities"), F.sum("file_size").alias("bytes"))


def categories(entities: DataFrame, image_items: DataFrame | None = None) -> DataFrame:
    """category, n; picture regions count under 图片脱敏."""
    rows = entities.select("category")
    if image_items is not None:
        rows = rows.unionByName(image_items.select(F.lit("图片脱敏").alias("category")))
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def manifests(entities: DataFrame) -> DataFrame:
    """doc_id, manifest (JSON): entities with masked texts and counts by category. A document's entities form one value."""
    counts = entities.groupBy("doc_id", "category").agg(F.count(F.lit(1)).alias("n"))
    stats = counts.groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n")))).alias("stats"))
    shown = F.struct(preview(F.col("text")).alias("text"), "replacement", "category", "confidence", "source")
    listed = entities.groupBy("doc_id").agg(F.sort_array(F.collect_list(shown)).alias("entities"))
    return listed.join(stats, "doc_id").select("doc_id", F.to_json(F.struct("doc_id", "entities", "stats")).alias("manifest"))


def manifest_markdown(entities: DataFrame) -> DataFrame:
    """doc_id, markdown: counts by category, the highest first, and a numbered table of the entities with masked texts."""
    counts = entities.groupBy("doc_id", "category").agg(F.count(F.lit(1)).alias("n")).select("doc_id", F.struct((-F.col("n")).alias("minus"), "category").alias("c"))
    by_doc = counts.groupBy("doc_id").agg(F.sort_array(F.collect_list("c")).alias("cs"))
    table = lambda rows: F.array_join(rows, "\n")
    shown = F.struct("category", "text", "replacement", "source", "confidence")
    listed = entities.groupBy("doc_id").agg(F.sort_array(F.collect_list(shown)).alias("es"))
    head = F.transform("cs", lambda c: F.concat(F.lit("| "), c["category"], F.lit(" | "), (-c["minus"]).cast("string"), F.lit(" |")))
    body = F.transform("es", lambda e, i: F.concat(
        F.lit("| "), (i + 1).cast("string"), F.lit(" | "), preview(e["text"]), F.lit(" | "), F.coalesce(e["replacement"], F.lit("")), F.lit(" | "), e["category"], F.lit(" | "),
        F.format_string("%.0f%%", e["confidence"] * 100), F.lit(" | "), e["source"], F.lit(" |"),
    ))
    return listed.join(by_doc, "doc_id").select("doc_id", F.concat(F.lit("| category | n |\n|---|---|\n"), table(head), F.lit("\n\n| # | text | replacement | category | confidence | source |\n|---|---|---|---|---|---|\n"), table(body), F.lit("\n")).alias("markdown"))


def listing(results: DataFrame) -> DataFrame:
    """status, line: all files of a batch by status and path, with errors cut at 60 characters. Where the report would be too long, write this table instead."""
    ordered = results.select("status", "input_path", F.substring("error", 1, 60).alias("error")).orderBy("status", "input_path")
    return ordered.select("status", F.when(F.col("status") == "failed", F.concat(F.lit("- "), "input_path", F.lit(": "), "error")).otherwise(F.concat(F.lit("- "), "input_path")).alias("line"))


def markdown(results: DataFrame) -> str:
    """Report of a batch: totals, types, and all files by status. The files come in parts, so that the driver holds one part at a time beside the report."""
    t = totals(results).withColumn("size", readable_size(F.col("bytes"))).first()
    lines = [
        "# 脱敏报告", "", "| 总数 | 成功 | 失败 | 跳过 | 实体 | 大小 | 耗时(ms) |", "|---|---|---|---|---|---|---|",
        f"| {t.n_total:,} | {t.n_success:,} | {t.n_failed:,} | {t.n_skipped:,} | {t.entities:,} | {t['size']} | {t.duration_ms:,} |",
        "", "| 类型 | 文件 | 实体 | 大小 |", "|---|---|---|---|",
    ]
    for r in by_type(results).withColumn("size", readable_size(F.col("bytes"))).orderBy("file_type").collect():
        lines.append(f"| {r.file_type} | {r.n:,} | {r.entities:,} | {r['size']} |")
    heads = {"success": "成功", "failed": "失败", "skipped": "跳过"}
    last = None
    for r in listing(results).toLocalIterator():
        if r.status != last:
            lines += ["", f"## {heads.get(r.status, r.status)}", ""]
            last = r.status
        lines.append(r.line)
    return "\n".join(lines) + "\n"
