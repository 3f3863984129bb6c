"""Text of PDF pages as tables. A parser outside Spark gives one row a page: path, page, width, height and nested `blocks`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.rules import RulePack

#: Blocks of type 0 hold text.
BLOCKS = "array<struct<type:int,lines:array<struct<spans:array<struct<text:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>,size:double>>>>>>"


def is_text(blocks: Column) -> Column:
    """Whether a page has a text block with lines."""
    return F.coalesce(F.exists(blocks, lambda b: (b["type"] == 0) & (F.size(b["lines"]) > 0)), F.lit(False))


def kinds(pages: DataFrame) -> DataFrame:
    """path, kind: `text` if any page has text, else `image_scan`."""
    return pages.groupBy("path").agg(F.when(F.bool_or(is_text(F.col("blocks"))), "text").otherwise("image_scan").alias("kind"))


def text_spans(pages: DataFrame) -> DataFrame:
    """path, page, block, line, span, text, bbox, size: a row for each span of text blocks."""
    blocks = pages.select("path", "page", F.posexplode("blocks").alias("block", "b")).filter("b.type = 0")
    lines = blocks.select("path", "page", "block", F.posexplode("b.lines").alias("line", "l"))
    return lines.select("path", "page", "block", "line", F.posexplode("l.spans").alias("span", "s")).select("path", "page", "block", "line", "span", "s.*")


def overlays(spans: DataFrame, pack: RulePack, pad: float = 2.0) -> DataFrame:
    """What a writer draws over each span that redaction changes: a black box with a margin, and the new text in three quarters of the size, 6 at least."""
    changed = spans.withColumn("redacted", pack.apply(F.col("text"))).filter((F.length(F.trim("text")) > 0) & (F.col("redacted") != F.col("text")))
    box = F.struct(*[(F.col(f"bbox.{c}") + d * pad).alias(c) for c, d in (("x0", -1), ("y0", -1), ("x1", 1), ("y1", 1))])
    return changed.select("path", "page", "block", "line", "span", box.alias("box"), "redacted", F.greatest(F.col("size") * 0.75, F.lit(6.0)).alias("font_size"))
