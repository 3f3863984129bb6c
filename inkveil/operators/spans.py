"""Spans and document structure as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkveil.functions.spans import applied, found


def offsets(nodes: DataFrame, keys: list[str], order: list[str], text: str = "text", separator: int = 0) -> DataFrame:
    """Adds start and end of every node in its document's concatenated text, with `separator` characters between nodes."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + separator).over(w), F.lit(0))
    return nodes.withColumn("start", start).withColumn("end", F.col("start") + F.length(text))


def merged(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping spans become one that keeps the first one's replacement; touching spans stay apart.

    Gaps and islands: a span that starts at or after the largest end so far opens an island.
    """
    w = Window.partitionBy(*keys).orderBy("start", F.desc("end"), "replacement")
    high = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(high.isNull() | (F.col("start") >= high), 1).otherwise(0)
    island = spans.filter("end > start").withColumn("opens", opens).withColumn("island", F.sum("opens").over(w))
    first = F.min_by("replacement", F.struct("start", (-F.col("end")).alias("e"), "replacement"))
    return island.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), first.alias("replacement")).drop("island")


def entity_spans(docs: DataFrame, entities: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, start, end, replacement: every place of every entity (doc_id, text, replacement) in its document's text, whatever blanks stand
    between its characters. Entities of one character are left out, and so are those without a replacement."""
    wanted = entities.filter((F.length(F.trim("text")) >= 2) & F.col("replacement").isNotNull()).select("doc_id", F.col("text").alias("entity"), "replacement").distinct()
    pattern = F.array_join(F.transform(F.filter(F.split("entity", ""), lambda c: ~c.rlike(r"^\s*$")), lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))), r"\s*")
    rows = docs.select("doc_id", F.col(text).alias("whole")).join(wanted, "doc_id")
    return rows.select("doc_id", F.inline(found(F.col("whole"), pattern, F.col("replacement"))))


def numbered(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Adds `number`, which counts the rows of a key from 1."""
    return rows.withColumn("number", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def in_nodes(spans: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Each span with the one node that contains it, and its offsets there; spans across nodes are left out.

    Nodes of a document must not overlap. Spans and nodes are sorted together once and the last node that began is carried forward, so that
    the work does not grow with spans times nodes.
    """
    width = [c for c in nodes.columns if c not in (*keys, "start", "end")]
    node = F.struct(F.col("start").alias("node_start"), F.col("end").alias("node_end"), *width)
    rest = [c for c in spans.columns if c not in keys]
    kind = nodes.select(node.alias("n")).schema["n"].dataType
    left = nodes.filter("end > start").select(*keys, F.col("start").alias("at"), F.lit(0).alias("kind"), node.alias("node"), F.lit(None).cast(spans.select(F.struct(*rest).alias("s")).schema["s"].dataType).alias("span"))
    right = spans.select(*keys, F.col("start").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(kind).alias("node"), F.struct(*rest).alias("span"))
    w = Window.partitionBy(*keys).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    placed = left.unionByName(right).withColumn("node", F.last("node", ignorenulls=True).over(w)).filter("kind = 1").select(*keys, "span.*", "node.*")
    inside = placed.filter("start >= node_start and end <= node_end")
    return inside.withColumn("local_start", F.col("start") - F.col("node_start")).withColumn("local_end", F.col("end") - F.col("node_start"))


def redistributed(nodes: DataFrame, spans: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Nodes (with start, end, text) with the spans of their document replaced: a span that crosses nodes puts its replacement into
    the node where it starts and goes from the others. Spans must not overlap."""
    cuts = spans.select(*keys, F.col("start").alias("s"), F.col("end").alias("e"), "replacement")
    hit = nodes.join(cuts, keys).filter("s < end and e > start")
    local = F.struct(F.greatest(F.col("s") - F.col("start"), F.lit(0)).cast("int").alias("start"), F.least(F.col("e") - F.col("start"), F.length("text")).cast("int").alias("end"), F.when(F.col("s") >= F.col("start"), F.col("replacement")).otherwise("").alias("replacement"))
    per_node = hit.groupBy(*keys, *order).agg(F.sort_array(F.collect_list(local)).alias("cuts"))
    joined = nodes.join(per_node, [*keys, *order], "left")
    return joined.withColumn("text", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(applied(F.col("text"), F.col("cuts")))).drop("cuts")


def packed(paragraphs: DataFrame, keys: list[str], order: str, limit: int = 200) -> DataFrame:
    """Greedy batches of paragraphs: a batch closes before the paragraph that would take it beyond `limit` characters.

    A fold over a document's paragraphs in order; every batch is kept.
    """
    start = F.struct(F.lit(-1).alias("batch"), F.lit(0).alias("size"), F.array().cast("array<struct<at:bigint,batch:int>>").alias("out"))

    def step(a, p):
        opens = (a["batch"] < 0) | (a["size"] + p["n"] > limit)
        batch = a["batch"] + F.when(opens, 1).otherwise(0)
        return F.struct(batch.alias("batch"), F.when(opens, p["n"]).otherwise(a["size"] + p["n"]).alias("size"), F.concat(a["out"], F.array(F.struct(p["at"].alias("at"), batch.alias("batch")))).alias("out"))

    listed = F.sort_array(F.collect_list(F.struct(F.col(order).cast("bigint").alias("at"), F.length("text").alias("n"))))
    batches = paragraphs.groupBy(*keys).agg(listed.alias("ps")).select(*keys, F.explode(F.aggregate("ps", start, step, lambda a: a["out"])).alias("b"))
    return batches.select(*keys, F.col("b.at").alias(order), F.col("b.batch").alias("batch"))


def chunks(docs: DataFrame, text: str = "text", size: int = 6000, overlap: int = 200) -> DataFrame:
    """Overlapping chunks of every text; the last one ends with the text."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - overlap - 1, F.lit(0)), F.lit(size - overlap))
    cut = docs.select("*", F.posexplode(starts).alias("chunk", "chunk_start"))
    return cut.withColumn("chunk_text", F.substring(F.col(text), F.col("chunk_start") + 1, F.lit(size)))
