"""Counts by rule and category, and audits of what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.functions.rules import RulePack


def by_rule(docs: DataFrame, pack: RulePack, text: str = "text", *by: str) -> DataFrame:
    """rule_id, category, n (matches in the unchanged texts) and the columns `by`, for rules that match."""
    rows = docs.select(*by, F.explode(pack.counts(F.col(text))).alias("c")).select(*by, "c.*").filter("n > 0")
    return rows.groupBy(*by, "rule_id", "category").agg(F.sum("n").alias("n"))


def changed(docs: DataFrame, pack: RulePack, text: str = "text") -> DataFrame:
    """The rows that redaction changes, with column `redacted`."""
    return docs.withColumn("redacted", pack.apply(F.col(text))).filter(~F.col("redacted").eqNullSafe(F.col(text)))


def residual(docs: DataFrame, pack: RulePack, text: str = "text", audit: RulePack | None = None) -> DataFrame:
    """Matches that the rules of `audit` (default: of the pack itself) still find after redaction, by rule (none: no row)."""
    return by_rule(docs.select(pack.apply(F.col(text)).alias("left")), audit or pack, "left")


def merged_maps(a, b):
    """Two maps of counts, added."""
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))
