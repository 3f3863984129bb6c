"""Algebra of character spans: half-open, in code points, as arrays of struct(start, end, replacement) in a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkveil.functions.rules import RulePack, between, let

SPAN = "struct<start:int,end:int,replacement:string>"


def found(text: Column, pattern: str | Column, replacement: str | Column) -> Column:
    """All matches of a pattern: offsets add up from the texts between the matches and the matches themselves."""
    pieces = between(text, pattern) if isinstance(pattern, str) else F.split(text, pattern, -1)
    pattern, replacement = (F.lit(x) if isinstance(x, str) else x for x in (pattern, replacement))
    empty = F.array().cast(f"array<{SPAN}>")

    def walked(pieces: Column, hits: Column) -> Column:
        return F.aggregate(
            F.transform(hits, lambda h, i: F.struct(F.length(F.get(pieces, i)).alias("gap"), F.length(h).alias("size"))),
            F.struct(F.lit(0).alias("at"), empty.alias("spans")),
            lambda a, m: F.struct(
                (a["at"] + m["gap"] + m["size"]).alias("at"),
                F.concat(a["spans"], F.array(F.struct((a["at"] + m["gap"]).alias("start"), (a["at"] + m["gap"] + m["size"]).alias("end"), replacement.alias("replacement")))).alias("spans"),
            ),
            lambda a: a["spans"],
        )

    both = F.struct(pieces.alias("pieces"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits"))
    return F.when(F.rlike(text, pattern), let(both, lambda b: walked(b["pieces"], b["hits"]))).otherwise(empty)


def collected(text: Column, pack: RulePack) -> Column:
    """Spans of all rules over the unchanged text, by start, the longest first. Back-references in a replacement stay empty."""
    parts = [found(text, r.compiled, r.replacement) for r in pack.rules if not r.literal]
    placed = F.transform(F.concat(*parts), lambda s, i: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus"), i.alias("i"), s["replacement"].alias("replacement")))
    ordered = F.sort_array(placed)  # of rules that find the same, the first one counts
    return F.transform(ordered, lambda s: F.struct(s["start"].alias("start"), (-s["minus"]).alias("end"), s["replacement"].alias("replacement")))


def outside(spans: Column, others: Column) -> Column:
    """The spans that do not start inside one of the others."""
    return F.filter(spans, lambda s: ~F.exists(others, lambda o: (s["start"] >= o["start"]) & (s["start"] < o["end"])))


def by_start(spans: Column) -> Column:
    """Sorted by start, the longest first, then by replacement."""
    keyed = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus"), s["replacement"].alias("replacement"))))
    return F.transform(keyed, lambda s: F.struct(s["start"].alias("start"), (-s["minus"]).alias("end"), s["replacement"].alias("replacement")))


def greedy(spans: Column) -> Column:
    """Of sorted spans those that start at or after the end of the last one kept."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).alias("end"), F.array().cast(f"array<{SPAN}>").alias("kept")),
        lambda a, s: F.when(s["start"] >= a["end"], F.struct(s["end"].alias("end"), F.concat(a["kept"], F.array(s)).alias("kept"))).otherwise(a),
        lambda a: a["kept"],
    )


def applied(text: Column, spans: Column) -> Column:
    """The text with sorted spans that do not overlap replaced, from piece to piece."""

    def rebuilt(spans: Column) -> Column:
        since = lambda i: F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"])
        kept = F.transform(spans, lambda s, i: F.concat(F.substring(text, since(i) + 1, s["start"] - since(i)), s["replacement"]))
        return F.concat(F.array_join(kept, ""), F.substring(text, F.coalesce(F.get(spans, F.size(spans) - 1)["end"], F.lit(0)) + 1, F.length(text)))

    return let(spans, rebuilt)


def mapped(position: Column, spans: Column) -> Column:
    """Where a position of the old text lies in the new one; inside a replaced span, as far into the replacement as it goes."""
    return F.aggregate(
        spans,
        F.struct(position.alias("p"), F.lit(0).alias("shift")),
        lambda a, s: F.when(
            s["end"] <= position, F.struct(a["p"].alias("p"), (a["shift"] + F.length(s["replacement"]) - (s["end"] - s["start"])).alias("shift"))
        ).when(
            s["start"] < position,
            F.struct((s["start"] + F.least(position - s["start"], F.length(s["replacement"]))).alias("p"), a["shift"].alias("shift")),
        ).otherwise(a),
        lambda a: a["p"] + a["shift"],
    )


def redact_once(text: Column, pack: RulePack) -> Column:
    """One-pass redaction: all rules look at the unchanged text, overlaps go to the earlier, then longer span."""
    return applied(text, greedy(collected(text, pack)))
