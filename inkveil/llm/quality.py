"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

The projection has no shuffle: every measure of a text comes from that text alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import SPACES, ascii_lower, words

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in that is was for with on are as by at from this it an be "
    "der die das und in zu den von mit ist nicht ein eine im auf es "
    "le la les de des du et un une en que qui dans pour est avec "
    "el los las del y una por con para se lo"
).split()
SYMBOLS = "#*$%&|<>"

#: name of the rule, measure, lowest and highest value that passes (None: open).
THRESHOLDS: list[tuple[str, str, float | None, float | None]] = [
    ("word_length", "mean_word_length", 2.0, 16.0),
    ("symbols", "symbol_ratio", None, 0.25),
    ("stop_words", "stop_word_ratio", 0.01, None),
    ("repeated_lines", "dup_line_ratio", None, 0.6),
]


def measured(docs: DataFrame, text_col: str = "text", *carry: str) -> DataFrame:
    """The columns `carry` and the measures of each text; a null text has no words.

    n_repeat_words counts the words in windows of three words that occur twice or more in the text, the first
    occurrence included; windows are compared by a 64-bit hash, and only texts with a repeated window sort them.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = F.translate(ascii_lower(text), ".,;:!?()\"'", "")
    split = docs.select(
        *carry,
        words(text).alias("ws"),
        F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0).alias("ls"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size(F.filter(words(plain), lambda w: w.isin(STOP_WORDS))).alias("n_stop"),
    )
    windows = F.when(
        F.size("ws") >= 3,
        F.transform(F.slice("ws", F.lit(1), F.size("ws") - 2), lambda w, i: F.xxhash64(w, F.get("ws", i + 1), F.get("ws", i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    counted = split.select(
        *carry, "word_chars", "n_symbols", "n_stop",
        F.size("ws").cast("long").alias("n_words"),
        F.size("ls").cast("long").alias("n_lines"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
    )
    ordered = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    seen = counted.withColumn("ordered", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), ordered))
    # starts of the windows that equal a neighbour in the sorted order
    twice = F.filter(
        F.transform(
            "ordered",
            lambda x, k: F.when((F.get("ordered", k - 1)["h"] == x["h"]) | (F.get("ordered", k + 1)["h"] == x["h"]), x["i"]),
        ),
        lambda i: i.isNotNull(),
    )
    starts = seen.withColumn("starts", F.sort_array(twice)).drop("ordered", "windows")
    # a start covers up to the next start, three words at most
    covered = F.aggregate(
        F.transform("starts", lambda i, k: F.coalesce(F.least(F.lit(3), F.get("starts", k + 1) - i), F.lit(3))),
        F.lit(0).cast("long"),
        lambda a, x: a + x.cast("long"),
    )
    share = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))
    return starts.select(
        *carry, "n_words", "n_lines", "word_chars", "n_symbols", "n_dup_lines", "n_stop",
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        share("word_chars", "n_words").alias("mean_word_length"),
        share("n_symbols", "n_words").alias("symbol_ratio"),
        share("n_stop", "n_words").alias("stop_word_ratio"),
        share("n_dup_lines", "n_lines").alias("dup_line_ratio"),
    )


def compiled(thresholds: list[tuple[str, str, float | None, float | None]]) -> Column:
    """Array of the names of the rules that a row of measures breaks."""
    checks = []
    for name, measure, low, high in thresholds:
        inside = [F.col(measure) >= low] if low is not None else []
        inside += [F.col(measure) <= high] if high is not None else []
        checks.append(F.when(~reduce(Column.__and__, inside, F.lit(True)), F.lit(name)))
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thresholds: list | None = None) -> DataFrame:
    """One row a document: doc_id, the counts, base_failed, kept, broken (names of the broken rules).

    base_failed: fewer than 50 words, or more than half of the words in repeated windows. Null and empty texts have
    no words and fail. Repeated rows and null ids are judged like any other; an empty table gives no rows.
    """
    rows = measured(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", "doc_id")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("broken", compiled(THRESHOLDS if thresholds is None else thresholds)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.size("broken") == 0)).alias("kept"),
        "broken",
    )
