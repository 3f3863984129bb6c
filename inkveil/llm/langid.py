"""Language ID by multilingual mixture inference.

Letter trigrams are counted for every language in hashed buckets (a table of fixed size for each language). A text is taken as a mixture of
languages: expectation-maximisation estimates the languages' proportions from the likelihoods of its trigrams, and languages
join the set as long as the likelihood, less a penalty for each language, rises.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import bounded_batches, fold, give_back, stored

BITS = 16
UNDETERMINED = "und"
SMOOTHING = 0.5
ROUNDS = 15
#: Languages whose tables (2^BITS floats each) are collected and broadcast; more stop the job.
MOST_LANGUAGES = 100
#: Nats of log-likelihood that one more language must gain, for each ln(trigrams).
PENALTY = 3.0


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else 0."""
    return np.array([k if chr(k).isalpha() else 0 for k in range(0x110000)], np.uint32)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of the trigrams of a text's words (with one blank at either side) and their counts."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    points = _letters()[points]
    x = points[(points != 0) | np.append(True, points[:-1] != 0)].astype(np.uint64)  # one blank between words
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = ((x[:-2] * np.uint64(0x9E3779B97F4A7C15) + x[1:-1]) * np.uint64(0xBF58476D1CE4E5B9) + x[2:]) * np.uint64(0x94D049BB133111EB)
    h = h[(x[1:-1] != 0)]
    return np.unique((h >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)


def _counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[str, np.ndarray] = {}
    for frame in frames:
        for lang, text in zip(frame["lang"], frame["text"], strict=True):
            bucket, n = grams(text)
            if lang not in total:
                total[lang] = np.zeros(1 << BITS, np.int64)
            total[lang][bucket] += n
    for lang, counts in total.items():
        met = np.flatnonzero(counts)
        yield pd.DataFrame({"lang": lang, "bucket": met.astype(np.int32), "n": counts[met]})


def learned(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and the log-probability of every bucket in each, from columns lang and text.

    2^BITS numbers for each language, whatever the input, for MOST_LANGUAGES at most. Without labelled rows there are no languages.
    """
    counts = stored(labelled.mapInPandas(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "trigrams")
    found = counts.select("lang").distinct().count()
    if found > MOST_LANGUAGES:
        raise ValueError(f"{found} distinct languages: more than {MOST_LANGUAGES} do not fit a broadcast table")
    counts = counts.toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.full((len(langs), 1 << BITS), SMOOTHING)
    table[np.searchsorted(langs, counts["lang"].to_numpy().astype(str)) if langs else [], counts["bucket"].to_numpy()] += counts["n"].to_numpy()
    return langs, np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


def mixture(like: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of the languages (rows of `like`, the likelihoods up to a factor for each trigram) and the log-likelihood."""
    share = np.full(len(like), 1 / len(like))
    for _ in range(ROUNDS):
        joint = share[:, None] * like
        share = (joint / joint.sum(0)) @ n
        share /= share.sum()
    return share, float(np.log(share @ like) @ n)


def inferred(bucket: np.ndarray, n: np.ndarray, table: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The set of languages and their proportions, the highest first."""
    log_like = table[:, bucket].astype(np.float64)
    like = np.exp(log_like - log_like.max(0))
    alone = np.log(like + 1e-300) @ n
    chosen, best = [int(alone.argmax())], float(alone.max())
    share = np.ones(1)
    whole, _ = mixture(like, n)
    cost = PENALTY * np.log(n.sum() + 1)
    for k in np.argsort(-whole, kind="stable"):
        if k in chosen or whole[k] < 0.02:
            continue
        mixed, found = mixture(like[[*chosen, k]], n)
        if found <= best + cost:
            break
        chosen, best, share = [*chosen, int(k)], found, mixed
    order = np.argsort(-share, kind="stable")
    return [chosen[i] for i in order], share[order]


def _judged(texts: Iterable[str | None], langs: list[str], table: np.ndarray) -> list[tuple[str, float, str, bool]]:
    """lang_pred, score, langs, and whether the languages explain the text better than noise, in which all trigrams are alike."""
    rows = []
    for text in texts:
        bucket, n = grams(text)
        if len(bucket) == 0 or not langs:
            rows.append((UNDETERMINED, 0.0, "", False))
            continue
        chosen, share = inferred(bucket, n, table)
        like = np.log(share @ np.exp(table[chosen][:, bucket].astype(np.float64))) @ n
        said = ",".join(f"{langs[k]}:{s:.2f}" for k, s in zip(chosen, share, strict=True))
        rows.append((langs[chosen[0]], float(min(share[0], 1.0)), said, bool(like > -BITS * np.log(2) * n.sum())))
    return rows


def _predicted(frames: Iterator[pd.DataFrame], langs: list[str], table) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = _judged(frame["text"], langs, table.value)
        yield pd.DataFrame([r[:3] for r in rows], columns=["lang_pred", "score", "langs"]).assign(doc_id=frame["doc_id"].to_numpy(), held_out=frame["held_out"].to_numpy())


def _labelled(docs: DataFrame, id_col: str, text_col: str, lang_col: str, held_out_fold: int) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        F.col(lang_col).cast("string").alias("lang"), (fold(F.col(id_col)) == held_out_fold).alias("held_out"),
    )


def _fitted(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    return learned(rows.filter(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text"))


def predicted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out_fold: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred, score (proportion of lang_pred in the text), langs (the set with proportions) of every row.

    Learns from the text and the language of rows whose fold (crc32 of the id as text, modulo 5; null id: empty text) is not
    `held_out_fold` and whose language is not null; a prediction sees the text alone. A text that is null or has no letter is `und` with score 0,
    as is every text where there is nothing to learn from. Repeated rows count as often as they occur; ties go to the
    language that sorts first. An empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = _labelled(docs, id_col, text_col, lang_col, held_out_fold)
    langs, table = _fitted(rows)
    shared = spark.sparkContext.broadcast(table)
    found = rows.select("doc_id", "text", "held_out").mapInPandas(
        partial(_predicted, langs=langs, table=shared), "doc_id long, held_out boolean, lang_pred string, score double, langs string"
    )
    return found.select("doc_id", "held_out", "lang_pred", "score", "langs")


def _accepted(batches: Iterator[pa.RecordBatch], text_col: str, langs: list[str], table) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        judged = _judged(batch.column(text_col).to_pylist(), langs, table.value)
        yield batch.filter(pa.array([lang != UNDETERMINED and known for lang, _, _, known in judged], pa.bool_()))
    give_back()


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out_fold: int = 0) -> DataFrame:
    """The rows, with all their columns, whose languages are determined: the set found, of one or of several languages, explains the text
    better than noise (every trigram as likely as any other).

    Null and empty texts and texts without a letter go, as do all where there is nothing to learn from. Null ids and languages take part; repeated rows
    are judged alike; an empty table gives no rows. Columns may have any name.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    langs, table = _fitted(_labelled(docs, id_col, text_col, lang_col, held_out_fold))
    return docs.mapInArrow(partial(_accepted, text_col=text_col, langs=langs, table=spark.sparkContext.broadcast(table)), docs.schema)
