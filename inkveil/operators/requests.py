"""Questions to a language model as rows: packed paragraphs, asked in rounds, each stored before the next.

Equal questions are one request, whatever documents they come from. A request that fails comes back in the next round, one that was refused for its rate after a
pause that grows with the attempts. Every answer is put into the shared folder under its request and attempt as soon as it is there, so that a task that runs again
after its executor was lost reads it instead of asking (and paying) again.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkveil.operators.detect import ENTITY, parsed_entities
from inkveil.sources import store

ROUND = "request string, text string, attempts int, answer string, error string, due double"
#: Seconds of the first pause after a refusal for the rate; the n-th is n times as long.
PAUSE = 5.0


class RateLimited(Exception):
    """What a client raises when the model's server asks for a pause."""


def _questions(text: str, limit: int) -> Iterator[str]:
    held: list[str] = []
    size = 0
    for para in filter(None, (p.strip(" ") for p in text.split("\n"))):
        if held and size + 1 + len(para) > limit:
            yield "\n".join(held)
            held, size = [], 0
        size += len(para) + bool(held)
        held.append(para)
    if held:
        yield "\n".join(held)


def _packed(frames: Iterator[pd.DataFrame], limit: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
            yield pd.DataFrame([(doc, n, q) for n, q in enumerate(_questions(text, limit), 1)], columns=["doc_id", "place", "text"])


def packed(docs: DataFrame, text: str = "text", limit: int = 200) -> DataFrame:
    """doc_id, place (from 1), request, text: the non-empty paragraphs of every text, put together in order until the next would take a question beyond `limit` characters.

    A paragraph longer than that is a question of its own. Null and empty texts have no questions.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).filter("text is not null")
    rows = rows.mapInPandas(partial(_packed, limit=limit), "doc_id long, place int, text string")
    return rows.select("doc_id", "place", F.sha2("text", 256).alias("request"), "text")


def _asked(frames: Iterator[pd.DataFrame], client: Callable[[str], str], log: str, now: Callable[[], float], sleep: Callable[[float], None]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for r in frame.itertuples():
            attempt = r.attempts + 1
            place = f"{log}/{r.request}-{attempt}.json"
            if any(store.listed_file(place)):
                answer, error, due = json.loads(store.read(place))
            else:
                if r.due > now():
                    sleep(r.due - now())
                answer, error, due = None, None, 0.0
                try:
                    answer = client(r.text)
                except RateLimited as e:
                    error, due = f"rate: {e}", now() + PAUSE * attempt
                except Exception as e:  # a client may fail in any way: the request is asked again
                    error = f"{type(e).__name__}: {e}"
                store.write(f"{place}.part", json.dumps([answer, error, due]).encode())
                store.move(f"{place}.part", place)
            rows.append((r.request, r.text, attempt, answer, error, due))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in ROUND.split(", ")])


def answered(
    questions: DataFrame, client: Callable[[str], str], tries: int = 3, log: str | None = None, now: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep
) -> DataFrame:
    """request, text, attempts, answer, error, due: the last attempt of every distinct request (request, text) of `questions`.

    `log` is the folder of the answers, by default one of this call; one that is given again is not paid for twice.
    """
    spark = questions.sparkSession
    log = log or f"{store.shared_dir(spark)}/answers-{time.time_ns()}"
    open_ = questions.select("request", "text").dropDuplicates(["request"]).select("*", F.lit(0).alias("attempts"), F.lit(0.0).alias("due"))
    done = spark.createDataFrame([], ROUND)
    for _ in range(tries):
        if not open_.limit(1).count():
            break
        asked = store.stored(open_.mapInPandas(partial(_asked, client=client, log=log, now=now, sleep=sleep), ROUND), "round")
        done = done.unionByName(asked.filter("error is null"))
        failed = asked.filter("error is not null")
        open_ = failed.select("request", "text", "attempts", "due")
    else:
        done = done.unionByName(failed)
    return done


def entities(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Entities (as `detect.ENTITY`) of every document, from the answers to its questions; answers that are no JSON give none. Each entity is listed once a document."""
    found = questions.select("doc_id", "request").join(answers.select("request", "answer"), "request").select("doc_id", F.explode(parsed_entities(F.col("answer"))).alias("e"))
    found = found.filter(F.coalesce(F.col("e.text"), F.lit("")) != "")
    rows = found.select(
        "doc_id", "e.text", F.coalesce("e.replacement", F.lit("XXX")).alias("replacement"), F.coalesce("e.category", F.lit("other")).alias("category"),
        F.coalesce("e.confidence", F.lit(0.8)).alias("confidence"), F.lit("llm").alias("source"), F.col("e.evidence").alias("evidence"),
    )
    best = Window.partitionBy("doc_id", "text", "replacement", "category").orderBy(F.desc("confidence"), "evidence")
    return rows.withColumn("n", F.row_number().over(best)).filter("n = 1").select(*[c.split()[0] for c in ENTITY.split(", ")])
