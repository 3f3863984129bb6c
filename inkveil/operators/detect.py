"""Entities as a table: role words, date ranges, and an injected client for language models."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions import lexicon as lx
from inkveil.functions.packs import _DAY, _JOIN, _MONTH, _YEAR
from inkveil.functions.rules import char_class
from inkveil.operators.spans import chunks

ENTITY = "doc_id long, text string, replacement string, category string, confidence double, source string, evidence string"
LLM_ENTITY = "array<struct<text:string,replacement:string,category:string,confidence:double,evidence:string>>"


def role_names(docs: DataFrame, text: str = "text") -> DataFrame:
    """Names of 2 to 4 characters after a role word."""
    found = [F.transform(F.regexp_extract_all(F.col(text), F.lit(f"(?U){p}([一-龥]{{2,4}})"), F.lit(1)), lambda n: n) for p in lx.ROLE_PATTERNS]
    names = docs.select("doc_id", F.explode(F.concat(*found)).alias("text")).filter(~F.col("text").isin(lx.ROLE_EXCLUDED))
    return names.select("doc_id", "text", F.lit("XXX").alias("replacement"), F.lit("NAME").alias("category"), F.lit(0.85).alias("confidence"), F.lit("role_word").alias("source"), F.lit(None).cast("string").alias("evidence"))


def date_ranges(docs: DataFrame, text: str = "text") -> DataFrame:
    """Date ranges in the three spellings; the replacement keeps the connector."""
    spellings = [(rf"\d{{4}}年{_MONTH}月{_DAY}日", "YYYY年MM月DD日"), (f"{_YEAR}/{_MONTH}/{_DAY}", "YYYY/MM/DD"), (f"{_YEAR}-{_MONTH}-{_DAY}", "YYYY/MM/DD")]

    def ranges(date: str, mask: str) -> Column:
        pattern = rf"{date}{_JOIN}{date}(?!\d)"
        hits = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
        return F.transform(hits, lambda h: F.struct(h.alias("text"), F.concat(F.lit(mask), F.regexp_extract(h, pattern, 1), F.lit(mask)).alias("replacement")))

    parts = [ranges(*s) for s in spellings]
    rows = docs.select("doc_id", F.explode(F.concat(*parts)).alias("e"))
    return rows.select("doc_id", "e.text", "e.replacement", F.lit("DATE").alias("category"), F.lit(0.95).alias("confidence"), F.lit("regex").alias("source"), F.lit(None).cast("string").alias("evidence"))


def prescreened(docs: DataFrame, text: str = "text", least: int = 8) -> DataFrame:
    """doc_id, para: the paragraphs that may hold names (a role word, or a surname before a Chinese character and one more), once each."""
    keyword = "负责人|联系人|支持人员|编写人|审核人|批准人"
    paras = docs.filter(F.length(F.trim(F.col(text))) >= least).select("doc_id", F.explode(F.split(F.col(text), "\n", -1)).alias("para"))
    named = F.length("para").between(2, 300) & F.col("para").rlike(f"(?s){char_class(lx.SURNAMES)}[一-鿿].")
    return paras.filter(F.col("para").rlike(keyword) | named).distinct()


def parsed_entities(content: Column) -> Column:
    """Entities of a model's answer: an object with `entities`, a bare array, or either inside a fence or other text; null if none."""
    fenced = F.regexp_extract(content, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(content)
    inner = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    whole = f"struct<entities:{LLM_ENTITY}>"
    return F.coalesce(F.from_json(body, whole)["entities"], F.from_json(inner, whole)["entities"], F.from_json(F.regexp_extract(body, r"(?s)(\[.*\])", 1), LLM_ENTITY))


def _answered(answer: str, doc: int) -> list[tuple]:
    """Rows of a model's answer. What is no entity (no object, no text, a confidence that is no number) is left out or gets the default."""
    found = json.loads(re.search(r"[\[{].*[\]}]", answer, re.DOTALL)[0])
    found = found.get("entities") if isinstance(found, dict) else found
    rows = []
    for e in found if isinstance(found, list) else ():
        if isinstance(e, dict) and isinstance(e.get("text"), str) and e["text"]:
            try:
                sure = float(e.get("confidence", 0.8))
            except (TypeError, ValueError):
                sure = 0.8
            said = [str(e[k]) if e.get(k) else default for k, default in (("replacement", "XXX"), ("category", "other"), ("evidence", None))]
            rows.append((doc, e["text"], said[0], said[1], sure, "llm", said[2]))
    return rows


def _asked(frames: Iterator[pd.DataFrame], client: Callable[[str], str], tries: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
            for _ in range(tries):
                try:
                    rows += _answered(client(text), doc)
                    break
                except Exception:  # a client that fails leaves its text to the rules
                    continue
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in ENTITY.split(", ")])


def model_entities(docs: DataFrame, client: Callable[[str], str] | None, text: str = "text", limit: int = 6000, tries: int = 3) -> DataFrame:
    """Entities that a client (text in, JSON out) finds; without a client none. A long text is asked about in chunks of `limit` characters,
    of which the next begins 200 before the last one ends, and a call that fails is made `tries` times."""
    rows = chunks(docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")), size=limit).select("doc_id", F.col("chunk_text").alias("text"))
    asked = rows.filter(F.lit(client is not None)).mapInPandas(partial(_asked, client=client, tries=tries), ENTITY)
    return asked.dropDuplicates(["doc_id", "text", "replacement", "category"])


def detected(docs: DataFrame, client: Callable[[str], str] | None = None, text: str = "text", least_confidence: float = 0.0) -> DataFrame:
    """Entities of all layers, one row each."""
    return model_entities(docs, client, text).unionByName(date_ranges(docs, text)).unionByName(role_names(docs, text)).filter(F.col("confidence") >= least_confidence)


def entities_replaced(text: Column, entities: Column) -> Column:
    """Literal replacement of entities (array of struct text, replacement), the longest first; null replacements keep the text."""
    usable = F.filter(entities, lambda e: e["replacement"].isNotNull() & (F.length(F.trim(e["text"])) >= 2))
    ordered = F.sort_array(F.transform(usable, lambda e: F.struct((-F.length(e["text"])).alias("n"), e["text"].alias("text"), e["replacement"].alias("replacement"))))
    return F.aggregate(ordered, text, lambda t, e: F.replace(t, e["text"], e["replacement"]))


def preview(text: Column) -> Column:
    """An entity as reports show it: its first four characters at most."""
    return F.when(F.length(text) > 4, F.concat(F.substring(text, 1, 4), F.lit("****"))).otherwise(F.lit("****"))
