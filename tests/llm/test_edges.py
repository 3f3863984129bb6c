"""Nulls, empty tables, repeated rows and clashing names: operators and stages give defined results."""

import pytest

import corpus_pipeline
from inkveil.llm import chat, mixing, quality, spm

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the house by the river was built in the year of the flood and nobody knew who had paid for it "
LONG = PROSE * 30_000


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def test_chat_empty(spark):
    assert chat.digest(chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_quality_null_ids_clashing_names_and_empty_tables(spark):
    rows = [(None, PROSE * 5, "a"), (1, None, "b"), (1, None, "b")]
    got = quality.judged(spark.createDataFrame(rows, "ws long, text string, n_words string"), id_col="ws").collect()
    assert sorted((r.doc_id or 0, r.n_words) for r in got) == [(0, 105), (1, 0), (1, 0)]
    assert quality.judged(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sentencepiece_null_ids_repeated_rows_and_empty_tables(spark):
    got = spm.decisions(docs(spark, [(None, "a b", "en", "s", 3), (1, "a b", "en", "s", 3), (1, "a b", "en", "s", 3), (2, None, None, None, None), (3, "", "en", "s", 0)]))
    assert got.count() == 5 and got.filter("doc_id is null").count() == 1
    assert spm.decisions(docs(spark, [])).count() == 0


def test_mixing_of_very_long_texts(spark):
    got = mixing.decisions(docs(spark, [(1, LONG, "en", "s", 1), (2, "short", "en", "s", 1), (None, None, None, None, None)]))
    assert got.count() == 3 and 0 <= got.agg({"probability": "min"}).first()[0] <= got.agg({"probability": "max"}).first()[0] <= 1


ROWS = [
    (1, PROSE * 3, "en", "a", 1), (2, PROSE.upper() * 3, "en", "a", 1), (2, PROSE.upper() * 3, "en", "a", 1), (3, None, "en", "a", 1), (4, "", None, None, None), (None, PROSE * 4, "en", "b", 1),
    (5, "12 34 !!", "en", "b", 1), (6, "der Hund und die Katze sind im Haus und das Wetter ist schön " * 4, "de", "b", 1),
]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, name, stage):
    """Every stage works on nulls, empty texts and repeated rows, keeps the columns of documents (the last adds some), and gives nothing for nothing."""
    rows = docs(spark, ROWS)
    out = stage(spark, rows, None)
    assert out.columns[: len(rows.columns)] == rows.columns and (name == "sentencepiece" or out.columns == rows.columns)
    kept = sorted((r.doc_id or 0, r.text or "") for r in out.select("doc_id", "text").collect())
    every = sorted((i or 0, t or "") for i, t, *_ in ROWS)
    want = {
        "language ID": lambda: len(kept) <= len(every) and {1, 2, 6} <= {i for i, _ in kept} and not {4, 5} & {i for i, _ in kept},
        "exact dedup": lambda: [i for i, _ in kept] == [0, 2, 4, 5, 6],
        "near dedup": lambda: {5, 6} <= {i for i, _ in kept},
        "mixing": lambda: set(kept) <= set(every),
        "sentencepiece": lambda: kept == every,
    }[name]
    assert want()
    assert stage(spark, docs(spark, []), None).count() == 0
