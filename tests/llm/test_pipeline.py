"""The whole corpus pipeline against plain versions of its stages."""

import sentencepiece
from tests.llm.test_models import brute_classes

import corpus_pipeline
from inkveil.llm import langid, mixing, near_dedup, spm

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_pipeline_against_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    left = {r.doc_id for r in langid.predicted(docs).collect() if r.lang_pred != "und"}
    best = {}
    for i in sorted(left):
        best[rows[i].text.translate(LOWER)] = i
    left = sorted(best.values())
    held = spark.createDataFrame([rows[i] for i in left], docs.schema)
    left = sorted(set(brute_classes([(i, rows[i].text) for i in left], near_dedup.inverse_frequencies(held.select("text"))).values()))
    held = spark.createDataFrame([rows[i] for i in left], docs.schema)
    left = {r.doc_id for r in mixing.decisions(held).collect() if r.kept}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == left and left
    library = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)
    for i, r in got.items():
        assert (r.text, r.lang, r.source, r.n_chars) == (rows[i].text, rows[i].lang, rows[i].source, rows[i].n_chars)
        assert r.piece_ids == library.encode(r.text) and r.round_trip
