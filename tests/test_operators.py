"""Spans, detection, boxes, pictures, documents, batches and reports on small literal tables."""

import io
import json
import zipfile

import numpy as np
from pyspark.sql import functions as F

from inkveil import catalog
from inkveil.operators import boxes, counts, detect, pixels
from inkveil.operators import spans as span_ops
from inkveil.plans import batch, report
from inkveil.sources import files, ooxml
from inkveil.streaming import resume

WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(paragraphs):
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as archive:
        body = "".join("<w:p>" + "".join(f"<w:r><w:t>{t}</w:t></w:r>" for t in p) + "</w:p>" for p in paragraphs)
        archive.writestr("word/document.xml", f'<w:document xmlns:w="{WORD}"><w:body>{body}</w:body></w:document>')
        archive.writestr("word/media/image1.png", b"\x89PNG")
    return made.getvalue()


def test_merge_and_greedy(spark):
    rows = spark.createDataFrame([(1, *s, str(s)) for s in [(0, 5), (3, 8), (8, 9), (20, 22), (21, 21)]], "doc_id int, start int, end int, replacement string")
    assert sorted(tuple(r)[1:3] for r in span_ops.merged(rows, ["doc_id"]).collect()) == [(0, 8), (8, 9), (20, 22)]


def test_paragraph_over_runs(spark):
    runs = ["2017年", "4", "月", "11", "日", "15:30-16:30"]
    nodes = spark.createDataFrame([(1, k, t) for k, t in enumerate(runs)], "doc_id int, node_idx int, text string")
    placed = span_ops.offsets(nodes, ["doc_id"], ["node_idx"])
    cut = spark.createDataFrame([(1, 0, 10, "YYYY/MM/DD ")], "doc_id int, start int, end int, replacement string")
    got = span_ops.redistributed(placed, cut, ["doc_id"], ["node_idx"]).orderBy("node_idx").collect()
    assert [r.text for r in got] == ["YYYY/MM/DD ", "", "", "", "", "15:30-16:30"]


def test_packing_and_chunks(spark):
    paras = spark.createDataFrame([(1, k, "x" * n) for k, n in enumerate([150, 60, 140, 300, 10])], "doc_id int, para int, text string")
    assert [r.batch for r in span_ops.packed(paras, ["doc_id"], "para").orderBy("para").collect()] == [0, 1, 1, 2, 3]
    docs = spark.createDataFrame([("a" * 13000,), ("b" * 6000,), ("",)], "text string")
    got = span_ops.chunks(docs).select(F.length("chunk_text").alias("n")).collect()
    assert sorted(r.n for r in got) == [0, 1400, 6000, 6000, 6000]


def test_detection(spark):
    docs = spark.createDataFrame([(1, "联系人：汪晶晶，主办行：项目组"), (2, "2024/03/15 至 2024/03/20"), (3, None), (4, "")], "doc_id long, text string")

    def client(text):
        if not text:
            raise ValueError("no text")
        return '```json\n[{"text": "甲", "replacement": null, "category": "ORG"}]\n```'

    got = {(r.doc_id, r.text, r.replacement, r.source) for r in detect.detected(docs, client).collect()}
    assert {(1, "汪晶晶", "XXX", "role_word"), (2, "2024/03/15 至 2024/03/20", "YYYY/MM/DD 至 YYYY/MM/DD", "regex"), (1, "甲", "XXX", "llm")} <= got
    assert detect.detected(docs).filter("source = 'llm'").count() == 0
    assert detect.detected(docs, client, least_confidence=0.9).count() == 1
    for answer in ('["a", "b"]', '[{"text": "x", "confidence": "high"}, {"text": 5}, 7]', '{"entities": null}', "nothing"):
        rows = detect.model_entities(docs, lambda text, a=answer: a).collect()
        assert {(r.text, r.confidence) for r in rows} == ({("x", 0.8)} if "high" in answer else set())


def test_answers_of_models(spark):
    rows = ['{"entities":[{"text":"a"}]}', '[{"text":"b"}]', 'x ```json\n{"entities":[{"text":"c"}]}\n``` y', "broken {", None]
    got = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, c string").select("k", detect.parsed_entities(F.col("c")).alias("e")).orderBy("k").collect()
    assert [[x.text for x in r.e] if r.e else None for r in got] == [["a"], ["b"], ["c"], None, None]


def test_boxes(spark):
    rows = spark.createDataFrame([([(0, 0, 10, 10), (30, 5, 40, 15), (200, 0, 210, 10), (45, 100, 50, 110)],)], "bs array<struct<x1:int,y1:int,x2:int,y2:int>>")
    assert [tuple(b) for b in rows.select(boxes.merged(F.col("bs")).alias("b")).first().b] == [(0, 0, 40, 15), (45, 100, 50, 110), (200, 0, 210, 10)]


def test_pictures(spark):
    picture = np.arange(40 * 60 * 3, dtype=np.uint8).reshape(40, 60, 3)
    for method in pixels.METHODS:
        rows = spark.createDataFrame([("a", 40, 60, 3, bytearray(picture.tobytes()), [(5, 5, 45, 35)])], "origin string, height int, width int, nChannels int, data binary, boxes array<struct<x1:int,y1:int,x2:int,y2:int>>")
        out = np.frombuffer(pixels.mask(rows, method).first().data, np.uint8).reshape(picture.shape)
        assert (out[:5] == picture[:5]).all() == (method != "whole") and (out[5:35, 5:45] != picture[5:35, 5:45]).any()
    assert len(np.unique(pixels.mosaic(picture[:32, :32]).reshape(-1, 3), axis=0)) <= 4
    assert (pixels.blur(np.full((20, 20, 3), 7, np.uint8)) == 7).all()
    std, edges, fill, levels = pixels.statistics(np.array([[0, 0, 0, 200]] * 4, np.uint8))
    assert (fill, levels) == (0.25, 2) and std > 80 and 0 < edges <= 0.5


def test_batch_of_documents(spark, tmp_path):
    source, target, state = tmp_path / "in", tmp_path / "out", str(tmp_path / "state")
    source.mkdir()
    (source / "sub").mkdir()
    (source / "sub" / "a.docx").write_bytes(docx([["手机 ", "13812345678", " ，邮箱 ", "a@b.cc"], ["plain"]]))
    (source / "a.docx").write_bytes(docx([["联系人：汪晶", "晶"], ["plain"]]))
    (source / "b.docx").write_bytes(b"no zip")
    (source / "c.pdf").write_bytes(b"%PDF")
    (source / "d.txt").write_bytes(b"ignored")
    got = {r.input_path.split("/in/", 1)[1]: r for r in batch.run(spark, str(source), str(target), state=state).collect()}
    assert {k: r.status for k, r in got.items()} == {"a.docx": "success", "sub/a.docx": "success", "b.docx": "failed", "c.pdf": "failed"}
    assert got["a.docx"].entities_count == 1 and got["sub/a.docx"].entities_count == 2 and got["c.pdf"].duration_ms == 0
    with zipfile.ZipFile(target / "sub" / "a_脱敏.docx") as archive:  # runs keep their text around what was masked
        assert [t for _, t, _ in ooxml.texts(archive.read("word/document.xml"))] == ["手机 ", "XXXXXXXXXXX", " ，邮箱 ", "XXXXX@XXXXX", "plain"]
    with zipfile.ZipFile(target / "a_脱敏.docx") as archive:
        text = archive.read("word/document.xml").decode()
    assert "联系人：XXX" in text and "汪" not in text and "plain" in text
    again = {r.input_path.split("/in/", 1)[1]: r.status for r in batch.run(spark, str(source), str(target), state=state).collect()}
    assert again == {"b.docx": "failed", "c.pdf": "failed"}
    skipped = {r.input_path.split("/in/", 1)[1]: r.status for r in batch.run(spark, str(source), str(target), types=["word"]).collect()}
    assert skipped == {"a.docx": "skipped", "sub/a.docx": "skipped", "b.docx": "failed"}


def test_cells_that_hold_numbers_are_masked(spark, tmp_path):
    sheet = '<worksheet xmlns="http://x/main"><sheetData><row><c r="A1"><v>13812345678</v></c><c r="B1" t="s"><v>0</v></c><c r="C1"><v>12.5</v></c></row></sheetData></worksheet>'
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as archive:
        archive.writestr("xl/worksheets/sheet1.xml", sheet)
        archive.writestr("xl/sharedStrings.xml", '<sst xmlns="http://x/main"><si><t>a@b.cc</t></si></sst>')
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "n.xlsx").write_bytes(made.getvalue())
    (tmp_path / "out").write_bytes(b"a file where the folder should be")
    assert [r.status for r in batch.run(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()] == ["failed"]
    row = batch.run(spark, str(tmp_path / "in"), str(tmp_path / "new" / "out")).first()
    assert row.status == "success" and row.entities_count == 2
    with zipfile.ZipFile(tmp_path / "new" / "out" / "n_脱敏.xlsx") as archive:
        text = archive.read("xl/worksheets/sheet1.xml").decode()
        assert "<v>XXXXXXXXXXX</v>" in text.replace("ns0:", "").replace(":v", "v") and "13812345678" not in text and 't="str"' in text and "12.5" in text
        assert "XXXXX@XXXXX" in archive.read("xl/sharedStrings.xml").decode()


def test_broken_documents_are_rows(spark):
    rows = spark.createDataFrame([("x.docx", bytearray(b"broken")), ("y.docx", bytearray(docx([["t"]])))], "path string, content binary")
    got = ooxml.nodes(rows).collect()
    assert sorted((r.path, r.error is None) for r in got) == [("x.docx", False), ("y.docx", True)]


def test_report(spark):
    rows = [("/a.docx", "success", "", 10, 3, 2000), ("/b.pdf", "failed", "e" * 100, 5, 0, 10), ("/c.docx", "skipped", "", 0, 0, 0)]
    results = spark.createDataFrame(rows, "input_path string, status string, error string, duration_ms long, entities_count long, file_size long")
    text = report.markdown(results)
    assert "| 3 | 1 | 1 | 1 | 3 | 2.0 KB | 15 |" in text and "- /b.pdf: " + "e" * 60 + "\n" in text
    assert report.totals(results.limit(0)).first().n_total == 0
    many = spark.range(1500).selectExpr("concat('/', id, '.pdf') as input_path", "'failed' as status", "'e' as error", "0L as duration_ms", "0L as entities_count", "0L as file_size")
    assert report.markdown(many).count("- /") == 1500


def test_manifest_shows_no_entity(spark):
    docs = spark.createDataFrame([(1, "联系人：汪晶晶，")], "doc_id long, text string")
    manifest = json.loads(report.manifests(detect.detected(docs)).first().manifest)
    assert manifest["stats"] == {"NAME": 1} and manifest["entities"][0]["text"] == "****"


def test_resume(spark):
    state = spark.createDataFrame([("a", "failed", "x", 1), ("a", "success", "", 2), ("b", "failed", "y", 1)], resume.STATE)
    paths = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    assert sorted(r.path for r in resume.pending(paths, state).collect()) == ["b", "c"]
    assert tuple(resume.summary(state).first()) == (1, 1, 2)


def test_files(spark):
    rows = spark.createDataFrame([("/x/a.DOCX",), ("/x.y/b",), ("c.tar.png",)], "path string")
    got = rows.select(files.file_type(F.col("path")).alias("t"), files.output_path(F.col("path"), "/o").alias("o")).collect()
    assert [tuple(r) for r in got] == [("word", "/o/a_脱敏.DOCX"), (None, "/o/b_脱敏"), ("image", "/o/c.tar_脱敏.png")]


def test_counts_add_up(spark):
    from inkveil.functions.packs import g2

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pack = g2().only("email", "ipv4")
    whole = {r.rule_id: r.n for r in counts.by_rule(docs, pack).collect()}
    parts = {r.rule_id: r.n for r in counts.by_rule(docs, pack, "text", "lang").groupBy("rule_id").agg(F.sum("n").alias("n")).collect()}
    assert whole == parts


def test_size_in_the_largest_unit(spark):
    rows = spark.createDataFrame([(1023,), (1536,), (1 << 30,), (3095205 * 512,), (5 << 40,)], "n long")
    got = rows.select(files.readable_size(F.col("n")), files.readable_size(F.col("n"), "MB")).collect()
    assert [tuple(r) for r in got] == [("1023.0 B", "1023.0 B"), ("1.5 KB", "1.5 KB"), ("1.0 GB", "1024.0 MB"), ("1.5 GB", "1511.3 MB"), ("5.0 TB", "5242880.0 MB")]


def test_format_size_beyond_a_gigabyte(spark, tmp_path):
    spark.createDataFrame([(2097151,), (3095205,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = catalog.queries()["format_size"](spark, str(tmp_path)).collect()
    assert sorted(r["size"] for r in got) == ["1024.0 MB", "1511.3 MB"]
