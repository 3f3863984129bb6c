"""Office files: bytes outside changed texts stay, the data source reads and writes, failures leave no file."""

import io
import pickle
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import Row

from inkveil.functions import pieces
from inkveil.plans import batch
from inkveil.sources import files, office, ooxml, store

HEAD = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\r\n<!-- kept --><w:document xmlns:w="http://w" xmlns:mc="http://mc" xmlns:w14="http://w14" xmlns:unused="http://u" mc:Ignorable="w14 unused"'
    "  w:rsid = '1' ><w:body>"
)


def archive(parts):
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as out:
        for name, data in parts.items():
            out.writestr(zipfile.ZipInfo(name, (2020, 2, 3, 4, 5, 6)), data if isinstance(data, bytes) else data.encode())
    return made.getvalue()


def parts(content):
    with zipfile.ZipFile(io.BytesIO(content)) as found:
        return {i.filename: found.read(i) for i in found.infolist()}


def redacted(spark, content, pack="g2"):
    files = spark.createDataFrame([("/a.docx", bytearray(content))], "path string, content binary")
    changed = batch.redacted_nodes(batch.paragraphs(ooxml.nodes(files), pack))
    return bytes(ooxml.rewritten(files, changed).first().content)


def runs(*texts):
    return "<w:p>" + "".join(f"<w:r><w:rPr><w:b/></w:rPr><w:t>{t}</w:t></w:r>" for t in texts) + "</w:p>"


def test_all_other_bytes_stay(spark):
    body = HEAD + runs("a@b.cc ", "KEEP BOLD ", "c@d.ee end") + '<w:p><w:r><w:t xml:space="preserve"> &amp; 13812345678 &lt;x&gt; </w:t></w:r><w:r><w:t/></w:r></w:p><w:p><w:t><![CDATA[e@f.gg]]></w:t></w:p></w:body></w:document>\n'
    files = {"[Content_Types].xml": "<Types/>", "word/document.xml": body, "word/media/i.png": b"\x89PNG\0", "word/glossary/document.xml": HEAD + runs("mail z@y.xx") + "</w:body></w:document>", "word/styles.xml": "<w:styles/>"}
    got = parts(redacted(spark, archive(files)))
    assert list(got) == list(files)
    want = body.replace("a@b.cc", "XXXXX@XXXXX").replace("c@d.ee", "XXXXX@XXXXX").replace("13812345678", "X" * 11).replace("<![CDATA[e@f.gg]]>", "XXXXX@XXXXX")
    assert got["word/document.xml"].decode() == want
    assert got["word/glossary/document.xml"].decode() == files["word/glossary/document.xml"].replace("z@y.xx", "XXXXX@XXXXX")
    assert all(got[n] == (d if isinstance(d, bytes) else d.encode()) for n, d in files.items() if n in ("[Content_Types].xml", "word/media/i.png", "word/styles.xml"))


def test_runs_of_names_in_pack_g3(spark):
    got = parts(redacted(spark, archive({"word/document.xml": HEAD + runs("联系人：", "汪晶", "晶", "，电话 ", "13812345678") + "</w:body></w:document>"}), "g3"))
    assert [t for _, t, _ in ooxml.texts(got["word/document.xml"])] == ["联系人：", "XXX", "", "，电话 ", "XXXXXXXXXXX"]


def test_blanks_at_the_ends_are_kept(spark):
    data = b"<w:document xmlns:w='http://w'><w:p><w:t>ab</w:t></w:p></w:document>"
    (_, _, place), = ooxml.texts(data)
    assert ooxml.spliced(data, [place | {"text": " a<b "}]) == b"<w:document xmlns:w='http://w'><w:p><w:t xml:space=\"preserve\"> a&lt;b </w:t></w:p></w:document>"


@pytest.mark.parametrize("code", ["utf-16", "gbk", "utf-8-sig"])
def test_other_encodings(code):
    name = {"utf-16": "UTF-16", "gbk": "GB2312", "utf-8-sig": "UTF-8"}[code]
    text = f'<?xml version="1.0" encoding="{name}"?><sst xmlns="http://x"><si><t>手机 1</t></si></sst>'
    try:
        found = ooxml.texts(text.encode(code))
    except ooxml.BROKEN:
        assert code == "gbk"  # expat knows few encodings: the file is a row with its error
        return
    (_, old, place), = found
    assert old == "手机 1" and ooxml.spliced(text.encode(code), [place | {"text": "手机 ü"}]).decode(code) == text.replace("手机 1", "手机 ü")


def test_sheets_with_formulas_comments_and_types(spark):
    sheet = (
        "<worksheet xmlns='http://x'><sheetData><row r='1'><c r='A1' s=\"2\"><f>13812345678+0</f><v>13812345678</v></c><c r='B1' t='n'><v>13912345678</v></c>"
        "<c r='C1' t='s'><v>0</v></c><c r='D1' t='b'><v>1</v></c><c r='E1' t=\"str\"><v>a@b.cc</v></c></row></sheetData></worksheet>"
    )
    files = {"xl/worksheets/sheet1.xml": sheet, "xl/comments1.xml": "<comments xmlns='http://x'><commentList><comment ref='A1'><text><r><t>call 13712345678 now</t></r></text></comment></commentList></comments>"}
    got = parts(redacted(spark, archive(files)))
    masked = sheet.replace("<c r='A1' s=\"2\">", "<c t=\"str\" r='A1' s=\"2\">").replace("<v>13812345678", "<v>XXXXXXXXXXX").replace("t='n'><v>13912345678", "t=\"str\"><v>XXXXXXXXXXX").replace("a@b.cc", "XXXXX@XXXXX")
    assert got["xl/worksheets/sheet1.xml"].decode() == masked and "call XXXXXXXXXXX now" in got["xl/comments1.xml"].decode()


def test_slides_and_notes(spark):
    slide = "<p:sld xmlns:p='http://p' xmlns:a='http://a'><a:p><a:r><a:t>mail a@b</a:t></a:r><a:r><a:t>.cc</a:t></a:r></a:p></p:sld>"
    got = parts(redacted(spark, archive({"ppt/slides/slide1.xml": slide, "ppt/notesSlides/notesSlide1.xml": slide})))
    assert all(d.decode() == slide.replace("a@b", "XXXXX@XXXXX").replace(".cc", "") for d in got.values())


def test_archives_with_too_much_in_them_are_rows(monkeypatch):
    monkeypatch.setattr(ooxml, "MOST", 10)
    (row,) = ooxml.archive_nodes("/a.docx", archive({"word/document.xml": "<a>" + " " * 100 + "</a>"}))
    assert "more than 10 bytes" in row[-1]


def test_data_source(spark, tmp_path):
    office.register(spark)
    source = tmp_path / "in" / "deep er"
    source.mkdir(parents=True)
    for k in range(5):
        (source / f"{k}.docx").write_bytes(archive({"word/document.xml": HEAD + runs(f"no {k}", "é") + "</w:body></w:document>"}))
    (source / "broken.pptx").write_bytes(b"no zip")
    (source / "~$lock.docx").write_bytes(b"")
    rows = spark.read.format("office").option("partitionBytes", 700).load(str(tmp_path / "in"))
    assert rows.rdd.getNumPartitions() > 1 and rows.columns == ["path", "part", "para_idx", "node_idx", "text", "place", "error"]
    got = sorted((r.path.rpartition("/")[2], r.node_idx, r.text) for r in rows.filter("error is null").collect())
    assert got == [(f"{k}.docx", n, t) for k in range(5) for n, t in enumerate((f"no {k}", "é"))]
    assert [r.path.rpartition("/")[2] for r in rows.filter("error is not null").collect()] == ["broken.pptx"]
    (tmp_path / "none").mkdir()
    assert spark.read.format("office").load(str(tmp_path / "none")).count() == 0


def test_a_job_that_fails_leaves_no_file(spark, tmp_path):
    office.register(spark)
    good = bytearray(archive({"word/document.xml": HEAD + runs("x") + "</w:body></w:document>"}))
    rows = spark.createDataFrame([(f"/{k}", f"{tmp_path}/out/{k}.docx", good, None) for k in range(4)] + [("/b", f"{tmp_path}/out/b.docx", bytearray(b"bad"), None)], office.ROWS)
    bad = rows.selectExpr("path", "if(path = '/3', assert_true(path = '') is null, true) as ok", "output_path", "content", "changes").select("path", "output_path", "content", "changes", "ok")
    with pytest.raises(Exception, match="assert|failed|USER_RAISED"):
        bad.filter("ok").drop("ok").coalesce(1).write.format("office").mode("append").option("path", f"{tmp_path}/out").save()
    assert not [p for p in (tmp_path / "out").rglob("*") if p.is_file()] if (tmp_path / "out").exists() else True
    rows.write.format("office").mode("append").option("path", f"{tmp_path}/out").option("report", f"{tmp_path}/report.json").save()
    assert sorted(p.name for p in (tmp_path / "out").rglob("*")) == ["0.docx", "1.docx", "2.docx", "3.docx"]
    report = {r.path: r.save_error for r in spark.read.schema(office.REPORT).json(f"{tmp_path}/report.json").collect()}
    assert [k for k, v in report.items() if v] == ["/b"] and len(report) == 5


def test_store(tmp_path):
    where = f"file://{tmp_path}/a/b.bin"
    store.write(where, b"x")
    store.move(where, f"file://{tmp_path}/a/c.bin")
    assert store.read(f"{tmp_path}/a/c.bin") == b"x" and list(store.listed(f"file://{tmp_path}")) == [(f"file://{tmp_path}/a/c.bin", 1)]
    store.remove(f"{tmp_path}/a/c.bin")
    store.remove(f"{tmp_path}/a/c.bin")
    assert not list(store.listed(str(tmp_path)))


def test_stretches_count_once():
    trace = {"gaps": [2, 0], "sizes": [3], "news": [1]}
    assert pieces.composed([trace, {"gaps": [1, 0], "sizes": [2], "news": [5]}]) == [(1, 5, 1, 6)]


def test_nodes_of_small_archives_share_batches(monkeypatch):
    files = [(f"/{k}.docx", archive({"word/document.xml": HEAD + runs(f"no {k}", "é") + "</w:body></w:document>"})) for k in range(30)] + [("/b.docx", b"bad")]
    want = [[(f"/{k}.docx", "word/document.xml", 0, n, t, "text", None) for n, t in enumerate((f"no {k}", "é"))] for k in range(30)]
    rows = lambda batches: [(r["path"], r["part"], r["para_idx"], r["node_idx"], r["text"], r["place"] and r["place"]["form"], r["error"]) for b in batches for r in b.to_pylist()]
    (batch_,) = ooxml.node_batches(files)
    got = rows([batch_])
    assert got[:-1] == sum(want, []) and got[-1][:-1] == ("/b.docx", None, None, None, None, None) and "BadZipFile" in got[-1][-1]
    for name, most in (("BATCH_ROWS", 7), ("BATCH_CHARS", 20)):
        with monkeypatch.context() as m:
            m.setattr(ooxml, name, most)
            batches = list(ooxml.node_batches(files))
        assert len(batches) > 3 and rows(batches) == got
    assert not list(ooxml.node_batches([]))


def test_small_files_are_read_by_many_tasks(tmp_path):
    for k in range(40):
        (tmp_path / f"{k}.docx").write_bytes(b"small")
    parts = office.OfficeReader({"path": str(tmp_path), "partitionBytes": str(10 * office.OPEN)}).partitions()
    assert [len(p.paths) for p in parts] == [10] * 4 and len({x for p in parts for x in p.paths}) == 40


def test_a_scan_of_many_partitions_is_read_by_fewer_tasks(spark):
    cores = spark.sparkContext.defaultParallelism
    many = spark.range(0, 5000, 1, 100 * cores)
    assert files.gathered(many).rdd.getNumPartitions() == -(-100 * cores // files.SCAN_PARTS) and files.gathered(many).distinct().count() == 5000
    assert files.gathered(spark.range(0, 10, 1, 5)).rdd.getNumPartitions() == 5


def test_folders_are_listed_by_tasks(spark, tmp_path):
    for name in ("a.docx", "b c%20.docx", "sub/deep/d.pptx", "sub/é.xlsx", "_state/x.docx", ".hidden/x.docx", "_x.docx", ".y.docx", "k=1/_z=1.docx"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12345"[: len(name) % 4 + 1])
    (tmp_path / "none.docx").write_bytes(b"")
    for path in (str(tmp_path), f"file://{tmp_path}/sub", str(tmp_path / "a.docx"), f"{tmp_path}/*.docx"):
        want = sorted(map(tuple, files.scan(spark, path).select("path", "length").collect()))
        assert sorted(map(tuple, files.listing(spark, path).select("path", "length").collect())) == want and want


def test_the_driver_gets_no_row_for_each_file(tmp_path):
    def written(n, report):
        writer = office.OfficeWriter({"path": str(tmp_path / "out"), "report": str(tmp_path / report)})
        content = archive({"word/document.xml": HEAD + runs("x") + "</w:body></w:document>"})
        message = writer.write(iter([Row(path=f"/{k}", output_path=f"{tmp_path}/out/{n}-{k}.docx", content=content, changes=None) for k in range(n)]))
        size = len(pickle.dumps(message))
        writer.commit([message, None])
        return size

    assert written(200, "b.json") == written(2, "a.json")
    assert len(list((tmp_path / "out").iterdir())) == 202 and len((tmp_path / "b.json").read_text().splitlines()) == 200
    folder = tmp_path / "a long name of a folder that would stand in each of the paths"
    folder.mkdir()
    for k in range(300):
        (folder / f"{k}.docx").write_bytes(b"small")
    (part,) = office.OfficeReader({"path": str(folder)}).partitions()
    assert len(part.paths) == 300 and len(pickle.dumps(part)) < 300 * 12


def test_documents_are_edited_without_a_shuffle(spark):
    content = {f"/{k}.docx": archive({"word/document.xml": HEAD + runs("x ", "138123", "45678") * k + runs("none") + "</w:body></w:document>", "word/b.xml": HEAD + runs("a@b.cc") + "</w:body></w:document>"}) for k in range(40)}
    rows = spark.createDataFrame([(p, bytearray(c)) for p, c in content.items()] + [("/empty.docx", bytearray(archive({"x": "y"})))], "path string, content binary")
    made = ooxml.put_in(batch.edited(rows))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    changed = batch.redacted_nodes(batch.paragraphs(ooxml.nodes(rows)))
    want = {r.path: (parts(r.content), r.n_changed) for r in ooxml.rewritten(rows, changed).collect()}
    assert {r.path: (parts(r.content), r.n_changed) for r in made.collect()} == want and len(want) == 41 and max(n for _, n in want.values()) == 79


def test_rows_of_a_document_that_stand_apart_stop_the_job(spark):
    rows = spark.createDataFrame([(f"/{k}.docx", bytearray(archive({"word/document.xml": HEAD + runs("a@b.cc") * 3 + "</w:body></w:document>"}))) for k in range(2)], "path string, content binary")
    (b,) = batch.edited(rows.coalesce(1)).toArrow().combine_chunks().to_batches()
    assert [len(d.changes) for d in ooxml.edits(iter([b]))] == [3, 3]
    for order in ([0, 3, 1, 2, 4, 5], [1, 0, 2, 3, 4, 5], [0, 1, 2, 3, 4]):
        with pytest.raises(RuntimeError, match="stand together|missing"):
            list(ooxml.edits(iter([b.take(pa.array(order))])))


def test_naming_again_after_an_attempt(tmp_path):
    store.write(f"{tmp_path}/a", b"x")
    store.name(f"{tmp_path}/a", f"{tmp_path}/b")
    store.name(f"{tmp_path}/a", f"{tmp_path}/b")
    with pytest.raises(FileNotFoundError):
        store.name(f"{tmp_path}/a", f"{tmp_path}/c")
    assert store.read(f"{tmp_path}/b") == b"x"
