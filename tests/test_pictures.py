"""Picture files: read, masked by text boxes and logos, saved, and read again."""

import re
import urllib.parse
import zipfile

import duckdb
import numpy as np
import pytest

from inkveil import catalog
from inkveil.functions.packs import g2
from inkveil.operators import pixels
from inkveil.plans import batch
from inkveil.sources import ooxml, pictures, raster

OCR = "path string, text string, left int, top int, width int, height int"


def noise(h, w, c=3, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (h, w, c), np.uint8)


def loaded(spark, path):
    r = pictures.read(spark, str(path)).first()
    return np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_png_round_trip(spark, tmp_path, channels):
    picture = noise(17, 33, channels)
    (tmp_path / "a.png").write_bytes(raster.png(picture))
    assert raster.size(raster.png(picture)) == (33, 17)
    got = loaded(spark, tmp_path / "a.png")
    assert got.shape == picture.shape and (got == picture).all()


def test_headers():
    assert raster.size(b"GIF89a" + bytes([7, 0, 5, 0])) == (7, 5) and raster.size(b"BM" + bytes(16) + (9).to_bytes(4, "little") + (-4).to_bytes(4, "little", signed=True)) == (9, 4)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x0a\x00\x14" + bytes(9)
    assert raster.size(jpeg) == (20, 10) and raster.size(b"") is None and raster.size(b"\xff\xd8\xff\xe0\x00\x04ab") is None


@pytest.mark.parametrize("method", ["mosaic", "blur", "black"])
def test_text_boxes_and_logos(spark, method):
    picture = noise(200, 500)
    picture[40:120, 0:340] = 7  # a quiet region: a logo
    rows = spark.createDataFrame([("/a.png", 200, 500, 3, bytearray(picture.tobytes())), ("/bad.png", -1, -1, -1, None)], pictures.PICTURE)
    ocr = spark.createDataFrame([("/a.png", " 13812345678 ", 400, 150, 40, 10), ("/a.png", "plain", 10, 10, 20, 10), ("/a.png", "海峡银行", 320, 60, 30, 20), ("/a.png", "", 0, 0, 5, 5), ("/other", "13812345678", 1, 1, 5, 5)], OCR)
    got = {r.path: r for r in pixels.redacted(rows, ocr, g2(), method).collect()}
    texts = [(317, 57, 353, 83), (397, 147, 443, 163)]
    want = pixels.masked(picture, texts, method)
    area = (0, 0, 370, 140)
    assert pixels.is_logo(picture[area[1] : area[3], area[0] : area[2]])
    want = pixels.masked(want, [area], "mosaic")
    out = np.frombuffer(got["/a.png"].data, np.uint8).reshape(picture.shape)
    assert (out == want).all() and (got["/a.png"].n_texts, got["/a.png"].n_logos) == (2, 1) and got["/bad.png"].height == -1


def test_regions_that_are_near_are_one():
    assert pixels.joined([(100, 0, 120, 10), (0, 0, 60, 10), (300, 0, 310, 10), (115, 10, 130, 20)]) == [(0, 0, 130, 20), (300, 0, 310, 10)]


def test_batch_of_pictures(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    picture = noise(60, 120)
    (source / "a.png").write_bytes(raster.png(picture))
    (source / "bad.jpg").write_bytes(b"no picture")
    ocr = spark.createDataFrame([(f"file:{source}/a.png", "a@b.cc", 10, 10, 50, 20)], OCR)
    got = {r.input_path.rpartition("/")[2]: r for r in batch.run(spark, str(source), str(target), ocr=ocr).collect()}
    assert {k: (r.status, r.entities_count) for k, r in got.items()} == {"a.png": ("success", 1), "bad.jpg": ("failed", 0)} and "decoded" in got["bad.jpg"].error
    assert (loaded(spark, target / "a_脱敏.png") == pixels.masked(picture, [(7, 7, 63, 33)], "mosaic")).all()
    again = {r.input_path.rpartition("/")[2]: r.status for r in batch.run(spark, str(source), str(target), ocr=ocr).collect()}
    assert again == {"a.png": "skipped", "bad.jpg": "failed"}
    assert {r.status for r in batch.run(spark, str(source), str(tmp_path / "none")).collect()} == {"failed"}


def test_media_in_documents(spark, tmp_path):
    """Logos become black pictures of their size; what points at a renamed picture follows it."""
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x0a\x00\x14" + bytes(9)
    rels = '<Relationships><Relationship Id="r1" Target="media/bank_logo.jpg"/><Relationship Id="r2" Target="media/a%20%E6%8B%9B%E5%95%86%E9%93%B6%E8%A1%8C.png"/><Relationship Id="r3" Target="styles.xml"/></Relationships>'
    types = '<?xml version="1.0"?><Types xmlns="t"><Default Extension="jpg" ContentType="image/jpeg"/></Types>'
    photo = raster.png(noise(400, 1200))
    (tmp_path / "in").mkdir()
    made = {"[Content_Types].xml": types, "word/_rels/document.xml.rels": rels, "word/document.xml": "<d xmlns:w='w'><w:p><w:t>x</w:t></w:p></d>", "word/media/bank_logo.jpg": jpeg, "word/media/a 招商银行.png": photo, "word/media/bank.emf": b"?", "word/media/photo.png": photo}
    for name in ("a.docx", "b.pptx"):
        with zipfile.ZipFile(tmp_path / "in" / name, "w") as out:
            for part, data in made.items():
                out.writestr(part.replace("word/", "ppt/") if name == "b.pptx" else part, data)
    got = {r.input_path.rpartition("/")[2]: (r.status, r.entities_count) for r in batch.run(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()}
    assert got == {"a.docx": ("success", 2), "b.pptx": ("success", 2)}
    with zipfile.ZipFile(tmp_path / "out" / "a_脱敏.docx") as found:
        names = set(found.namelist())
        assert names == {"[Content_Types].xml", "word/_rels/document.xml.rels", "word/document.xml", "word/media/bank_logo.png", "word/media/a XX银行.png", "word/media/bank.emf", "word/media/photo.png"}
        targets = [urllib.parse.unquote(t) for t in re.findall('Target="([^"]*)"', found.read("word/_rels/document.xml.rels").decode())]
        assert len(targets) == 3 and all(f"word/{t}" in names for t in targets[:2]) and targets[2] == "styles.xml"
        assert raster.size(found.read(f"word/{targets[0]}")) == (20, 10) and found.read("word/media/photo.png") == photo and found.read("word/media/bank.emf") == b"?"
        assert b'Extension="png"' in found.read("[Content_Types].xml")
        assert not [n for n in names if "招商" in n]
        (tmp_path / "black.png").write_bytes(found.read(f"word/{targets[0]}"))
    assert loaded(spark, tmp_path / "black.png").max() == 0 and ooxml.MEDIA.fullmatch("word/media/x.png")


@pytest.mark.parametrize("name", ["black_pictures", "mosaic_pictures", "picture_levels", "whole_pictures"])
def test_pixels_are_products_of_floats(spark, tmp_path, name):
    """Values whose thousandfold is a whole number as a float and just below it as a double."""
    numbers = np.arange(1, 1000, dtype=np.float32) / np.float32(1000)
    near = [float(x) for x in numbers if int(x * np.float32(1000)) != int(float(x) * 1000)][:64]
    assert len(near) == 64
    spark.createDataFrame([(1, near), (2, [-x for x in near[::-1]]), (3, near[:1] * 32 + [near[0] + 0.0005] * 32)], "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(f"select * from ({catalog.oracle_sql()[name]}) order by vec_id").fetchall()
    assert [tuple(r) for r in catalog.queries()[name](spark, str(tmp_path)).orderBy("vec_id").collect()] == want
