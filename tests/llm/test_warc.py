"""WARC archives against plain Python over the same rows, and archives of other writers."""

import gzip
import hashlib

import pytest

from inkveil.llm import warc

BIG = "é" * 700_000
PAGES = [
    (1, "http://a/", "x" * 999), (2, "http://b/", "x" * 999), (3, "http://c/", "y" * 1000), (4, None, "y" * 1000), (4, "http://d/\r\nWARC-Type: x", "y" * 1000), (5, "http://e/", BIG),
    (9, "http://f/ü", BIG), (6, "", None), (7, "http://g/", ""), (None, "http://h/", "y" * 1000), (None, None, "z\r\n\r\nWARC/1.1\r\n"), (-8, "http://i/", "z" * 5000),
]


def expected(pages, least=1000):
    rows = []
    for i, _, text in pages:
        data = (text or "").encode()
        keep = max((j for j, _, t in pages if (t or "") == (text or "") and j is not None), default=None)
        alone = len(data) < least or i == keep or keep is None
        rows.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if alone else "revisit", None if alone else keep))
    return sorted(map(repr, rows))


@pytest.mark.parametrize("chunk, archive", [(1 << 18, 1 << 30), (777, 500)])
def test_round_trip(spark, chunk, archive):
    pages = spark.createDataFrame([(*p, "k", 5) for p in PAGES], "page_id long, url string, html string, key string, digest int")
    got = warc.round_trip(pages, chunk_bytes=chunk, archive_bytes=archive)
    assert sorted(repr(tuple(r)[:5]) for r in got.collect()) == expected(PAGES)
    assert {r.target_uri for r in got.collect()} >= {"http://d/%0D%0AWARC-Type:%20x", "http://f/ü", None}


def test_many_copies(spark):
    pages = spark.range(4000).selectExpr("id as page_id", "'u' as url", "if(id % 3 = 0, repeat('same ', 300), concat(repeat('own ', 300), id div 2)) as html")
    got = warc.round_trip(pages.repartition(5)).groupBy("record_type").count().collect()
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    assert max(r["count"] for r in got if r.record_type == "response") == len({t for _, _, t in rows}) and sum(r["count"] for r in got) == 4000


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_chunks_carry_digests(spark, tmp_path):
    rows = warc.decided(spark.createDataFrame([(1, "u", "abcdefgh"), (2, "v", "")], "page_id long, url string, html string"))
    manifest = warc.written(warc.chunked(rows, 3), f"file://{tmp_path}")
    got = [(r.record_id, r.chunk_no, bytes(r.data), r.payload_bytes, r.payload_digest, r.last) for r in warc.read(manifest, 3).orderBy("record_id", "chunk_no").collect()]
    sha = lambda b: hashlib.sha1(b).hexdigest()
    assert got == [
        ("urn:record:1", 0, b"abc", 3, sha(b"abc"), False), ("urn:record:1", 1, b"def", 6, sha(b"abcdef"), False), ("urn:record:1", 2, b"gh", 8, sha(b"abcdefgh"), True),
        ("urn:record:2", 0, b"", 0, sha(b""), True),
    ]
    assert warc.listed(spark, f"file://{tmp_path}").count() == manifest.count() and manifest.agg({"records": "sum"}).first()[0] == 2


FOREIGN = (
    b"WARC/1.0\r\nWARC-Type: request\r\nWARC-Record-ID: <urn:r>\r\nContent-Length: 3\r\n\r\nGET\r\n\r\n"
    b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:a>\r\nWARC-Target-URI: http://x\r\n y\r\nWARC-Payload-Digest: sha1:VL2MMHO4YXUKFWV63YHTWSBM3GXKSQ2N\r\n"
    b"Content-Type: application/http; msgtype=response\r\nContent-Length: 22\r\n\r\nHTTP/1.0 200\r\nA: b\r\n\r\n"
)


def test_other_writers(spark, tmp_path):
    body = FOREIGN + b"\r\n\r\nWARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:b>\r\nContent-Type: text/plain\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    body = body.replace(b"WARC-Payload-Digest: sha1:VL2MMHO4YXUKFWV63YHTWSBM3GXKSQ2N\r\n", b"")
    (tmp_path / "a.warc").write_bytes(body)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(body))
    got = sorted((r.record_id, r.record_type, r.target_uri, bytes(r.data)) for r in warc.read(warc.listed(spark, f"file://{tmp_path}")).collect())
    assert got == [("urn:a", "response", "http://x y", b"")] * 2 + [("urn:b", "resource", None, b"hello")] * 2


@pytest.mark.parametrize("damage", [lambda b: b[:-20], lambda b: b.replace(b"hello", b"hullo")])
def test_damage_stops(spark, tmp_path, damage):
    good = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:b>\r\nWARC-Payload-Digest: sha1:" + hashlib.sha1(b"hello" * 9).hexdigest().encode() + b"\r\nContent-Length: 45\r\n\r\n" + b"hello" * 9
    (tmp_path / "a.warc").write_bytes(damage(good))
    with pytest.raises(Exception, match="cut off|digest states"):
        warc.read(warc.listed(spark, f"file://{tmp_path}")).collect()
