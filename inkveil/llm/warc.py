"""WARC archives as a table of chunks.

A payload leaves Spark as rows of record identifier and chunk number, and a task streams such rows into compressed archives with the digest
carried from chunk to chunk. Reading streams archives back into the same rows: no task ever holds a whole payload, whatever its size (a source
row is in memory because Parquet gives it whole). Records with equal payloads are written once: others revisit the one with the largest identifier.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import io
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from functools import partial
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm.common import bounded_batches, decided_by_key, discard, fresh, stored

#: Bytes of a chunk, and of an archive after which a task begins another one.
CHUNK, ARCHIVE = 1 << 18, 1 << 30
#: Bytes from which equal payloads are stored once.
LEAST = 1000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NOW = "%Y-%m-%dT%H:%M:%SZ"
MANIFEST = "archive string, records long, bytes long"
CHUNKS = "record_id string, record_type string, refers_to string, target_uri string, stated_digest string, chunk_no long, payload_bytes long, payload_digest string, data binary, last boolean"
_CHUNK_TYPES = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("stated_digest", pa.string()),
    ("chunk_no", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("data", pa.binary()), ("last", pa.bool_()),
])


def record_name(ids: Column) -> Column:
    """The record identifier of a row's id: a URN with the id percent-encoded; that of null is empty."""
    return F.concat(F.lit("urn:record:"), F.coalesce(F.url_encode(ids.cast("string")), F.lit("")))


def row_id(names: Column, kind: str) -> Column:
    """The id of a record identifier, null for that of null."""
    coded = F.regexp_extract(names, "^urn:record:(.*)$", 1)
    return F.when(coded != "", F.url_decode(coded)).cast(kind)


def decided(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST) -> DataFrame:
    """One row for each page: id, url, payload, payload_bytes, digest (SHA-1), keep: the largest id with this payload, null where the page stands alone or is smaller than `least` bytes.

    Payloads are equal if their SHA-256 and lengths are. Groups are counted by partial sums; those with a thousandth of all rows are broadcast
    (there are at most a thousand), so that a payload shared by a third of the pages is decided where its rows are; the others are joined by digest.
    A null payload is empty. Null ids are smaller than all others. An empty table gives no rows.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "digest": F.sha1("payload"), "key": F.sha2("payload", 256)})
    groups = rows.filter(F.col("payload_bytes") >= least).groupBy("key", "payload_bytes").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n"))
    groups = stored(groups.filter("n > 1").select("key", "keep", "n"), "payloads")
    rows = decided_by_key(rows, groups, "key", "keep", "n")
    return rows.select("id", "url", "payload", "payload_bytes", "digest", "keep")


def chunked(rows: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """Rows of `decided` as chunks: record_id, url, refers_to (null: a response), payload_bytes, digest, chunk_no, chunks, data.

    The chunks of a record follow each other in its partition. A revisit has one chunk without data, an empty payload too.
    """
    revisits = F.coalesce(F.col("id") != F.col("keep"), F.col("id").isNull() & F.col("keep").isNotNull())
    chunks = F.when(revisits, 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("payload_bytes") / chunk_bytes))).cast("long")
    rows = rows.select(
        record_name(F.col("id")).alias("record_id"), "url", F.when(revisits, record_name(F.col("keep"))).alias("refers_to"), "payload_bytes", "digest", "payload", chunks.alias("chunks")
    )
    rows = rows.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    data = F.when(F.col("refers_to").isNull(), F.substring("payload", (F.col("chunk_no") * chunk_bytes + 1).cast("int"), F.lit(chunk_bytes)))
    return rows.select("record_id", "url", "refers_to", "payload_bytes", "digest", "chunk_no", "chunks", data.alias("data"))


class _Archive:
    """One compressed archive that is being written: a gzip member for each record, a hidden name until it is complete."""

    def __init__(self, folder: str, name: str) -> None:
        from pyarrow import fs

        parts = urllib.parse.urlsplit(folder)
        self.store, self.folder = (fs.LocalFileSystem(), parts.path) if parts.scheme in ("", "file") else fs.FileSystem.from_uri(folder)
        self.store.create_dir(self.folder, recursive=True)
        self.name, self.uri, self.bytes, self.records = name, f"{folder}/{name}", 0, 0
        self.out = self.store.open_output_stream(f"{self.folder}/.{name}", compression=None)
        self.member: zlib._Compress | None = None

    def write(self, data: bytes) -> None:
        if self.member is None:
            self.member = zlib.compressobj(6, zlib.DEFLATED, 31)
        self._put(self.member.compress(data))

    def end_record(self) -> None:
        self.write(b"\r\n\r\n")
        self._put(self.member.flush())
        self.member = None
        self.records += 1

    def _put(self, data: bytes) -> None:
        self.bytes += len(data)
        self.out.write(data)

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        self.store.move(f"{self.folder}/.{self.name}", f"{self.folder}/{self.name}")
        return self.uri, self.records, self.bytes


def _head(fields: list[tuple[str, str | None]]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields if v is not None) + b"\r\n"


def _plain_uri(uri: str | None) -> str | None:
    """No white space or control character can end a header's line."""
    return None if uri is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)


def _opening(row: dict, date: str) -> bytes:
    """Header and HTTP head of a record; the payload's digest is stated in base 32, as is usual."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    refers = row["refers_to"]
    return _head([
        ("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", date), ("WARC-Target-URI", _plain_uri(row["url"])),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row["digest"])).decode()), ("WARC-Refers-To", refers and f"<{refers}>"), ("WARC-Profile", refers and _PROFILE),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + (row["payload_bytes"] if refers is None else 0))),
    ]) + http


def _write(folder: str, date: str, archive_bytes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams chunk rows into archives; yields a manifest row for each."""
    archive, digest, done = None, hashlib.sha1(usedforsecurity=False), []
    for batch in batches:
        fields = {n: batch.column(n) for n in batch.schema.names}
        for k in range(batch.num_rows):
            row = {n: c[k].as_py() for n, c in fields.items()}
            if row["chunk_no"] == 0:
                if archive is None:
                    archive = _Archive(folder, f"part-{uuid.uuid4().hex}.warc.gz")
                    about = b"software: inkveil\r\nformat: WARC File Format 1.1\r\n"
                    archive.write(_head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(about)))]) + about)
                    archive.end_record()
                archive.write(_opening(row, date))
                digest = hashlib.sha1(usedforsecurity=False)
            if row["data"]:
                archive.write(row["data"])
                digest.update(row["data"])
            if row["chunk_no"] == row["chunks"] - 1:
                if row["refers_to"] is None and digest.hexdigest() != row["digest"]:
                    raise ValueError(f"the chunks of {row['record_id']} do not make its payload")
                archive.end_record()
                if archive.bytes >= archive_bytes:
                    done.append(archive.close())
                    archive = None
    if archive is not None:
        done.append(archive.close())
    yield pa.RecordBatch.from_pydict({"archive": [d[0] for d in done], "records": [d[1] - 1 for d in done], "bytes": [d[2] for d in done]})


def written(chunks: DataFrame, folder: str, date: datetime.datetime | None = None, archive_bytes: int = ARCHIVE) -> DataFrame:
    """Writes chunk rows (see `chunked`) to archives in `folder`: a manifest row for each archive. Only archives of the manifest count:
    a task that was lost may leave others. No rows give no archives. `date` is that of all records (default: now).
    """
    date = (date or datetime.datetime.now(datetime.UTC)).strftime(_NOW)
    bounded_batches(chunks.sparkSession)
    return stored(chunks.mapInArrow(partial(_write, folder, date, archive_bytes), MANIFEST), "manifest")


def _opened(uri: str) -> BinaryIO:
    from pyarrow import fs

    parts = urllib.parse.urlsplit(uri)
    store, path = (fs.LocalFileSystem(), parts.path) if parts.scheme in ("", "file") else fs.FileSystem.from_uri(uri)
    raw = io.BufferedReader(store.open_input_file(path), 1 << 20)
    return gzip.GzipFile(fileobj=raw) if raw.peek(2)[:2] == b"\x1f\x8b" else raw


def _fields(stream: BinaryIO, uri: str) -> tuple[dict[str, str], int]:
    """Header lines up to the empty one, by lower-case name, and their bytes."""
    found, size, name = {}, 0, None
    while True:
        line = stream.readline(1 << 20)
        size += len(line)
        if not line.endswith(b"\n"):
            raise ValueError(f"{uri}: a header is cut off or too long")
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if not text:
            return found, size
        if name is not None and text[0] in " \t":  # a folded line
            found[name] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        name = name.strip().lower()
        found[name] = value.strip()


def _hex(stated: str | None) -> str | None:
    """A stated SHA-1 as lower-case hex, whether written in base 32 or in hex; null if it is another digest."""
    value = (stated or "").removeprefix("sha1:")
    if re.fullmatch("[0-9a-fA-F]{40}", value):
        return value.lower()
    return base64.b32decode(value.upper()).hex() if re.fullmatch("[A-Z2-7a-z]{32}", value) else None


def _records(stream: BinaryIO, uri: str, chunk_bytes: int) -> Iterator[tuple]:
    """The chunk rows of an archive's response, resource and revisit records, in order. What is cut off raises."""
    while True:
        line = stream.readline(1 << 16)
        while line in (b"\r\n", b"\n"):
            line = stream.readline(1 << 16)
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{uri}: no record begins where one is expected")
        head, _ = _fields(stream, uri)
        left, kind, http = int(head["content-length"]), head.get("warc-type"), {}
        if left and head.get("content-type", "").startswith("application/http"):
            left -= len(stream.readline(1 << 16))
            http, size = _fields(stream, uri)
            left -= size
        named = [head.get(k, "").strip("<>") or None for k in ("warc-record-id", "warc-refers-to")]
        about = named[0], kind, named[1], head.get("warc-target-uri"), _hex(head.get("warc-payload-digest"))
        stored_here, digest, at, number = left, hashlib.sha1(usedforsecurity=False), 0, 0
        while True:
            data = stream.read(min(chunk_bytes, left))
            if left and not data:
                raise ValueError(f"{uri}: {named[0]} is cut off")
            left, at = left - len(data), at + len(data)
            digest.update(data)
            if kind == "revisit":  # the payload is that of the record referred to
                full = int(http["content-length"]) if "content-length" in http else None
                yield (*about, number, full, about[4], data, left == 0)
            elif kind in ("response", "resource"):
                if left == 0 and about[4] not in (None, digest.hexdigest()):
                    raise ValueError(f"{uri}: the payload of {named[0]} ({stored_here} bytes) is not the one that its digest states")
                yield (*about, number, at, digest.hexdigest(), data, left == 0)
            number += 1
            if left == 0:
                break


def _read(chunk_bytes: int, with_data: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = _CHUNK_TYPES.names
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            rows, size = [], 0
            with _opened(uri) as stream:
                for row in _records(stream, uri, chunk_bytes):
                    if not with_data:
                        row = (*row[:8], None, row[9])
                    rows.append(row)
                    size += len(row[8] or b"") + 300
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=_CHUNK_TYPES)
                        rows, size = [], 0
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=_CHUNK_TYPES)


def read(archives: DataFrame, chunk_bytes: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunks of the archives in column `archive` (compressed or plain, of any writer), a task for each archive.

    payload_bytes and payload_digest are of the payload up to and with the chunk, so that the row marked `last` has those of the whole payload;
    of a revisit they are those that the record states. Without `with_data` the payload is read and digested, but left out. Other record types give no
    rows. A payload that is cut off, or not the one that its digest states, stops the job.
    """
    archives = archives.select("archive")
    n = max(1, archives.count())
    return archives.repartition(n).mapInArrow(partial(_read, chunk_bytes, with_data), CHUNKS)


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """The archives of a folder, as Spark lists them (their content is not read)."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").option("recursiveFileLookup", "true").load(folder)
    return names.select(F.col("path").alias("archive"))


def round_trip(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST, chunk_bytes: int = CHUNK, archive_bytes: int = ARCHIVE, keep_archives: bool = False
) -> DataFrame:
    """Writes a record for each page and reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri, in the shared folder.

    Of pages with equal payloads of `least` bytes or more the one with the largest id is the response and others revisit it; repeated rows of that id are all
    responses, with equal record identifiers. Null payloads are empty, a null url gives no target, a null id is the smallest and comes back as null.
    An empty table gives no rows. Unless `keep_archives`, the archives go when their records have been read and stored.
    """
    spark, folder = pages.sparkSession, fresh(pages.sparkSession, "warc")
    manifest = written(chunked(decided(pages, id_col, url_col, payload_col, least), chunk_bytes), folder, archive_bytes=archive_bytes)
    kind = pages.schema[id_col].dataType.simpleString()
    found = read(manifest, chunk_bytes, with_data=False).filter("last").select(
        row_id(F.col("record_id"), kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", row_id(F.col("refers_to"), kind).alias("refers_to"), "target_uri"
    )
    found = stored(found, "records")
    if not keep_archives:
        discard(spark, folder)
    return found
