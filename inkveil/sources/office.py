"""Office files as a Spark data source: spark.read.format("office") gives text nodes, df.write.format("office") writes rewritten documents.

Register it with `register(spark)`. Reading cuts a folder into partitions of some megabytes. Writing takes rows (path, output_path, content, changes), as `batch` makes them:
every task writes below a hidden folder of the job, and the commit gives all files their names; a task or job that fails leaves none.
"""

from __future__ import annotations

import contextlib
import json
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from inkveil.sources import ooxml, store

#: Bytes of archives for each task that reads.
PARTITION = 32 << 20
#: Bytes that a file counts for at least, as opening it takes time too.
OPEN = 32 << 10
ROWS = f"path string, output_path string, content binary, changes array<{ooxml.CHANGE}>"
REPORT = "path string, save_error string, duration_ms long"


@dataclass
class Archives(InputPartition):
    """Files of folders, a line for each folder: its address and the names of files in it, with slashes between. The driver holds no more of them than that."""

    folders: list[tuple[str, str]]

    @property
    def paths(self) -> list[str]:
        return [f"{folder}/{name}" for folder, names in self.folders for name in names.split("/")]


class OfficeReader(DataSourceReader):
    """Options: path (a file or folder), partitionBytes, media (true: a row for each picture too)."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.size = options["path"], int(options.get("partitionBytes", PARTITION))
        self.media = options.get("media", "false").lower() == "true"

    def partitions(self) -> list[Archives]:
        parts: list[Archives] = []
        held, names, at = self.size, [], None

        def close() -> None:
            if names:
                parts[-1].folders.append((at, "/".join(names)))
                names.clear()

        for path, size in store.listed(self.path):
            folder, _, name = path.rpartition("/")
            if re.search(r"\.(docx|xlsx|pptx)$", name, re.IGNORECASE) and not name.startswith((".", "_", "~$")) and "/_temporary/" not in path:
                size = max(size, OPEN)
                if folder != at or held + size > self.size:
                    close()
                    at = folder
                if held + size > self.size:
                    parts.append(Archives([]))
                    held = 0
                names.append(name)
                held += size
        close()
        return parts or [Archives([])]

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        return ooxml.node_batches(((path, store.read(path)) for path in partition.paths), self.media)


@dataclass
class Written(WriterCommitMessage):
    """Where a task has left JSON lines of its files: path, hidden name (or none), final name, error (or none) and milliseconds. Where it could not, the lines themselves."""

    at: str | None
    lines: str = ""


class CommittedWriter(DataSourceWriter):
    """Writes a file for each row (path, output_path, ...) that `made` turns into bytes. Options: path (the target folder), report (optional: a file that gets a JSON line with path,
    save_error and duration_ms for each row). A row that fails is a line of the report."""

    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.report = options["path"].rstrip("/"), options.get("report")
        self.hidden = f"{self.root}/_temporary/{uuid.uuid4().hex}"

    def made(self, row: Row) -> bytes:
        raise NotImplementedError

    def write(self, rows: Iterator[Row]) -> Written:
        done = []
        for row in rows:
            began, error, part = time.monotonic(), None, f"{self.hidden}/{uuid.uuid4().hex}"
            try:
                store.write(part, self.made(row))
            except ooxml.BROKEN as e:
                part, error = None, f"{type(e).__name__}: {e}"
            done.append(json.dumps((row.path, part, row.output_path, error, int((time.monotonic() - began) * 1000))))
        lines, at = "\n".join(done), f"{self.hidden}/{uuid.uuid4().hex}"
        try:
            store.write(at, lines.encode())
        except OSError:  # the target is no folder: no row was written
            return Written(None, lines)
        return Written(at)

    def commit(self, messages: list[Written | None]) -> None:
        folders = set()
        with store.created(self.report) if self.report else contextlib.nullcontext() as report:
            for m in (m for m in messages if m is not None):  # the files of one task at a time
                for path, part, final, error, spent in map(json.loads, (store.read(m.at).decode() if m.at else m.lines).splitlines()):
                    if part is not None:
                        try:
                            where, target = store.opened(final)
                            if (folder := target.rpartition("/")[0]) not in folders:
                                where.create_dir(folder, recursive=True)
                                folders.add(folder)
                            store.move(part, final)
                        except OSError as e:
                            error = f"{type(e).__name__}: {e}"
                    if report is not None:
                        report.write(json.dumps({"path": path, "save_error": error, "duration_ms": spent}, ensure_ascii=False).encode() + b"\n")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store.clear(self.hidden)


class OfficeWriter(CommittedWriter):
    def made(self, row: Row) -> bytes:
        return ooxml.changed_archive(bytes(row.content), [c.asDict() for c in row.changes or []])


class TextWriter(CommittedWriter):
    def made(self, row: Row) -> bytes:
        return row.text.encode()


class TextFiles(DataSource):
    """df.write.format("text_files"): rows (path, output_path, text) become files of their own."""

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return "path string, output_path string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> TextWriter:
        return TextWriter(self.options)


class OfficeDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "office"

    def schema(self) -> str:
        return ooxml.NODE

    def reader(self, schema: StructType) -> OfficeReader:
        return OfficeReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> OfficeWriter:
        return OfficeWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session."""
    spark.dataSource.register(OfficeDataSource)
    spark.dataSource.register(TextFiles)
