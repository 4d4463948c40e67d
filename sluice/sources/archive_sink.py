"""A streaming sink that writes each micro-batch as one compressed export file.

Every task compresses the rows it has as one gzip member below the target folder. A gzip file may be a sequence
of members, so the commit strings them together, after one for the header if the format has any, and moves the
whole into place; no row passes the driver's parser. A ZIP gets one entry per task. Files are reached through
Arrow's file systems, so the folder may be any that all tasks and the driver share.
"""

from __future__ import annotations

import csv
import gzip
import io
import json
import shutil
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

from ..errors import EngineError

FORMATS, COMPRESSIONS = ("json", "csv"), ("gzip", "zip")
#: Bytes that the commit copies at once.
COPIED = 1 << 20


@dataclass
class Part(WriterCommitMessage):
    path: str
    rows: int


def file_name(template: str, batch_id: int) -> str:
    try:
        return template.format(batch_id=batch_id, timestamp=datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S"))
    except (KeyError, IndexError) as e:
        raise EngineError(f"export names know batch_id and timestamp only: {template}") from e


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"file://{path}")


def csv_line(values) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerow(["" if v is None else v for v in values])
    return out.getvalue()


class ArchiveWriter(DataSourceStreamWriter):
    """Options: path, format (json, csv), compression (gzip, zip), file_name, header (of csv, on by default)."""

    def __init__(self, schema, options):
        self.names, self.path = schema.names, options["path"].rstrip("/")
        self.template, self.compression = options.get("file_name", "export-{batch_id}"), options.get("compression", "gzip")
        self.format, self.header = options.get("format", "json"), str(options.get("header", "true")).lower() == "true"
        if self.format not in FORMATS or self.compression not in COMPRESSIONS:
            raise EngineError(f"archive export: format is one of {FORMATS}, compression one of {COMPRESSIONS}")
        file_name(self.template, 0)

    def line(self, row) -> str:
        if self.format == "csv":
            return csv_line(row)
        return json.dumps(dict(zip(self.names, row)), default=str, ensure_ascii=False) + "\n"

    def write(self, iterator: Iterator) -> Part:
        from pyspark import TaskContext

        first = next(iterator, None)
        if first is None:
            return Part("", 0)
        fs, base = file_system(self.path)
        fs.create_dir(f"{base}/_staging")
        part, n = f"{base}/_staging/{TaskContext.get().taskAttemptId()}.gz", 0
        with fs.open_output_stream(part, compression=None) as raw, gzip.open(raw, "wt", encoding="utf-8", newline="") as f:
            row = first
            while row is not None:
                f.write(self.line(row))
                n, row = n + 1, next(iterator, None)
        return Part(part, n)

    def commit(self, messages: list[Part], batchId: int) -> None:  # noqa: N803
        full = [m.path for m in messages if m is not None and m.rows]
        if full:
            fs, base = file_system(self.path)
            kind = "csv" if self.format == "csv" else "jsonl"
            out = f"{base}/{file_name(self.template, batchId)}" + (f".{kind}.gz" if self.compression == "gzip" else ".zip")
            head = csv_line(self.names).encode() if self.format == "csv" and self.header else b""
            with fs.open_output_stream(f"{out}.part", compression=None) as target:
                (self._members if self.compression == "gzip" else self._entries)(fs, full, target, head, kind)
            fs.move(f"{out}.part", out)
        self.abort(messages, batchId)

    @staticmethod
    def _members(fs, parts: list[str], target, head: bytes, kind: str) -> None:
        target.write(gzip.compress(head) if head else b"")
        for part in parts:
            with fs.open_input_stream(part, compression=None) as source:
                shutil.copyfileobj(source, target, COPIED)

    @staticmethod
    def _entries(fs, parts: list[str], target, head: bytes, kind: str) -> None:
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for i, part in enumerate(parts):
                with fs.open_input_stream(part, compression="gzip") as source, z.open(f"part-{i:05d}.{kind}", "w", force_zip64=True) as entry:
                    entry.write(head)
                    shutil.copyfileobj(source, entry, COPIED)

    def abort(self, messages: list[Part], batchId: int) -> None:  # noqa: N803
        fs, _ = file_system(self.path)
        for m in messages:
            if m is not None and m.rows and fs.get_file_info(m.path).type != pyarrow.fs.FileType.NotFound:
                fs.delete_file(m.path)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive_export"

    def streamWriter(self, schema, overwrite: bool) -> ArchiveWriter:  # noqa: N802
        return ArchiveWriter(schema, self.options)
