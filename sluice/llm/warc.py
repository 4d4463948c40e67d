"""Conversion of legacy ARC archives to WARC.

An ARC file starts with a version block that names the fields of its records' header lines (version 1 and 2
differ); a record is such a line and as many bytes as it declares. The converter parses both versions and
synthesises what WARC wants and ARC lacks: record ids, ISO timestamps, record types and payload digests.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, tidied

#: Field names of the two versions' header lines (fixed by the format).
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
IDENTICAL = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: An archive file is closed once it holds this many bytes; at most one record more.
FILE_BYTES = 16 << 20
#: Bytes of an archive that are read at once.
READ_BYTES = 1 << 16
#: What stands before a page's bytes in an ARC record.
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
#: Up to so many payloads that occur more than once are broadcast with their first rows; more are joined by shuffle.
MAX_BROADCAST_GROUPS = 200_000
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass
class ArcRecord:
    fields: dict[str, str]
    payload: bytes


def write_arc(records: list[ArcRecord], version: int, name: str = "archive.arc", date: str = "19980101000000") -> bytes:
    block = f"{version} 0 sluice\n{' '.join(FIELDS[version])}\n".encode()
    head = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Filename": name, "Offset": "0"}
    out = [_arc_line(head | {"Archive-length": str(len(block))}, version), block, b"\n"]
    for r in records:
        out += [_arc_line(r.fields | {"Archive-length": str(len(r.payload))}, version), r.payload, b"\n"]
    return b"".join(out)


def header_url(url: str | None) -> str:
    """A URL as it stands in headers: white space and control characters but blanks are percent-encoded; a dash for none."""
    return "".join(c if c > "\x20" and c != "\x7f" or c == " " else f"%{ord(c):02X}" for c in url or "").strip(" ") or "-"


def _arc_line(fields: dict[str, str], version: int) -> bytes:
    """A header line. Fields are parted by blanks, so only the first, the URL, may hold some; others lose theirs."""
    return (" ".join([header_url(fields["URL"]), *("".join(fields.get(k, "-").split()) or "-" for k in FIELDS[version][1:])]) + "\n").encode()


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file. The version block tells the fields; a bad line or length is an error."""
    names, at = FIELDS[1], 0
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"ARC header line at byte {at} has no end")
        line = data[at:end].decode("utf-8", "replace")
        if not line.strip():
            at = end + 1
            continue
        first = at == 0 and line.startswith("filedesc:")
        values = line.split(" ") if first else line.rsplit(" ", len(names) - 1)  # only the URL may hold blanks
        if not first and len(values) != len(names) or first and not values[-1].isdigit():
            raise ValueError(f"ARC header line at byte {at} has {len(values)} fields")
        try:
            length = int(values[-1])
        except ValueError:
            raise ValueError(f"ARC header line at byte {at} declares no length") from None
        payload = data[end + 1 : end + 1 + length]
        if len(payload) < length:
            raise ValueError(f"ARC record at byte {at} declares {length} bytes and has {len(payload)}")
        at = end + 1 + length + (data[end + 1 + length : end + 2 + length] == b"\n")
        if first:
            version = int(payload.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version} is not known")
            names = payload.split(b"\n")[1].decode().split(" ")
            continue
        yield ArcRecord(dict(zip(names, values)), payload)


def entity(payload: bytes) -> bytes:
    """What follows the HTTP head of a payload that begins with one, else all of it."""
    if not payload.startswith(b"HTTP/"):
        return payload
    ends = [(at, len(mark)) for mark in (b"\r\n\r\n", b"\n\n") if (at := payload.find(mark)) >= 0]
    return payload[sum(min(ends)) :] if ends else b""


def convert(record: ArcRecord, original: Original | None = None, key: str | None = None, extra: tuple[tuple[str, str], ...] = ()) -> list[tuple[str, str]]:
    """The WARC header of an ARC record, in order. A given original makes it a revisit of that record.

    The record id is made from the key, by default the record's file name, URL and date. The payload digest is
    that of the entity, without an HTTP head; the block digest is that of the whole block. An ARC Location
    (where a response redirects to) is no mark of a revisit; it is passed on.
    """
    f = record.fields
    block = record.payload if original is None else http_head(record.payload)
    http = record.payload.startswith(b"HTTP/")
    out = [
        ("WARC-Type", "response" if original is None else "revisit"),
        ("WARC-Record-ID", record_id(key or f"{f.get('Filename', '-')} {f['URL']} {f['Archive-date']}")),
        ("WARC-Date", iso_date(f["Archive-date"])),
        ("WARC-Target-URI", f["URL"]),
        ("WARC-IP-Address", f["IP-address"]),
        ("WARC-Payload-Digest", f"sha1:{digest(entity(record.payload))}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("X-Payload-Length", str(len(entity(record.payload)))),
    ]
    if f.get("Location", "-") != "-":
        out.append(("X-ARC-Location", f["Location"]))
    if original is not None:
        out += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", original.record), ("WARC-Refers-To-Target-URI", original.url), ("WARC-Refers-To-Date", original.date)]
    return [*out, *extra, ("Content-Type", "application/http; msgtype=response" if http else f["Content-type"]), ("Content-Length", str(len(block)))]


@dataclass
class Original:
    """The response that a revisit refers to: its record id, URL and date."""

    record: str
    url: str
    date: str


def record_id(key: str) -> str:
    return f"<{uuid.uuid5(_NAMESPACE, key).urn}>"


def iso_date(date: str) -> str:
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def http_head(payload: bytes) -> bytes:
    return payload[: len(payload) - len(entity(payload))]


def warc_bytes(record: ArcRecord, original: Original | None = None, key: str | None = None, extra: tuple[tuple[str, str], ...] = ()) -> bytes:
    """One record, a gzip member of its own; a revisit holds no more than the HTTP head."""
    head = convert(record, original, key, extra)
    body = record.payload if original is None else http_head(record.payload)
    text = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(text.encode() + body + b"\r\n\r\n") + pack.flush()


def _members(file: BinaryIO) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time; each byte is read and inflated once."""
    held, member, out = b"", None, []
    while True:
        data = held or file.read(READ_BYTES)
        held = b""
        if not data:
            break
        member = member or zlib.decompressobj(31)
        out.append(member.decompress(data))
        if member.eof:
            yield b"".join(out)
            held, member, out = member.unused_data, None, []
    if member is not None:
        raise ValueError("a gzip member has no end")


def parse_warc(file: BinaryIO | bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of all gzip members of a stream or of bytes."""
    for record in _members(io.BytesIO(file) if isinstance(file, bytes) else file):
        end = record.index(b"\r\n\r\n")
        lines = record[:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = dict(x.split(": ", 1) for x in lines[1:])
        yield head, record[end + 4 : end + 4 + int(head["Content-Length"])]


def write_archives(pages: DataFrame, work: Workspace, date: str = "19980101000000") -> DataFrame:
    """Writes a WARC record per row of pages (page_id, url, html); returns the manifest (file, records).

    A page becomes an ARC payload with an HTTP head; a null URL is written as a dash. Records pass through a version-2 ARC in memory, so the converter makes every record. Of equal payloads
    the row with the smallest page_id (repeated rows: one of them) is the response, the others are revisits;
    null html is the empty payload, and a null page_id comes after all others. Files have names of their
    own, and only those that the committed manifest names count, so tasks may run again. Pages of any length are
    written whole, one record each. Extra columns are ignored; an empty table gives an empty manifest.
    """
    folder = work.at("archives")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("key", F.sha1("html"))
    keys = rows.select("key", F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url").alias("row"))
    groups = work.save(keys.groupBy("key").agg(F.min("row").alias("first"), F.count("*").alias("n")).filter("n > 1"), "groups")
    # Rows are told apart by what they hold, not by their place in a scan, which another scan need not repeat.
    alike = keys.groupBy("key", "row").count().filter("count > 1")
    alike = work.save(alike.select(F.col("key").alias("k"), F.col("row").alias("r"), F.col("count").cast("int").alias("copies")), "alike")
    row = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")
    several = (F.col("key") == F.col("k")) & row.eqNullSafe(F.col("r"))
    is_first = F.col("first").isNull() | F.col("first").eqNullSafe(row)
    first_of = F.broadcast(groups) if groups.count() <= MAX_BROADCAST_GROUPS else groups
    told = rows.join(first_of, "key", "left").select("page_id", "url", "html", "key", "first", F.lit(1).alias("copy"))
    if not alike.isEmpty():
        # Of rows that are alike in everything one may be the response, the others are revisits.
        same = told.join(alike, several).dropDuplicates(["key", "page_id", "url"])
        same = same.select("page_id", "url", "html", "key", "first", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
        told = told.join(alike, several, "left_anti").unionByName(same)
    original = F.when(~(is_first & (F.col("copy") == 1)), F.struct("first.page_id", "first.url"))
    told = told.select("page_id", "url", "html", "key", "copy", original.alias("original"))
    run_id = work.path
    name = lambda id_, url, key, copy: f"{run_id} {id_} {url} {key} {copy}"

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(base)
        out, file, size, n = None, "", 0, 0
        done: list[tuple[str, int]] = []
        for whole in batches:
            for k in range(0, whole.num_rows, 200):
                ids, urls, keys_, copies, originals = (whole.slice(k, 200).column(i).to_pylist() for i in (0, 1, 3, 4, 5))
                bodies = whole.slice(k, 200).column(2).cast(pa.binary()).to_pylist()
                records = [
                    ArcRecord({"URL": header_url(url), "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html", "Result-code": "200"}, HTTP_HEAD % len(body) + body)
                    for url, body in zip(urls, bodies)
                ]
                for record, id_, url, key, copy, first in zip(parse_arc(write_arc(records, 2)), ids, urls, keys_, copies, originals, strict=True):
                    if out is None:
                        file, size, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = fs.open_output_stream(f"{base}/{file.rpartition('/')[2]}", compression=None)
                    extra = (("X-Page-ID", "null" if id_ is None else str(id_)),)
                    original = None
                    if first is not None:
                        original = Original(record_id(name(first["page_id"], first["url"], key, 1)), header_url(first["url"]), iso_date(date))
                        extra += (("X-Refers-To-Page-ID", "null" if first["page_id"] is None else str(first["page_id"])),)
                    data = warc_bytes(record, original, name(id_, url, key, copy), extra)
                    out.write(data)
                    size, n = size + len(data), n + 1
                    if size >= FILE_BYTES:
                        out.close()
                        done.append((file, n))
                        out = None
        if out is not None:
            out.close()
            done.append((file, n))
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in done], pa.string()), pa.array([c for _, c in done], pa.int64())], ["file", "records"])

    written = told.select("page_id", "url", "html", "key", "copy", "original").mapInArrow(run, "file string, records long")
    return work.save(written, "manifest")


def _plain(data: bytes) -> bytes:
    """The bytes of an ARC file; a compressed one is a sequence of gzip members."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        if not member.eof:
            raise ValueError("a gzip member has no end")
        data = member.unused_data
    return b"".join([*out, data])


def convert_archives(arcs: DataFrame, work: Workspace) -> DataFrame:
    """Converts existing ARC files of both versions, plain or gzipped; returns the manifest (file, records).

    arcs has path and content, as Spark's binaryFile source gives them. Each file becomes one WARC file, each
    of its records a response with its whole payload. A bad file is an error that names it; a null or empty
    one has no records and no file; extra columns are ignored.
    """
    folder = work.at("archives")

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(base)
        for batch in batches:
            done: list[tuple[str, int]] = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not (data := content.as_py()):
                    continue
                name, n = f"{uuid.uuid4().hex}.warc.gz", 0
                with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
                    try:
                        for record in parse_arc(_plain(data)):
                            out.write(warc_bytes(record, key=f"{path} {n}"))
                            n += 1
                    except (ValueError, zlib.error) as e:
                        raise ValueError(f"{path}: {e}") from e
                done.append((f"{folder}/{name}", n))
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in done], pa.string()), pa.array([c for _, c in done], pa.int64())], ["file", "records"])

    written = arcs.select(F.col("path").cast("string"), F.col("content").cast("binary")).mapInArrow(run, "file string, records long")
    return work.save(written, "manifest")


def read_archives(manifest: DataFrame, tasks: int) -> DataFrame:
    """Per record of the manifest's files: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest of a response are those of the payload read, without an HTTP head; a record whose header
    tells another digest is an error. Those of a revisit are in its header, as it has no payload. Records of
    other makers have no page_id. Files are streamed record by record.
    """

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: int(x) if x and x.removeprefix("-").isdecimal() else None
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = pa.fs.FileSystem.from_uri(uri)
                rows = []
                with fs.open_input_stream(path, compression=None) as f:
                    for head, block in parse_warc(f):
                        kind, found = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                        payload = entity(block)
                        if kind == "response" and digest(payload) != found:
                            raise ValueError(f"{uri}: the payload of {head['WARC-Record-ID']} has another digest")
                        length = len(payload) if kind == "response" else int(head["X-Payload-Length"])
                        url = head["WARC-Target-URI"]
                        rows.append((number(head.get("X-Page-ID")), None if url == "-" else url, length, found, kind, number(head.get("X-Refers-To-Page-ID"))))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return manifest.select("file").repartition(tasks).mapInArrow(run, schema)
