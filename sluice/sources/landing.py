"""Archives in a landing folder: extraction by tasks, markers, deletion, and batches of archives joined into a table.

Folders are paths or URIs of any file system that Arrow and all tasks reach. The driver lists folders and keeps
markers; each archive is opened, checked and extracted by a task of its own.
"""

from __future__ import annotations

import csv
import fnmatch
import gzip
import hashlib
import io
import os
import posixpath
import shutil
import time
import zipfile
import zlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

from ..errors import EngineError
from ..functions.aes import unlocked_zip_member

RETENTION_DAYS = 7
#: Endings that an archive's member loses, in this order, to get its name (fixed values).
ENDINGS = (".decrypted", ".gpg", ".pgp", ".gz")
#: Bytes copied at once.
COPIED = 1 << 20
#: What a broken archive raises; Arrow's files don't seek before their start with an OSError.
TORN = (OSError, zipfile.BadZipFile, zlib.error, EOFError, pyarrow.ArrowInvalid)
BROKEN = (*TORN, EngineError)


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")


def _files(folder: str, pattern: str) -> list[pyarrow.fs.FileInfo]:
    fs, base = file_system(folder)
    found = fs.get_file_info(pyarrow.fs.FileSelector(base, allow_not_found=True))
    return sorted((f for f in found if f.type == pyarrow.fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern)), key=lambda f: f.base_name)


def marker(archive: str) -> str:
    folder, name = posixpath.split(archive)
    return posixpath.join(folder, f".{name}.__extracted__")


def waiting(folder: str, pattern: str) -> list[str]:
    """Archives without a marker as new as they are. A stale marker is removed."""
    if fnmatch.fnmatch(posixpath.basename(marker(f"{folder}/x")), pattern):
        raise EngineError(f"{pattern} would match the markers")
    fs, _ = file_system(folder)
    out = []
    for f in _files(folder, pattern):
        sign = fs.get_file_info(marker(f.path))
        if sign.type == pyarrow.fs.FileType.File:
            if sign.mtime_ns >= f.mtime_ns:
                continue
            fs.delete_file(sign.path)
        out.append(f.path)
    return out


def extract_archives(folder: str, pattern: str, target: str, spark: SparkSession | None = None, password: str | None = None, decrypt: Callable[[bytes], bytes] | None = None) -> list[str]:
    """Members of all matching ZIP and GZIP files that wait; failures are raised once, after all were tried.

    With a session each archive is one task's work. `password` opens encrypted ZIP members (the old scheme and
    AES); `decrypt` is applied to the whole content of archives whose name tells that they are encrypted.
    """
    archives = waiting(folder, pattern)
    root = folder.split("://")[0] + "://" if "://" in folder else ""
    full = [f"{root}{a}" for a in archives]

    def one(path: str) -> tuple[list[str], str]:
        try:
            return extract(path, target, password, decrypt), ""
        except BROKEN as e:
            return [], f"{type(e).__name__}: {e}"

    if spark is None or not full:
        results = [(p, *one(p)) for p in full]
    else:

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield pd.DataFrame([(p, *one(p)) for p in frame["path"]], columns=["path", "members", "error"])

        paths = spark.createDataFrame([(p,) for p in full], "path string").repartition(len(full), "path")
        results = [tuple(r) for r in paths.mapInPandas(run, "path string, members array<string>, error string").collect()]  # a row per archive
    fs, _ = file_system(folder)
    made, failed = [], {}
    for path, members, error in sorted(results, key=lambda r: r[0]):
        if error:
            failed[posixpath.basename(path)] = error
            continue
        made += members
        with fs.open_output_stream(marker(file_system(path)[1]), compression=None):
            pass
    if failed:
        raise EngineError(f"archives failed: {failed}")
    return made


def member_name(archive: str) -> str:
    """The name of what a compressed file holds."""
    name = posixpath.basename(archive)
    for end in ENDINGS:
        name = name.removesuffix(end)
    return name


def extract(path: str, target: str, password: str | None = None, decrypt: Callable[[bytes], bytes] | None = None) -> list[str]:
    """Extracts one archive and returns its members' paths. Every member is checked before any is in place."""
    fs, source = file_system(path)
    out_fs, out = file_system(target)
    out_fs.create_dir(out)
    name = posixpath.basename(source)
    if name.endswith((".gpg", ".pgp")) and decrypt is None:
        raise EngineError(f"{name} is encrypted and no way to decrypt it is given")
    with fs.open_input_file(source) as opened:
        raw = io.BytesIO(decrypt(opened.read())) if name.endswith((".gpg", ".pgp")) else opened
        head = raw.read(4)
        raw.seek(0)
        if head[:2] == b"PK":
            return _zip_members(raw, out_fs, out, password)
        if head[:2] != b"\x1f\x8b" and not raw is opened:
            return [_placed(out_fs, f"{out}/{member_name(name)}", raw)]
        if head[:2] != b"\x1f\x8b":
            raise EngineError(f"{name} is neither ZIP nor GZIP")
        end = f"{out}/{member_name(name)}"
        if (out_fs, end) == (fs, source) or end == source:
            raise EngineError(f"{name} would be written over itself")
        with gzip.open(raw) as plain:
            return [_placed(out_fs, end, plain)]


def _zip_members(raw, fs, out: str, password: str | None) -> list[str]:
    made = []
    with zipfile.ZipFile(raw) as z:
        members = [i for i in z.infolist() if not i.is_dir()]
        for info in members:
            end = posixpath.normpath(f"{out}/{info.filename}")
            if not end.startswith(out.rstrip("/") + "/"):
                raise EngineError(f"{info.filename} leaves the folder")
        for info in members:
            end = posixpath.normpath(f"{out}/{info.filename}")
            fs.create_dir(posixpath.dirname(end))
            if info.compress_type == 99:
                source = io.BytesIO(unlocked_zip_member(raw, info, password))
            else:
                source = z.open(info, pwd=password.encode() if password and info.flag_bits & 1 else None)
            with source:
                made.append((_placed(fs, f"{end}.part", source), end))  # a bad checksum is raised at the member's end
    for part, end in made:
        fs.move(part, end)
    return [end for _, end in made]


def _placed(fs, path: str, source) -> str:
    with fs.open_output_stream(path, compression=None) as f:
        shutil.copyfileobj(source, f, COPIED)
    return path


@dataclass(frozen=True)
class DeletePolicy:
    """Whether and after how many days an archive that was extracted goes."""

    days: float | None

    @classmethod
    def of(cls, spec: Mapping | bool | None) -> DeletePolicy:
        """Nothing or true: at once; false: never; a mapping: after delete_after_x_days."""
        if spec is None or spec is True:
            return cls(0.0)
        if spec is False:
            return cls(None)
        if not isinstance(spec, Mapping) or set(spec) - {"delete_after_x_days"} or float(spec.get("delete_after_x_days", RETENTION_DAYS)) < 0:
            raise EngineError(f"delete policy: true, false or delete_after_x_days, not {spec}")
        return cls(float(spec.get("delete_after_x_days", RETENTION_DAYS)))


def sweep(folder: str, pattern: str, days: float = RETENTION_DAYS) -> list[str]:
    """Deletes matching archives older than so many days, with their markers."""
    fs, _ = file_system(folder)
    gone = []
    for f in _files(folder, pattern):
        if time.time() - f.mtime_ns / 1e9 > days * 86_400:
            fs.delete_file(f.path)
            if fs.get_file_info(marker(f.path)).type == pyarrow.fs.FileType.File:
                fs.delete_file(marker(f.path))
            gone.append(f.path)
    return gone


def clean_up(folder: str, pattern: str, policy: DeletePolicy) -> list[str]:
    """Deletes extracted archives that the policy gives up: those with a marker as new as they are."""
    if policy.days is None:
        return []
    fs, _ = file_system(folder)
    gone = []
    for f in _files(folder, pattern):
        sign = fs.get_file_info(marker(f.path))
        if sign.type == pyarrow.fs.FileType.File and sign.mtime_ns >= f.mtime_ns and time.time() - f.mtime_ns / 1e9 >= policy.days * 86_400:
            fs.delete_file(f.path)
            fs.delete_file(sign.path)
            gone.append(f.path)
    return gone


@dataclass(frozen=True)
class BatchError:
    archive: str
    reason: str


def validate_batch(archives: Sequence[str]) -> list[BatchError]:
    """What is wrong with a batch: missing, empty or malformed archives, bad checksums, and contents that come twice."""
    errors, seen = [], {}
    for path in archives:
        fs, source = file_system(path)
        info = fs.get_file_info(source)
        if info.type != pyarrow.fs.FileType.File:
            errors.append(BatchError(path, "missing"))
            continue
        if not info.size:
            errors.append(BatchError(path, "empty"))
            continue
        with fs.open_input_file(source) as f:
            digest = hashlib.sha256()
            while data := f.read(COPIED):
                digest.update(data)
            f.seek(0)
            try:
                with zipfile.ZipFile(f) as z:
                    if bad := z.testzip():
                        errors.append(BatchError(path, f"bad checksum in {bad}"))
            except TORN as e:
                errors.append(BatchError(path, f"malformed: {e}"))
        if digest.hexdigest() in seen:
            errors.append(BatchError(path, f"the same content as {seen[digest.hexdigest()]}"))
        seen.setdefault(digest.hexdigest(), path)
    return errors


def join_batch(spark: SparkSession, archives: Mapping[str, str], sql: str, folder: str) -> DataFrame:
    """The result of a query over views of CSV files with headers, one for each name, read from a ZIP each.

    The batch is checked first; any error stops it. An archive holds one file.
    """
    if errors := validate_batch(list(archives.values())):
        raise EngineError("; ".join(f"{e.archive}: {e.reason}" for e in errors))
    frames = {}
    for name, path in archives.items():
        members = extract(path, f"{folder.rstrip('/')}/{name}")
        if len(members) != 1:
            raise EngineError(f"{path} holds {len(members)} files, not one")
        root = folder.split("://")[0] + "://" if "://" in folder else "file://"
        frames[name] = spark.read.option("header", "true").option("inferSchema", "true").csv(f"{root}{members[0]}")
        frames[name].createOrReplaceTempView(name)
    return spark.sql(sql)


def export_csv_zip(df: DataFrame, path: str, member: str) -> str:
    """df as one CSV file with a header in a ZIP. Rows stream through the driver, a partition at a time."""
    fs, target = file_system(path)
    fs.create_dir(posixpath.dirname(target))
    with fs.open_output_stream(f"{target}.part", compression=None) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z, z.open(member, "w", force_zip64=True) as entry:
        text = io.TextIOWrapper(entry, "utf-8", newline="")
        writer = csv.writer(text, lineterminator="\n")
        writer.writerow(df.columns)
        writer.writerows(df.toLocalIterator())
        text.flush()
        text.detach()
    fs.move(f"{target}.part", target)
    return target


def compress_folder(folder: str, archive: str, endings: Sequence[str] = (".json", ".jsonl", ".csv", ".parquet", ".txt"), remove: bool = False, encrypt: Callable[[bytes], bytes] | None = None) -> list[str]:
    """Packs a folder's files with the allowed endings into one ZIP, streamed; returns the members' names.

    The archive appears under its name when it is whole. Files are removed after that, if asked.
    """
    fs, base = file_system(folder)
    out_fs, target = file_system(archive)
    found = fs.get_file_info(pyarrow.fs.FileSelector(base, recursive=True))
    chosen = sorted(f.path for f in found if f.type == pyarrow.fs.FileType.File and f.base_name.endswith(tuple(endings)) and f.path != target and not f.base_name.startswith((".", "_")))
    out_fs.create_dir(posixpath.dirname(target))
    names = [posixpath.relpath(p, base) for p in chosen]
    with out_fs.open_output_stream(f"{target}.part", compression=None) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path, name in zip(chosen, names):
            with fs.open_input_stream(path, compression=None) as source, z.open(name, "w", force_zip64=True) as entry:
                shutil.copyfileobj(source, entry, COPIED)
    if encrypt is not None:
        with out_fs.open_input_stream(f"{target}.part", compression=None) as f:
            locked = encrypt(f.read())
        with out_fs.open_output_stream(f"{target}.part", compression=None) as f:
            f.write(locked)
    out_fs.move(f"{target}.part", target)
    if remove:
        for path in chosen:
            fs.delete_file(path)
    return names
