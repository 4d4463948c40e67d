"""File sources: stored schemas that evolve, glob and reader options, rescued fields, retention of what was read."""

from __future__ import annotations

import json
import time
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType, TimestampType

from ..errors import ShapeError
from .commit import Folder
from .landing import RETENTION_DAYS, extract_archives, marker, sweep

__all__ = ["MODES", "RESCUED", "Retention", "apply_retention", "evolve", "extract_archives", "marker", "processed", "read_files", "read_rescuing", "resolve_schema", "sweep"]

#: Evolution modes and the name of the rescue column (fixed values of the format).
MODES = ("addNewColumns", "addNewColumnsWithTypeWidening", "rescue", "failOnNewColumns", "none")
RESCUED = "_rescued_data"
#: What a type may widen to.
WIDER: dict[type[DataType], tuple[type[DataType], ...]] = {
    ShortType: (IntegerType, LongType, DoubleType), IntegerType: (LongType, DoubleType), FloatType: (DoubleType,), DateType: (TimestampType,),
}


def evolve(stored: StructType | None, found: StructType, mode: str) -> StructType:
    """The schema to read with, from the stored one and that of the files."""
    if mode not in MODES:
        raise ShapeError(f"evolution mode {mode} is not one of {MODES}")
    if stored is None:
        return found
    new = [f for f in found.fields if f.name not in stored.fieldNames()]
    if new and mode == "failOnNewColumns":
        raise ShapeError(f"new columns: {[f.name for f in new]}")
    kept = list(stored.fields)
    if mode == "addNewColumnsWithTypeWidening":
        types = {f.name: f.dataType for f in found.fields}
        kept = [StructField(f.name, types[f.name] if isinstance(types.get(f.name), WIDER.get(type(f.dataType), ())) else f.dataType, f.nullable, f.metadata) for f in kept]
    return StructType(kept + (new if mode.startswith("addNewColumns") else []))


def resolve_schema(spark: SparkSession, location: str, found: StructType | None, mode: str) -> StructType:
    """The schema stored at a location, evolved by what the files have and stored again.

    Versions are numbered and committed without overwriting, so of two readers that evolve it at once one fails.
    """
    folder = Folder(spark, location)
    versions = [n for n in folder.names() if n.startswith("schema-")]
    stored = StructType.fromJson(folder.read_json(versions[-1])) if versions else None
    if stored is None and found is None:
        raise ShapeError(f"{location}: there is neither a stored schema nor a file to take one from")
    schema = evolve(stored, found if found is not None else stored, mode)
    if schema != stored and not folder.commit_json(f"schema-{len(versions) + 1:06d}.json", json.loads(schema.json())):
        raise ShapeError(f"{location}: another reader stored a schema at the same time")
    return schema


def _found(spark: SparkSession, path: str, fmt: str, glob: str | None, options: Mapping[str, str]) -> StructType | None:
    """The schema of the files that are there, over all of them; None without any."""
    reader = spark.read.format(fmt).options(**options)
    if fmt in ("csv", "json"):
        reader = reader.option("inferSchema", "true")
    if fmt in ("parquet", "orc"):
        reader = reader.option("mergeSchema", "true")
    try:
        schema = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).schema
    except Exception as e:
        if "UNABLE_TO_INFER_SCHEMA" in str(e) or "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return schema if schema.fields else None


def read_files(spark: SparkSession, path: str, fmt: str, schema: StructType | str | None = None, stream: bool = False, glob: str | None = None, options: Mapping[str, str] | None = None, schema_location: str | None = None, evolution: str = "addNewColumns") -> DataFrame:
    """A batch or stream over files. Without a schema, that of the schema location is evolved by what is there.

    With the evolution `rescue` (JSON lines only) unexpected or mismatched fields stay in a column of their own.
    """
    options = {k: str(v) for k, v in (options or {}).items()}
    if evolution not in MODES:
        raise ShapeError(f"evolution mode {evolution} is not one of {MODES}")
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    if schema is None:
        found = _found(spark, path, fmt, glob, options)
        schema = resolve_schema(spark, schema_location, found, evolution) if schema_location else found
        if schema is None:
            raise ShapeError(f"{path}: no schema is given and there is no file to take one from")
    if evolution == "rescue":
        if fmt != "json":
            raise ShapeError(f"{path}: only JSON lines are read with rescued fields, not {fmt}")
        return read_rescuing(spark, path, schema, stream, glob)
    reader = (spark.readStream if stream else spark.read).format(fmt).schema(schema).options(**options)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def read_rescuing(spark: SparkSession, path: str, schema: StructType, stream: bool = False, glob: str | None = None) -> DataFrame:
    """JSON lines read with the stored schema; unexpected or mismatched fields stay in _rescued_data as JSON."""
    reader = spark.readStream if stream else spark.read
    raw = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
    plain = raw.select(F.from_json("value", "map<string,string>").alias("m"))
    field = lambda f: F.element_at("m", F.lit(f.name))
    typed = lambda f: field(f) if isinstance(f.dataType, StringType) else field(f).try_cast(f.dataType)
    names = F.array(*[F.lit(f.name) for f in schema.fields])
    wrong = [F.when(field(f).isNotNull() & typed(f).isNull(), F.lit(f.name)) for f in schema.fields]
    bad = F.array_compact(F.array(*wrong))
    kept = F.map_filter("m", lambda k, v: ~F.array_contains(names, k) | F.array_contains(bad, k))
    return plain.select(*[typed(f).alias(f.name) for f in schema.fields], F.when(F.size(kept) > 0, F.to_json(kept)).alias(RESCUED))


@dataclass(frozen=True)
class Retention:
    """What becomes of landing files that a stream has read: nothing, or after some days an archive or deletion."""

    mode: str = "off"
    days: float = RETENTION_DAYS
    path: str | None = None

    @classmethod
    def of(cls, spec: Mapping | str | None) -> Retention:
        """An archive without a path to put files in is off."""
        spec = {"mode": spec} if isinstance(spec, str) else dict(spec or {})
        mode = spec.get("mode", "off")
        if mode not in ("off", "archive", "delete"):
            raise ShapeError(f"retention mode {mode} is not one of off, archive, delete")
        if mode == "archive" and not spec.get("path"):
            mode = "off"
        return cls(mode, float(spec.get("days", RETENTION_DAYS)), spec.get("path"))


def processed(spark: SparkSession, checkpoint: str) -> dict[str, int]:
    """Files that a streaming query has committed, with their time in milliseconds, from its checkpoint."""
    folder, out = Folder(spark, checkpoint), {}
    done = {int(n) for n in folder.names("commits") if n.isdigit()}
    for source in folder.names("sources"):
        for name in folder.names(f"sources/{source}"):
            if not name.removesuffix(".compact").isdigit():
                continue
            for line in folder.read_bytes(f"sources/{source}/{name}").decode().splitlines()[1:]:
                entry = json.loads(line)
                if int(entry["batchId"]) in done:
                    out[entry["path"]] = int(entry["timestamp"])
    return out


def apply_retention(spark: SparkSession, checkpoint: str, policy: Retention, now: float | None = None) -> list[str]:
    """Archives or deletes the files a query has committed and that are older than the policy's days; returns them."""
    if policy.mode == "off":
        return []
    jvm, gone, limit = spark._jvm, [], ((now if now is not None else time.time()) - policy.days * 86_400) * 1000
    for path, modified in sorted(processed(spark, checkpoint).items()):
        file = jvm.org.apache.hadoop.fs.Path(path)
        fs = file.getFileSystem(spark._jsc.hadoopConfiguration())
        if modified >= limit or not fs.exists(file):
            continue
        if policy.mode == "archive":
            target = jvm.org.apache.hadoop.fs.Path(f"{policy.path.rstrip('/')}/{file.getName()}")
            fs.mkdirs(target.getParent())
            if not fs.rename(file, target):
                raise ShapeError(f"{path} can't be moved to {policy.path}")
        else:
            fs.delete(file, False)
        gone.append(path)
    return gone
