"""Reads by their type: files, session tables, tables of a store, binary call records."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from ..errors import PlanError
from ..functions.params import in_path
from ..operators import shape
from . import ber, files
from .store import Store
from .table_stream import TableStream

Reader = Callable[[SparkSession, Mapping, Store | None], DataFrame]
READERS: dict[str, Reader] = {}


def reader(kind: str) -> Callable[[Reader], Reader]:
    """Registers a source type; projects may add their own."""

    def add(f: Reader) -> Reader:
        READERS[kind] = f
        return f

    return add


def read_source(spark: SparkSession, read: Mapping | str, store: Store | None = None, parameters: Mapping[str, object] | None = None) -> DataFrame:
    """The frame of a read: a table name, or a mapping with a type. ${name} parameters stand in paths."""
    read = {"table": read} if isinstance(read, str) else dict(read)
    kind = read.get("type", "table")
    if kind not in READERS:
        raise PlanError(f"source type {kind} is not one of {sorted(READERS)}")
    for k in ("path", "schema_location"):
        if read.get(k):
            read[k] = in_path(read[k], parameters or {})
    return READERS[kind](spark, read, store)


@reader("files")
def _(spark: SparkSession, read: Mapping, store: Store | None) -> DataFrame:
    names = ("schema", "stream", "glob", "options", "schema_location", "evolution")
    return files.read_files(spark, read["path"], read["format"], **{k: read[k] for k in names if k in read})


@reader("table")
def _(spark: SparkSession, read: Mapping, store: Store | None) -> DataFrame:
    """A table of the store if it has one of that name, else one of the session's catalogue."""
    if store is not None and store.versions(read["table"]):
        return READERS["store"](spark, read, store)
    source = spark.readStream if read.get("stream") else spark.read
    return source.options(**{k: str(v) for k, v in read.get("options", {}).items()}).table(read["table"])


@reader("store")
def _(spark: SparkSession, read: Mapping, store: Store | None) -> DataFrame:
    if store is None or not store.versions(read["table"]):
        raise PlanError(f"table {read['table']} has no version yet")
    if not read.get("stream"):
        return store.read(read["table"], read.get("version"))
    spark.dataSource.register(TableStream)
    made = spark.readStream.format("store_table").schema(store.read(read["table"]).schema).option("path", f"{store.path}/{read['table']}")
    return made.options(**{k: str(v) for k, v in read.get("options", {}).items()}).load()


@reader("binary_records")
def _(spark: SparkSession, read: Mapping, store: Store | None) -> DataFrame:
    """Whole binary files, each split into records and decoded; the files' metadata stays with their records."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    made = (spark.readStream.schema(schema) if read.get("stream") else spark.read).format("binaryFile")
    made = made.option("pathGlobFilter", read["glob"]) if read.get("glob") else made
    raw = shape.with_hidden_metadata(made.load(read["path"])).select("_metadata", "content")
    return ber.decode_frame(raw, read["schema"], read.get("root"))


def read_dataset(spark: SparkSession, dataset: Mapping | str, store: Store | None = None) -> DataFrame:
    """A side of a reconciliation: a table, as a batch or a stream; files are no tables."""
    dataset = {"table": dataset} if isinstance(dataset, str) else dict(dataset)
    if dataset.get("type", "table") not in ("table", "store"):
        raise PlanError(f"a reconciliation reads tables, not {dataset['type']}")
    known = {"type", "table", "stream", "options", "version"}
    return read_source(spark, {k: v for k, v in dataset.items() if k in known}, store)


def read_keys(spark: SparkSession, location: str, store: Store | None = None) -> DataFrame:
    """Rows of a key list: a table of the store or session, Parquet files, or CSV files with a header."""
    if store is not None and store.versions(location):
        return store.read(location)
    if "/" not in location and spark.catalog.tableExists(location):
        return spark.read.table(location)
    if location.rstrip("/").endswith(".csv"):
        return spark.read.option("header", "true").option("inferSchema", "true").csv(location)
    try:
        return spark.read.parquet(location)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise PlanError(f"there is no key list {location}") from e
        if "FAILED_READ_FILE" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e) and "is not a Parquet file" not in str(e):
            raise
        return spark.read.option("header", "true").option("inferSchema", "true").csv(location)
