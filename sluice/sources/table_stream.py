"""A stream over the versions of an appended table of a store."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..errors import PlanError
from .landing import file_system

#: A partition's name for rows without a value (fixed by the layout).
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


@dataclass
class File(InputPartition):
    path: str


class TableStreamReader(DataSourceStreamReader):
    """Offsets are versions: a batch holds the files that the versions after its start added, one task a file.

    Only files that a committed manifest names are read. A version that rewrites the table ends the stream with
    an error, as its readers have seen rows that are no longer there.
    """

    def __init__(self, schema: StructType, options):
        self.schema, self.table = schema, options["path"].rstrip("/")
        self.first, self.most = int(options.get("startingversion", 0)), int(options.get("maxversionspertrigger", 0))
        self.at = max(self.first - 1, 0)

    def _manifests(self) -> dict[int, str]:
        fs, base = file_system(f"{self.table}/_versions")
        found = fs.get_file_info(pyarrow.fs.FileSelector(base, allow_not_found=True))
        return {int(f.base_name[:-5]): f.path for f in found if f.base_name.endswith(".json")}

    def _entry(self, path: str) -> dict:
        fs, _ = file_system(self.table)
        with fs.open_input_stream(path, compression=None) as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:  # noqa: N802
        return {"version": max(self.first - 1, 0)}

    def latestOffset(self) -> dict:  # noqa: N802
        newest = max(self._manifests(), default=0)
        self.at = max(self.at, min(newest, self.at + self.most) if self.most else newest)
        return {"version": self.at}

    def partitions(self, start: dict, end: dict) -> list[File]:
        self.at = max(self.at, end["version"])
        manifests, fs, out = self._manifests(), file_system(self.table)[0], []
        known = set(self._entry(manifests[start["version"]])["data"]) if start["version"] else set()
        for version in range(start["version"] + 1, end["version"] + 1):
            entry = self._entry(manifests[version])
            if not known <= set(entry["data"]) or (entry["buckets"] and version > 1):
                raise PlanError(f"{self.table}: version {version} ({entry['operation']}) rewrites what was streamed")
            for name in sorted(set(entry["data"]) - known):
                base = posixpath.join(file_system(self.table)[1], name)
                files = fs.get_file_info(pyarrow.fs.FileSelector(base, recursive=True))
                out += [File(f.path) for f in files if f.base_name.startswith("part-")]
            known = set(entry["data"])
        return out

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fs, _ = file_system(self.table)
        schema = to_arrow_schema(self.schema)
        # Partition columns stand in the path, as name=value.
        told = dict(part.split("=", 1) for part in partition.path.split("/") if "=" in part)
        with fs.open_input_file(partition.path) as f:
            for batch in pq.ParquetFile(f).iter_batches():

                def column(x: pa.Field, batch: pa.RecordBatch = batch) -> pa.Array:
                    if x.name in batch.schema.names:
                        return batch.column(batch.schema.get_field_index(x.name)).cast(x.type)
                    if told.get(x.name, NO_VALUE) == NO_VALUE:
                        return pa.nulls(batch.num_rows, x.type)
                    return pa.array([unquote(told[x.name])] * batch.num_rows, pa.string()).cast(x.type)

                yield pa.RecordBatch.from_arrays([column(x) for x in schema], schema=schema)

    def commit(self, end: dict) -> None:
        pass


class TableStream(DataSource):
    """Format `store_table`; options path, startingVersion, maxVersionsPerTrigger. The schema must be given.

    A run of `availableNow` is one batch, so with a limit it takes that many versions and the next run the next.
    """

    @classmethod
    def name(cls) -> str:
        return "store_table"

    def streamReader(self, schema: StructType) -> TableStreamReader:  # noqa: N802
        return TableStreamReader(schema, self.options)
