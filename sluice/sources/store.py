"""Versioned Parquet tables: new directories per version and a manifest that is committed under its number."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import LoadError
from ..functions.hashing import row_hash
from .commit import Folder

BUCKET = "_eng_bucket"
#: At most so many clustering columns (fixed by the format of the properties).
MAX_CLUSTERING = 3


@dataclass(frozen=True)
class Properties:
    """How a table is laid out: partition columns, columns that order the rows of a file, and an age limit.

    ttl is (timestamp column, days); older rows are left out when a version is written. A row without a time stays.
    """

    partition_by: Sequence[str] = ()
    cluster_by: Sequence[str] = ()
    ttl: tuple[str, int] | None = None

    @classmethod
    def of(cls, spec: Mapping | None) -> Properties:
        spec = dict(spec or {})
        unknown = set(spec) - {"partition_by", "cluster_by", "ttl"}
        if unknown:
            raise LoadError(f"table properties not known: {sorted(unknown)}")
        if len(spec.get("cluster_by", ())) > MAX_CLUSTERING:
            raise LoadError(f"at most {MAX_CLUSTERING} clustering columns")
        ttl = spec.get("ttl")
        return cls(tuple(spec.get("partition_by", ())), tuple(spec.get("cluster_by", ())), (ttl["column"], int(ttl["days"])) if ttl else None)

    def laid_out(self, df: DataFrame) -> DataFrame:
        missing = [c for c in (*self.partition_by, *self.cluster_by, *([self.ttl[0]] if self.ttl else [])) if c not in df.columns]
        if missing:
            raise LoadError(f"table properties name columns that are not there: {missing}")
        if self.ttl:
            column, days = self.ttl
            df = df.filter(F.col(column).isNull() | (F.col(column).cast("timestamp") >= F.current_timestamp() - F.make_dt_interval(F.lit(days))))
        return df.sortWithinPartitions(*self.partition_by, *self.cluster_by) if self.cluster_by else df


class Store:
    """Tables below one folder of any file system Spark reaches. Readers see whole versions only.

    A manifest names the directories of its version and, per streaming query, the last batch it holds: a query's
    batches have ascending numbers, so a batch that is replayed is known, and those of another query are not
    mistaken for it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.folder = spark, path.rstrip("/"), Folder(spark, path)

    def tables(self) -> list[str]:
        return [n for n in self.folder.names() if self.versions(n)]

    def versions(self, table: str) -> list[int]:
        return [int(n[:-5]) for n in self.folder.names(f"{table}/_versions") if n.endswith(".json")]

    def manifest(self, table: str, version: int | None = None) -> dict | None:
        """The manifest of a version, by default the newest; None for a table without versions."""
        found = self.versions(table)
        if not found or (version is not None and version not in found):
            return None
        return self.folder.read_json(f"{table}/_versions/{version if version is not None else found[-1]:010d}.json")

    def history(self, table: str) -> list[dict]:
        """All manifests, oldest first."""
        return [self.manifest(table, v) for v in self.versions(table)]

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        entry = self.manifest(table, version)
        return self._frame(table, entry["data"], entry["schema"]) if entry else None

    def _frame(self, table: str, data: Sequence[str], schema: str) -> DataFrame:
        """Directories with parts of a table; each is read by its own schema, as later ones may have more columns."""
        frames = {}
        for d in data:
            frames.setdefault(d.split("/")[0], []).append(d)
        out = None
        for name, parts in frames.items():
            df = self.spark.read.option("basePath", f"{self.path}/{table}/{name}").parquet(*[f"{self.path}/{table}/{p}" for p in parts])
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return self.spark.createDataFrame([], StructType.fromJson(json.loads(schema))) if out is None else out.drop(BUCKET)

    def committed(self, table: str, batch: tuple[str, int] | None) -> bool:
        entry = self.manifest(table)
        return bool(batch and entry and entry["batches"].get(batch[0], -1) >= batch[1])

    def write(self, table: str, df: DataFrame, operation: str = "REPLACE", batch: tuple[str, int] | None = None, properties: Properties = Properties()) -> int:
        """A new version; APPEND adds a directory, everything else replaces. A batch (query id, number) that
        the table holds already is skipped."""
        old = self.manifest(table)
        if self.committed(table, batch):
            return old["version"]
        if old and old["buckets"] and operation == "APPEND":
            return self.merge(table, df, old["buckets"]["keys"], lambda current, new: current.unionByName(new, allowMissingColumns=True), operation, batch)
        name = self._written(table, properties.laid_out(df), properties.partition_by)
        kept = old["data"] if old and operation == "APPEND" else []
        return self._commit(table, old, df.schema.json(), [*kept, name], operation, batch)

    def merge(self, table: str, changes: DataFrame, keys: Sequence[str], apply: Callable[[DataFrame | None, DataFrame], DataFrame], operation: str, batch: tuple[str, int] | None = None, buckets: int = 64) -> int:
        """A new version with `apply(current, changes)`, where a row's outcome depends on rows of its key alone.

        Rows are dealt to buckets by key; only buckets that changes touch are read and written again.
        """
        old = self.manifest(table)
        if self.committed(table, batch):
            return old["version"]
        if old and (old["buckets"] or {}).get("keys") != list(keys):
            raise LoadError(f"{table} is not kept by {list(keys)} and can't be merged into by them")
        buckets = old["buckets"]["count"] if old else buckets
        kept_by = {"count": buckets, "keys": list(keys)}
        number = bucket_of(keys, buckets)
        touched = sorted(r[0] for r in changes.select(number.alias("b")).distinct().collect())  # one row per bucket
        if old and not touched:
            return self._commit(table, old, old["schema"], old["data"], operation, batch, kept_by)
        part = lambda d: int(d.rpartition(f"{BUCKET}=")[2])
        hit = [d for d in old["data"] if part(d) in touched] if old else []
        made = apply(self._frame(table, hit, old["schema"]) if old else None, changes)
        name = self._written(table, made.withColumn(BUCKET, number).repartition(F.col(BUCKET)), (BUCKET,))
        fresh = [f"{name}/{d}" for d in self.folder.names(f"{table}/{name}") if d.startswith(f"{BUCKET}=")]
        kept = [d for d in old["data"] if part(d) not in touched] if old else []
        return self._commit(table, old, made.schema.json(), [*kept, *fresh], operation, batch, kept_by)

    def _written(self, table: str, df: DataFrame, partition_by: Sequence[str]) -> str:
        name = f"data-{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).parquet(f"{self.path}/{table}/{name}")
        return name

    def _commit(self, table: str, old: dict | None, schema: str, data: Sequence[str], operation: str, batch: tuple[str, int] | None, buckets: Mapping | None = None) -> int:
        version = old["version"] + 1 if old else 1
        batches = (old["batches"] if old else {}) | ({batch[0]: batch[1]} if batch else {})
        entry = {"version": version, "data": list(data), "operation": operation, "batches": batches, "buckets": buckets, "schema": schema}
        if not self.folder.commit_json(f"{table}/_versions/{version:010d}.json", entry):
            raise LoadError(f"{table}: version {version} was committed by another writer")
        return version

    def changes(self, table: str, start: int, end: int, keys: Sequence[str]) -> DataFrame:
        """Counts by change (insert, update, delete) between two versions, by key and row hash."""
        a, b = self.read(table, start), self.read(table, end)
        values = sorted(set(b.columns) - set(keys))
        a = a.select(*keys, *[F.col(c) if c in a.columns else F.lit(None).alias(c) for c in values])
        side = lambda df, n: df.select(*keys, row_hash(values).alias(n))
        change = F.when(F.col("o").isNull(), "insert").when(F.col("n").isNull(), "delete").when(F.col("o") != F.col("n"), "update")
        return side(a, "o").join(side(b, "n"), list(keys), "full_outer").select(change.alias("change")).filter("change IS NOT NULL").groupBy("change").agg(F.count("*").alias("n"))


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
