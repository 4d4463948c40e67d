"""Size-tiered compaction of immutable shards under a versioned manifest.

Arrivals are appended as small Parquet shards. Compaction sorts the shards into tiers by size; a tier with
enough shards is a run of similarly sized ones, which is merged into files of the target size without any
shuffle. Every change is one new manifest, committed under its version's name unless that is taken; readers only see
shards that a manifest names, so a job that dies leaves nothing but unnamed files for vacuum().
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..sources.commit import Folder
from .common import shared_root


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int


class ShardStore:
    """A table of shards below one folder, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 128 << 20, fan_in: int = 4, base_bytes: int = 64 << 10):
        self.spark, self.path, self.target, self.fan_in, self.base = spark, path.rstrip("/"), target_bytes, fan_in, base_bytes
        self._folder = Folder(spark, self.path)

    def versions(self) -> list[int]:
        return [int(n[1:-5]) for n in self._folder.names("_manifests") if n.startswith("v") and n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "schema", "shards"} of a version, by default the newest; version 0 is empty."""
        version = version if version is not None else max(self.versions(), default=0)
        if version == 0:
            return {"version": 0, "schema": None, "shards": []}
        found = self._folder.read_json(f"_manifests/v{version:08d}.json")
        return found | {"shards": [Shard(**s) for s in found["shards"]]}

    def _commit(self, old: dict, schema: str, shards: list[Shard]) -> int:
        """Commits the next manifest; if another writer was first, nothing changes and it fails."""
        version = old["version"] + 1
        if not self._folder.commit_json(f"_manifests/v{version:08d}.json", {"version": version, "schema": schema, "shards": [asdict(s) for s in shards]}):
            raise RuntimeError(f"{self.path}: version {version} was committed by another writer")
        return version

    def _write(self, df: DataFrame, rows_per_shard: int = 0) -> list[Shard]:
        name = f"shards/{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", rows_per_shard).parquet(self._folder.at(name).toString())
        listed = self._folder.fs.listStatus(self._folder.at(name))
        return [Shard(f"{name}/{f.getPath().getName()}", f.getLen()) for f in listed if f.getPath().getName().startswith("part-")]

    def append(self, arrivals: DataFrame, rows_per_shard: int = 2000) -> int:
        """Adds arrivals as small shards; returns the new version."""
        old = self.manifest()
        schema = old["schema"] or arrivals.schema.json()
        if StructType.fromJson(json.loads(schema)).simpleString() != arrivals.schema.simpleString():
            raise ValueError(f"{self.path}: arrivals have another schema than the shards")
        return self._commit(old, schema, old["shards"] + self._write(arrivals, rows_per_shard))

    def tier(self, size: int) -> int:
        """Tier t holds shards of base * fan_in ** (t - 1) up to base * fan_in ** t bytes."""
        return 0 if size <= self.base else math.ceil(math.log(size / self.base, self.fan_in) - 1e-9)

    def runs(self, shards: list[Shard]) -> list[list[Shard]]:
        """Runs to merge: the shards of each tier with at least fan_in shards below the target size."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes < self.target // 2:
                tiers.setdefault(self.tier(s.bytes), []).append(s)
        return [run for _, run in sorted(tiers.items()) if len(run) >= self.fan_in]

    def compact(self) -> int:
        """Merges runs until no tier has one; returns the newest version. Each round is one commit, made on the
        manifest that its runs were chosen from; another commit in between makes it fail and changes nothing."""
        while runs := self.runs((old := self.manifest())["shards"]):
            merged, gone = [], {s.path for run in runs for s in run}
            for run in runs:
                files = max(1, math.ceil(sum(s.bytes for s in run) / self.target))
                merged += self._write(self._read(run, old["schema"]).coalesce(files))
            self._commit(old, old["schema"], [s for s in old["shards"] if s.path not in gone] + merged)
        return old["version"]

    def _read(self, shards: list[Shard], schema: str) -> DataFrame:
        kind = StructType.fromJson(json.loads(schema))
        if not shards:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[self._folder.at(s.path).toString() for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        found = self.manifest(version)
        return self._read(found["shards"], found["schema"])

    def vacuum(self) -> int:
        """Deletes shards that the newest manifest doesn't name (older versions can't be read then)."""
        named = {s.path for s in self.manifest()["shards"]}
        gone = 0
        for folder in self._folder.fs.listStatus(self._folder.at("shards")):
            name = f"shards/{folder.getPath().getName()}"
            files = [f for f in self._folder.fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-")]
            dead = [f for f in files if f"{name}/{f.getPath().getName()}" not in named]
            gone += len(dead)
            if len(dead) == len(files):
                self._folder.fs.delete(folder.getPath(), True)
            else:
                for f in dead:
                    self._folder.fs.delete(f.getPath(), False)
        return gone


def shard_documents(docs: DataFrame, name: str = "shards", **options) -> DataFrame:
    """docs after a pass through a store: appended as small shards, compacted, read back by the manifest.

    Rows, repeated ones and nulls included, and all columns come back as they went in, in no fixed order; an
    empty table comes back empty.
    """
    store = ShardStore(docs.sparkSession, f"{shared_root(docs.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}", **options)
    store.append(docs)
    store.compact()
    store.vacuum()
    return store.read()
