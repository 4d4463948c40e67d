"""Small files on any file system that Spark reaches, and commits that no other writer can overwrite."""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    """A folder, by Hadoop's file system API on the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._jvm = spark, path.rstrip("/"), spark._jvm
        self.fs = self.at("x").getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str = "") -> list[str]:
        """Names in a folder, in order; none if it isn't there."""
        where = self.at(folder)
        return sorted(f.getPath().getName() for f in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def read_bytes(self, name: str) -> bytes:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def read_json(self, name: str) -> dict:
        return json.loads(self.read_bytes(name))

    def write_bytes(self, name: str, data: bytes, overwrite: bool = True) -> None:
        stream = self.fs.create(self.at(name), overwrite)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)

    def commit_json(self, name: str, entry: dict) -> bool:
        """Puts the file there whole, or returns False if the name is taken, whoever else tries the same."""
        draft = f"{os.path.dirname(name)}/draft-{uuid.uuid4().hex}"
        self.write_bytes(draft, json.dumps(entry).encode(), overwrite=False)
        if self._placed(self.at(draft), self.at(name)):
            return True
        self.delete(draft)
        return False

    def _placed(self, draft, final) -> bool:
        """Hadoop's rename without the overwrite option is one step on a name node. On a local disk it looks first
        and moves then, so a hard link, which the kernel refuses for a name in use, takes its place there."""
        if self.fs.getScheme() == "file":
            try:
                os.link(draft.toUri().getPath(), final.toUri().getPath())
            except FileExistsError:
                return False
            self.fs.delete(draft, False)
            return True
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, final, plain)
        except Py4JJavaError as e:
            if e.java_exception.getClass().getName().endswith("FileAlreadyExistsException"):
                return False
            raise
        return True
