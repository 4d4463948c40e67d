"""Shared plumbing of the corpus operators: work folders that every executor sees, and word rules."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Java/RE2 classes of the two word rules: split at ASCII white space, or at every ASCII non-alphanumeric.
SPACE = r"[\x20\x09-\x0D]+"
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: bytes.translate table of the second rule: lower-cases A-Z, turns separators into blanks.
ALNUM_TABLE = bytes(
    (c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset (tests), one is made and set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="sluice-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


@contextlib.contextmanager
def at_most(spark: SparkSession, key: str, most: int | None):
    """Holds a setting of the session, of which 0 or less is no limit, at most so high; None leaves it alone."""
    before = spark.conf.get(key)
    if most is None or 0 < int(before) <= most:
        yield
        return
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Workspace:
    """A fresh folder below the shared root. Tables written here cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def save(self, df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
        """Writes df as Parquet and returns the frame that reads it. With batch_rows its Python steps get their rows
        in batches of at most that many: the executor and its workers hold one or two batches of every task."""
        with at_most(self.spark, "spark.sql.execution.arrow.maxRecordsPerBatch", batch_rows):
            df.write.mode("overwrite").parquet(self.at(name))
        return self.spark.read.schema(df.schema).parquet(self.at(name))

    def drop(self, *names: str) -> None:
        """Deletes tables (all of the folder without names) and lets Spark release unused shuffle files."""
        jvm = self.spark._jvm
        for path in [self.at(n) for n in names] or [self.path]:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        release(self.spark)


def held(kind: str, key: str, make):
    """This worker process's large object of a kind, made once per key. A process holds one such object at a time:
    workers are used again by the next stage, and its memory is theirs too."""
    found = sys.__dict__.get("_sluice_held")
    if found is None or found[:2] != (kind, key):
        sys.__dict__["_sluice_held"] = None
        found = sys.__dict__["_sluice_held"] = (kind, key, make())
    return found[2]


def let_go() -> None:
    """Frees what `held` keeps; for tasks that have no use for it."""
    sys.__dict__["_sluice_held"] = None


def tidied(run):
    """A function over a partition's batches that gives freed memory back to the system when it ends: Arrow and the
    C library would keep it for this worker, which then waits beside the next stage's memory."""

    @functools.wraps(run)
    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # another C library
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return tidy


def release(spark: SparkSession) -> None:
    """Collects driver garbage, so that shuffle files of finished queries are removed."""
    gc.collect()
    spark._jvm.System.gc()


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; lower() does the same, much faster, where all characters are ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def bind(df: DataFrame, **named: Column) -> DataFrame:
    """df with the named columns (those of the same name replaced), each computed once per row whatever is
    selected or filtered later.

    They come out of a generator of one row. The optimiser neither merges projections across it nor moves a
    predicate on its output below it, so no later filter or lambda repeats the work.
    """
    values = F.explode(F.array(F.struct(*[c.alias(n) for n, c in named.items()]))).alias("bound")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in named]
    return df.select("*", values).select(*kept, *[F.col("bound").getField(n).alias(n) for n in named])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
