"""Streaming pieces: bounded dedup, interval join, micro-batch loads, and one-shot runs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import PlanError
from ..operators import loads
from ..sources.commit import Folder
from ..sources.store import Store


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A file stream over one Parquet table, its time column as a timestamp.

    A path pattern may name a single file, which a plain path to a stream may not.
    """
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]").withColumn("ts", F.col("ts").cast("timestamp"))


def dedup(df: DataFrame, keys: list[str], time: str = "ts", delay: str = "1 day") -> DataFrame:
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed(df: DataFrame, width: str, keys: list[str], aggregates: list[Column], time: str = "ts", delay: str = "1 day", slide: str | None = None, gap: str | None = None) -> DataFrame:
    """Aggregates per time window and key, with a watermark: tumbling, sliding with `slide`, sessions with `gap`.

    A row later than the watermark is dropped; a window comes out once the watermark has passed its end.
    """
    kind = F.session_window(time, gap) if gap else F.window(time, width, slide)
    return df.withWatermark(time, delay).groupBy(kind.alias("window"), *keys).agg(*aggregates)


def interval_join(left: DataFrame, right: DataFrame, key: str, minutes: int, delay: str = "1 day", time: str = "ts", row: str = "event_id") -> DataFrame:
    """Pairs (first_id, second_id) of one key where the right row is at most so many minutes after the left one."""
    a = left.withWatermark(time, delay).select(key, F.col(time).alias("a_ts"), F.col(row).alias("first_id"))
    b = right.withWatermark(time, delay).select(F.col(key).alias("b_key"), F.col(time).alias("b_ts"), F.col(row).alias("second_id"))
    near = (F.col("b_ts") >= F.col("a_ts")) & (F.col("b_ts") <= F.col("a_ts") + F.expr(f"INTERVAL {minutes} MINUTES"))
    return a.join(b, (F.col(key) == F.col("b_key")) & near & (F.col("first_id") != F.col("second_id"))).select("first_id", "second_id")


def run_once(df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns the rows it wrote."""
    spark, name = df.sparkSession, f"once_{uuid.uuid4().hex}"
    if mode == "append":
        out = f"{folder}/{name}"
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(df.schema).parquet(out)
    held: list[str] = []

    def keep(batch: DataFrame, batch_id: int) -> None:
        held[:] = [f"{folder}/{name}-{batch_id}"]
        batch.write.mode("overwrite").parquet(held[0])

    df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(*held)


def load_scd1(df: DataFrame, store: Store, table: str, cdc: loads.Cdc, checkpoint: str) -> None:
    """Micro-batches into an SCD1 state, of which only the buckets that a batch touches are written again; a batch
    that is replayed after a failure is committed once."""

    def batch(changes: DataFrame, number: tuple[str, int]) -> None:
        store.merge(table, changes, cdc.keys, lambda state, new: loads.scd1_state(state, new, cdc), "SCD1", number)

    each_batch(df, batch, checkpoint)


def each_batch(df: DataFrame, handler: Callable[[DataFrame, tuple[str, int]], None], checkpoint: str) -> None:
    """Calls handler(rows, (query id, batch number)) for all there is. The query id belongs to the checkpoint, so a
    new checkpoint's batches, which are numbered from 0 again, are other batches."""
    folder = Folder(df.sparkSession, checkpoint)

    def numbered(batch: DataFrame, batch_id: int) -> None:
        handler(batch, (folder.read_json("metadata")["id"], batch_id))

    df.writeStream.foreachBatch(numbered).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def reconcile_stream(source: DataFrame, target: Callable[[], DataFrame], keys: list[str], compare: list[str], store: Store, table: str, checkpoint: str) -> None:
    """Each micro-batch of source is compared with the target as it is then; class counts are appended once a batch."""
    from ..operators import reconcile

    if target().isStreaming:
        raise PlanError("at most one side of a reconciliation can be a stream")

    def batch(changes: DataFrame, number: tuple[str, int]) -> None:
        s, g = reconcile.prepare(changes, keys, compare), reconcile.prepare(target(), keys, compare)
        counts = reconcile.counts(reconcile.classify(s, g)).withColumn("batch_id", F.lit(number[1]).cast("bigint"))
        store.write(table, counts, "APPEND", number)

    each_batch(source, batch, checkpoint)
