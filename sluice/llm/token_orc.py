"""Token ids as ORC: integer run-length encoded stripes, row indexes and Bloom filters on document ids.

Documents are dealt by ranges of doc_id and sorted, so a file holds a contiguous range and readers can skip
files, stripes and row groups by the statistics of doc_id; stripes are read in parallel.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let_go, tidied
from .tokens import WordEncoder

FORMAT = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.compress": "ZSTD"}
SCHEMA = "doc_id long, part int, part_start long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Encodes every text with an end id and writes (doc_id, part, part_start, ids) in ascending doc_id order.

    part is the range's number, part_start counts the ids before the document in its range. Null text is
    empty (the end id alone). Null doc_ids come first; rows that repeat a doc_id are ordered by a hash of
    their text, so the files are the same whenever a task is run again. Long texts are encoded whole. An empty
    table gives a folder without rows; extra columns are ignored.
    """

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = WordEncoder.of(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            row = 0
            for coded, sizes in encoder.runs(batch.column(1)):
                ends = np.cumsum(sizes)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(coded.view(np.int32)))
                keys = batch.column(0).slice(row, len(sizes))
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.full(len(sizes), part, np.int32)), pa.array(at + ends - sizes), ids], ["doc_id", "part", "part_start", "ids"])
                at += int(ends[-1])
                row += len(sizes)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = ("doc_id", F.xxhash64("text"))
    text.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, SCHEMA).write.mode("overwrite").options(**FORMAT).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows; filters on doc_id reach the files' statistics and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            lists = batch.column(3)
            offsets = lists.offsets.to_numpy()
            values = memoryview(np.ascontiguousarray(lists.values.to_numpy(), "<i4")).cast("B")
            crc = [zlib.crc32(values[4 * s : 4 * e]) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
                ["doc_id", "part", "part_start", "n_tokens", "ids_crc32"],
            )

    files = read_tokens(spark, path)
    sizes = files.groupBy("part").agg(F.sum(F.size("ids").cast("long")).alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range: as many as shuffle partitions, so the broadcast is bounded by that setting.
    bases = sizes.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    rows = files.mapInArrow(run, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
