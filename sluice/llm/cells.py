"""Tables of a fixed number of hashed cells, filled by all tasks and merged in a tree.

Their size depends on neither rows nor tasks, so the driver may hold and broadcast them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied

#: Entries of a cell table that travel as one row.
CHUNK = 1 << 16
#: Rows of a chunk that one merging task reads at most.
FAN_IN = 64


def merged(frame: DataFrame, fill: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], size: int, op: np.ufunc, wide: type) -> np.ndarray:
    """The element-wise op, as numbers of type wide, over what fill makes of each partition of frame.

    fill returns size entries, or None for nothing; size is a multiple of CHUNK. An empty frame gives zeros.
    """

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = fill(batches)
        if filled is not None:
            chunks = [filled[at : at + CHUNK].astype(wide).tobytes() for at in range(0, size, CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(chunks), dtype=np.int32)), pa.array(chunks, pa.binary())], ["chunk", "entries"])

    def merge(table: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x.as_py(), wide) for x in table.column("entries")]
        total = rows[0]
        for row in rows[1:]:
            total = op(total, row)
        return pa.table({"part": table.column("part").slice(0, 1), "chunk": table.column("chunk").slice(0, 1), "entries": pa.array([total.tobytes()], pa.binary())})

    tasks = frame.rdd.getNumPartitions()
    rows = frame.mapInArrow(run, "chunk int, entries binary").withColumn("part", F.spark_partition_id())
    while True:
        tasks = -(-tasks // FAN_IN)
        rows = rows.select(F.floor(F.col("part") / FAN_IN).cast("int").alias("part"), "chunk", "entries")
        rows = rows.groupBy("part", "chunk").applyInArrow(merge, "part int, chunk int, entries binary")
        if tasks <= 1:
            break
    out = np.zeros(size, wide)
    for row in rows.collect():  # size / CHUNK rows
        out[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["entries"], wide)
    return out
