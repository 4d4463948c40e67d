"""Packing documents into fixed-size sequences: cutting stock by column generation.

Documents are cut into full sequences and one remainder; remainders are counted in a histogram of length
classes. A linear program over patterns (how many remainders of each class fill one sequence) is solved by
the simplex method, a knapsack dynamic program prices new patterns, the solution is rounded down, and the
few remainders left are packed best fit decreasing. All that works on the histogram alone, whose size does
not grow with the corpus. Documents are then ranked within their class and dealt to the patterns' slots.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, let_go, tidied
from .tokens import WordEncoder

#: Width of a length class in tokens: a pattern is at most this much per piece longer than its pieces.
STEP = 8
#: Rows that a task gets at once (10,000, Spark's default, are about 25 MB of the large check table, held on both
#: sides of the pipe) and bytes of text that it takes apart at once.
BATCH_ROWS, CHUNK = 1_000, 4 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, part int, rank long"


def cut(docs: DataFrame, tokenizer: str, size: int, step: int = STEP) -> DataFrame:
    """One row per piece; class 0 are full sequences, class c > 0 remainders of up to c * step tokens."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = WordEncoder.of(tokenizer), TaskContext.get().partitionId()
        seen = [0] * (size // step + 2)
        for batch in batches:
            docs = iter(batch.column(0).to_pylist())
            for coded, sizes in encoder.runs(batch.column(1), CHUNK):
                rows, ids, at = [], memoryview(coded).cast("B"), 0
                for n, doc in zip(sizes.tolist(), docs):
                    for start in range(0, n, size):
                        length = min(size, n - start)
                        piece = ids[4 * (at + start) : 4 * (at + start + length)]
                        c = 0 if length == size else -(-length // step)
                        rows.append((doc, start, length, zlib.crc32(piece), n, c, part, seen[c]))
                        seen[c] += 1
                    at += n
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def knapsack(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of classes 1..len(values) whose sizes add up to at most the capacity."""
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for w in range(1, capacity + 1):
        k = min(w, len(values))
        gain = best[w - k : w][::-1] + values[:k]
        c = int(np.argmax(gain))
        best[w], choice[w] = (gain[c], c + 1) if gain[c] > best[w - 1] else (best[w - 1], 0)
    pattern, w = np.zeros(len(values), np.int64), capacity
    while w > 0:
        if choice[w]:
            pattern[choice[w] - 1] += 1
            w -= choice[w]
        else:
            w -= 1
    return float(best[capacity]), pattern


def solve(demand: np.ndarray, capacity: int, rounds: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often each is used in the linear program's solution. demand[c - 1] > 0 or 0."""
    rows = np.flatnonzero(demand)
    m = len(rows)
    basis = np.zeros((m, len(demand)), np.int64)
    for i, c in enumerate(rows):
        basis[i, c] = capacity // (c + 1)
    inverse = np.diag(1.0 / basis[np.arange(m), rows])
    used = inverse @ demand[rows].astype(float)
    for _ in range(rounds):
        prices = inverse.sum(axis=0)  # every pattern costs one sequence
        values = np.zeros(len(demand))
        values[rows] = prices
        gain, pattern = knapsack(values, capacity)
        if gain <= 1 + 1e-6:
            break
        direction = inverse @ pattern[rows]
        ratios = np.where(direction > 1e-9, used / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(np.argmin(ratios))
        if not np.isfinite(ratios[out]):
            break
        used -= ratios[out] * direction
        used[out] = ratios[out]
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
        basis[out] = pattern
    else:
        warnings.warn(f"column generation stopped after {rounds} rounds: the packing is whole, but its padding may not be the least", stacklevel=2)
    return basis, np.maximum(used, 0)


def plan(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) that hold exactly the demand: the rounded solution and the rest by best fit."""
    left, made = demand.astype(np.int64).copy(), []
    for pattern, times in zip(*solve(demand, capacity)) if demand.any() else ():
        fits = left[pattern > 0] // pattern[pattern > 0]
        if (n := min(int(times + 1e-6), int(fits.min()))) > 0:
            left -= n * pattern
            made.append((pattern, n))
    room: list[list[np.ndarray]] = [[] for _ in range(capacity + 1)]
    for c in range(len(left), 0, -1):
        for _ in range(int(left[c - 1])):
            r = next((r for r in range(c, capacity + 1) if room[r]), None)
            pattern = room[r].pop() if r is not None else np.zeros(len(left), np.int64)
            pattern[c - 1] += 1
            room[(capacity if r is None else r) - c].append(pattern)
    return made + [(p, 1) for r in room for p in r]


def slots(patterns: list[tuple[np.ndarray, int]], classes: int) -> list[tuple[np.ndarray, ...]]:
    """Per class: first rank, pieces per sequence, first sequence and first slot of every pattern holding it."""
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in range(classes + 1)]
    taken, first = [0] * (classes + 1), 0
    for pattern, times in patterns:
        place = count()
        for c in np.flatnonzero(pattern):
            n = int(pattern[c])
            slot = next(place)
            for _ in range(n - 1):
                next(place)
            out[c + 1].append((taken[c + 1], n, first, slot))
            taken[c + 1] += n * times
        first += times
    out[0].append((0, 1, first, 0))  # full pieces have sequences of their own, after all others
    return [tuple(np.array(x, np.int64) for x in zip(*rows)) if rows else () for rows in out]


def pack(docs: DataFrame, work: Workspace, tokenizer: str, size: int = 4096, step: int = STEP) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each id of each document (its text's ids and the end id) lies in exactly one piece; a sequence holds at
    most `size` ids, and its offsets are gapless from 0. Null or empty text is the end id alone. Rows that
    repeat a doc_id (null too) are packed as documents of their own. Long texts are cut into as many full
    sequences as they fill. Other columns are ignored; an empty table gives no piece.
    """
    pieces = work.save(cut(docs, tokenizer, size, step), "pieces", BATCH_ROWS)
    capacity = size // step
    counts = work.save(pieces.groupBy("part", "class").agg(F.count("*").alias("n")), "counts")
    demand = np.zeros(capacity, np.int64)
    for row in counts.filter("class > 0").groupBy("class").agg(F.sum("n").alias("n")).collect():  # at most size / step rows
        demand[row["class"] - 1] = row["n"]
    tables = slots(plan(demand, capacity), capacity)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            kind, rank = batch.column(5).to_numpy(), batch.column(6).to_numpy()
            sequence, slot = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for c in np.unique(kind):
                at = np.flatnonzero(kind == c)
                ranks, per, first, place = tables[c]
                i = np.searchsorted(ranks, rank[at], side="right") - 1
                k = rank[at] - ranks[i]
                sequence[at], slot[at] = first[i] + k // per[i], place[i] + k % per[i]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(slot)], [*batch.schema.names[:5], "sequence_id", "slot"])

    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "class", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    ranked = pieces.join(offsets, ["part", "class"]).select(*columns, "class", (F.col("before") + F.col("rank")).alias("rank"))
    dealt = ranked.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.select(*columns, "sequence_id", F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset"))
