"""Source and target compared by hashes: fingerprints first, then a full outer join on one hash column."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ShapeError
from ..functions.hashing import KEY, VALUE, compared_columns, fingerprint, folded, unfolded, with_hashes

#: Classes of a key; a matching pair of rows beats a differing one, and that a missing side (fixed by the format).
MATCHED, DRIFT, NO_TARGET, NO_SOURCE = "MATCHED", "VALUE_DRIFT", "MISSING_IN_TARGET", "MISSING_IN_SOURCE"


def prepare(df: DataFrame, keys: Sequence[str], compare: Sequence[str] | None = None, hashed: bool = False) -> DataFrame:
    """df with key and value hash; an empty list compares presence only. With hashed, df brings its own."""
    if hashed:
        if absent := [c for c in (KEY, VALUE) if c not in df.columns]:
            raise ShapeError(f"precomputed hashes are missing: {absent}")
        return df
    return with_hashes(df, keys, compared_columns(df.columns, keys) if compare is None else compare)


def same(source: DataFrame, target: DataFrame) -> bool:
    """Phase 1. May be falsely true for duplicates of even number, never falsely false."""
    return fingerprint(source) == fingerprint(target)


def classify(source: DataFrame, target: DataFrame, presence_only: bool = False) -> DataFrame:
    """Phase 2: one row per key hash with its class; duplicates on either side do not multiply keys.

    Both sides are one table with a flag, summed up by (key, value) and then by key, each with a map-side sum: a
    key repeated a million times moves as one row per task, and nothing is joined.
    """
    value = F.lit(None).cast("string") if presence_only else F.col(VALUE)
    side = lambda df, s: df.select(KEY, value.alias("v"), F.lit(s).alias("s"), F.lit(not s).alias("t"))
    rows = side(source, True).union(side(target, False))
    pairs = rows.groupBy(KEY, "v").agg(F.bool_or("s").alias("s"), F.bool_or("t").alias("t"))
    keys = pairs.groupBy(KEY).agg(F.bool_or(F.col("s") & F.col("t")).alias("equal"), F.bool_or("s").alias("s"), F.bool_or("t").alias("t"))
    kind = F.when(F.col("equal"), MATCHED).when(F.col("s") & F.col("t"), DRIFT).when(F.col("s"), NO_TARGET).otherwise(NO_SOURCE)
    return keys.select(KEY, kind.alias("class"))


def counts(classes: DataFrame) -> DataFrame:
    """Matched, drifted, missing in target (drift included) and missing in source keys; zeros on no rows."""
    n = lambda *k: F.coalesce(F.count_if(F.col("class").isin(*k)), F.lit(0)).cast("bigint")
    return classes.agg(n(MATCHED).alias("matched"), n(DRIFT).alias("value_drift"), n(NO_TARGET, DRIFT).alias("missing_in_target"), n(NO_SOURCE).alias("missing_in_source"))


def missing_rows(source: DataFrame, classes: DataFrame) -> DataFrame:
    """Source rows that are missing or drifted in the target, duplicates preserved."""
    return source.join(classes.filter(F.col("class").isin(NO_TARGET, DRIFT)).select(KEY), KEY, "left_semi")


def mismatches(source: DataFrame, target: DataFrame, classes: DataFrame, keys: Sequence[str], compare: Sequence[str]) -> DataFrame:
    """Per key that doesn't match: class, key JSON, and for drift the differing columns with both values."""
    bad = classes.filter(F.col("class") != MATCHED)
    # Only rows of keys that don't match are summed up.
    side = lambda df, n: df.join(bad.select(KEY), KEY, "left_semi").groupBy(KEY).agg(F.min(F.struct(*keys, *compare)).alias(n))
    rows = bad.join(side(source, "s"), KEY, "left").join(side(target, "t"), KEY, "left")
    text = lambda n, c: F.col(f"{n}.{c}").cast("string")
    differs = F.array_compact(F.array(*[F.when(~text("s", c).eqNullSafe(text("t", c)), F.struct(F.lit(c).alias("column"), text("s", c).alias("source"), text("t", c).alias("target"))) for c in compare]))
    key = F.to_json(F.struct(*[F.coalesce(F.col(f"s.{k}"), F.col(f"t.{k}")).alias(k) for k in keys]))
    return rows.select(KEY, "class", key.alias("key_json"), F.when(F.col("class") == DRIFT, F.to_json(differs)).alias("drift_json"))


def batch_fingerprint(rows: DataFrame) -> DataFrame:
    """Order-independent fingerprint of the distinct keys of a miss set; names a healing batch."""
    made = rows.select(KEY).distinct().agg(*[x.alias(f"k{i}") for i, x in enumerate(folded(F.col(KEY)))])
    return made.select(unfolded([F.col(c) for c in made.columns]).alias("fingerprint"))


@dataclass(frozen=True)
class Outcome:
    """What one comparison found and did: the metrics record of a reconciliation."""

    status: str
    matched: int = 0
    value_drift: int = 0
    missing_in_target: int = 0
    missing_in_source: int = 0
    appended: int = 0
    fingerprint: str | None = None
    error: str | None = None


def run(source: DataFrame, target: DataFrame, keys: Sequence[str], compare: Sequence[str] | None = None, heal: Callable[[DataFrame], object] | None = None, ledger: Ledger | None = None, two_tier: bool = True, hashed: bool = False) -> Outcome:
    """Compares both sides; `heal(rows)` appends the miss set, once per fingerprint that the ledger knows."""
    s, t = prepare(source, keys, compare, hashed).persist(), prepare(target, keys, compare, hashed).persist()
    try:
        if two_tier and same(s, t):
            return Outcome("MATCHED", matched=s.select(KEY).distinct().count())
        classes = classify(s, t, compare is not None and not compare).persist()
        found = counts(classes).first().asDict()
        rows = missing_rows(s, classes)
        mark = batch_fingerprint(rows).first()[0]
        if heal is None or not found["missing_in_target"]:
            return Outcome("SUCCESS", **found, fingerprint=mark)
        if ledger is not None and mark in ledger:
            return Outcome("SKIPPED_ALREADY_PROCESSED", **found, fingerprint=mark)
        out = rows.drop(KEY, VALUE)
        heal(out)
        if ledger is not None:
            ledger.add(mark)
        return Outcome("SUCCESS", **found, appended=out.count(), fingerprint=mark)
    finally:
        s.unpersist(), t.unpersist()


class Ledger(Protocol):
    """Fingerprints of miss sets that were appended; a set will do, a table outlives the process."""

    def __contains__(self, mark: str) -> bool: ...

    def add(self, mark: str) -> None: ...
