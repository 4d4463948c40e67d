"""Load strategies as functions of the current table and the changes; batch and micro-batch use the same code.

Everything is one shuffle on the key columns: a partial aggregate or a window. No step collects rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import LoadError
from ..functions.hashing import row_hash

START, END, SEQ, OP = "__START_AT", "__END_AT", "_eng_seq", "_eng_deleted"


@dataclass(frozen=True)
class Cdc:
    keys: Sequence[str]
    sequence: Sequence[str]
    deletes: str | tuple[str, Sequence[object]] | None = None  # of a row that deletes its key: a predicate, or an operation column and its values
    exclude: Sequence[str] = ()
    track: Sequence[str] | None = None  # SCD2: columns whose change opens a version; default all
    extra: Sequence[str] = field(default=())

    @property
    def gone(self) -> Column:
        """Whether a row deletes its key; an unknown operation does not."""
        if self.deletes is None:
            return F.lit(False)
        told = F.expr(self.deletes) if isinstance(self.deletes, str) else F.col(self.deletes[0]).isin(*self.deletes[1])
        return F.coalesce(told, F.lit(False))

    def check(self, df: DataFrame) -> None:
        missing = [c for c in (*self.keys, *self.sequence) if c not in df.columns]
        if not self.keys or missing:
            raise LoadError(f"keys and sequence must be columns of the source; missing: {missing or 'keys'}")

    def values(self, df: DataFrame) -> list[str]:
        drop = {*self.keys, *self.exclude, SEQ, OP, START, END}
        return [c for c in df.columns if c not in drop]


def append(current: DataFrame, changes: DataFrame) -> DataFrame:
    return current.unionByName(changes, allowMissingColumns=True)


def truncate_and_load(current: DataFrame | None, source: DataFrame, empty_target_if_source_empty: bool = False) -> DataFrame:
    """The source replaces the table; an empty source leaves it, unless asked to empty it."""
    return current if current is not None and not empty_target_if_source_empty and source.isEmpty() else source


def _events(changes: DataFrame, cdc: Cdc) -> DataFrame:
    cdc.check(changes)
    seq = F.struct(*[F.col(c) for c in cdc.sequence])
    missing = reduce(or_, [F.col(c).isNull() for c in cdc.sequence])
    guard = F.when(missing, F.raise_error(F.lit("the sequence is null")).cast("boolean")).otherwise(cdc.gone)
    return changes.select("*", seq.alias(SEQ), guard.alias(OP)).drop(*[c for c in cdc.exclude if c not in cdc.sequence])


def scd1_state(state: DataFrame | None, changes: DataFrame, cdc: Cdc) -> DataFrame:
    """Newest event per key with its sequence, tombstones included; late and split batches give the same state."""
    events = _events(changes, cdc)
    events = events if state is None else state.unionByName(events)
    values = [c for c in events.columns if c not in (*cdc.keys, SEQ, OP)]
    tie = row_hash(sorted(values)) if values else F.lit("")
    newest = F.max_by(F.struct(SEQ, OP, *values), F.struct(F.col(SEQ), tie))
    return events.groupBy(*cdc.keys).agg(newest.alias("x")).select(*cdc.keys, "x.*").select(*events.columns)


def scd1(state: DataFrame) -> DataFrame:
    """The table that a state stands for."""
    return state.filter(~F.col(OP)).drop(SEQ, OP)


def scd2(changes: DataFrame, cdc: Cdc) -> DataFrame:
    """History of all events: a version opens when a tracked column changes and closes at the next version or
    delete. Untracked columns hold the latest values seen within the version. Events are one row per key and
    sequence; of several the one with the largest row hash counts."""
    events = _events(changes, cdc)
    values = cdc.values(events)
    tracked = sorted(cdc.track or [c for c in values if c not in cdc.sequence])
    one = F.max_by(F.struct(OP, *values), row_hash(sorted(values)))
    events = events.groupBy(*cdc.keys, SEQ).agg(one.alias("x")).select(*cdc.keys, SEQ, "x.*")
    by = Window.partitionBy(*cdc.keys).orderBy(SEQ)
    state = F.when(F.col(OP), F.lit("deleted")).otherwise(row_hash(tracked))
    events = events.withColumn("_eng_state", state)
    events = events.withColumn("_eng_opens", (~F.lag("_eng_state").over(by).eqNullSafe(F.col("_eng_state"))).cast("int"))
    events = events.withColumn("_eng_version", F.sum("_eng_opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    version = events.groupBy(*cdc.keys, "_eng_version").agg(F.max_by(F.struct(*values), F.col(SEQ)).alias("x"), F.min(SEQ).alias(START), F.first(OP).alias(OP))
    version = version.withColumn(END, F.lead(START).over(Window.partitionBy(*cdc.keys).orderBy("_eng_version")))
    name = cdc.sequence[0]
    return version.filter(~F.col(OP)).select(*cdc.keys, "x.*", F.col(f"{START}.{name}").alias(START), F.col(f"{END}.{name}").alias(END))


def scd2_current(history: DataFrame) -> DataFrame:
    return history.filter(F.col(END).isNull())


def scd3(changes: DataFrame, cdc: Cdc, columns: Sequence[str], track_only_checked: bool = False) -> DataFrame:
    """Newest version per key with current_ and previous_ values; deletes are not applied."""
    if not columns:
        raise LoadError("SCD3 needs the columns to check")
    history = scd2(changes, Cdc(cdc.keys, cdc.sequence, None, cdc.exclude, columns if track_only_checked else None))
    by = Window.partitionBy(*cdc.keys).orderBy(F.desc(START))
    ranked = history.withColumn("_eng_rank", F.row_number().over(by)).filter("_eng_rank <= 2")
    pick = lambda c, r: F.max(F.when(F.col("_eng_rank") == r, F.struct(c)))[c]
    return ranked.groupBy(*cdc.keys).agg(*[x for c in columns for x in (pick(c, 1).alias(f"current_{c}"), pick(c, 2).alias(f"previous_{c}"))])


def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], deletes: str | tuple[str, Sequence[object]] | None = None) -> DataFrame:
    """Keys with change: insert, update, delete or unchanged; values are those of the newer side."""
    missing = [k for k in keys if k not in new.columns]
    if missing:
        raise LoadError(f"key columns not found: {missing}")
    new = new.filter(~Cdc(keys, (), deletes).gone)
    values = [c for c in new.columns if c not in keys]
    digest = row_hash(sorted(values)) if values else F.lit("")
    a, b = (x.select(*keys, F.struct(*values, digest.alias("_eng_digest")).alias(n)) for x, n in ((old, "o"), (new, "n")))
    change = (
        F.when(F.col("o").isNull(), "insert").when(F.col("n").isNull(), "delete").when(F.col("o._eng_digest") != F.col("n._eng_digest"), "update").otherwise("unchanged")
    )
    both = a.join(b, list(keys), "full_outer").select(*keys, change.alias("change"), F.coalesce("n", "o").alias("x"))
    return both.select(*keys, "change", *[F.col(f"x.{c}").alias(c) for c in values])


def full_snapshot(old: DataFrame | None, new: DataFrame, keys: Sequence[str], deletes: str | tuple[str, Sequence[object]] | None = None) -> DataFrame:
    """The newest snapshot becomes the table; a key that stands twice in it is an error."""
    if not new.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise LoadError("a key stands twice in the snapshot")
    base = old if old is not None else new.limit(0)
    return snapshot_diff(base, new, keys, deletes).filter("change <> 'delete'").drop("change")


def soft_delete(table: DataFrame, key_rows: DataFrame, keys: Sequence[str], indicator: str) -> DataFrame:
    """is_deleted becomes true for keys whose indicator is true; nothing is un-deleted. The table itself comes
    back, with the column, if no key is marked."""
    marked = key_rows.filter(F.col(indicator).cast("boolean")).select(*keys).distinct().withColumn("_eng_marked", F.lit(True))
    had = F.col("is_deleted") if "is_deleted" in table.columns else F.lit(False)
    joined = table.join(marked, list(keys), "left").withColumn("is_deleted", F.coalesce("_eng_marked", had, F.lit(False)))
    return joined.drop("_eng_marked")
