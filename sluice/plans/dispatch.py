"""Load strategies applied to tables of a store."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import LoadError
from ..operators import loads, shape
from ..sources import registry
from ..sources.store import Properties, Store
from .validation import LOADS

#: Column that orders the changes of a flow that names no sequence.
DEFAULT_SEQUENCE = "_eng_ingested_at"
Batch = tuple[str, int] | None


def cdc_of(flow: Mapping) -> loads.Cdc:
    deletes = flow.get("deletes")
    deletes = (deletes["column"], list(deletes["values"])) if isinstance(deletes, Mapping) else deletes
    return loads.Cdc(flow["keys"], flow.get("sequence") or [DEFAULT_SEQUENCE], deletes, flow.get("exclude", ()), flow.get("track"))


def _without(current: DataFrame | None, keys: list[str], changes: DataFrame) -> DataFrame | None:
    return None if current is None else current.join(changes.select(*keys).distinct(), keys, "left_anti")


def _replaced(current: DataFrame | None, fresh: DataFrame, keys: list[str], changes: DataFrame) -> DataFrame:
    """The rows of other keys, and fresh ones for the keys that changed."""
    kept = _without(current, keys, changes)
    return fresh if kept is None else kept.unionByName(fresh, allowMissingColumns=True)


def load(store: Store, flow: Mapping, rows: DataFrame, batch: Batch = None) -> int:
    """Loads a flow's clean rows into its target by its strategy; returns the table's version.

    Keyed strategies keep what late rows need in a table beside the target: SCD1 its newest events with their
    sequence, SCD2 and SCD3 all events. It is committed first, so a batch that fails in between is made good
    when it is run again.
    """
    strategy, table = flow.get("load", "APPEND"), flow["target"]
    if strategy not in LOADS:
        raise LoadError(f"{table}: load strategy {strategy} is not one of {sorted(LOADS)}")
    properties = Properties.of(flow.get("properties"))
    if strategy == "APPEND":
        return store.write(table, rows, "APPEND", batch, properties)
    if strategy == "TRUNCATE_AND_LOAD":
        old = store.manifest(table)
        if old and not flow.get("empty_target_if_source_empty") and rows.isEmpty():
            return old["version"]
        return store.write(table, rows, strategy, batch, properties)
    if strategy == "FULL_SNAPSHOT_CDC":
        deletes = cdc_of(flow).deletes
        return store.write(table, loads.full_snapshot(_plain(store.read(table), rows), rows, flow["keys"], deletes), strategy, batch, properties)
    rows = shape.with_ingestion_time(rows) if not flow.get("sequence") else rows
    cdc, keys, beside = cdc_of(flow), list(flow["keys"]), f"{table}__changes"
    cdc.check(rows)
    if strategy == "SCD1":
        store.merge(beside, rows, keys, lambda state, new: loads.scd1_state(state, new, cdc), strategy, batch)
        fresh = loads.scd1(_of_keys(store.read(beside), keys, rows))
    else:
        store.merge(beside, rows, keys, lambda old, new: new if old is None else old.unionByName(new, allowMissingColumns=True), "EVENTS", batch)
        events = _of_keys(store.read(beside), keys, rows)
        fresh = loads.scd2(events, cdc) if strategy == "SCD2" else loads.scd3(events, cdc, flow["check_columns"])
    return store.merge(table, rows, keys, lambda current, changes: _replaced(current, fresh, keys, changes), strategy, batch)


def _plain(old: DataFrame | None, new: DataFrame) -> DataFrame | None:
    """The table with the columns of a newer snapshot."""
    return None if old is None else old.select(*[F.col(c) if c in old.columns else F.lit(None).cast(new.schema[c].dataType).alias(c) for c in new.columns])


def _of_keys(events: DataFrame, keys: list[str], changes: DataFrame) -> DataFrame:
    return events.join(changes.select(*keys).distinct(), keys, "left_semi")


def change_counts(store: Store, table: str, keys: list[str], since: int | None) -> list[dict]:
    """Rows inserted, updated and deleted by each version after `since`; nothing for a table's first version."""
    out, versions = [], store.versions(table)
    for before, after in zip(versions, versions[1:]):
        if since is None or after > since:
            found = {r["change"]: r["n"] for r in store.changes(table, before, after, keys).collect()}  # at most three rows
            out.append({"table": table, "version": after, **{k: found.get(k, 0) for k in ("insert", "update", "delete")}})
    return out


def soft_delete(store: Store, table: str, location: str, keys: list[str], indicator: str) -> tuple[str, int]:
    """Marks a table's rows whose keys a key list (see ``registry.read_keys``) marks: ("COMPLETED" or "SKIPPED",
    keys marked). Without a marked key the table keeps its version; nothing is ever un-deleted."""
    current = store.read(table)
    if current is None:
        raise LoadError(f"{table} has no version")
    listed = registry.read_keys(store.spark, location, store)
    if absent := [c for c in (*keys, indicator) if c not in listed.columns]:
        raise LoadError(f"{location}: columns are missing: {absent}")
    # A CSV file's columns are what they look like; they are compared as the table's types.
    listed = listed.select(*[F.col(k).cast(current.schema[k].dataType) for k in keys], F.col(indicator).cast("boolean").alias(indicator))
    marked = listed.filter(F.col(indicator)).select(*keys).distinct().count()
    if not marked:
        return "SKIPPED", 0
    fresh = loads.soft_delete(current, listed, keys, indicator)
    kept_by = (store.manifest(table)["buckets"] or {}).get("keys")
    if kept_by:
        changed = fresh.join(listed.filter(F.col(indicator)).select(*keys).distinct(), keys, "left_semi")
        store.merge(table, changed, kept_by, lambda old, new: _replaced(old, new, kept_by, new), "SOFT_DELETE")
    else:
        store.write(table, fresh, "SOFT_DELETE")
    return "COMPLETED", marked
