"""Onboarding: group specs become rows of control tables, one group or a folder of them at a time."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError, PlanError, SpecError
from ..sources.commit import Folder
from ..sources.store import Store
from . import control, flow
from .validation import check_spec_sql, validate

GROUPS, FLOWS, VERSIONS = "_groups", "_flows", "_versions_of_groups"
GROUP_SCHEMA = "group_id string, spec string, is_active boolean"
FLOW_SCHEMA = "group_id string, flow_id string, kind string, mode string, target string, load string, reads array<string>, spec string, is_active boolean"
KINDS = {"ingestion_flows": "ingestion", "transformation_flows": "transformation", "reconciliation_flows": "reconciliation"}


@dataclass
class Onboarded:
    """The outcome for one spec."""

    name: str
    ok: bool
    group_id: str | None = None
    flows: int = 0
    disabled: int = 0
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def flow_rows(spec: Mapping) -> list[tuple]:
    out = []
    for section, kind in KINDS.items():
        for f in spec.get(section, []):
            source = [f["source"]] if "source" in f else list(f.get("inputs", {}).values())
            source += [t["dataset"] for t in f.get("targets", [])]
            reads = [s if isinstance(s, str) else s.get("table") or s.get("path") for s in source]
            target = f.get("target") or (f.get("sink") or {}).get("type")
            out.append((spec["group_id"], f["flow_id"], kind, f.get("mode"), target, f.get("load", "APPEND") if kind != "reconciliation" else None, reads, json.dumps(f, sort_keys=True), f.get("is_active", True)))
    return out


def onboard(spark: SparkSession, store: Store, spec: Mapping, name: str = "spec", version: str | None = None) -> Onboarded:
    """Checks a spec and puts it into the control tables: new and changed rows replace old ones and keep when they
    were made, flows that are no longer named become inactive. With errors nothing changes."""
    errors = validate(spec)
    if not errors:
        try:
            flow.plan(spec)
        except PlanError as e:
            errors.append(str(e))
    warnings: list[str] = []
    if not errors:
        try:
            bad, warnings = check_spec_sql(spark, spec)
            errors += bad
        except SpecError as e:
            errors += e.errors
    if errors:
        return Onboarded(name, False, spec.get("group_id") if isinstance(spec, Mapping) else None, errors=errors, warnings=warnings)
    group, rows, now = spec["group_id"], flow_rows(spec), F.current_timestamp()
    _put(store, GROUPS, spark.createDataFrame([(group, json.dumps(spec, sort_keys=True), True)], GROUP_SCHEMA), ["group_id"], now)
    before = store.read(FLOWS)
    present = [r[1] for r in rows]
    gone = 0 if before is None else before.filter((F.col("group_id") == group) & F.col("is_active") & ~F.col("flow_id").isin(*present)).count()
    _put(store, FLOWS, spark.createDataFrame(rows, FLOW_SCHEMA), ["group_id", "flow_id"], now, lambda table: control.prune(table, group, present))
    if version:
        store.write(VERSIONS, spark.createDataFrame([(group, version)], "group_id string, version string").withColumn("deployed_at", now), "APPEND")
    return Onboarded(name, True, group, len(rows), gone, warnings=warnings)


def _put(store: Store, table: str, rows: DataFrame, keys: Sequence[str], now, after=lambda df: df) -> None:
    old = store.read(table)
    made = rows.withColumns({"created_at": now, "updated_at": now}) if old is None else control.upsert(old, rows, keys, now)
    store.write(table, after(made).coalesce(1))


def onboard_folder(spark: SparkSession, store: Store, path: str, placeholders: Mapping[str, str] | None = None, version: str | None = None) -> list[Onboarded]:
    """Onboards every JSON and YAML spec of a folder. A spec that fails does not stop the others."""
    folder, out = Folder(spark, path), []
    for name in folder.names():
        kind = {"json": "json", "yaml": "yaml", "yml": "yaml"}.get(name.rpartition(".")[2])
        if kind is None:
            continue
        try:
            out.append(onboard(spark, store, flow.load_spec(folder.read_bytes(name).decode(), kind, **(placeholders or {})), name, version))
        except Exception as e:  # noqa: BLE001
            out.append(Onboarded(name, False, errors=e.errors if isinstance(e, SpecError) else [f"{type(e).__name__}: {e}"]))
    return out


def active_spec(store: Store, group: str) -> dict:
    """The spec of an active group with its active flows alone, without reconciliations that run as jobs."""
    groups, flows = store.read(GROUPS), store.read(FLOWS)
    row = None if groups is None else groups.filter((F.col("group_id") == group) & F.col("is_active")).first()
    if row is None:
        raise EngineError(f"group {group} is not there or not active")
    spec = json.loads(row["spec"])
    names = {r["flow_id"] for r in control.active(flows, group).filter("NOT (kind = 'reconciliation' AND coalesce(mode, 'pipeline') = 'job')").select("flow_id").collect()}  # a group's flows
    for section in KINDS:
        if section in spec:
            spec[section] = [f for f in spec[section] if f["flow_id"] in names]
    return spec
