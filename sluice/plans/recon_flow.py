"""Reconciliation as a flow: sides by name, overlays, rules on the counts, healing once, and what is logged.

Healing is one append under the name of the miss set's fingerprint. The store keeps the names that a table
holds, so the ledger and the rows are one commit: rows can't be appended without their entry, or twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError, QualityError
from ..functions.hashing import KEY, VALUE
from ..functions.params import in_sql
from ..observability.events import EventLog
from ..operators import quality_rules, reconcile, shape
from ..operators.quality_rules import Rule
from ..sources.registry import read_dataset
from ..sources.store import Properties, Store

RUNS, MISMATCHES = "_recon_runs", "_recon_mismatches"
RUN_SCHEMA = "run_id string, ts timestamp, flow_id string, target string, status string, matched bigint, value_drift bigint, missing_in_target bigint, missing_in_source bigint, appended bigint, fingerprint string, error string"
#: View over the rows to heal, for a heal query.
UNMATCHED = "unmatched"


def overlaid(df: DataFrame, spec: Mapping, parameters: Mapping[str, object] | None = None) -> DataFrame:
    """What a dataset's spec adds to its read: one run's rows, a filter with parameters, standardisation."""
    if spec.get("run_id"):
        df = df.filter(F.col(spec["run_id"]["column"]) == F.lit(spec["run_id"]["value"]))
    if spec.get("filter"):
        df = df.filter(in_sql(spec["filter"], parameters or {}))
    return shape.standardise(df, spec["standardize"]) if spec.get("standardize") else df


def log_flags(target: Mapping, runtime: Mapping[str, bool] | None = None) -> dict[str, bool]:
    """Whether mismatching and matching keys are logged: what the run asks for, else the spec, else no."""
    return {k: bool((runtime or {}).get(k, target.get(k, False))) for k in ("capture_mismatches", "capture_matches")}


def heal_rows(spark: SparkSession, rows: DataFrame, sql: str | None) -> DataFrame:
    """Rows to append: the miss set, or a query over it by the name `unmatched`."""
    return spark.sql(sql.replace(UNMATCHED, f"{{{UNMATCHED}}}"), **{UNMATCHED: rows}) if sql else rows


def check_counts(found: DataFrame, rules: list[Rule]) -> list[str]:
    """Ids of warn rules that the one row of counts violates; a fail rule that it violates raises, a drop or
    quarantine rule that it violates keeps the run from healing."""
    row = found.select(*[quality_rules.passes(r).alias(r.id) for r in rules]).first() if rules else None
    bad = [r for r in rules if not row[r.id]]
    if fatal := [r.id for r in bad if r.action == "fail"]:
        raise QualityError(f"counts violate {fatal}")
    return [r.id for r in bad]


def run(spark: SparkSession, store: Store, flow: Mapping, log: EventLog, parameters: Mapping[str, object] | None = None, runtime: Mapping[str, bool] | None = None) -> list[reconcile.Outcome]:
    """Compares the source with every target. A target that fails does not stop the others; with `on_failure:
    fail` the first error is raised after the last of them."""
    source = overlaid(read_dataset(spark, flow["source"], store), flow["source"] if isinstance(flow["source"], Mapping) else {}, parameters)
    outcomes, first = [], None
    for target in flow["targets"]:
        try:
            out = _one(spark, store, flow, target, source, log, parameters, runtime)
        except Exception as e:  # noqa: BLE001
            first = first or e
            out = reconcile.Outcome("FAILED", error=str(e)[:2000])
        outcomes.append(out)
        record(store, log.update_id, flow["flow_id"], target["name"], out)
        level = "ERROR" if out.status == "FAILED" else "INFO"
        log.add("reconciliation", f"{target['name']}: {out.status}", flow["flow_id"], level, target=target["name"], status=out.status, matched=out.matched, value_drift=out.value_drift, missing_in_target=out.missing_in_target, missing_in_source=out.missing_in_source, appended=out.appended)
    if first is not None and flow.get("on_failure", "fail") == "fail":
        raise EngineError(f"reconciliation {flow['flow_id']} failed: {first}") from first
    return outcomes


def _one(spark, store: Store, flow: Mapping, target: Mapping, source: DataFrame, log: EventLog, parameters, runtime) -> reconcile.Outcome:
    keys, compare, hashed = list(flow["keys"]), flow.get("compare"), bool(target.get("hashed"))
    other = overlaid(read_dataset(spark, target["dataset"], store), target, parameters)
    s, t = (reconcile.prepare(df, keys, compare, hashed).persist() for df in (source, other))
    try:
        if reconcile.same(s, t):
            return reconcile.Outcome("MATCHED", matched=s.select(KEY).distinct().count())
        classes = reconcile.classify(s, t, compare is not None and not compare).persist()
        counted = reconcile.counts(classes)
        found = counted.first().asDict()
        rules = [Rule(r["id"], r["expression"], r["action"], r.get("reason", "")) for r in target.get("rules", [])]
        violated = check_counts(counted, rules)
        for rule in violated:
            log.add("data_quality", f"{target['name']}: rule {rule} is violated", flow["flow_id"], "WARN")
        compared = compare if compare is not None else [c for c in s.columns if c not in (*keys, KEY, VALUE) and c in t.columns and not c.startswith(shape.RESERVED)]
        capture(store, log.update_id, flow["flow_id"], target["name"], s, t, classes, keys, compared, log_flags(target, runtime))
        rows = reconcile.missing_rows(s, classes)
        mark = reconcile.batch_fingerprint(rows).first()[0]
        held = any(r.id in violated and r.action in ("drop", "quarantine") for r in rules)
        audit = flow.get("direction", "both") == "audit" or flow.get("mode") == "pipeline_audit_only"
        if not target.get("heal") or audit or held or not found["missing_in_target"]:
            return reconcile.Outcome("SUCCESS", **found, fingerprint=mark)
        table, batch = target["heal"]["table"], (f"heal {flow['flow_id']} {target['name']} {mark}", 0)
        if store.committed(table, batch):
            return reconcile.Outcome("SKIPPED_ALREADY_PROCESSED", **found, fingerprint=mark)
        fresh = heal_rows(spark, rows.drop(KEY, VALUE), target["heal"].get("sql")).persist()
        try:
            n = fresh.count()
            if n:
                store.write(table, fresh, "APPEND", batch, Properties.of(target["heal"].get("properties")))
            return reconcile.Outcome("SUCCESS", **found, appended=n, fingerprint=mark)
        finally:
            fresh.unpersist()
    finally:
        s.unpersist(), t.unpersist()


def capture(store: Store, run_id: str, flow_id: str, target: str, s: DataFrame, t: DataFrame, classes: DataFrame, keys: list[str], compare: list[str], flags: Mapping[str, bool]) -> None:
    """Logs keys that don't match, with what differs, and matching ones, as asked."""
    out = []
    if flags["capture_mismatches"]:
        out.append(reconcile.mismatches(s, t, classes, keys, compare))
    if flags["capture_matches"]:
        matched = classes.filter(F.col("class") == reconcile.MATCHED)
        names = s.join(matched.select(KEY), KEY, "left_semi").groupBy(KEY).agg(F.to_json(F.min(F.struct(*keys))).alias("key_json"))
        out.append(names.select(KEY, F.lit(reconcile.MATCHED).alias("class"), "key_json", F.lit(None).cast("string").alias("drift_json")))
    for frame in out:
        named = [F.lit(v).alias(k) for k, v in (("run_id", run_id), ("flow_id", flow_id), ("target", target))]
        store.write(MISMATCHES, frame.select(*named, KEY, "class", "key_json", "drift_json"), "APPEND")


def record(store: Store, run_id: str, flow_id: str, target: str, out: reconcile.Outcome) -> None:
    row = (run_id, flow_id, target, out.status, out.matched, out.value_drift, out.missing_in_target, out.missing_in_source, out.appended, out.fingerprint, out.error)
    schema = RUN_SCHEMA.replace("ts timestamp, ", "")
    frame = store.spark.createDataFrame([row], schema).withColumn("ts", F.current_timestamp())
    store.write(RUNS, frame.select(*[x.split()[0] for x in RUN_SCHEMA.split(", ")]).coalesce(1), "APPEND")


def backstop(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Control rows for reconciliations that are in the event log but not among the recorded runs.

    Their ids are made from update, flow and target, so a second export finds them there.
    """
    value = lambda k, kind="bigint": F.get_json_object("details", f"$.{k}").cast(kind)
    logged = events.filter("event_type = 'reconciliation'").select(
        "update_id", "ts", "flow_id", value("target", "string").alias("target"), value("status", "string").alias("status"),
        *[value(c).alias(c) for c in ("matched", "value_drift", "missing_in_target", "missing_in_source", "appended")],
    )
    known = runs.select(F.col("run_id").alias("update_id"), "flow_id", "target")
    made = F.udf(lambda *x: str(uuid.uuid5(uuid.NAMESPACE_URL, "/".join(map(str, x)))), "string")
    missing = logged.join(known, ["update_id", "flow_id", "target"], "left_anti").withColumn("run_id", made("update_id", "flow_id", "target"))
    missing = missing.join(runs.select("run_id"), "run_id", "left_anti")
    return missing.select(
        "run_id", "ts", "flow_id", "target", "status", "matched", "value_drift", "missing_in_target", "missing_in_source", "appended",
        F.lit(None).cast("string").alias("fingerprint"), F.lit(None).cast("string").alias("error"),
    )
