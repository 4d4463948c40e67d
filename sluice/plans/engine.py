"""Runs a group: reads, shapes, checks, loads, exports and reconciles its flows, and logs what it did."""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError, SpecError
from ..observability.events import EventLog
from ..operators import quality_rules
from ..sources import registry
from ..sources.store import Store
from ..streaming import sinks
from ..streaming.flows import each_batch
from . import control, dispatch, flow, recon_flow
from .validation import KEYED, validate

CHANGES = "_change_metrics"


@dataclass
class Outcome:
    """What became of a flow: its target's version, rows written and quarantined, batches for a stream."""

    flow_id: str
    status: str = "COMPLETED"
    version: int | None = None
    written: int = 0
    quarantined: int = 0
    batches: int = 0
    warned: dict[str, int] = field(default_factory=dict)


class Engine:
    """One pipeline over one store. `read` replaces the source registry; `secrets` are those of sinks."""

    def __init__(self, spark: SparkSession, store: Store, pipeline_id: str = "pipeline", read: Callable[[Mapping], DataFrame] | None = None, secrets: Mapping[str, str] | None = None):
        self.spark, self.store, self.pipeline_id, self.secrets = spark, store, pipeline_id, secrets or {}
        self._read = read

    def run(self, spec: Mapping, runtime: Mapping[str, object] | None = None) -> dict[str, Outcome | list]:
        """Outcomes by flow_id. The first flow that fails ends the update; its event is logged before it raises.

        runtime: settings that win over the spec's `spark_config`.
        """
        if errors := validate(spec):
            raise SpecError(errors)
        log = EventLog(self.store, self.pipeline_id, spec["group_id"])
        log.add("update_progress", "update started", state="RUNNING")
        done: dict[str, Outcome | list] = {}
        try:
            for problem in control.apply_settings(self.spark, spec.get("spark_config"), runtime):
                log.add("settings", problem, level="WARN")
            self._tables(spec, log, done)
            self._reconcile(spec, log, done)
            log.add("update_progress", "update completed", state="COMPLETED")
        except Exception as e:
            log.add("update_progress", f"update failed: {e}"[:2000], level="ERROR", state="FAILED")
            raise
        finally:
            log.flush()
        return done

    def _tables(self, spec: Mapping, log: EventLog, done: dict) -> None:
        made, values, flows = flow.plan(spec), spec.get("parameters", {}), flow.flows_of(spec)
        makers, reads = {k: f.get("target") for k, f in flows.items()}, {}
        for k in made.order:
            if not flows[k].get("is_active", True):
                log.add("flow_progress", "flow is not active", k, state="SKIPPED")
                done[k] = Outcome(k, "SKIPPED")
                continue
            bound = {}
            for (flow_id, name), node in made.bindings.items():
                if flow_id != k:
                    continue
                if node in made.reads:
                    # Equal reads share one frame; a stream over a sibling's table is read once that is loaded.
                    if node not in reads:
                        reads[node] = self._read(made.reads[node]) if self._read else registry.read_source(self.spark, made.reads[node], self.store, values)
                    df, source = reads[node], json.dumps(made.reads[node], sort_keys=True)
                else:
                    df, source = self.store.read(makers[node]), makers[node]
                    if df is None:
                        raise EngineError(f"{k} reads {makers[node]}, which has no version")
                bound[name] = flow.as_input(df, made.consumers[k, name])
                log.add("lineage", f"{source} feeds {makers[k]}", k, source=source, target=makers[k])
            done[k] = self._flow(flows[k], bound, values, log)

    def _flow(self, f: Mapping, bound: Mapping[str, DataFrame], values: Mapping, log: EventLog) -> Outcome:
        k, rules = f["flow_id"], flow.rules_of(f, values)
        log.add("flow_progress", "flow started", k, state="RUNNING", target=f.get("target"))
        out = Outcome(k)
        try:
            df = flow.frame(self.spark, f, bound, values)
            if f.get("sink"):
                self._sink(f, df, rules, values)
            elif df.isStreaming:

                def batch(rows: DataFrame, number: tuple[str, int]) -> None:
                    self._load(f, rows, rules, out, number)
                    out.batches += 1

                each_batch(df, batch, f"{self.store.path}/_checkpoints/{k}")
            else:
                self._load(f, df, rules, out, None)
            if f.get("export"):
                published = registry.read_source(self.spark, {"type": "store", "table": f["target"], "stream": True}, self.store)
                sinks.write_stream(published, f["export"], f"{self.store.path}/_checkpoints/{k}__export", self.store, values, self.secrets)
        except Exception as e:
            log.add("flow_progress", f"flow failed: {e}"[:2000], k, level="ERROR", state="FAILED")
            raise
        if f.get("load") in KEYED and f.get("load") != "SCD3":
            self._capture_changes(f, log)
        if rules:
            log.add("data_quality", "rules applied", k, expectations=[{"name": r.id, "action": r.action, "failed": out.warned.get(r.id)} for r in rules], rows_written=out.written, rows_quarantined=out.quarantined)
        log.add("flow_progress", "flow completed", k, state="COMPLETED", target=f.get("target"), rows_written=out.written, rows_quarantined=out.quarantined, version=out.version)
        return out

    def _load(self, f: Mapping, df: DataFrame, rules: list, out: Outcome, number: tuple[str, int] | None) -> None:
        """One batch: the rules' counts, the quarantined rows and the clean ones, from one pass that is kept.

        With a fail rule nothing is written unless all rows pass.
        """
        quality_rules.check_fail(df, rules)
        marked = flow.staged(df, rules).persist()
        try:
            name = lambda r: f"v{rules.index(r)}"
            warn = quality_rules.of(rules, "warn")
            seen = marked.agg(F.count("*").alias("rows"), F.count_if(quality_rules.FLAG).alias("bad"), *[F.count_if(~quality_rules.passes(r)).alias(name(r)) for r in warn]).first()
            if quality_rules.of(rules, "quarantine") and seen["bad"]:
                self.store.write(f"{f['target']}_quarantine", quality_rules.quarantined(marked), "APPEND", number)
            out.version = dispatch.load(self.store, f, flow.cleaned(marked, f), number)
            out.written += seen["rows"] - seen["bad"]
            out.quarantined += seen["bad"]
            for r in warn:
                out.warned[r.id] = out.warned.get(r.id, 0) + seen[name(r)]
        finally:
            marked.unpersist()

    def _sink(self, f: Mapping, df: DataFrame, rules: list, values: Mapping) -> None:
        """A flow without a table: clean rows go to the sink, quarantined ones to a table named after the flow."""
        checkpoint = f"{self.store.path}/_checkpoints/{f['flow_id']}"
        marked = flow.staged(df, rules)
        if not df.isStreaming:
            sinks.export_once(marked, f["sink"], checkpoint, values)
            if quality_rules.of(rules, "quarantine"):
                self.store.write(f"{f['flow_id']}_quarantine", quality_rules.quarantined(marked), "APPEND")
            return
        sinks.write_stream(marked, f["sink"], checkpoint, self.store, values, self.secrets)
        if quality_rules.of(rules, "quarantine"):
            bad = quality_rules.quarantined(marked)
            each_batch(bad, lambda rows, number: self.store.write(f"{f['flow_id']}_quarantine", rows, "APPEND", number), f"{checkpoint}__quarantine")

    def _capture_changes(self, f: Mapping, log: EventLog) -> None:
        """Change counts of the versions since the last capture; best effort."""
        try:
            seen = self.store.read(CHANGES)
            last = None if seen is None else seen.filter(F.col("table") == f["target"]).agg(F.max("version")).first()[0]
            keys = [*f["keys"], "__START_AT"] if f["load"] == "SCD2" else list(f["keys"])
            rows = dispatch.change_counts(self.store, f["target"], keys, last)
            if rows:
                frame = self.spark.createDataFrame([(r["table"], r["version"], r["insert"], r["update"], r["delete"]) for r in rows], "table string, version bigint, inserted bigint, updated bigint, deleted bigint")
                self.store.write(CHANGES, frame.coalesce(1), "APPEND")
        except Exception as e:  # noqa: BLE001
            warnings.warn(f"changes of {f['target']} were not counted: {e}", stacklevel=2)
            log.add("change_metrics", f"changes were not counted: {e}"[:2000], f["flow_id"], level="WARN")

    def _reconcile(self, spec: Mapping, log: EventLog, done: dict) -> None:
        for f in spec.get("reconciliation_flows", []):
            if f.get("mode", "pipeline") == "job" or not f.get("is_active", True):
                log.add("flow_progress", "runs as a job of its own" if f.get("mode") == "job" else "flow is not active", f["flow_id"], state="SKIPPED")
                continue
            done[f["flow_id"]] = recon_flow.run(self.spark, self.store, f, log)
