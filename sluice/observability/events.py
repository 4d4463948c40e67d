"""The event log: what updates and flows did, as rows of one table."""

from __future__ import annotations

import json
import uuid
import warnings
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import Store

TABLE = "_events"
SCHEMA = "event_id string, ts timestamp, level string, event_type string, pipeline_id string, group_id string, update_id string, flow_id string, message string, details string"
#: States after which nothing follows.
TERMINAL = ("COMPLETED", "FAILED", "SKIPPED", "STOPPED")


class EventLog:
    """Collects the events of one update and appends them to the store's event table in one commit.

    Logging never fails what it logs: an event that can't be kept is a warning.
    """

    def __init__(self, store: Store, pipeline_id: str, group_id: str, update_id: str | None = None):
        self.store, self.pipeline_id, self.group_id, self.update_id = store, pipeline_id, group_id, update_id or str(uuid.uuid4())
        self._held: list[tuple] = []

    def add(self, event_type: str, message: str, flow_id: str | None = None, level: str = "INFO", **details: object) -> None:
        try:
            text = json.dumps(details, default=str, sort_keys=True)
            self._held.append((str(uuid.uuid4()), datetime.now(timezone.utc), level, event_type, self.pipeline_id, self.group_id, self.update_id, flow_id, message, text))
        except Exception as e:  # noqa: BLE001
            warnings.warn(f"event {event_type} was not kept: {e}", stacklevel=2)

    def flush(self) -> None:
        if not self._held:
            return
        try:
            self.store.write(TABLE, self.store.spark.createDataFrame(self._held, SCHEMA).coalesce(1), "APPEND")
            self._held = []
        except Exception as e:  # noqa: BLE001
            warnings.warn(f"{len(self._held)} events were not written: {e}", stacklevel=2)


def scan(events: DataFrame, start: object, end: object, update_ids: Sequence[str] | None = None) -> DataFrame:
    """Events of a time window (its end excluded), optionally of some updates; both reach the scan."""
    rows = events.filter((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")))
    return rows.filter(F.col("update_id").isin(*update_ids)) if update_ids is not None else rows


def detail(path: str, kind: str = "string") -> Column:
    return F.get_json_object("details", f"$.{path}").cast(kind)


def flow_metrics(events: DataFrame) -> DataFrame:
    """Per update and flow: first and last time, last state (a final one wins), rows written, dropped, quarantined."""
    rows = events.filter("event_type = 'flow_progress'").withColumn("state", detail("state"))
    final = F.when(F.col("state").isin(*TERMINAL), 1).otherwise(0)
    return rows.groupBy("update_id", "flow_id").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max_by("state", F.struct(final, "ts", "event_id")).alias("state"),
        F.sum(detail("rows_written", "bigint")).alias("rows_written"), F.sum(detail("rows_quarantined", "bigint")).alias("rows_quarantined"),
        F.count("*").alias("events"),
    )


def telemetry_rows(events: DataFrame) -> DataFrame:
    """Events as rows of the OTLP sink."""
    return events.select(
        F.col("pipeline_id").alias("pipeline"), F.col("flow_id").alias("flow"), "level", "message", F.unix_millis("ts").alias("time_ms"), "event_type", "update_id", "group_id", "details"
    )


