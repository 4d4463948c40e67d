"""Sinks of flows: options by type, streams written out, and batch results exported once per update."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import PlanError, SpecError
from ..functions.params import in_path
from ..operators import quality_rules, shape
from ..sources.archive_sink import ArchiveSource
from ..sources.store import Store
from ..sources.telemetry import OtlpSource
from .flows import each_batch

#: Kafka options that name secrets; they are looked up, never written in a spec.
SECRETS = ("username", "password")


def options(sink: Mapping, parameters: Mapping[str, object] | None = None, secrets: Mapping[str, str] | None = None) -> tuple[str, dict[str, str]]:
    """(format, writer options) of a sink spec. Values `secret:name` are looked up in secrets."""
    values, kind = parameters or {}, sink.get("type")

    def secret(text: str) -> str:
        if not str(text).startswith("secret:"):
            return str(text)
        name = text.removeprefix("secret:")
        if name not in (secrets or {}):
            raise SpecError(f"secret {name} is not defined")
        return secrets[name]

    extra = {k: secret(v) for k, v in sink.get("options", {}).items()}
    if kind in ("path", "json"):
        return sink.get("format", "json"), {"path": in_path(sink["path"], values), **extra}
    if kind == "kafka":
        made = {"kafka.bootstrap.servers": sink["bootstrap_servers"], "topic": sink["topic"]}
        if any(k in sink for k in SECRETS):
            user, word = (secret(sink.get(k, "")) for k in SECRETS)
            quoted = [x.replace("\\", "\\\\").replace('"', '\\"') for x in (user, word)]
            made |= {
                "kafka.security.protocol": "SASL_SSL", "kafka.sasl.mechanism": "PLAIN",
                "kafka.sasl.jaas.config": f'org.apache.kafka.common.security.plain.PlainLoginModule required username="{quoted[0]}" password="{quoted[1]}";',
            }
        return "kafka", made | extra
    if kind == "archive_export":
        named = {k: str(sink[k]) for k in ("format", "compression", "file_name", "header") if k in sink}
        return "archive_export", {"path": in_path(sink["path"], values), **named, **extra}
    if kind == "otlp":
        return "otlp", {"url": sink["url"], **{f"header.{k}": secret(v) for k, v in sink.get("headers", {}).items()}, **extra}
    raise SpecError(f"sink type {kind} is not known")


def payload(df: DataFrame, sink: Mapping) -> DataFrame:
    """What a sink gets: the clean rows without reserved columns; for kafka a key and the row as JSON."""
    df = quality_rules.clean(df) if quality_rules.FLAG in df.columns else df
    df = shape.strip_reserved(df)
    if sink.get("type") == "kafka":
        key = F.concat_ws("|", *[F.col(c).cast("string") for c in sink["key"]]) if sink.get("key") else F.lit(None).cast("string")
        return df.select(key.alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))
    return df


def register(spark: SparkSession) -> None:
    for source in (ArchiveSource, OtlpSource):
        spark.dataSource.register(source)


def write_stream(df: DataFrame, sink: Mapping, checkpoint: str, store: Store | None = None, parameters: Mapping[str, object] | None = None, secrets: Mapping[str, str] | None = None) -> None:
    """Writes all there is of a stream to a sink and ends. A batch that is replayed overwrites nothing twice in a
    table; the other sinks are as exact as their format."""
    if not df.isStreaming:
        raise PlanError("a sink takes a stream; export_once takes a batch")
    out = payload(df, sink)
    if sink.get("type") == "table":
        if store is None:
            raise PlanError("a table sink needs a store")
        each_batch(out, lambda batch, number: store.write(sink["table"], batch, "APPEND", number), checkpoint)
        return
    register(df.sparkSession)
    fmt, named = options(sink, parameters, secrets)
    writer = out.writeStream.format(fmt).options(**named).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()


def pulse(spark: SparkSession) -> DataFrame:
    """A stream of one row per update."""
    return spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load().select(F.lit(1).alias("_eng_pulse"))


def export_once(df: DataFrame, sink: Mapping, checkpoint: str, parameters: Mapping[str, object] | None = None) -> None:
    """Exports a batch result once per call: the update's one-row pulse is joined with all its rows.

    A call that failed is made good by the next one, under the number of its batch.
    """
    if df.isStreaming or sink.get("type") != "archive_export":
        raise PlanError("export_once takes a batch and an archive_export sink")
    spark = df.sparkSession
    register(spark)
    rows = payload(df, sink).withColumn("_eng_pulse", F.lit(1))
    joined = pulse(spark).join(rows, "_eng_pulse").drop("_eng_pulse")
    fmt, named = options(sink, parameters)
    joined.writeStream.format(fmt).options(**named).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
