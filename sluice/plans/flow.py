"""Flows: a group spec is checked, planned (shared reads, order, guards) and turned into lazy DataFrames.

``run`` gives the frames alone; ``engine.Engine`` loads them into tables.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import PlanError, SpecError
from ..functions.crypto import Crypt, decrypt, encrypt
from ..functions.hashing import compared_columns, with_hashes
from ..functions.params import in_sql
from ..operators import quality_rules, shape
from ..operators.quality_rules import Rule
from .validation import KEYED, validate

__all__ = ["Plan", "Result", "frame", "ingest", "load_spec", "node_name", "plan", "rules_of", "run", "validate"]

#: Of a read, what each consumer applies for itself; the rest is the read's identity.
PER_CONSUMER = ("watermark", "decrypt")


def load_spec(text: str, kind: str = "json", **placeholders: str) -> dict:
    """Spec text (JSON or YAML) with {{name}} placeholders filled in; one without a value is an error."""
    missing = sorted({n for n in re.findall(r"\{\{\s*(\w+)\s*\}\}", text) if n not in placeholders})
    if missing:
        raise SpecError(f"placeholders without a value: {missing}")
    text = re.sub(r"\{\{\s*(\w+)\s*\}\}", lambda m: str(placeholders[m[1]]), text)
    if kind == "json":
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


@dataclass
class Plan:
    """Reads by identity, what each flow is bound to, and the order of flows."""

    reads: dict[str, dict] = field(default_factory=dict)
    bindings: dict[tuple[str, str], str] = field(default_factory=dict)
    consumers: dict[tuple[str, str], dict] = field(default_factory=dict)
    order: list[str] = field(default_factory=list)


def node_name(prefix: str, locator: str) -> str:
    core = re.sub(r"\W+", "_", locator).strip("_").lower()[:40]
    return f"{prefix}_{core}_{hashlib.sha256(locator.encode()).hexdigest()[:8]}"


def flows_of(spec: Mapping) -> dict[str, Mapping]:
    return {f["flow_id"]: f for s in ("ingestion_flows", "transformation_flows") for f in spec.get(s, [])}


def plan(spec: Mapping) -> Plan:
    """Equal reads (locator, options, mode) become one; inputs that a sibling makes bind to it; cycles are errors."""
    out, flows = Plan(), flows_of(spec)
    makers = {f["target"]: k for k, f in flows.items() if f.get("target")}
    needs: dict[str, set[str]] = {k: set() for k in flows}
    for k, f in flows.items():
        for name, source in ({"source": f["source"]} if "source" in f else f["inputs"]).items():
            read = {"table": source} if isinstance(source, str) else dict(source)
            out.consumers[k, name] = {x: read.pop(x) for x in PER_CONSUMER if x in read}
            maker = makers.get(read.get("table"))
            if maker and read.get("stream") and flows[maker].get("load", "APPEND") != "APPEND":
                raise PlanError(f"{k} streams {read['table']}, which {flows[maker]['load']} rewrites")
            if maker and not read.get("stream"):
                needs[k].add(maker)
                out.bindings[k, name] = maker
                continue
            if maker:
                needs[k].add(maker)  # a stream over a sibling's table runs after it
            locator = json.dumps(read, sort_keys=True)
            node = node_name("read", locator)
            out.reads[node] = read
            out.bindings[k, name] = node
    waiting = {k: set(v) for k, v in needs.items()}
    while waiting:
        ready = sorted(k for k, v in waiting.items() if not v)
        if not ready:
            ring, at = [], min(waiting)
            while at not in ring:
                ring.append(at)
                at = min(waiting[at])
            raise PlanError("flows feed each other: " + " -> ".join([*ring[ring.index(at) :], at]))
        out.order += ready
        waiting = {k: v - set(ready) for k, v in waiting.items() if k not in ready}
    return out


@dataclass
class Result:
    clean: DataFrame
    quarantine: DataFrame


def as_input(df: DataFrame, consumer: Mapping) -> DataFrame:
    """What a consumer applies to a read of its own: decryption, and a watermark on a column made a timestamp."""
    if consumer.get("decrypt"):
        df = decrypt(df, [crypt(c, "type") for c in consumer["decrypt"]])
    if mark := consumer.get("watermark"):
        if mark["column"] not in df.columns:
            raise PlanError(f"watermark column {mark['column']} is not there")
        df = df.withColumn(mark["column"], F.col(mark["column"]).cast("timestamp"))
        df = df.withWatermark(mark["column"], mark["delay"]) if df.isStreaming else df
    return df


def crypt(spec: Mapping, declared: str) -> Crypt:
    return Crypt(spec["column"], spec["key"], spec.get("mode", "GCM"), spec.get("output"), spec.get(declared))


def frame(spark: SparkSession, flow: Mapping, bound: Mapping[str, DataFrame], values: Mapping[str, object]) -> DataFrame:
    """A flow's rows before its rules: shaped or queried, then encrypted. Inputs stand in the SQL by name."""
    if "source" in flow:
        df = ingest(bound["source"], flow)
    else:
        text = re.sub(r"\b(" + "|".join(map(re.escape, bound)) + r")\b(?!\s*\()", r"{\1}", flow["sql"])
        df = spark.sql(in_sql(text, values), **bound)
    return encrypt(df, [crypt(c, "type") for c in flow["encrypt"]]) if flow.get("encrypt") else df


def rules_of(flow: Mapping, values: Mapping[str, object]) -> list[Rule]:
    return [Rule(r["id"], in_sql(r["expression"], values), r["action"], r.get("reason", "")) for r in flow.get("rules", [])]


def staged(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows after warn, drop and fail rules, with the quarantine columns."""
    return quality_rules.with_quarantine(quality_rules.apply_native(df, rules), rules)


def cleaned(df: DataFrame, flow: Mapping) -> DataFrame:
    """The clean rows of staged ones, with hash columns where a load strategy compares rows."""
    df = quality_rules.clean(df)
    if flow.get("keys") and flow.get("load", "APPEND") in KEYED:
        df = with_hashes(df, flow["keys"], compared_columns(df.columns, flow["keys"], flow.get("check_columns"), flow.get("exclude", ())))
    return df


def run(spark: SparkSession, spec: Mapping, read: Callable[[Mapping], DataFrame]) -> dict[str, Result]:
    """Frames of all flows by flow_id. A read is made once; a transformation sees its inputs as views."""
    if errors := validate(spec):
        raise SpecError(errors)
    made, values, flows = plan(spec), spec.get("parameters", {}), flows_of(spec)
    reads = {k: read(v) for k, v in made.reads.items()}
    done: dict[str, Result] = {}
    for k in made.order:
        inputs = {name: node for (flow_id, name), node in made.bindings.items() if flow_id == k}
        bound = {name: as_input(reads[node] if node in reads else done[node].clean, made.consumers[k, name]) for name, node in inputs.items()}
        marked = staged(frame(spark, flows[k], bound, values), rules_of(flows[k], values))
        done[k] = Result(cleaned(marked, flows[k]), quality_rules.quarantined(marked))
    return done


def ingest(df: DataFrame, flow: Mapping) -> DataFrame:
    """The shaping steps of an ingestion flow, in their fixed order."""
    df = shape.apply_schema(df, flow["columns"]) if flow.get("columns") else df
    df = shape.normalise_names(df, flow["normalize"]) if flow.get("normalize") else df
    df = shape.with_lineage(df) if flow.get("capture_lineage") else df
    df = shape.parse_json(df, flow["json_columns"]) if flow.get("json_columns") else df
    df = shape.explode_columns(df, flow["explode_columns"]) if "explode_columns" in flow else df
    if flow.get("dedup"):
        mark = flow["dedup"] if isinstance(flow["dedup"], Mapping) else None
        df = shape.dedup(df, (mark["column"], mark["delay"]) if mark else None)
    df = shape.standardise(df, flow["standardize"]) if flow.get("standardize") else df
    return shape.with_ingestion_time(df) if flow.get("capture_lineage") else df
