"""Checks of a group spec. All errors are collected, each with the path of what is wrong."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator, Mapping, Sequence

from pyspark.errors import ParseException
from pyspark.sql import SparkSession

from ..errors import LoadError
from ..operators.quality_rules import ACTIONS
from ..sources.store import Properties

#: Allowed keys and values of a group spec (fixed by the spec format).
GROUP_KEYS = {"group_id", "parameters", "spark_config", "ingestion_flows", "transformation_flows", "reconciliation_flows"}
_TABLE_KEYS = {"flow_id", "target", "keys", "rules", "load", "sequence", "deletes", "exclude", "track", "check_columns", "empty_target_if_source_empty", "properties", "encrypt", "sink", "export", "tags", "is_active"}
INGESTION_KEYS = _TABLE_KEYS | {"source", "columns", "json_columns", "explode_columns", "normalize", "dedup", "standardize", "capture_lineage"}
TRANSFORMATION_KEYS = _TABLE_KEYS | {"inputs", "sql"}
RECONCILIATION_KEYS = {"flow_id", "mode", "source", "targets", "keys", "compare", "on_failure", "direction", "is_active"}
TARGET_KEYS = {"name", "dataset", "heal", "rules", "hashed", "capture_mismatches", "capture_matches", "filter", "standardize", "run_id"}
LOADS = {"APPEND", "TRUNCATE_AND_LOAD", "SCD1", "SCD2", "SCD3", "FULL_SNAPSHOT_CDC"}
#: Load strategies that compare rows by key.
KEYED = {"SCD1", "SCD2", "SCD3", "FULL_SNAPSHOT_CDC"}
SINKS = {"path": ("path", "format"), "table": ("table",), "kafka": ("bootstrap_servers", "topic"), "archive_export": ("path",), "otlp": ("url",), "json": ("path",)}
SOURCES = {"files": ("path", "format"), "table": ("table",), "store": ("table",), "binary_records": ("path", "schema")}
MODES, DIRECTIONS, ON_FAILURE = ("job", "pipeline", "pipeline_audit_only"), ("both", "heal", "audit"), ("fail", "warn")
CASES, CRYPT_MODES = ("lower", "upper", "preserve"), ("GCM", "CBC", "ECB")
ALIASES = {"primary_keys": "keys", "transformation_sql": "sql", "dq_rules": "rules", "cdc_load_strategy": "load", "source_inputs": "inputs", "name": "flow_id"}
_NAME, _DELAY = re.compile(r"[A-Za-z_][\w.]*"), re.compile(r"\s*\d+\s+(second|minute|hour|day|week)s?\s*", re.I)


def validate(spec: Mapping) -> list[str]:
    """All errors of a spec; unknown keys come with the name that was probably meant."""
    if not isinstance(spec, Mapping):
        return ["group: a spec is a mapping"]
    errors = [*_keys("group", spec, GROUP_KEYS)]
    if not spec.get("group_id"):
        errors.append("group: group_id is missing")
    for section in ("parameters", "spark_config"):
        if not isinstance(spec.get(section, {}), Mapping):
            errors.append(f"{section}: must be a mapping")
    ids: list[str] = []
    for section in ("ingestion_flows", "transformation_flows", "reconciliation_flows"):
        flows = spec.get(section, [])
        if not isinstance(flows, Sequence) or isinstance(flows, str):
            errors.append(f"{section}: must be a list")
            continue
        for i, flow in enumerate(flows):
            at = f"{section}[{i}]"
            if not isinstance(flow, Mapping):
                errors.append(f"{at}: must be a mapping")
                continue
            ids.append(flow.get("flow_id", at))
            if not flow.get("flow_id"):
                errors.append(f"{at}: flow_id is missing")
            errors += _reconciliation(at, flow) if section == "reconciliation_flows" else _table_flow(at, flow, section == "ingestion_flows", spec.get("parameters") or {})
    errors += [f"flow_id {x} stands twice" for x in sorted({x for x in ids if ids.count(x) > 1})]
    return errors + ([] if errors else [*_across(spec)])


def _keys(at: str, found: Mapping, allowed: set[str]) -> Iterator[str]:
    for k in sorted(map(str, set(found) - allowed)):
        meant = ALIASES.get(k) if ALIASES.get(k) in allowed else next(iter(difflib.get_close_matches(k, sorted(allowed), 1, 0.75)), None)
        yield f"{at}: unknown key {k}" + (f", did you mean {meant}?" if meant else "")


def _table_flow(at: str, flow: Mapping, ingestion: bool, parameters: Mapping) -> Iterator[str]:
    yield from _keys(at, flow, INGESTION_KEYS if ingestion else TRANSFORMATION_KEYS)
    if not flow.get("target") and not flow.get("sink"):
        yield f"{at}: target is missing"
    if flow.get("target") and not _NAME.fullmatch(str(flow["target"])):
        yield f"{at}.target: {flow['target']} is no table name"
    for k in ("source",) if ingestion else ("inputs", "sql"):
        if not flow.get(k):
            yield f"{at}: {k} is missing"
    if ingestion:
        yield from _read(f"{at}.source", flow.get("source"))
        yield from _shaping(at, flow)
    elif isinstance(flow.get("inputs"), Mapping):
        for name, source in flow["inputs"].items():
            if not _NAME.fullmatch(str(name)):
                yield f"{at}.inputs: {name} can't stand in SQL"
            yield from _read(f"{at}.inputs.{name}", source)
    elif flow.get("inputs"):
        yield f"{at}.inputs: must be a mapping of names to reads"
    if isinstance(flow.get("sql"), str):
        yield from (f"{at}.sql: parameter ${{{p}}} is not defined" for p in sorted(set(re.findall(r"\$\{(\w+)\}", flow["sql"])) - set(parameters)))
    yield from _load(at, flow, ingestion)
    yield from _rules(at, flow, parameters)
    for j, c in enumerate(flow.get("encrypt", [])):
        yield from _crypt(f"{at}.encrypt[{j}]", c, False)
    for k in ("sink", "export"):
        if flow.get(k):
            yield from _sink(f"{at}.{k}", flow[k])
    if flow.get("sink") and flow.get("target"):
        yield f"{at}: a flow has a target or a sink; use export for both"
    if flow.get("export") and flow.get("load", "APPEND") != "APPEND":
        yield f"{at}.export: a table that {flow['load']} rewrites can't be streamed out"
    try:
        Properties.of(flow.get("properties"))
    except (LoadError, AttributeError, KeyError, TypeError, ValueError) as e:
        yield f"{at}.properties: {e}"


def _load(at: str, flow: Mapping, ingestion: bool) -> Iterator[str]:
    load = flow.get("load", "APPEND")
    if load not in LOADS:
        yield f"{at}.load: {load} is not one of {sorted(LOADS)}"
        return
    if load in KEYED and not flow.get("keys"):
        yield f"{at}.keys: {load} needs keys"
    if load == "SCD3" and ingestion:
        yield f"{at}.load: SCD3 is for transformations only"
    if load == "SCD3" and not flow.get("check_columns"):
        yield f"{at}.check_columns: SCD3 needs the columns to check"
    if load == "TRUNCATE_AND_LOAD" and ingestion and isinstance(flow.get("source"), Mapping) and flow["source"].get("stream"):
        yield f"{at}.load: a streamed table can't be truncated and loaded"
    for k in ("keys", "sequence", "exclude", "track", "check_columns"):
        value = flow.get(k)
        if value is not None and (isinstance(value, str) or not isinstance(value, Sequence) or not all(isinstance(x, str) for x in value)):
            yield f"{at}.{k}: must be a list of columns"
        elif value and len(set(value)) < len(value):
            yield f"{at}.{k}: a column stands twice"
    for k in ("sequence", "exclude", "track", "deletes"):
        if flow.get(k) and load not in KEYED:
            yield f"{at}.{k}: {load} has no use for it"
    if isinstance(flow.get("exclude"), Sequence) and set(flow.get("exclude", ())) & set(flow.get("keys") or ()):
        yield f"{at}.exclude: keys can't be excluded"
    deletes = flow.get("deletes")
    if deletes is not None and not (isinstance(deletes, str) or (isinstance(deletes, Mapping) and deletes.get("column") and isinstance(deletes.get("values"), Sequence))):
        yield f"{at}.deletes: a predicate, or a column and its values"
    if flow.get("empty_target_if_source_empty") and load != "TRUNCATE_AND_LOAD":
        yield f"{at}.empty_target_if_source_empty: only TRUNCATE_AND_LOAD knows it"


def _rules(at: str, flow: Mapping, parameters: Mapping) -> Iterator[str]:
    seen: list[str] = []
    for j, rule in enumerate(flow.get("rules", [])):
        where = f"{at}.rules[{j}]"
        if not isinstance(rule, Mapping):
            yield f"{where}: must be a mapping"
            continue
        yield from (f"{where}: {k} is missing" for k in ("id", "expression") if not rule.get(k))
        if rule.get("action") not in ACTIONS:
            yield f"{where}.action: {rule.get('action')} is not one of {ACTIONS}"
        yield from (f"{where}: parameter ${{{p}}} is not defined" for p in sorted(set(re.findall(r"\$\{(\w+)\}", str(rule.get("expression", "")))) - set(parameters)))
        seen.append(rule.get("id"))
    yield from (f"{at}.rules: id {x} stands twice" for x in sorted({x for x in seen if x and seen.count(x) > 1}))


def _shaping(at: str, flow: Mapping) -> Iterator[str]:
    renamed: list[str] = []
    for j, c in enumerate(flow.get("columns", [])):
        if not isinstance(c, Mapping) or not c.get("name"):
            yield f"{at}.columns[{j}]: name is missing"
        else:
            yield from _keys(f"{at}.columns[{j}]", c, {"name", "rename", "data_type", "comment"})
            renamed.append(str(c.get("rename") or c["name"]).lower())
    yield from (f"{at}.columns: {x} stands twice" for x in sorted({x for x in renamed if renamed.count(x) > 1}))
    if flow.get("normalize") and flow["normalize"] not in CASES:
        yield f"{at}.normalize: {flow['normalize']} is not one of {CASES}"
    for j, text in enumerate(flow.get("standardize", [])):
        if not isinstance(text, str) or not re.fullmatch(r"(?is).+\sas\s+`?[A-Za-z_]\w*`?\s*", text):
            yield f"{at}.standardize[{j}]: must end in AS name"
    if flow.get("json_columns") is not None and not isinstance(flow["json_columns"], Mapping):
        yield f"{at}.json_columns: must map columns to DDL"
    elif isinstance(flow.get("source"), Mapping) and flow["source"].get("stream"):
        yield from (f"{at}.json_columns.{k}: a stream needs the DDL" for k, v in (flow.get("json_columns") or {}).items() if not v)
    if isinstance(flow.get("dedup"), Mapping):
        yield from _watermark(f"{at}.dedup", flow["dedup"])


def _watermark(at: str, mark: object) -> Iterator[str]:
    if not isinstance(mark, Mapping) or not mark.get("column"):
        yield f"{at}: column is missing"
    elif not _DELAY.fullmatch(str(mark.get("delay", ""))):
        yield f"{at}.delay: {mark.get('delay')} is no interval"


def _crypt(at: str, c: object, decrypting: bool) -> Iterator[str]:
    if not isinstance(c, Mapping):
        yield f"{at}: must be a mapping"
        return
    yield from _keys(at, c, {"column", "key", "mode", "output", "type"})
    yield from (f"{at}: {k} is missing" for k in ("column", "key", *(["type"] if decrypting else [])) if not c.get(k))
    if c.get("mode", "GCM") not in CRYPT_MODES:
        yield f"{at}.mode: {c['mode']} is not one of {CRYPT_MODES}"


def _read(at: str, read: object) -> Iterator[str]:
    if read is None or isinstance(read, str):
        return
    if not isinstance(read, Mapping):
        yield f"{at}: a table name or a mapping"
        return
    kind = read.get("type", "table")
    if kind not in SOURCES:
        yield f"{at}.type: {kind} is not one of {sorted(SOURCES)}"
        return
    yield from (f"{at}: {k} is missing" for k in SOURCES[kind] if not read.get(k))
    if read.get("evolution"):
        from ..sources.files import MODES as EVOLUTION

        if read["evolution"] not in EVOLUTION:
            yield f"{at}.evolution: {read['evolution']} is not one of {EVOLUTION}"
    if read.get("watermark") is not None:
        yield from _watermark(f"{at}.watermark", read["watermark"])
    for j, c in enumerate(read.get("decrypt", [])):
        yield from _crypt(f"{at}.decrypt[{j}]", c, True)


def _sink(at: str, sink: object) -> Iterator[str]:
    if not isinstance(sink, Mapping) or sink.get("type") not in SINKS:
        yield f"{at}.type: {sink.get('type') if isinstance(sink, Mapping) else sink} is not one of {sorted(SINKS)}"
        return
    yield from (f"{at}: {k} is missing" for k in SINKS[sink["type"]] if not sink.get(k))


def _reconciliation(at: str, flow: Mapping) -> Iterator[str]:
    yield from _keys(at, flow, RECONCILIATION_KEYS)
    yield from (f"{at}: {k} is missing" for k in ("source", "targets", "keys") if not flow.get(k))
    for k, allowed in (("mode", MODES), ("direction", DIRECTIONS), ("on_failure", ON_FAILURE)):
        if flow.get(k) is not None and flow[k] not in allowed:
            yield f"{at}.{k}: {flow[k]} is not one of {allowed}"
    names: list[str] = []
    targets = flow.get("targets") or []
    for j, target in enumerate(targets if isinstance(targets, Sequence) and not isinstance(targets, str) else []):
        where = f"{at}.targets[{j}]"
        if not isinstance(target, Mapping):
            yield f"{where}: must be a mapping"
            continue
        yield from _keys(where, target, TARGET_KEYS)
        yield from (f"{where}: {k} is missing" for k in ("name", "dataset") if not target.get(k))
        yield from _rules(where, target, {})
        names.append(target.get("name"))
        heal = target.get("heal")
        if heal is not None and (not isinstance(heal, Mapping) or not heal.get("table")):
            yield f"{where}.heal: table is missing"
        if heal and flow.get("mode") == "pipeline_audit_only":
            yield f"{where}.heal: an audit heals nothing"
    yield from (f"{at}.targets: name {x} stands twice" for x in sorted({x for x in names if x and names.count(x) > 1}))
    streams = [d for d in (flow.get("source"), *(t.get("dataset") for t in targets if isinstance(t, Mapping))) if isinstance(d, Mapping) and d.get("stream")]
    if len(streams) > 1:
        yield f"{at}: at most one dataset can be a stream"


def _table_of(dataset: object) -> str | None:
    return dataset if isinstance(dataset, str) else dataset.get("table") if isinstance(dataset, Mapping) else None


def _across(spec: Mapping) -> Iterator[str]:
    """Rules between flows: one maker a table, and no reconciliation that feeds what it reads."""
    feeds: dict[str, set[str]] = {}
    makers: dict[str, list[str]] = {}
    for section in ("ingestion_flows", "transformation_flows"):
        for f in spec.get(section, []):
            if f.get("target"):
                makers.setdefault(f["target"], []).append(f["flow_id"])
                makers.setdefault(f"{f['target']}_quarantine", []).append(f["flow_id"])
                reads = [f.get("source")] if "source" in f else list(f["inputs"].values())
                for r in reads:
                    if _table_of(r):
                        feeds.setdefault(_table_of(r), set()).add(f["target"])
    yield from (f"{table} is made by several flows: {', '.join(sorted(set(flows)))}" for table, flows in sorted(makers.items()) if len(flows) > 1)

    def reach(start: str) -> set[str]:
        seen, todo = set(), [start]
        while todo:
            for nxt in feeds.get(todo.pop(), ()):
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return seen

    healed: dict[str, list[str]] = {}
    for f in spec.get("reconciliation_flows", []):
        source = _table_of(f["source"])
        for t in f["targets"]:
            table = (t.get("heal") or {}).get("table")
            if not table:
                continue
            at = f"{f['flow_id']}.{t['name']}"
            healed.setdefault(table, []).append(at)
            if table == source:
                yield f"{at}: heals its own source {table}"
            elif source in reach(table):
                yield f"{at}: heals {table}, which feeds its source {source}"
            if table != _table_of(t["dataset"]) and _table_of(t["dataset"]) not in reach(table):
                yield f"{at}: heals {table}, but compares {_table_of(t['dataset'])}, which that does not feed"
            if (makers.get(table) and (made := next((x for s in ("ingestion_flows", "transformation_flows") for x in spec.get(s, []) if x.get("target") == table), None)) and made.get("load", "APPEND") == "TRUNCATE_AND_LOAD"):
                yield f"{at}: heals {table}, which the next run replaces"
    yield from (f"{table} is healed by several targets: {', '.join(sorted(x))}" for table, x in sorted(healed.items()) if len(x) > 1)
    # Reconciliations that heal each other's sources in a ring never come to rest.
    pairs = {(_table_of(f["source"]), (t.get("heal") or {}).get("table")) for f in spec.get("reconciliation_flows", []) for t in f["targets"]}
    for a, b in sorted((a, b) for a, b in pairs if a and b and a < b and (b, a) in pairs):
        yield f"reconciliations heal {a} from {b} and {b} from {a}"


def check_sql(spark: SparkSession, text: str) -> tuple[str | None, str | None]:
    """(error, warning) of a query: text that can't be parsed is an error, tables or columns not there yet a warning."""
    try:
        spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:  # a parse error comes in Spark's or the gateway's clothes
        return (str(e).strip().splitlines()[0] if isinstance(e, ParseException) or "ParseException" in str(e) else f"can't be parsed: {str(e).splitlines()[0]}"), None
    told = " ".join(r[0] for r in spark.sql(f"EXPLAIN {text}").collect()).strip()  # an analysis error is part of the answer
    return None, (told if told.startswith("Error occurred") else None)


def check_spec_sql(spark: SparkSession, spec: Mapping) -> tuple[list[str], list[str]]:
    """(errors, warnings) of all transformation queries, with parameters filled in."""
    from ..functions.params import in_sql

    errors, warnings = [], []
    for f in spec.get("transformation_flows", []):
        error, warning = check_sql(spark, in_sql(f["sql"], spec.get("parameters", {})))
        errors += [f"{f['flow_id']}.sql: {error}"] if error else []
        warnings += [f"{f['flow_id']}.sql: {warning}"] if warning else []
    return errors, warnings
