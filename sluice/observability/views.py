"""Views over the event log and the control tables, as SQL over inputs in braces.

Inputs are frames by name: `events` (see ``events.SCHEMA``), the control tables of ``plans.onboarding``, the run
table of ``plans.recon_flow``, and what a platform reports: pipelines (pipeline_id, name, tags map, changed_at),
jobs (job_id, name, changed_at), runs (job_id, run_id, state, started_at, ended_at), pipeline_usage and job_usage
(owner, sku, quantity, used_on), prices (sku, price, valid_from, valid_to).
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from .events import TERMINAL

_FINAL = ", ".join(f"'{x}'" for x in TERMINAL)

VIEWS = {
    # One row per group: what it holds, where it writes, how it went last.
    "group_catalog": """
WITH kinds AS (SELECT group_id, count_if(kind = 'ingestion') AS ingestions, count_if(kind = 'transformation') AS transformations, count_if(kind = 'reconciliation') AS reconciliations
               FROM {flows} WHERE is_active GROUP BY group_id),
targets AS (SELECT group_id, array_sort(collect_set(target)) AS targets FROM {flows} WHERE is_active AND target IS NOT NULL GROUP BY group_id),
loads AS (SELECT group_id, array_sort(collect_set(load)) AS loads, max(CASE WHEN load IN ('SCD1', 'SCD2', 'SCD3') THEN 1 ELSE 0 END) = 1 AS keeps_history FROM {flows} WHERE is_active GROUP BY group_id),
last AS (SELECT group_id, update_id, state FROM (SELECT group_id, update_id, get_json_object(details, '$.state') AS state,
               row_number() OVER (PARTITION BY group_id ORDER BY ts DESC, event_id DESC) AS rn FROM {events} WHERE event_type = 'update_progress') WHERE rn = 1)
SELECT g.group_id, g.is_active, coalesce(ingestions, 0) AS ingestions, coalesce(transformations, 0) AS transformations, coalesce(reconciliations, 0) AS reconciliations,
       concat_ws(',', targets) AS targets, concat_ws(',', filter(loads, x -> x <> 'APPEND')) AS loads, coalesce(keeps_history, false) AS keeps_history,
       last.update_id AS last_update, last.state AS last_state,
       concat(g.group_id, ': ', coalesce(size(targets), 0), ' tables, last ', coalesce(lower(last.state), 'never run')) AS summary
FROM {groups} g LEFT JOIN kinds ON g.group_id = kinds.group_id LEFT JOIN targets ON g.group_id = targets.group_id LEFT JOIN loads ON g.group_id = loads.group_id LEFT JOIN last ON g.group_id = last.group_id""",
    # The newest definition of each pipeline, with the group that its tags or else its name tell.
    "pipeline_registry": """
WITH newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pipeline_id ORDER BY changed_at DESC) AS rn FROM {pipelines}) WHERE rn = 1)
SELECT n.pipeline_id, n.name, coalesce(n.tags['group'], g.group_id) AS group_id, coalesce(n.tags['env'], 'unknown') AS env, n.tags['group'] IS NOT NULL AS is_tagged, g.group_id IS NOT NULL AS is_onboarded
FROM newest n LEFT JOIN {groups} g ON g.group_id = coalesce(n.tags['group'], replace(lower(n.name), 'pl_', ''))""",
    # One row per update.
    "pipeline_updates": f"""
SELECT update_id, max(pipeline_id) AS pipeline_id, max(group_id) AS group_id, min(ts) AS started_at, max(CASE WHEN state IN ({_FINAL}) THEN ts END) AS ended_at,
       timestampdiff(SECOND, min(ts), max(CASE WHEN state IN ({_FINAL}) THEN ts END)) AS seconds,
       max(state = 'FAILED') AS is_failed, max(state = 'COMPLETED') AS is_completed, max(coalesce(full_refresh, false)) AS is_full_refresh
FROM (SELECT *, get_json_object(details, '$.state') AS state, cast(get_json_object(details, '$.full_refresh') AS boolean) AS full_refresh FROM {{events}} WHERE event_type = 'update_progress')
GROUP BY update_id""",
    # Runs of jobs under their newest names, with the groups that the names contain.
    "job_runs": """
WITH named AS (SELECT job_id, name FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY changed_at DESC) AS rn FROM {jobs}) WHERE rn = 1)
SELECT r.run_id, r.job_id, n.name, g.group_id, r.state, timestampdiff(SECOND, r.started_at, r.ended_at) AS seconds,
       CASE WHEN r.state = 'SUCCESS' THEN 'ok' WHEN r.state IN ('FAILED', 'TIMEDOUT') THEN 'failed' WHEN r.ended_at IS NULL THEN 'running' ELSE 'other' END AS outcome
FROM {runs} r JOIN named n ON r.job_id = n.job_id LEFT JOIN {groups} g ON lower(n.name) LIKE concat('%', lower(g.group_id), '%')""",
    # What pipelines and jobs used, at the price of the day.
    "cost": """
WITH used AS (SELECT 'pipeline' AS kind, owner, sku, quantity, used_on FROM {pipeline_usage} UNION ALL SELECT 'job', owner, sku, quantity, used_on FROM {job_usage})
SELECT u.kind, u.owner, u.sku, any_value(u.kind) = 'job' AS is_job, sum(u.quantity) AS quantity, sum(u.quantity * coalesce(p.price, 0)) AS amount, count(DISTINCT u.used_on) AS days, count_if(p.price IS NULL) AS unpriced
FROM used u LEFT JOIN {prices} p ON u.sku = p.sku AND u.used_on >= p.valid_from AND (p.valid_to IS NULL OR u.used_on < p.valid_to) GROUP BY ALL""",
    # One row per update and flow; a final state wins over a later one that is not.
    "flow_metrics": f"""
WITH rows AS (SELECT *, get_json_object(details, '$.state') AS state, cast(get_json_object(details, '$.rows_written') AS bigint) AS written,
              cast(get_json_object(details, '$.rows_quarantined') AS bigint) AS quarantined FROM {{events}} WHERE event_type = 'flow_progress'),
last AS (SELECT update_id, flow_id, state, message FROM (SELECT *, row_number() OVER (PARTITION BY update_id, flow_id ORDER BY CASE WHEN state IN ({_FINAL}) THEN 0 ELSE 1 END, ts DESC, event_id DESC) AS rn FROM rows) WHERE rn = 1)
SELECT m.update_id, m.flow_id, last.state, last.message, m.first_ts, m.last_ts, m.written, m.quarantined, m.events
FROM (SELECT update_id, flow_id, min(ts) AS first_ts, max(ts) AS last_ts, sum(written) AS written, sum(quarantined) AS quarantined, count(*) AS events FROM rows GROUP BY update_id, flow_id) m
JOIN last ON m.update_id = last.update_id AND m.flow_id <=> last.flow_id""",
    # One row per update, flow and rule, from the flow's last report.
    "dq_results": """
WITH last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY update_id, flow_id ORDER BY ts DESC, event_id DESC) AS rn FROM {events} WHERE event_type = 'data_quality') WHERE rn = 1),
told AS (SELECT update_id, flow_id, from_json(details, 'rows_written bigint, rows_quarantined bigint, expectations array<struct<name:string,action:string,failed:bigint>>') AS d FROM last)
SELECT update_id, flow_id, e.name AS rule, e.action, coalesce(e.failed, 0) AS failed, d.rows_written + coalesce(d.rows_quarantined, 0) AS checked,
       CASE WHEN d.rows_written + coalesce(d.rows_quarantined, 0) > 0 THEN round(100 * (1 - coalesce(e.failed, 0) / (d.rows_written + coalesce(d.rows_quarantined, 0))), 2) END AS pass_rate
FROM told LATERAL VIEW explode(d.expectations) x AS e""",
    # Every reconciliation flow and target with its newest run.
    "recon_health": """
WITH newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY flow_id, target ORDER BY ts DESC, run_id DESC) AS rn FROM {recon_runs}) WHERE rn = 1)
SELECT f.group_id, f.flow_id, n.target, n.status, n.matched, n.missing_in_target, n.missing_in_source, n.value_drift,
       CASE WHEN n.matched + n.missing_in_target + n.missing_in_source > 0 THEN round(100 * n.matched / (n.matched + n.missing_in_target + n.missing_in_source), 2) END AS match_rate,
       coalesce(n.status IN ('MATCHED', 'SUCCESS') AND n.missing_in_target = 0 AND n.missing_in_source = 0, false) AS is_clean
FROM (SELECT * FROM {flows} WHERE kind = 'reconciliation') f LEFT JOIN newest n ON f.flow_id = n.flow_id""",
    # One verdict per group over the 30 days before `now`.
    "group_health": f"""
WITH updates AS (SELECT group_id, update_id, min(ts) AS started_at, max(ts) AS ended_at, max(state = 'FAILED') AS failed, max(coalesce(full_refresh, false)) AS refreshed
     FROM (SELECT *, get_json_object(details, '$.state') AS state, cast(get_json_object(details, '$.full_refresh') AS boolean) AS full_refresh FROM {{events}} WHERE event_type = 'update_progress') GROUP BY group_id, update_id),
recent AS (SELECT * FROM updates WHERE started_at >= (SELECT max(run_at) FROM {{now}}) - INTERVAL 30 DAYS),
totals AS (SELECT group_id, count(*) AS updates, count_if(failed) AS failed, percentile_approx(timestampdiff(SECOND, started_at, ended_at), 0.95, 10000) AS p95_seconds,
     avg(CASE WHEN NOT refreshed THEN timestampdiff(SECOND, started_at, ended_at) END) AS mean_seconds FROM recent GROUP BY group_id),
last AS (SELECT group_id, failed AS last_failed FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY started_at DESC, update_id DESC) AS rn FROM recent) WHERE rn = 1),
rules AS (SELECT group_id, count(*) AS reports FROM {{events}} WHERE event_type = 'data_quality' AND level <> 'INFO' AND ts >= (SELECT max(run_at) FROM {{now}}) - INTERVAL 30 DAYS GROUP BY group_id),
recon AS (SELECT f.group_id, count_if(r.missing_in_target > 0) AS dirty FROM {{recon_runs}} r JOIN {{flows}} f ON r.flow_id = f.flow_id GROUP BY f.group_id)
SELECT g.group_id, coalesce(t.updates, 0) AS updates, coalesce(t.failed, 0) AS failed, t.p95_seconds, t.mean_seconds, coalesce(rules.reports, 0) AS rule_reports, coalesce(recon.dirty, 0) AS dirty_runs,
       CASE WHEN t.updates IS NULL THEN 'NO_RUNS' WHEN last.last_failed THEN 'FAILING' WHEN t.failed * 5 > t.updates THEN 'UNSTABLE' WHEN coalesce(rules.reports, 0) + coalesce(recon.dirty, 0) > 0 THEN 'REVIEW' ELSE 'HEALTHY' END AS status
FROM {{groups}} g LEFT JOIN totals t ON g.group_id = t.group_id LEFT JOIN last ON g.group_id = last.group_id LEFT JOIN rules ON g.group_id = rules.group_id LEFT JOIN recon ON g.group_id = recon.group_id""",
    # All flows in one list, with what each kind has.
    "flow_inventory": """
SELECT 'ingestion' AS kind, group_id, flow_id, element_at(reads, 1) AS source, target, load, is_active FROM {flows} WHERE kind = 'ingestion'
UNION ALL SELECT 'transformation', group_id, flow_id, concat_ws(',', array_sort(reads)), target, load, is_active FROM {flows} WHERE kind = 'transformation'
UNION ALL SELECT 'reconciliation', group_id, flow_id, element_at(reads, 1), concat_ws(',', slice(reads, 2, size(reads))), NULL, is_active FROM {flows} WHERE kind = 'reconciliation'""",
    # Which source feeds which target, how often and since when.
    "lineage": """
SELECT get_json_object(e.details, '$.source') AS source, get_json_object(e.details, '$.target') AS target, coalesce(f.kind, 'unknown') AS kind, count(*) AS uses, min(e.ts) AS first_ts, max(e.ts) AS last_ts
FROM {events} e LEFT JOIN {flows} f ON e.flow_id = f.flow_id AND e.group_id = f.group_id WHERE e.event_type = 'lineage' GROUP BY ALL""",
    # Versions of each group in the order of their numbers, with how many are newer here and anywhere.
    "deployment_versions": """
WITH parts AS (SELECT DISTINCT group_id, version, cast(split(version, '[.]')[0] AS int) AS major, cast(split(version, '[.]')[1] AS int) AS minor, cast(split(version, '[.]')[2] AS int) AS patch FROM {versions}),
known AS (SELECT major, minor, patch FROM parts UNION SELECT 0, 0, 0),
ranked AS (SELECT *, dense_rank() OVER (PARTITION BY group_id ORDER BY major DESC, minor DESC, patch DESC) AS place FROM parts),
newest AS (SELECT max(struct(major, minor, patch)) AS v FROM known)
SELECT r.group_id, r.version, r.place, r.place = 1 AS is_current, (SELECT count(*) FROM known k WHERE struct(k.major, k.minor, k.patch) > struct(r.major, r.minor, r.patch)) AS newer_anywhere,
       struct(r.major, r.minor, r.patch) = n.v AS is_newest FROM ranked r CROSS JOIN newest n""",
}


def view(spark: SparkSession, name: str, **inputs: DataFrame) -> DataFrame:
    """A view over its inputs; extra ones are ignored, a missing one is an error that names it."""
    text = VIEWS[name]
    needed = sorted(set(re.findall(r"\{(\w+)\}", text)))
    if absent := [n for n in needed if n not in inputs]:
        raise ValueError(f"view {name} needs {absent}")
    return spark.sql(text, **{n: inputs[n] for n in needed})


def all_logs(logs: Sequence[DataFrame]) -> DataFrame:
    """The events of any number of logs; a log without a column has nulls there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), logs)


def create(spark: SparkSession, prefix: str = "v_", **inputs: DataFrame) -> list[str]:
    """Temporary views of all that the inputs suffice for; returns their names."""
    made = []
    for name, text in VIEWS.items():
        if set(re.findall(r"\{(\w+)\}", text)) <= set(inputs):
            view(spark, name, **inputs).createOrReplaceTempView(f"{prefix}{name}")
            made.append(f"{prefix}{name}")
    return made
