"""One query per observability view, over control tables and event logs made of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..observability import views
from .catalogue import Tables, query

_STATE = "CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' ELSE 'RUNNING' END"


def _log(kind: str, details: str, level: str = "'INFO'") -> str:
    return f"""SELECT CAST(event_id AS STRING) AS event_id, ts, {level} AS level, '{kind}' AS event_type, concat('p', CAST(user_id % 3 AS STRING)) AS pipeline_id, concat('g', CAST(user_id % 4 AS STRING)) AS group_id,
  concat('u', CAST(user_id % 40 AS STRING)) AS update_id, concat('f', CAST(user_id % 5 AS STRING)) AS flow_id, concat('event ', CAST(event_id AS STRING)) AS message, {details} AS details FROM {{events}}"""


#: Inputs as SQL that both engines read; tables stand in braces.
INPUTS = {
    "flow_log": _log("flow_progress", f"""concat('{{"state":"', {_STATE}, '","rows_written":', CAST(event_id % 1000 AS STRING), ',"rows_quarantined":', CAST(event_id % 7 AS STRING), '}}')"""),
    "update_log": _log("update_progress", f"""concat('{{"state":"', {_STATE}, '","full_refresh":', CASE WHEN event_id % 50 = 0 THEN 'true' ELSE 'false' END, '}}')"""),
    "rule_log": _log("data_quality", """concat('{"rows_written":', CAST(100 + event_id % 100 AS STRING), ',"rows_quarantined":', CAST(event_id % 3 AS STRING), ',"expectations":[{"name":"a","action":"warn","failed":', CAST(event_id % 9 AS STRING), '},{"name":"b","action":"drop","failed":null}]}')""", "CASE WHEN event_id % 97 = 0 THEN 'WARN' ELSE 'INFO' END"),
    "lineage_log": _log("lineage", """concat('{"source":"s', CAST(event_id % 4 AS STRING), '","target":"t', CAST(user_id % 5 AS STRING), '"}')"""),
    "groups": "SELECT concat('g', CAST(n_nationkey AS STRING)) AS group_id, n_nationkey <> 3 AS is_active FROM {nation} WHERE n_nationkey < 7",
    "pipelines": "SELECT p_partkey % 40 AS pipeline_id, concat('PL_G', CAST(p_partkey % 9 AS STRING)) AS name, p_partkey AS changed_at, p_partkey % 3 = 0 AS tagged, p_brand AS env FROM {part}",
    "jobs": "SELECT s_suppkey % 30 AS job_id, concat('Load G', CAST(s_suppkey % 8 AS STRING), ' nightly') AS name, s_suppkey AS changed_at FROM {supplier}",
    "runs": "SELECT o_custkey % 30 AS job_id, o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'FAILED' ELSE 'RUNNING' END AS state, CAST(o_orderdate AS TIMESTAMP) AS started_at, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 90 SECONDS END AS ended_at FROM {orders}",
    "pipeline_usage": "SELECT l_orderkey % 6 AS owner, l_returnflag AS sku, CAST(l_quantity AS DECIMAL(18,2)) AS quantity, CAST(l_shipdate AS DATE) AS used_on FROM {lineitem} WHERE l_orderkey % 2 = 0",
    "job_usage": "SELECT l_orderkey % 6 AS owner, l_returnflag AS sku, CAST(l_quantity AS DECIMAL(18,2)) AS quantity, CAST(l_shipdate AS DATE) AS used_on FROM {lineitem} WHERE l_orderkey % 2 = 1",
    "prices": "SELECT 'A' AS sku, 2 AS price, DATE '1990-01-01' AS valid_from, DATE '1995-01-01' AS valid_to UNION ALL SELECT 'A', 3, DATE '1995-01-01', CAST(NULL AS DATE) UNION ALL SELECT 'N', 5, DATE '1996-01-01', CAST(NULL AS DATE)",
    "flow_rows": """SELECT concat('g', CAST(p_partkey % 4 AS STRING)) AS group_id, concat('f', CAST(p_partkey % 5 AS STRING)) AS flow_id, CASE p_partkey % 3 WHEN 0 THEN 'ingestion' WHEN 1 THEN 'transformation' ELSE 'reconciliation' END AS kind,
  concat('t', CAST(p_partkey AS STRING)) AS target, CASE p_size % 4 WHEN 0 THEN 'SCD1' WHEN 1 THEN 'SCD2' ELSE 'APPEND' END AS load, p_partkey AS k, p_size % 11 <> 0 AS is_active FROM {part} WHERE p_partkey <= 20""",
    "recon_runs": """SELECT concat('r', CAST(o_orderkey AS STRING)) AS run_id, o_orderdate AS ts, concat('f', CAST(o_custkey % 5 AS STRING)) AS flow_id, concat('t', CAST(o_custkey % 3 AS STRING)) AS target, CASE WHEN o_orderstatus = 'P' THEN 'FAILED' ELSE 'SUCCESS' END AS status,
  o_orderkey % 100 AS matched, o_orderkey % 5 AS value_drift, o_orderkey % 7 AS missing_in_target, o_orderkey % 2 AS missing_in_source FROM {orders}""",
    "versions": "SELECT concat('g', CAST(p_partkey % 4 AS STRING)) AS group_id, concat(CAST(p_size % 3 AS STRING), '.', CAST(p_partkey % 12 AS STRING), '.', CAST(p_size % 11 AS STRING)) AS version FROM {part} WHERE p_partkey <= 60",
    "now": "SELECT max(ts) AS run_at FROM {events}",
}


def _input(t: Tables, name: str) -> DataFrame:
    names = [n for n in ("events", "nation", "part", "supplier", "orders", "lineitem") if "{" + n + "}" in INPUTS[name]]
    text = INPUTS[name]
    for n in names:
        text = text.replace("{" + n + "}", f"\0{n}\1")
    text = text.replace("{", "{{").replace("}", "}}").replace("\0", "{").replace("\1", "}")
    return t.spark.sql(text, **{n: getattr(t, n) for n in names}) if names else t.spark.sql(INPUTS[name])


def _bare(name: str) -> str:
    text = INPUTS[name]
    for n in ("events", "nation", "part", "supplier", "orders", "lineitem"):
        text = text.replace("{" + n + "}", n)
    return text


def _with(*names: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({_bare(n)})" for n in names)


def _flows(t: Tables) -> DataFrame:
    rows = _input(t, "flow_rows")
    return t.spark.sql("SELECT group_id, flow_id, kind, target, load, array(concat('s', CAST(k % 4 AS STRING)), concat('r', CAST(k % 3 AS STRING))) AS reads, is_active FROM {r}", r=rows)


def _view(t: Tables, name: str, **more: DataFrame) -> DataFrame:
    inputs = {n: _input(t, n) for n in INPUTS if n in {"groups", "jobs", "runs", "pipeline_usage", "job_usage", "prices", "recon_runs", "versions", "now"}}
    return views.view(t.spark, name, **inputs, flows=_flows(t), **more)


J = lambda path, kind="VARCHAR": f"CAST(json_extract_string(details, '$.{path}') AS {kind})"


@query("view_group_catalog", f"""{_with('groups', 'flow_rows', 'update_log')}
SELECT g.group_id, g.is_active, CAST(count(*) FILTER (f.kind = 'ingestion') AS BIGINT) AS ingestions, CAST(count(*) FILTER (f.kind = 'transformation') AS BIGINT) AS transformations, CAST(count(*) FILTER (f.kind = 'reconciliation') AS BIGINT) AS reconciliations,
  coalesce(string_agg(DISTINCT f.target, ',' ORDER BY f.target), '') AS targets, coalesce(string_agg(DISTINCT f.load, ',' ORDER BY f.load) FILTER (f.load <> 'APPEND'), '') AS loads, coalesce(bool_or(f.load LIKE 'SCD%'), false) AS keeps_history,
  any_value(u.update_id) AS last_update, any_value(u.state) AS last_state, g.group_id || ': ' || count(DISTINCT f.target) || ' tables, last ' || coalesce(lower(any_value(u.state)), 'never run') AS summary
FROM groups g LEFT JOIN (SELECT * FROM flow_rows WHERE is_active) f USING (group_id)
LEFT JOIN (SELECT group_id, arg_max(update_id, (ts, event_id)) AS update_id, arg_max({J('state')}, (ts, event_id)) AS state FROM update_log GROUP BY group_id) u USING (group_id) GROUP BY g.group_id, g.is_active""")
def _(t: Tables) -> DataFrame:
    return _view(t, "group_catalog", events=_input(t, "update_log"))


@query("view_pipeline_registry", f"""{_with('groups', 'pipelines')}, n AS (SELECT pipeline_id, arg_max(name, changed_at) AS name, arg_max(tagged, changed_at) AS tagged, arg_max(env, changed_at) AS env FROM pipelines GROUP BY pipeline_id)
SELECT pipeline_id, name, CASE WHEN tagged THEN 'g1' ELSE group_id END AS group_id, CASE WHEN tagged THEN env ELSE 'unknown' END AS env, tagged AS is_tagged, group_id IS NOT NULL AS is_onboarded
FROM n LEFT JOIN groups g ON g.group_id = CASE WHEN tagged THEN 'g1' ELSE replace(lower(name), 'pl_', '') END""")
def _(t: Tables) -> DataFrame:
    made = t.spark.sql("SELECT pipeline_id, name, changed_at, CASE WHEN tagged THEN map('group', 'g1', 'env', env) ELSE map() END AS tags FROM {p}", p=_input(t, "pipelines"))
    return _view(t, "pipeline_registry", pipelines=made)


@query("view_pipeline_updates", f"""{_with('update_log')}, r AS (SELECT *, {J('state')} AS state, {J('full_refresh', 'BOOLEAN')} AS fr FROM update_log)
SELECT update_id, max(pipeline_id) AS pipeline_id, max(group_id) AS group_id, min(ts) AS started_at, max(ts) FILTER (state IN ('COMPLETED', 'FAILED')) AS ended_at,
  CAST(floor(epoch(max(ts) FILTER (state IN ('COMPLETED', 'FAILED'))) - epoch(min(ts))) AS BIGINT) AS seconds, bool_or(state = 'FAILED') AS is_failed, bool_or(state = 'COMPLETED') AS is_completed, bool_or(fr) AS is_full_refresh FROM r GROUP BY update_id""")
def _(t: Tables) -> DataFrame:
    return _view(t, "pipeline_updates", events=_input(t, "update_log"))


@query("view_job_runs", f"""{_with('groups', 'jobs', 'runs')}, n AS (SELECT job_id, arg_max(name, changed_at) AS name FROM jobs GROUP BY job_id)
SELECT run_id, job_id, name, group_id, state, CASE WHEN ended_at IS NOT NULL THEN CAST(90 AS BIGINT) END AS seconds, CASE state WHEN 'SUCCESS' THEN 'ok' WHEN 'FAILED' THEN 'failed' ELSE 'running' END AS outcome
FROM runs JOIN n USING (job_id) LEFT JOIN groups ON contains(lower(name), group_id)""")
def _(t: Tables) -> DataFrame:
    return _view(t, "job_runs")


@query("view_cost", f"""{_with('pipeline_usage', 'job_usage', 'prices')}, u AS (SELECT 'pipeline' AS kind, * FROM pipeline_usage UNION ALL SELECT 'job', * FROM job_usage)
SELECT kind, owner, u.sku, kind = 'job' AS is_job, CAST(sum(quantity) AS DECIMAL(28,2)) AS quantity, CAST(sum(quantity * coalesce(price, 0)) AS DECIMAL(38,2)) AS amount, CAST(count(DISTINCT used_on) AS BIGINT) AS days, CAST(count(*) FILTER (price IS NULL) AS BIGINT) AS unpriced
FROM u LEFT JOIN prices p ON u.sku = p.sku AND used_on >= valid_from AND (valid_to IS NULL OR used_on < valid_to) GROUP BY kind, owner, u.sku""")
def _(t: Tables) -> DataFrame:
    return _view(t, "cost")


@query("view_flow_metrics", f"""{_with('flow_log')}, r AS (SELECT *, {J('state')} AS state FROM flow_log)
SELECT update_id, flow_id, arg_max(state, (state <> 'RUNNING', ts, event_id)) AS state, arg_max(message, (state <> 'RUNNING', ts, event_id)) AS message, min(ts) AS first_ts, max(ts) AS last_ts,
  CAST(sum({J('rows_written', 'BIGINT')}) AS BIGINT) AS written, CAST(sum({J('rows_quarantined', 'BIGINT')}) AS BIGINT) AS quarantined, CAST(count(*) AS BIGINT) AS events FROM r GROUP BY update_id, flow_id""")
def _(t: Tables) -> DataFrame:
    logs = _input(t, "flow_log")
    return _view(t, "flow_metrics", events=views.all_logs([logs.filter("pipeline_id = 'p0'"), logs.filter("pipeline_id <> 'p0' OR pipeline_id IS NULL"), _input(t, "rule_log")]))


@query("view_dq_results", f"""{_with('rule_log')}, l AS (SELECT update_id, flow_id, arg_max(details, (ts, event_id)) AS details FROM rule_log GROUP BY update_id, flow_id),
e AS (SELECT *, {J('rows_written', 'BIGINT')} + {J('rows_quarantined', 'BIGINT')} AS checked FROM l)
SELECT update_id, flow_id, 'a' AS rule, 'warn' AS action, {J('expectations[0].failed', 'BIGINT')} AS failed, checked, round(100 * (1 - {J('expectations[0].failed', 'BIGINT')} / checked), 2) AS pass_rate FROM e
UNION ALL SELECT update_id, flow_id, 'b', 'drop', 0, checked, 100.0 FROM e""")
def _(t: Tables) -> DataFrame:
    return _view(t, "dq_results", events=_input(t, "rule_log"))


@query("view_recon_health", f"""{_with('flow_rows', 'recon_runs')}, n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY flow_id, target ORDER BY ts DESC, run_id DESC) AS rn FROM recon_runs) WHERE rn = 1)
SELECT f.group_id, f.flow_id, n.target, status, matched, missing_in_target, missing_in_source, value_drift, CASE WHEN matched + missing_in_target + missing_in_source > 0 THEN round(100.0 * matched / (matched + missing_in_target + missing_in_source), 2) END AS match_rate,
  coalesce(status = 'SUCCESS' AND missing_in_target = 0 AND missing_in_source = 0, false) AS is_clean FROM flow_rows f LEFT JOIN n ON f.flow_id = n.flow_id WHERE kind = 'reconciliation'""")
def _(t: Tables) -> DataFrame:
    return _view(t, "recon_health")


@query("view_group_health", f"""{_with('groups', 'update_log', 'rule_log', 'flow_rows', 'recon_runs', 'now')},
u AS (SELECT group_id, update_id, min(ts) AS s, max(ts) AS e, bool_or({J('state')} = 'FAILED') AS failed, bool_or({J('full_refresh', 'BOOLEAN')}) AS fr FROM update_log GROUP BY group_id, update_id),
r AS (SELECT *, CAST(floor(epoch(e) - epoch(s)) AS BIGINT) AS secs FROM u WHERE s >= (SELECT run_at FROM now) - INTERVAL 30 DAYS),
o AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY secs) AS k, count(*) OVER (PARTITION BY group_id) AS n FROM r),
t AS (SELECT group_id, count(*) AS updates, count(*) FILTER (failed) AS failed, min(secs) FILTER (k >= ceil(0.95 * n)) AS p95, avg(secs) FILTER (NOT fr) AS mean, arg_max(failed, (s, update_id)) AS last_failed FROM o GROUP BY group_id),
q AS (SELECT group_id, count(*) AS reports FROM rule_log WHERE level <> 'INFO' AND ts >= (SELECT run_at FROM now) - INTERVAL 30 DAYS GROUP BY group_id),
c AS (SELECT f.group_id, count(*) FILTER (missing_in_target > 0) AS dirty FROM recon_runs r JOIN flow_rows f ON r.flow_id = f.flow_id GROUP BY f.group_id)
SELECT g.group_id, CAST(coalesce(updates, 0) AS BIGINT) AS updates, CAST(coalesce(failed, 0) AS BIGINT) AS failed, p95 AS p95_seconds, mean AS mean_seconds, CAST(coalesce(reports, 0) AS BIGINT) AS rule_reports, CAST(coalesce(dirty, 0) AS BIGINT) AS dirty_runs,
  CASE WHEN updates IS NULL THEN 'NO_RUNS' WHEN last_failed THEN 'FAILING' WHEN failed * 5 > updates THEN 'UNSTABLE' WHEN coalesce(reports, 0) + coalesce(dirty, 0) > 0 THEN 'REVIEW' ELSE 'HEALTHY' END AS status
FROM groups g LEFT JOIN t USING (group_id) LEFT JOIN q USING (group_id) LEFT JOIN c USING (group_id)""")
def _(t: Tables) -> DataFrame:
    return _view(t, "group_health", events=_input(t, "update_log").union(_input(t, "rule_log")))


@query("view_flow_inventory", f"""{_with('flow_rows')}, r AS (SELECT *, 's' || k % 4 AS a, 'r' || k % 3 AS b FROM flow_rows)
SELECT kind, group_id, flow_id, CASE kind WHEN 'transformation' THEN b || ',' || a ELSE a END AS source, CASE kind WHEN 'reconciliation' THEN b ELSE target END AS target, CASE WHEN kind <> 'reconciliation' THEN load END AS load, is_active FROM r""")
def _(t: Tables) -> DataFrame:
    return _view(t, "flow_inventory")


@query("view_lineage", f"""{_with('lineage_log', 'flow_rows')}
SELECT {J('source')} AS source, {J('target')} AS target, coalesce(kind, 'unknown') AS kind, CAST(count(*) AS BIGINT) AS uses, min(ts) AS first_ts, max(ts) AS last_ts FROM lineage_log e LEFT JOIN flow_rows f ON e.flow_id = f.flow_id AND e.group_id = f.group_id GROUP BY 1, 2, 3""")
def _(t: Tables) -> DataFrame:
    return _view(t, "lineage", events=_input(t, "lineage_log"))


@query("view_deployment_versions", f"""{_with('versions')}, p AS (SELECT DISTINCT group_id, version, [CAST(x AS INT) for x in string_split(version, '.')] AS v FROM versions), k AS (SELECT DISTINCT v FROM p UNION SELECT [0, 0, 0])
SELECT group_id, version, CAST(dense_rank() OVER (PARTITION BY group_id ORDER BY v DESC) AS INT) AS place, dense_rank() OVER (PARTITION BY group_id ORDER BY v DESC) = 1 AS is_current,
  CAST((SELECT count(*) FROM k WHERE k.v > p.v) AS BIGINT) AS newer_anywhere, v = (SELECT max(v) FROM k) AS is_newest FROM p""")
def _(t: Tables) -> DataFrame:
    return _view(t, "deployment_versions")
