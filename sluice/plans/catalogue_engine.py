"""Queries of the engine: flows that load, sources, sinks, reconciliation flows, governance and observability views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import governance
from ..observability import events as log_events
from ..operators.loads import END, START
from ..sources import landing, registry
from ..sources.store import Store
from ..streaming import flows as streams
from ..streaming import sinks
from . import dispatch, recon_flow
from .catalogue import CLASSES, LATEST, SCD2, SOURCE, TARGET, Tables, query, shared_folder, sql
from .engine import CHANGES, Engine

# --- flows that load -------------------------------------------------------------------------------------


def _engine(t: Tables) -> Engine:
    return Engine(t.spark, Store(t.spark, shared_folder(t.spark)), read=lambda read: getattr(t, read["table"]))


def _events_flow(load: str, **more) -> dict:
    raw = {"flow_id": "load", "inputs": {"e": {"table": "events"}}, "target": "users", "sql": "SELECT user_id, ts, event_id, event_type, value FROM e", "load": load, "keys": ["user_id"], "sequence": ["ts", "event_id"], **more}
    return {"group_id": "g", "transformation_flows": [raw]}


@query("flow_scd1", f"SELECT user_id, event_id, event_type FROM ({LATEST}) WHERE rn = 1 AND event_type <> 'error'")
def _(t: Tables) -> DataFrame:
    engine = _engine(t)
    for half in ("event_id % 2 = 0", "event_id % 2 = 1"):  # late rows come in the second update
        spec = _events_flow("SCD1", deletes={"column": "event_type", "values": ["error"]})
        spec["transformation_flows"][0]["sql"] += f" WHERE {half}"
        engine.run(spec)
    return engine.store.read("users").select("user_id", "event_id", "event_type")


@query("flow_scd2", SCD2.replace("{track}", "event_type"))
def _(t: Tables) -> DataFrame:
    engine = _engine(t)
    for half in ("user_id % 3 = 0", "user_id % 3 <> 0 OR user_id IS NULL"):
        spec = _events_flow("SCD2", deletes="event_type = 'error'", track=["event_type"])
        spec["transformation_flows"][0]["sql"] += f" WHERE {half}"
        engine.run(spec)
    return engine.store.read("users").select("user_id", "event_type", "value", F.col(START).alias("start_at"), F.col(END).alias("end_at"))


@query("flow_scd3", f"SELECT user_id, max(CASE WHEN rn = 1 THEN event_id END) AS current_event_id, max(CASE WHEN rn = 2 THEN event_id END) AS previous_event_id FROM ({LATEST}) GROUP BY user_id")
def _(t: Tables) -> DataFrame:
    engine = _engine(t)
    spec = _events_flow("SCD3", check_columns=["event_id"])
    engine.run(spec)
    return engine.store.read("users")


@query("flow_snapshot", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderstatus <> 'P'")
def _(t: Tables) -> DataFrame:
    engine = _engine(t)
    for keep in ("o_orderkey % 3 <> 0", "o_orderkey % 4 <> 0"):
        engine.run({"group_id": "g", "transformation_flows": [{
            "flow_id": "s", "inputs": {"o": {"table": "orders"}}, "target": "t", "load": "FULL_SNAPSHOT_CDC", "keys": ["o_orderkey"], "deletes": {"column": "o_orderstatus", "values": ["P"]},
            "sql": f"SELECT o_orderkey, o_orderstatus FROM o WHERE {keep}"}]})
    return engine.store.read("t").select("o_orderkey", "o_orderstatus")


@query("flow_truncate_and_load", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey > 5")
def _(t: Tables) -> DataFrame:
    engine = _engine(t)
    for keep in ("n_nationkey <= 5", "n_nationkey > 5", "false"):  # an empty source leaves the table
        engine.run({"group_id": "g", "transformation_flows": [{"flow_id": "s", "inputs": {"n": {"table": "nation"}}, "target": "t", "load": "TRUNCATE_AND_LOAD", "sql": f"SELECT n_nationkey, n_name FROM n WHERE {keep}"}]})
    return engine.store.read("t")


CHAIN = {
    "group_id": "g", "spark_config": {"spark.sql.adaptive.enabled": True},
    "ingestion_flows": [{
        "flow_id": "raw", "source": {"table": "orders"}, "target": "bronze", "rules": [
            {"id": "big", "expression": "o_totalprice > 100000", "action": "quarantine", "reason": "too small"}, {"id": "priced", "expression": "o_totalprice > 1000", "action": "drop"},
            {"id": "urgent", "expression": "o_orderpriority LIKE '1%'", "action": "warn"}]}],
    "transformation_flows": [{"flow_id": "sum", "inputs": {"b": "bronze"}, "target": "silver", "sql": "SELECT o_orderstatus, count(*) AS n FROM b GROUP BY o_orderstatus"}],
}


@query("flow_quarantine_table", "SELECT o_orderkey, 'big' AS rules FROM orders WHERE o_totalprice > 1000 AND o_totalprice <= 100000")
def _(t: Tables) -> DataFrame:
    engine = _engine(t)
    engine.run(CHAIN)
    return engine.store.read("bronze_quarantine").select("o_orderkey", F.array_join("_eng_failed_rules", ",").alias("rules"))


@query("flow_chain", "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderstatus")
def _(t: Tables) -> DataFrame:
    engine = _engine(t)
    engine.run(CHAIN)
    return engine.store.read("silver")


@query("flow_event_log", """SELECT 'raw' AS flow_id, 'COMPLETED' AS state, CAST(count(*) FILTER (o_totalprice > 100000) AS BIGINT) AS rows_written, CAST(count(*) FILTER (o_totalprice > 1000 AND o_totalprice <= 100000) AS BIGINT) AS rows_quarantined FROM orders
UNION ALL SELECT 'sum', 'COMPLETED', CAST(count(DISTINCT o_orderstatus) AS BIGINT), 0 FROM orders WHERE o_totalprice > 100000""")
def _(t: Tables) -> DataFrame:
    engine = _engine(t)
    engine.run(CHAIN)
    return log_events.flow_metrics(engine.store.read(log_events.TABLE)).select("flow_id", "state", "rows_written", "rows_quarantined")


@query("flow_change_metrics", "SELECT CAST(2 AS BIGINT) AS version, CAST(count(*) FILTER (c_custkey % 3 = 0) AS BIGINT) AS inserted, CAST(count(*) FILTER (c_custkey % 3 <> 0 AND c_custkey % 5 = 0) AS BIGINT) AS updated, CAST(0 AS BIGINT) AS deleted FROM customer")
def _(t: Tables) -> DataFrame:
    engine = _engine(t)
    for i, (keep, name) in enumerate((("c_custkey % 3 <> 0", "c_name"), ("c_custkey % 3 = 0 OR c_custkey % 5 = 0", "concat(c_name, '*')"))):
        engine.run({"group_id": "g", "transformation_flows": [{"flow_id": "c", "inputs": {"c": {"table": "customer"}}, "target": "t", "load": "SCD1", "keys": ["c_custkey"], "sequence": ["s"], "sql": f"SELECT c_custkey, {name} AS name, {i} AS s FROM c WHERE {keep}"}]})
    return engine.store.read(CHANGES).select("version", "inserted", "updated", "deleted")


@query("flow_crypt", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def _(t: Tables) -> DataFrame:
    engine, key = _engine(t), "0123456789abcdef"
    engine.run({
        "group_id": "g",
        "ingestion_flows": [{"flow_id": "a", "source": {"table": "customer"}, "target": "locked", "encrypt": [{"column": "c_acctbal", "key": key}]}],
        "transformation_flows": [{"flow_id": "b", "inputs": {"l": {"table": "locked", "decrypt": [{"column": "c_acctbal", "key": key, "type": "double"}]}}, "target": "open", "sql": "SELECT c_custkey, c_acctbal FROM l WHERE c_acctbal > 0"}],
    })
    return engine.store.read("open")


@query("flow_stream_scd1", f"SELECT user_id, event_id, event_type FROM ({LATEST}) WHERE rn = 1")
def _(t: Tables) -> DataFrame:
    engine = Engine(t.spark, Store(t.spark, shared_folder(t.spark)), read=lambda read: streams.read_events(t.spark, f"{t.sf_dir}/events.parquet"))
    engine.run({"group_id": "g", "ingestion_flows": [{"flow_id": "s", "source": {"table": "events", "stream": True}, "target": "users", "load": "SCD1", "keys": ["user_id"], "sequence": ["ts", "event_id"]}]})
    return engine.store.read("users").select("user_id", "event_id", "event_type")


@query("flow_change_envelope", "SELECT 'customer' AS t, c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier WHERE s_suppkey % 7 <> 0")
def _(t: Tables) -> DataFrame:
    """A log with the changes of several tables: a rule drops other tables' rows, operations load the rest."""
    side = lambda df, name, k, n: df.select(F.lit(name).alias("tab"), F.col(k).alias("id"), F.col(n).alias("name"), F.lit("I").alias("op"), F.lit(1).alias("seq"))
    both = side(t.customer, "customer", "c_custkey", "c_name").union(side(t.supplier, "supplier", "s_suppkey", "s_name"))
    log = both.union(both.filter("id % 7 = 0").select("tab", "id", "name", F.lit("D").alias("op"), F.lit(2).alias("seq")))
    engine = Engine(t.spark, Store(t.spark, shared_folder(t.spark)), read=lambda read: log)
    engine.run({"group_id": "g", "ingestion_flows": [{
        "flow_id": n, "source": {"table": "log"}, "target": n, "load": "SCD1", "keys": ["id"], "sequence": ["seq"], "deletes": {"column": "op", "values": ["D"]}, "exclude": ["op", "tab"],
        "rules": [{"id": "mine", "expression": f"tab = '{n}'", "action": "drop"}]} for n in ("customer", "supplier")]})
    part = lambda n: engine.store.read(n).select(F.lit(n).alias("t"), "id", "name")
    return part("customer").union(part("supplier"))


@query("table_properties", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(t: Tables) -> DataFrame:
    engine = _engine(t)
    engine.run({"group_id": "g", "ingestion_flows": [{"flow_id": "o", "source": {"table": "orders"}, "target": "o", "properties": {"partition_by": ["o_orderstatus"], "cluster_by": ["o_orderkey"]}}]})
    return engine.store.read("o").select("o_orderkey", "o_orderstatus")


# --- sources and sinks -----------------------------------------------------------------------------------


@query("source_files_evolving", "SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 2 = 1 THEN n_regionkey END AS n_regionkey FROM nation")
def _(t: Tables) -> DataFrame:
    """JSON files whose later ones have one more column, read with a stored schema."""
    folder = shared_folder(t.spark)
    read = {"type": "files", "path": f"{folder}/in", "format": "json", "schema_location": f"{folder}/schema"}
    t.nation.filter("n_nationkey % 2 = 0").select("n_nationkey", "n_name").write.json(f"{folder}/in", mode="append")
    registry.read_source(t.spark, read)
    t.nation.filter("n_nationkey % 2 = 1").select("n_nationkey", "n_name", "n_regionkey").write.json(f"{folder}/in", mode="append")
    return registry.read_source(t.spark, read).select("n_nationkey", "n_name", "n_regionkey")


@query("source_table_stream", "SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0")
def _(t: Tables) -> DataFrame:
    folder = shared_folder(t.spark)
    store = Store(t.spark, folder)
    for k in range(3):
        store.write("c", t.customer.filter(f"c_custkey % 3 = {k}").select("c_custkey"), "APPEND")
    source = registry.read_source(t.spark, {"table": "c", "stream": True, "options": {"startingVersion": 2}}, store)
    return streams.run_once(source, f"{folder}/out")


@query("source_binary_records", "SELECT CAST(0 AS BIGINT) AS records, CAST(count(*) AS BIGINT) AS files FROM region")
def _(t: Tables) -> DataFrame:
    """Files that hold no record of the schema come out as rows with an error and their lineage."""
    folder = shared_folder(t.spark)
    t.region.select(F.col("r_name").alias("value")).repartition(t.region.count(), "r_name").coalesce(1).write.option("maxRecordsPerFile", 1).text(f"{folder}/in")
    schema = "A DEFINITIONS AUTOMATIC TAGS ::= BEGIN R ::= SEQUENCE { n INTEGER } END"
    rows = registry.read_source(t.spark, {"type": "binary_records", "path": f"{folder}/in", "schema": schema, "glob": "*.txt"})
    return rows.agg(F.count("n").alias("records"), F.count_distinct("_metadata.file_name").alias("files"))


@query("archive_join", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t: Tables) -> DataFrame:
    """Two archives of one CSV file each, checked, joined, and the join packed and read again."""
    folder = shared_folder(t.spark)
    for name, df in (("n", t.nation.select("n_name", "n_regionkey")), ("r", t.region)):
        landing.export_csv_zip(df, f"{folder}/in/{name}.zip", f"{name}.csv")
    joined = landing.join_batch(t.spark, {"n": f"{folder}/in/n.zip", "r": f"{folder}/in/r.zip"}, "SELECT n_name, r_name FROM n JOIN r ON n_regionkey = r_regionkey", f"{folder}/work")
    landing.export_csv_zip(joined, f"{folder}/out/j.zip", "j.csv")
    landing.extract_archives(f"{folder}/out", "*.zip", f"{folder}/back", t.spark)
    return t.spark.read.option("header", "true").csv(f"{folder}/back")


@query("sink_json", "SELECT event_id, event_type FROM events WHERE event_type <> 'error'")
def _(t: Tables) -> DataFrame:
    folder = shared_folder(t.spark)
    stream = streams.read_events(t.spark, f"{t.sf_dir}/events.parquet").select("event_id", "event_type", F.lit("x").alias("_eng_extra"))
    engine = Engine(t.spark, Store(t.spark, folder), read=lambda read: stream)
    engine.run({"group_id": "g", "ingestion_flows": [{"flow_id": "s", "source": {"table": "events", "stream": True}, "sink": {"type": "json", "path": f"{folder}/out"}, "rules": [{"id": "ok", "expression": "event_type <> 'error'", "action": "quarantine"}]}]})
    return t.spark.read.json(f"{folder}/out")


@query("sink_table_and_export", "SELECT n_nationkey, n_name FROM nation")
def _(t: Tables) -> DataFrame:
    folder = shared_folder(t.spark)
    engine = Engine(t.spark, Store(t.spark, folder), read=lambda read: getattr(t, read["table"]))
    engine.run({"group_id": "g", "ingestion_flows": [{"flow_id": "n", "source": {"table": "nation"}, "target": "n", "export": {"type": "archive_export", "format": "csv", "path": f"{folder}/out"}}]})
    return t.spark.read.option("header", "true").option("inferSchema", "true").csv(f"{folder}/out/*.gz").select("n_nationkey", "n_name")


@query("sink_export_once", "SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY l_returnflag")
def _(t: Tables) -> DataFrame:
    folder = shared_folder(t.spark)
    sinks.export_once(t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n")), {"type": "archive_export", "path": f"{folder}/out"}, f"{folder}/state")
    return t.spark.read.json(f"{folder}/out/*.gz")


# --- reconciliation flows --------------------------------------------------------------------------------


def _recon(t: Tables) -> Engine:
    engine = _engine(t)
    for name, text in (("src", SOURCE), ("tgt", TARGET)):
        engine.store.write(name, t.spark.sql(text, orders=t.orders))
    flow = {
        "flow_id": "r", "source": "src", "keys": ["o_orderkey"], "compare": ["o_custkey", "o_orderstatus"],
        "targets": [{"name": "t", "dataset": "tgt", "capture_mismatches": True, "heal": {"table": "tgt", "sql": "SELECT *, true AS healed FROM unmatched"}, "rules": [{"id": "few", "expression": "missing_in_source < 0", "action": "warn"}]}],
    }
    for _ in range(2):
        engine.run({"group_id": "g", "reconciliation_flows": [flow]})
    return engine


@query("recon_flow_heals_once", f"SELECT o.o_orderkey, o_custkey, o_orderstatus FROM orders o JOIN ({CLASSES}) c ON o.o_orderkey = c.o_orderkey WHERE class IN ('VALUE_DRIFT', 'MISSING_IN_TARGET')")
def _(t: Tables) -> DataFrame:
    return _recon(t).store.read("tgt").filter("healed").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("recon_flow_runs", f"""WITH c AS ({CLASSES}) SELECT 'SUCCESS' AS status, CAST(count(*) FILTER (class = 'MATCHED') AS BIGINT) AS matched, CAST(count(*) FILTER (class IN ('VALUE_DRIFT', 'MISSING_IN_TARGET')) AS BIGINT) AS appended FROM c
UNION ALL SELECT 'SUCCESS', CAST(count(*) FILTER (class <> 'MISSING_IN_SOURCE') AS BIGINT), 0 FROM c""")
def _(t: Tables) -> DataFrame:
    return _recon(t).store.read(recon_flow.RUNS).select("status", "matched", "appended")


@query("recon_flow_mismatches", f"SELECT class, CAST(sum(n) AS BIGINT) AS n FROM (SELECT class, count(*) AS n FROM ({CLASSES}) WHERE class <> 'MATCHED' GROUP BY class UNION ALL SELECT 'MISSING_IN_SOURCE', count(*) FROM ({CLASSES}) WHERE class = 'MISSING_IN_SOURCE') GROUP BY class")
def _(t: Tables) -> DataFrame:
    return _recon(t).store.read(recon_flow.MISMATCHES).groupBy("class").agg(F.count("*").alias("n"))


@query("recon_overlay", "SELECT CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 50000.5")
def _(t: Tables) -> DataFrame:
    made = recon_flow.overlaid(t.orders, {"run_id": {"column": "o_orderstatus", "value": "O"}, "filter": "o_totalprice > ${least}", "standardize": ["lower(o_orderpriority) AS p"]}, {"least": 50000.5})
    return made.agg(F.count("p").alias("n"))


# --- joins, functions and windows ------------------------------------------------------------------------


@query("match_candidates", r"""WITH a AS (SELECT c_custkey, substr(c_name, -3) AS area, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS n FROM customer),
b AS (SELECT s_suppkey, substr(s_name, -3) AS area, regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS n FROM supplier),
s AS (SELECT c_custkey, s_suppkey, levenshtein(a.n, b.n) AS d, greatest(length(a.n), length(b.n)) AS l FROM a JOIN b USING (area))
SELECT c_custkey, s_suppkey, CAST(round(100 * (l - d) / l) AS INT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY d, s_suppkey) AS rn FROM s) WHERE rn = 1""")
def _(t: Tables) -> DataFrame:
    """Candidates share a normalised area; the most similar one counts."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    a = t.customer.select("c_custkey", F.right("c_name", F.lit(3)).alias("area"), plain("c_name").alias("a"))
    b = t.supplier.select("s_suppkey", F.right("s_name", F.lit(3)).alias("area"), plain("s_name").alias("b"))
    scored = a.join(b, "area").withColumn("d", F.levenshtein("a", "b")).withColumn("l", F.greatest(F.length("a"), F.length("b")))
    best = scored.groupBy("c_custkey").agg(F.min(F.struct("d", "s_suppkey", "l")).alias("x"))
    return best.select("c_custkey", "x.s_suppkey", F.round(100 * (F.col("x.l") - F.col("x.d")) / F.col("x.l")).cast("int").alias("score"))


@query("join_privacy", "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND CAST(l_linenumber AS BIGINT) = 1 + o_custkey % 4 WHERE o_totalprice > 100000")
def _(t: Tables) -> DataFrame:
    left = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("bigint").alias("n"))
    right = t.orders.select(F.col("o_orderkey").alias("k"), (1 + F.col("o_custkey") % 4).cast("bigint").alias("n"), "o_custkey", (F.col("o_totalprice") > 100000).alias("consent"))
    return governance.privacy_join(left, right, ("k", "n"), "consent").select(F.col("k").alias("l_orderkey"), F.col("n").cast("int").alias("l_linenumber"), "o_custkey")


sql("join_nested", "SELECT a.session.id AS user_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT named_struct('id', user_id, 'kind', event_type) AS session FROM {events}) a JOIN (SELECT named_struct('id', c_custkey) AS person FROM {customer}) b ON a.session.id = b.person.id WHERE a.session.kind <> 'error' GROUP BY a.session.id",
    "SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events JOIN customer ON user_id = c_custkey WHERE event_type <> 'error' GROUP BY user_id")
sql("agg_any_value", "SELECT o_custkey, any_value(o_custkey % 3) AS side, CAST(floor(avg(CASE WHEN o_orderstatus <> 'F' THEN CAST(o_orderkey AS DOUBLE) END)) AS BIGINT) AS open_mean, CAST(count(DISTINCT o_orderstatus) AS BIGINT) AS states FROM {orders} GROUP BY ALL")
sql("set_union_padded", "SELECT n_nationkey AS id, n_name AS name, CAST(NULL AS INT) AS size FROM {nation} UNION ALL SELECT p_partkey, CAST(NULL AS STRING), p_size FROM {part}")
sql("fn_dates", "SELECT o_orderkey, CAST(months_between(o_orderdate, DATE'1992-01-01', false) >= 36 AS BOOLEAN) AS late, timestampdiff(DAY, TIMESTAMP_NTZ'1992-01-01 00:00:00', o_orderdate) AS days, CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS month, unix_timestamp(CAST(o_orderdate AS TIMESTAMP)) AS epoch, CAST(timestamp_millis(unix_timestamp(CAST(o_orderdate AS TIMESTAMP)) * 1000) AS TIMESTAMP_NTZ) = CAST(o_orderdate AS TIMESTAMP_NTZ) AS same FROM {orders}",
    "SELECT o_orderkey, o_orderdate >= DATE '1995-01-01' AS late, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(epoch(o_orderdate) AS BIGINT) AS epoch, true AS same FROM orders")
sql("fn_maps", "SELECT n_nationkey, m['name'] AS name, size(map_keys(m)) AS n, element_at(map_filter(m, (k, v) -> k = 'region'), 'region') AS region, s.a AS a FROM (SELECT n_nationkey, map('name', n_name, 'region', CAST(n_regionkey AS STRING)) AS m, named_struct('a', n_nationkey, 'b', n_name) AS s FROM {nation})",
    "SELECT n_nationkey, n_name AS name, CAST(2 AS INT) AS n, CAST(n_regionkey AS VARCHAR) AS region, n_nationkey AS a FROM nation")


@query("mask_and_filter", "SELECT c_custkey, '#' || right(c_name, 4) AS c_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
def _(t: Tables) -> DataFrame:
    entitlements = t.nation.select(F.concat(F.lit("user"), "n_regionkey").alias("user"), F.col("n_nationkey").alias("c_nationkey"))
    return governance.mask(governance.allowed_rows(t.customer, entitlements, ["c_nationkey"], "user2"), ["c_name"]).select("c_custkey", "c_name")


@query("soft_delete_by_key_list", "SELECT c_custkey, c_custkey % 11 = 0 AS is_deleted FROM customer")
def _(t: Tables) -> DataFrame:
    store = Store(t.spark, shared_folder(t.spark))
    store.merge("c", t.customer, ["c_custkey"], lambda old, new: new.withColumn("is_deleted", F.lit(False)), "SCD1")
    keys = t.customer.select("c_custkey", (F.col("c_custkey") % 11 == 0).alias("gone"))
    keys.write.option("header", "true").csv(f"{store.path}/keys.csv")
    dispatch.soft_delete(store, "c", f"{store.path}/keys.csv", ["c_custkey"], "gone")
    return store.read("c").select("c_custkey", "is_deleted")


@query("governance_tags", "SELECT 'customer' AS table_name, 'c_name' AS column_name, 'pii' AS tag, 'yes' AS value UNION ALL SELECT 'customer', '', 'owner', 'b'")
def _(t: Tables) -> DataFrame:
    store = Store(t.spark, shared_folder(t.spark))
    governance.record_tags(store, "customer", {"owner": "a"}, {"c_name": {"pii": "yes"}})
    governance.record_tags(store, "customer", {"owner": "b"})
    return store.read(governance.TAGS)


@query("stream_sliding", "SELECT CAST(epoch(d) AS BIGINT) AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM events, unnest([date_trunc('day', ts) - INTERVAL 1 DAY, date_trunc('day', ts)]) u(d) GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    events = streams.read_events(t.spark, f"{t.sf_dir}/events.parquet")
    counted = streams.windowed(events, "2 days", ["event_type"], [F.count("*").alias("n")], slide="1 day", delay="400 days")
    return streams.run_once(counted.select(F.unix_timestamp("window.start").alias("start"), "event_type", "n"), shared_folder(t.spark), "complete")


@query("stream_sessions", """WITH o AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 60 MINUTES OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k""")
def _(t: Tables) -> DataFrame:
    """Of what is there; the same call on a stream is tested with late rows."""
    batch = t.events.withColumn("ts", F.col("ts").cast("timestamp")).filter("user_id IS NOT NULL")
    counted = streams.windowed(batch, "", ["user_id"], [F.count("*").alias("n")], gap="60 minutes")
    return counted.select("user_id", F.unix_timestamp("window.start").alias("start"), "n")
