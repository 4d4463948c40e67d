"""Groups that load, export and reconcile, read back from the store."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sluice.errors import EngineError, LoadError, PlanError, QualityError, SpecError
from sluice.observability import events, views
from sluice.operators import loads
from sluice.plans import dispatch, flow, onboarding, recon_flow, validation
from sluice.plans.engine import CHANGES, Engine
from sluice.sources import registry
from sluice.sources.store import Properties, Store
from sluice.streaming import sinks


@pytest.fixture
def engine(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.write("orders", spark.createDataFrame([(1, "a", 5), (2, "b", -1), (3, "a", None)], "id int, kind string, v int"))
    return Engine(spark, store)


def group(**flows):
    return {"group_id": "g", **flows}


def table_flow(**more):
    return {"flow_id": "f", "inputs": {"o": {"table": "orders"}}, "target": "t", "sql": "SELECT * FROM o", **more}


def test_unknown_names_are_told_with_what_was_meant():
    spec = group(ingestion_flows=[{"flow_id": "a", "source": "x", "target": "t", "standardise": [], "capture_linage": True}], transformation_flows=[table_flow(load="SCD2", sequence="ts", deletes=3)])
    text = "; ".join(validation.validate(spec))
    for part in ("did you mean standardize?", "did you mean capture_lineage?", "SCD2 needs keys", "sequence: must be a list", "deletes: a predicate"):
        assert part in text, part


@pytest.mark.parametrize("more,part", [
    ({"load": "SCD3", "keys": ["id"]}, "check_columns"), ({"sql": "SELECT ${x} FROM o"}, "${x} is not defined"), ({"exclude": ["v"]}, "APPEND has no use"),
    ({"rules": [{"id": "a", "expression": "true", "action": "warn"}] * 2}, "id a stands twice"), ({"encrypt": [{"column": "v", "mode": "XTS"}]}, "encrypt[0]: key is missing"),
    ({"sink": {"type": "kafka"}}, "bootstrap_servers is missing"), ({"properties": {"cluster_by": list("abcd")}}, "at most 3"), ({"export": {"type": "path", "path": "x", "format": "json"}, "load": "TRUNCATE_AND_LOAD"}, "can't be streamed out"),
    ({"inputs": {"o": {"table": "x", "watermark": {"column": "ts", "delay": "soon"}}}}, "no interval"), ({"inputs": {"o": {"type": "files", "path": "p"}}}, "format is missing"), ({"target": "a b"}, "no table name"),
    ({"load": "SCD1", "keys": ["id", "id"]}, "stands twice"), ({"empty_target_if_source_empty": True}, "only TRUNCATE_AND_LOAD"),
])
def test_spec_rules(more, part):
    assert part in "; ".join(validation.validate(group(transformation_flows=[table_flow(**more)])))


def recon(**more):
    return {"flow_id": "r", "source": "s", "keys": ["id"], "targets": [{"name": "x", "dataset": "t", "heal": {"table": "t"}}], **more}


@pytest.mark.parametrize("flows,part", [
    ({"reconciliation_flows": [recon(source="t")]}, "heals its own source"),
    ({"reconciliation_flows": [recon(source="s2")], "transformation_flows": [table_flow(inputs={"o": "t"}, target="s2")]}, "which feeds its source"),
    ({"reconciliation_flows": [recon(targets=[{"name": "x", "dataset": "t", "heal": {"table": "u"}}])]}, "which that does not feed"),
    ({"reconciliation_flows": [recon(), recon(flow_id="r2", source="s9")]}, "healed by several"),
    ({"reconciliation_flows": [recon(), recon(flow_id="r2", source="t", targets=[{"name": "x", "dataset": "s", "heal": {"table": "s"}}])]}, "heal s from t and t from s"),
    ({"transformation_flows": [table_flow(), table_flow(flow_id="h")]}, "made by several flows"),
    ({"reconciliation_flows": [recon()], "transformation_flows": [table_flow(load="TRUNCATE_AND_LOAD")]}, "which the next run replaces"),
    ({"reconciliation_flows": [recon(mode="pipeline_audit_only")]}, "an audit heals nothing"),
    ({"reconciliation_flows": [recon(source={"table": "s", "stream": True}, targets=[{"name": "x", "dataset": {"table": "t", "stream": True}}])]}, "at most one dataset"),
])
def test_rules_between_flows(flows, part):
    assert part in "; ".join(validation.validate(group(**flows)))


def test_good_specs_have_no_errors():
    assert validation.validate(group(transformation_flows=[table_flow(load="SCD2", keys=["id"], sequence=["v"], deletes={"column": "kind", "values": ["D"]})], reconciliation_flows=[recon(source="orders", targets=[{"name": "x", "dataset": "t", "heal": {"table": "t"}}])])) == []


def test_sql_check(spark):
    assert "PARSE" in validation.check_sql(spark, "SELEC 1")[0].upper() and validation.check_sql(spark, "SELECT 1") == (None, None)
    error, warning = validation.check_sql(spark, "SELECT * FROM not_there_yet")
    assert error is None and "not_there_yet" in warning


def test_placeholders_without_a_value_are_errors():
    with pytest.raises(SpecError, match="env"):
        flow.load_spec('{"group_id": "{{env}}"}')


def test_fail_rule_writes_nothing(engine):
    with pytest.raises(QualityError):
        engine.run(group(transformation_flows=[table_flow(rules=[{"id": "pos", "expression": "v > 0", "action": "fail"}])]))
    assert engine.store.read("t") is None
    log = engine.store.read(events.TABLE)
    assert [r.state for r in events.flow_metrics(log).collect()] == ["FAILED"] and log.filter("level = 'ERROR'").count() == 2


def test_quarantine_table_only_with_a_quarantine_rule(engine):
    out = engine.run(group(transformation_flows=[table_flow(rules=[{"id": "pos", "expression": "v > 0", "action": "warn"}])]))["f"]
    assert (out.written, out.warned, out.version) == (3, {"pos": 2}, 1) and engine.store.read("t_quarantine") is None
    out = engine.run(group(transformation_flows=[table_flow(rules=[{"id": "pos", "expression": "v > 0", "action": "quarantine"}])]))["f"]
    assert (out.written, out.quarantined) == (2, 1) and [r.id for r in engine.store.read("t_quarantine").collect()] == [2]
    assert engine.store.read("t").count() == 5


def test_default_sequence_and_inactive_flows(engine, spark):
    spec = group(transformation_flows=[table_flow(load="SCD1", keys=["id"], sql="SELECT id, v FROM o"), table_flow(flow_id="off", target="u", is_active=False)])
    assert engine.run(spec)["off"].status == "SKIPPED" and engine.store.read("u") is None
    engine.store.write("orders", spark.createDataFrame([(2, "b", 9), (4, "c", 1)], "id int, kind string, v int"))
    engine.run(spec)
    assert {r.id: r.v for r in engine.store.read("t").collect()} == {1: 5, 2: 9, 3: None, 4: 1}
    assert [(r.version, r.inserted, r.updated) for r in engine.store.read(CHANGES).collect()] == [(2, 1, 1)]


def test_unknown_load_and_foreign_keys(engine):
    with pytest.raises(LoadError):
        dispatch.load(engine.store, {"target": "t", "load": "NOPE"}, engine.store.read("orders"))
    engine.store.merge("m", engine.store.read("orders"), ["id"], lambda old, new: new, "X")
    with pytest.raises(LoadError, match="can't be merged"):
        engine.store.merge("m", engine.store.read("orders"), ["kind"], lambda old, new: new, "X")
    engine.store.write("m", engine.store.read("orders").withColumn("id", F.col("id") + 10), "APPEND")  # keeps to the buckets
    engine.store.merge("m", engine.store.read("orders").filter("id = 1"), ["id"], lambda old, new: old.filter("id <> 1"), "X")
    assert sorted(r.id for r in engine.store.read("m").collect()) == [2, 3, 11, 12, 13]


def test_replayed_batch_is_loaded_once(engine, spark):
    rows = spark.createDataFrame([(1, 1, "a")], "k int, s int, v string")
    spec = {"target": "h", "load": "SCD2", "keys": ["k"], "sequence": ["s"]}
    assert dispatch.load(engine.store, spec, rows, ("q", 0)) == dispatch.load(engine.store, spec, rows, ("q", 0)) == 1
    dispatch.load(engine.store, spec, rows.select("k", F.lit(2).alias("s"), F.lit("b").alias("v")), ("q", 1))
    assert sorted((r.v, r[loads.START], r[loads.END]) for r in engine.store.read("h").collect()) == [("a", 1, 2), ("b", 2, None)]


def test_stream_over_a_sibling_that_is_rewritten(spark, engine):
    engine.run(group(transformation_flows=[table_flow(load="SCD1", keys=["id"])]))
    with pytest.raises(PlanError, match="rewrites"):
        engine.run(group(transformation_flows=[table_flow(load="SCD1", keys=["id"]), table_flow(flow_id="s", target="u", inputs={"o": {"table": "t", "stream": True}})]))
    store = engine.store
    store.write("appended", spark.range(3), "APPEND")
    store.write("appended", spark.range(2), "REPLACE")
    stream = registry.read_source(spark, {"table": "appended", "stream": True}, store)
    with pytest.raises(Exception, match="rewrites what was streamed"):
        sinks.write_stream(stream, {"type": "table", "table": "out"}, f"{store.path}/state", store)


def test_table_stream_resumes(spark, engine):
    store = engine.store
    for n in (3, 4):
        store.write("a", spark.range(n).withColumn("t", F.current_timestamp()), "APPEND")
        stream = registry.read_source(spark, {"table": "a", "stream": True}, store)
        sinks.write_stream(stream.withColumn("_eng_x", F.lit(1)), {"type": "table", "table": "out"}, f"{store.path}/state", store)
    assert store.read("out").count() == 7 and store.read("out").columns == ["id", "t"]


def test_table_stream_of_partitions(spark, engine):
    store, rows = engine.store, spark.sql("SELECT id, if(id = 3, NULL, concat('p/', id % 2)) AS side, CAST(id AS INT) AS n FROM range(6)")
    store.write("a", rows, "APPEND", properties=Properties.of({"partition_by": ["side", "n"]}))
    stream = registry.read_source(spark, {"table": "a", "stream": True}, store)
    sinks.write_stream(stream, {"type": "table", "table": "out"}, f"{store.path}/state", store)
    assert store.read("out").exceptAll(rows).isEmpty() and store.read("out").count() == 6


def test_sink_options():
    made = sinks.options({"type": "kafka", "bootstrap_servers": "b:1", "topic": "t", "username": "u", "password": "secret:p", "options": {"x": 1}}, secrets={"p": 'a"b'})
    assert made[0] == "kafka" and made[1]["topic"] == "t" and made[1]["x"] == "1" and 'password="a\\"b"' in made[1]["kafka.sasl.jaas.config"]
    for bad in ({"type": "kafka", "bootstrap_servers": "b", "topic": "t", "password": "secret:none", "username": "u"}, {"type": "nope"}):
        with pytest.raises(SpecError):
            sinks.options(bad)
    assert sinks.options({"type": "path", "path": "/x/${d}"}, {"d": "y"}) == ("json", {"path": "/x/y"})


def test_sink_payload(spark):
    df = spark.createDataFrame([(1, "a", 2)], "k int, v string, _eng_hash_key int")
    assert sinks.payload(df, {"type": "json"}).columns == ["k", "v"]
    row = sinks.payload(df, {"type": "kafka", "key": ["k"]}).first()
    assert row.key == "1" and json.loads(row.value) == {"k": 1, "v": "a"}
    with pytest.raises(PlanError):
        sinks.write_stream(df, {"type": "json", "path": "x"}, "y")


@pytest.fixture
def sides(spark, engine):
    frame = lambda rows: spark.createDataFrame(rows, "id int, v string")
    engine.store.write("s", frame([(1, "a"), (2, "b"), (3, "c"), (3, "c")]))
    engine.store.write("t", frame([(1, "a"), (2, "x"), (9, "z")]))
    return engine


def test_reconciliation_heals_once_and_survives_a_crash(sides, monkeypatch):
    """The rows and their ledger entry are one commit: a run that dies after it heals nothing again."""
    spec = group(reconciliation_flows=[recon(compare=["v"], targets=[{"name": "x", "dataset": "t", "capture_mismatches": True, "capture_matches": True, "heal": {"table": "t"}}])])
    monkeypatch.setattr(recon_flow, "record", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        sides.run(spec)
    monkeypatch.undo()
    assert sides.store.read("t").count() == 6
    first = sides.run(spec)["r"]
    # Keys 2 and 3 match now; key 2 keeps its other value beside.
    assert [(o.status, o.matched, o.missing_in_target, o.missing_in_source, o.appended) for o in first] == [("SUCCESS", 3, 0, 1, 0)]
    log = sides.store.read(recon_flow.MISMATCHES)
    assert log.filter("class = 'VALUE_DRIFT'").count() == 1 and json.loads(log.filter("class = 'VALUE_DRIFT'").first().drift_json) == [{"column": "v", "source": "b", "target": "x"}]
    sides.store.write("t", sides.spark.createDataFrame([(1, "a"), (2, "x"), (9, "z")], "id int, v string"))  # someone restores the old state
    assert sides.run(spec)["r"][0].status == "SKIPPED_ALREADY_PROCESSED" and sides.store.read("t").count() == 3


def test_reconciliation_rules_direction_and_failure(sides):
    target = {"name": "x", "dataset": "t", "heal": {"table": "t"}}
    run = lambda **more: sides.run(group(reconciliation_flows=[recon(compare=["v"], **more)]))
    held = run(targets=[target | {"rules": [{"id": "few", "expression": "missing_in_target < 2", "action": "drop"}]}])["r"][0]
    assert (held.status, held.appended, held.missing_in_target) == ("SUCCESS", 0, 2)
    assert run(direction="audit", targets=[target])["r"][0].appended == 0
    with pytest.raises(EngineError, match="few"):
        run(targets=[target | {"rules": [{"id": "few", "expression": "missing_in_target < 2", "action": "fail"}]}])
    out = run(on_failure="warn", targets=[{"name": "gone", "dataset": "nowhere"}, target])["r"]
    assert [o.status for o in out] == ["FAILED", "SUCCESS"] and out[1].appended == 3
    with pytest.raises(PlanError, match="reads tables"):
        registry.read_dataset(sides.spark, {"type": "files", "path": "x", "format": "csv"}, sides.store)


def test_reconciliation_by_precomputed_hashes_and_heal_query(sides):
    with pytest.raises(EngineError, match="precomputed hashes are missing"):
        sides.run(group(reconciliation_flows=[recon(targets=[{"name": "x", "dataset": "t", "hashed": True}])]))
    sides.run(group(reconciliation_flows=[recon(compare=["v"], targets=[{"name": "x", "dataset": "t", "heal": {"table": "t", "sql": "SELECT id, upper(v) AS v, 'r' AS origin FROM unmatched WHERE id = 2"}}])]))
    assert [tuple(r) for r in sides.store.read("t").filter("origin = 'r'").collect()] == [(2, "B", "r")]


def test_log_flags():
    assert recon_flow.log_flags({"capture_mismatches": True}, {"capture_mismatches": False, "capture_matches": True}) == {"capture_mismatches": False, "capture_matches": True}
    assert recon_flow.log_flags({}) == {"capture_mismatches": False, "capture_matches": False}


def test_backstop_export(sides):
    """Runs that only the event log has get a row once, under an id made from what they are."""
    sides.run(group(reconciliation_flows=[recon(compare=["v"])]))
    log, runs = sides.store.read(events.TABLE), sides.store.read(recon_flow.RUNS)
    assert recon_flow.backstop(log, runs).count() == 0
    lost = recon_flow.backstop(log, runs.limit(0))
    assert [(r.flow_id, r.target, r.matched) for r in lost.collect()] == [("r", "x", 1)]
    assert recon_flow.backstop(log, lost).count() == 0


def test_onboarding(spark, tmp_path, engine):
    store, folder = engine.store, tmp_path / "specs"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(group(transformation_flows=[table_flow(), table_flow(flow_id="h", target="u")], reconciliation_flows=[recon(source="orders", targets=[{"name": "x", "dataset": "t"}], mode="job")])))
    (folder / "b.yaml").write_text("group_id: '{{env}}_b'\ningestion_flows: [{flow_id: i, source: orders, target: b}]\n")
    (folder / "bad.json").write_text('{"group_id": "x", "nope": 1}')
    (folder / "broken.json").write_text("{")
    (folder / "sql.json").write_text(json.dumps({"group_id": "q", "transformation_flows": [table_flow(sql="SELEC 1")]}))
    (folder / "readme.txt").write_text("no spec")
    out = {o.name: o for o in onboarding.onboard_folder(spark, store, f"file://{folder}", {"env": "dev"}, "1.0.0")}
    assert {n: o.ok for n, o in out.items()} == {"a.json": True, "b.yaml": True, "bad.json": False, "broken.json": False, "sql.json": False}
    assert out["a.json"].flows == 3 and out["b.yaml"].group_id == "dev_b" and out["a.json"].warnings
    spec = onboarding.active_spec(store, "g")
    assert [f["flow_id"] for f in spec["transformation_flows"]] == ["f", "h"] and spec["reconciliation_flows"] == []
    made = {r.flow_id: r.created_at for r in store.read(onboarding.FLOWS).collect()}
    again = onboarding.onboard(spark, store, group(transformation_flows=[table_flow()]))
    assert again.disabled == 2 and [f["flow_id"] for f in onboarding.active_spec(store, "g")["transformation_flows"]] == ["f"]
    rows = {r.flow_id: r for r in store.read(onboarding.FLOWS).collect()}
    assert rows["f"].created_at == made["f"] and not rows["h"].is_active and rows["i"].is_active
    with pytest.raises(EngineError):
        onboarding.active_spec(store, "none")


def test_event_log_never_fails_its_caller(spark, tmp_path):
    log = events.EventLog(Store(spark, f"file://{tmp_path}/x"), "p", "g")
    log.add("e", "fine", value=object())
    log.store.write = lambda *a: 1 / 0
    with pytest.warns(UserWarning, match="not written"):
        log.flush()


def test_event_scan(spark):
    rows = spark.sql("SELECT concat('e', id) AS event_id, timestamp '2024-01-01' + make_dt_interval(id) AS ts, concat('u', id % 2) AS update_id FROM range(10)")
    assert events.scan(rows, "2024-01-03", "2024-01-06").count() == 3
    assert sorted(r.event_id for r in events.scan(rows, "2024-01-03", "2024-01-06", ["u0"]).collect()) == ["e2", "e4"]


def test_views_of_an_engine_run(engine, spark):
    """The views read what the engine and onboarding write."""
    spec = group(transformation_flows=[table_flow(rules=[{"id": "pos", "expression": "v > 0", "action": "warn"}])], reconciliation_flows=[recon(source="orders", targets=[{"name": "x", "dataset": "t"}])])
    assert onboarding.onboard(spark, engine.store, spec).ok
    engine.run(spec)
    read = engine.store.read
    inputs = {"events": read(events.TABLE), "groups": read(onboarding.GROUPS), "flows": read(onboarding.FLOWS), "recon_runs": read(recon_flow.RUNS), "now": spark.sql("SELECT current_timestamp() AS run_at")}
    made = views.create(spark, **inputs)
    assert {"v_group_catalog", "v_flow_metrics", "v_dq_results", "v_recon_health", "v_group_health", "v_flow_inventory", "v_lineage", "v_pipeline_updates"} <= set(made)
    assert spark.table("v_group_catalog").first().summary == "g: 1 tables, last completed" and spark.table("v_group_health").first().status == "HEALTHY"
    rule = spark.table("v_dq_results").first()
    assert (rule.rule, rule.failed, rule.checked, rule.pass_rate) == ("pos", 2, 3, 33.33)
    assert spark.table("v_recon_health").first().is_clean and spark.table("v_lineage").first().target == "t"
    with pytest.raises(ValueError, match="prices"):
        views.view(spark, "cost", pipeline_usage=inputs["events"], job_usage=inputs["events"])


def test_settings_are_applied_and_bad_ones_told(engine, spark):
    engine.run(group(spark_config={"spark.sql.shuffle.partitions": 3, "spark.sql.warehouse.dir": "/x"}, transformation_flows=[table_flow()]))
    assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert engine.store.read(events.TABLE).filter("event_type = 'settings' AND level = 'WARN'").count() == 1
    assert os.path.isdir(engine.store.path.removeprefix("file://"))
