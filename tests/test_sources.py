import csv
import gzip
import json
import os
import zipfile

import pytest
from pyspark.sql.types import StructType

from sluice.errors import EngineError, LoadError, PlanError, ShapeError, SpecError
from sluice.operators import loads
from sluice.plans import flow
from sluice.sources import files
from sluice.sources.archive_sink import ArchiveSource, file_name
from sluice.sources.store import Properties, Store
from sluice.streaming import flows

DDL = StructType.fromDDL


def test_evolution_modes(spark):
    old, new = DDL("a int"), DDL("a int, b string")
    assert files.evolve(None, new, "none") == new and files.evolve(old, new, "none") == old and files.evolve(old, new, "addNewColumns") == new
    for bad in ("failOnNewColumns", "nope"):
        with pytest.raises(ShapeError):
            files.evolve(old, new, bad)


def test_rescue(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"id": "1", "reading": "2.5"}\n{"id": "2", "reading": "bad", "extra": "z"}\n')
    rows = {r.id: r for r in files.read_rescuing(spark, str(tmp_path), DDL("id string, reading double")).collect()}
    assert rows["1"].reading == 2.5 and rows["1"]._rescued_data is None
    assert rows["2"].reading is None and json.loads(rows["2"]._rescued_data) == {"reading": "bad", "extra": "z"}


def test_archives(tmp_path):
    land, out = str(tmp_path / "land"), str(tmp_path / "out")
    os.makedirs(land)
    with zipfile.ZipFile(f"{land}/a.zip", "w") as z:
        z.writestr("a.csv", "x\n1\n")
    with gzip.open(f"{land}/b.csv.gz", "wb") as g:
        g.write(b"y\n2\n")
    assert [os.path.basename(p) for p in files.extract_archives(land, "*.zip", out)] == ["a.csv"]
    assert files.extract_archives(land, "*.zip", out) == []
    assert [os.path.basename(p) for p in files.extract_archives(land, "*.gz", out)] == ["b.csv"]
    with open(f"{land}/c.zip", "wb") as f:
        f.write(b"PK broken")
    with pytest.raises(EngineError):
        files.extract_archives(land, "c.*", out)
    os.utime(f"{land}/a.zip", (0, 0))
    assert [os.path.basename(p) for p in files.sweep(land, "a.zip")] == ["a.zip"] and not os.path.exists(files.marker(f"{land}/a.zip"))


def test_store_versions_and_conflicts(spark, tmp_path):
    store, df = Store(spark, f"file://{tmp_path}"), spark.createDataFrame([(1, "a")], ["k", "v"])
    assert store.read("t") is None
    assert [store.write("t", df), store.write("t", df, "APPEND", batch=("q", 7)), store.write("t", df, "APPEND", batch=("q", 7))] == [1, 2, 2]
    assert store.read("t").count() == 2 and store.read("t", 1).count() == 1
    other = Store(spark, f"file://{tmp_path}")
    other.manifest = lambda table, version=None: None
    with pytest.raises(LoadError):
        other.write("t", df)
    assert store.write("t", df, "APPEND", batch=("other", 0)) == 3 and store.read("t").count() == 3  # another query's batch 0


def test_store_keeps_batches_of_every_checkpoint(spark, tmp_path):
    """Batch numbers start at 0 again with each checkpoint; no batch is taken for another query's."""
    store = Store(spark, f"file://{tmp_path}/store")
    for i, n in enumerate((3, 10)):
        spark.range(n).write.parquet(f"{tmp_path}/in{i}")
        stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in{i}")
        for _ in range(2):  # the second run finds nothing new
            flows.each_batch(stream, lambda df, number: store.write("t", df, "APPEND", number), f"file://{tmp_path}/state{i}")
    assert store.read("t").count() == 13


def test_store_merges_touched_buckets(spark, tmp_path):
    store, cdc = Store(spark, f"file://{tmp_path}"), loads.Cdc(["k"], ["s"])
    frame = lambda rows: spark.createDataFrame(rows, "k int, s int, v string")
    merge = lambda rows: store.merge("t", frame(rows), ["k"], lambda old, new: loads.scd1_state(old, new, cdc), "SCD1", buckets=8)
    merge([(k, 1, "a") for k in range(50)])
    before = set(store.manifest("t")["data"])
    merge([(7, 2, "b"), (100, 1, "c")])
    assert 1 <= len(set(store.manifest("t")["data"]) - before) <= 2 and len(before & set(store.manifest("t")["data"])) >= 6
    got = {r.k: r.v for r in loads.scd1(store.read("t")).collect()}
    assert got == {**{k: "a" for k in range(50)}, 7: "b", 100: "c"}
    merge([])
    assert {r.k for r in loads.scd1(store.read("t")).collect()} == set(got) and store.read("none") is None


def test_store_properties(spark, tmp_path):
    store, df = Store(spark, f"file://{tmp_path}"), spark.sql("SELECT id, id % 2 AS side, current_timestamp() - make_dt_interval(id) AS at FROM range(10)")
    store.write("t", df, properties=Properties.of({"partition_by": ["side"], "cluster_by": ["id"], "ttl": {"column": "at", "days": 4}}))
    assert sorted(r.id for r in store.read("t").collect()) in ([0, 1, 2, 3], [0, 1, 2, 3, 4])
    for bad in ({"cluster_by": list("abcd")}, {"nope": 1}):
        with pytest.raises(LoadError):
            Properties.of(bad)
    with pytest.raises(LoadError):
        store.write("t", df, properties=Properties.of({"partition_by": ["gone"]}))


def test_archive_sink(spark, tmp_path):
    spark.dataSource.register(ArchiveSource)
    spark.range(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    stream.writeStream.format("archive_export").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    (made,) = [f for f in os.listdir(tmp_path / "out") if f.endswith(".gz")]
    with gzip.open(tmp_path / "out" / made, "rt") as f:
        assert sorted(json.loads(x)["id"] for x in f) == [0, 1, 2, 3, 4]
    assert os.listdir(tmp_path / "out" / "_staging") == []
    with pytest.raises(EngineError):
        file_name("{other}", 1)


@pytest.mark.parametrize("compression", ["gzip", "zip"])
def test_archive_sink_of_csv(spark, tmp_path, compression):
    """One header, however many tasks had rows; a batch without rows writes nothing."""
    spark.dataSource.register(ArchiveSource)
    spark.createDataFrame([(i, f'a "{i}", b') for i in range(6)], "id int, text string").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, text string").option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))
    for keep in ("id >= 0", "id < 0"):
        out = tmp_path / f"out{keep[3] == '<'}"
        writer = stream.filter(keep).writeStream.format("archive_export").options(format="csv", compression=compression, path=str(out))
        writer.option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    (made,) = [f for f in os.listdir(tmp_path / "outFalse") if f != "_staging"]
    if compression == "gzip":
        texts = [gzip.open(tmp_path / "outFalse" / made, "rt").read()]
    else:
        with zipfile.ZipFile(tmp_path / "outFalse" / made) as z:
            texts = [z.read(n).decode() for n in z.namelist()]
    rows = [list(csv.reader(text.splitlines())) for text in texts]
    assert all(r[0] == ["id", "text"] for r in rows) and sorted(x for r in rows for x in r[1:]) == [[str(i), f'a "{i}", b'] for i in range(6)]
    assert not os.path.exists(tmp_path / "outTrue") or set(os.listdir(tmp_path / "outTrue")) <= {"_staging"}


def test_spec_errors():
    bad = {"group_id": "g", "x": 1, "ingestion_flows": [{"flow_id": "a", "source": {"table": "t"}, "target": "b", "primary_keys": ["k"], "load": "SCD2"}, {"flow_id": "a", "target": "c", "load": "NOPE", "rules": [{"action": "?"}]}]}
    text = "; ".join(flow.validate(bad))
    for part in ("unknown key x", "did you mean keys?", "SCD2 needs keys", "source is missing", "NOPE", "rules[0].action", "a stands twice"):
        assert part in text
    with pytest.raises(SpecError):
        flow.run(None, bad, None)
    assert flow.load_spec("group_id: '{{env}}_g'", "yaml", env="dev") == {"group_id": "dev_g"}


def test_plan_shares_reads_and_finds_cycles():
    t = lambda i, inputs, target, **k: {"flow_id": i, "inputs": inputs, "sql": "select 1", "target": target, **k}
    plan = flow.plan({"transformation_flows": [t("b", {"x": "ta", "o": {"table": "orders"}}, "tb"), t("a", {"o": {"table": "orders"}}, "ta")]})
    assert plan.order == ["a", "b"] and len(plan.reads) == 1
    with pytest.raises(PlanError, match="->"):
        flow.plan({"transformation_flows": [t("a", {"x": "tb"}, "ta"), t("b", {"x": "ta"}, "tb")]})
    with pytest.raises(PlanError, match="rewrites"):
        flow.plan({"transformation_flows": [t("a", {"x": {"table": "o"}}, "ta", load="SCD1"), t("b", {"x": {"table": "ta", "stream": True}}, "tb")]})
