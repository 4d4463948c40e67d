"""Landing folders, archives, schemas that evolve, encrypted members, export and telemetry sinks."""

import gzip
import hmac
import http.server
import io
import json
import os
import struct
import threading
import time
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sluice.errors import EngineError, LoadError, PlanError, ShapeError
from sluice.functions import aes, governance
from sluice.operators import shape
from sluice.plans import dispatch
from sluice.sources import files, landing, registry, telemetry
from sluice.sources.store import Store
from sluice.streaming import flows, sinks


def test_aes_is_the_standard(spark):
    """Blocks as the standard's appendix and as Spark's own cipher encrypt them; counter mode undoes itself."""
    import numpy as np

    key, block = bytes(range(16)), bytes.fromhex("00112233445566778899aabbccddeeff")
    once = lambda k, b: aes.encrypt_blocks(aes.round_keys(k), np.frombuffer(b, np.uint8).reshape(1, -1)).tobytes()
    assert once(key, block).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    for size in (16, 24, 32):
        k = bytes(range(7, 7 + size))
        want = spark.range(1).select(F.expr(f"hex(aes_encrypt(unhex('{block.hex()}'), unhex('{k.hex()}'), 'ECB'))")).first()[0]
        assert once(k, block).hex().upper() == want[:32]
        data = os.urandom(100_003)
        assert aes.counter_mode(k, aes.counter_mode(k, data, 1000), 4096) == data
    with pytest.raises(EngineError):
        aes.round_keys(b"short")


def aes_zip(path, name, content, password, strength=3, version=2, method=8):
    """A ZIP with one AES-encrypted member."""
    salt_size, key_size = aes.STRENGTHS[strength]
    salt = os.urandom(salt_size)
    key, mac, check = aes.zip_keys(password, salt, key_size)
    pack = zlib.compressobj(9, zlib.DEFLATED, -15)
    packed = pack.compress(content) + pack.flush() if method == 8 else content
    body = aes.counter_mode(key, packed)
    data = salt + check + body + hmac.new(mac, body, "sha1").digest()[:10]
    extra = struct.pack("<HHHHBH", aes.EXTRA_ID, 7, version, 0x4541, strength, method)
    crc = zlib.crc32(content) if version == 1 else 0
    fixed = struct.pack("<HHHHHLLLHH", 51, 1, 99, 0, 33, crc, len(data), len(content), len(name), len(extra))
    local = b"PK\x03\x04" + fixed + name.encode() + extra + data
    central = b"PK\x01\x02" + struct.pack("<H", 51) + fixed + struct.pack("<HHHLL", 0, 0, 0, 0, 0) + name.encode() + extra
    with open(path, "wb") as f:
        f.write(local + central + b"PK\x05\x06" + struct.pack("<HHHHLLH", 0, 0, 1, 1, len(central), len(local), 0))


@pytest.mark.parametrize("strength,version,method", [(1, 1, 8), (2, 2, 0), (3, 2, 8)])
def test_encrypted_members(spark, tmp_path, strength, version, method):
    land = tmp_path / "land"
    land.mkdir()
    aes_zip(land / "a.zip", "a.csv", b"x\n" + b"1\n" * 50_000, "word", strength, version, method)
    for wrong in (None, "other"):
        with pytest.raises(EngineError, match="a.zip"):
            landing.extract_archives(str(land), "*.zip", str(tmp_path / "out"), password=wrong)
    (made,) = landing.extract_archives(str(land), "*.zip", str(tmp_path / "out"), spark, "word")
    assert open(made).read() == "x\n" + "1\n" * 50_000


def test_extraction_by_tasks_collects_failures(spark, tmp_path):
    land, out = tmp_path / "land", tmp_path / "out"
    land.mkdir()
    for i in range(4):
        with zipfile.ZipFile(land / f"{i}.zip", "w") as z:
            z.writestr(f"d/{i}.csv", f"x\n{i}\n")
    (land / "bad.zip").write_bytes(b"PK\x03\x04 broken")
    (land / "text.zip").write_text("no archive")
    with zipfile.ZipFile(land / "evil.zip", "w") as z:
        z.writestr("../evil.csv", "x")
    damaged = bytearray((land / "3.zip").read_bytes())
    damaged[damaged.index(b"x\n3") + 2] ^= 1
    (land / "3.zip").write_bytes(damaged)
    with pytest.raises(EngineError) as e:
        landing.extract_archives(f"file://{land}", "*.zip", f"file://{out}", spark)
    assert all(n in str(e.value) for n in ("3.zip", "bad.zip", "evil.zip", "text.zip")) and "0.zip" not in str(e.value)
    assert sorted(str(p.relative_to(out)) for p in out.rglob("*.csv")) == ["d/0.csv", "d/1.csv", "d/2.csv"] and not (tmp_path / "evil.csv").exists()
    assert sorted(os.path.basename(p) for p in landing.waiting(str(land), "*.zip")) == ["3.zip", "bad.zip", "evil.zip", "text.zip"]
    time.sleep(0.02)
    with zipfile.ZipFile(land / "0.zip", "w") as z:  # a new delivery under an old name
        z.writestr("d/0.csv", "new")
    assert [os.path.basename(p) for p in landing.extract_archives(str(land), "0.zip", str(out))] == ["0.csv"] and (out / "d/0.csv").read_text() == "new"


def test_an_archive_is_not_written_over_itself(tmp_path):
    with gzip.open(tmp_path / "plain", "wb") as f:
        f.write(b"data")
    with pytest.raises(EngineError, match="over itself"):
        landing.extract(str(tmp_path / "plain"), str(tmp_path))
    assert gzip.open(tmp_path / "plain").read() == b"data"
    with pytest.raises(EngineError, match="match the markers"):
        landing.waiting(str(tmp_path), "*")
    (tmp_path / "x.csv.gz.gpg").write_bytes(b"?" + gzip.compress(b"secret")[::-1])
    with pytest.raises(EngineError, match="no way to decrypt"):
        landing.extract(str(tmp_path / "x.csv.gz.gpg"), str(tmp_path))
    (made,) = landing.extract(str(tmp_path / "x.csv.gz.gpg"), str(tmp_path), decrypt=lambda b: b[1:][::-1])
    assert os.path.basename(made) == "x.csv" and open(made).read() == "secret"


def test_delete_policies(tmp_path):
    assert [landing.DeletePolicy.of(x).days for x in (None, True, False, {"delete_after_x_days": 3}, {})] == [0, 0, None, 3, 7]
    for bad in ("x", {"days": 1}, {"delete_after_x_days": -1}):
        with pytest.raises(EngineError):
            landing.DeletePolicy.of(bad)
    for name in ("a", "b"):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("x", "y")
    landing.extract_archives(str(tmp_path), "a.zip", str(tmp_path / "out"))
    assert landing.clean_up(str(tmp_path), "*.zip", landing.DeletePolicy.of(False)) == []
    assert landing.clean_up(str(tmp_path), "*.zip", landing.DeletePolicy.of({"delete_after_x_days": 1})) == []
    assert [os.path.basename(p) for p in landing.clean_up(str(tmp_path), "*.zip", landing.DeletePolicy.of(None))] == ["a.zip"]  # b was never extracted
    assert sorted(os.listdir(tmp_path)) == ["b.zip", "out"]


def test_batch_validation(spark, tmp_path):
    good = tmp_path / "good.zip"
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("a.csv", "k,v\n1,x\n2,y\n")
    (tmp_path / "same.zip").write_bytes(good.read_bytes())
    (tmp_path / "empty.zip").write_bytes(b"")
    (tmp_path / "bad.zip").write_bytes(b"PK no")
    torn = bytearray(good.read_bytes())
    torn[torn.index(b"1,x")] ^= 1
    (tmp_path / "torn.zip").write_bytes(torn)
    found = {os.path.basename(e.archive): e.reason.split()[0] for e in landing.validate_batch([str(tmp_path / f"{n}.zip") for n in ("good", "same", "empty", "bad", "torn", "gone")])}
    assert found == {"same.zip": "the", "empty.zip": "empty", "bad.zip": "malformed:", "torn.zip": "bad", "gone.zip": "missing"}
    with pytest.raises(EngineError, match="empty"):
        landing.join_batch(spark, {"a": str(tmp_path / "empty.zip")}, "SELECT 1", str(tmp_path / "w"))
    assert landing.join_batch(spark, {"a": str(good)}, "SELECT sum(k) AS s FROM a", str(tmp_path / "w")).first().s == 3


def test_compress_folder(tmp_path):
    (tmp_path / "in/d").mkdir(parents=True)
    for name in ("a.json", "d/b.csv", "c.exe", "_SUCCESS", ".hidden.json"):
        (tmp_path / "in" / name).write_text(name)
    assert landing.compress_folder(str(tmp_path / "in"), str(tmp_path / "out/x.zip"), remove=True) == ["a.json", "d/b.csv"]
    with zipfile.ZipFile(tmp_path / "out/x.zip") as z:
        assert {n: z.read(n).decode() for n in z.namelist()} == {"a.json": "a.json", "d/b.csv": "d/b.csv"}
    assert not (tmp_path / "in/a.json").exists() and (tmp_path / "in/c.exe").exists() and os.listdir(tmp_path / "out") == ["x.zip"]
    landing.compress_folder(str(tmp_path / "in"), str(tmp_path / "out/y.zip"), (".exe",), encrypt=lambda b: b[::-1])
    assert zipfile.is_zipfile(io.BytesIO((tmp_path / "out/y.zip").read_bytes()[::-1]))


def test_stored_schemas_evolve(spark, tmp_path):
    src, schema = tmp_path / "in", f"file://{tmp_path}/schema"
    src.mkdir()
    read = lambda **more: registry.read_source(spark, {"type": "files", "path": str(src), "format": "json", "schema_location": schema, **more})
    with pytest.raises(ShapeError, match="neither"):
        read()
    (src / "1.json").write_text('{"a": 1}\n')
    assert read().dtypes == [("a", "bigint")]
    (src / "2.json").write_text('{"a": 2, "b": "x"}\n')
    with pytest.raises(ShapeError, match="new columns"):
        read(evolution="failOnNewColumns")
    assert read(evolution="none").dtypes == [("a", "bigint")]
    rescued = {r.a: r._rescued_data for r in read(evolution="rescue").collect()}
    assert rescued == {1: None, 2: '{"b":"x"}'}
    assert {(r.a, r.b) for r in read().collect()} == {(1, None), (2, "x")}
    (src / "3.json").write_text('{"a": 2.5}\n')
    assert dict(read().dtypes)["a"] == "bigint"  # types stay unless they may widen
    assert dict(read(glob="1.json").dtypes) == {"a": "bigint", "b": "string"} and read(glob="1.json").count() == 1
    ddl = StructType.fromDDL
    assert files.evolve(ddl("a int, b float, c string"), ddl("a bigint, b double, c int, d int"), "addNewColumnsWithTypeWidening") == ddl("a bigint, b double, c string, d int")
    assert files.evolve(ddl("a bigint"), ddl("a int"), "addNewColumnsWithTypeWidening") == ddl("a bigint")
    with pytest.raises(ShapeError, match="JSON lines"):
        registry.read_source(spark, {"type": "files", "path": str(src), "format": "csv", "schema": "a int", "evolution": "rescue"})
    with pytest.raises(PlanError, match="source type"):
        registry.read_source(spark, {"type": "ftp"})


def test_retention_waits_for_age_and_commit(spark, tmp_path):
    src, state, store = tmp_path / "in", f"file://{tmp_path}/state", Store(spark, f"file://{tmp_path}/store")
    src.mkdir()
    (src / "a.json").write_text('{"a": 1}\n')
    read = {"type": "files", "path": str(src), "format": "json", "schema": "a int", "stream": True, "glob": "*.json"}
    sinks.write_stream(registry.read_source(spark, read), {"type": "table", "table": "t"}, state, store)
    (src / "b.json").write_text('{"a": 2}\n')  # not read yet
    keep = lambda policy, days=0.0: files.apply_retention(spark, state, files.Retention.of(policy), time.time() + days * 86_400)
    assert keep("off", 30) == [] and keep({"mode": "archive"}, 30) == [] and keep("delete", 6) == []
    assert [os.path.basename(p) for p in keep({"mode": "archive", "path": f"file://{tmp_path}/old"}, 8)] == ["a.json"]
    assert os.listdir(src) == ["b.json"] or sorted(os.listdir(src)) == [".a.json.crc", "b.json"]
    assert "a.json" in os.listdir(tmp_path / "old") and keep("delete", 8) == []
    sinks.write_stream(registry.read_source(spark, read), {"type": "table", "table": "t"}, state, store)
    assert store.read("t").count() == 2 and [os.path.basename(p) for p in keep({"mode": "delete", "days": 1}, 2)] == ["b.json"]
    with pytest.raises(ShapeError):
        files.Retention.of("burn")


CALL = "A DEFINITIONS AUTOMATIC TAGS ::= BEGIN R ::= SEQUENCE { n INTEGER, s IA5String OPTIONAL } END"


def test_binary_stream_keeps_metadata(spark, tmp_path):
    """Records of a stream of files, with the hidden metadata and columns of any name beside them."""
    src = tmp_path / "in"
    src.mkdir()
    record = lambda n: bytes([0x30, 3, 0x80, 1, n])
    (src / "a.ber").write_bytes(record(1) + record(2))
    (src / "b.ber").write_bytes(record(3) + b"\x30\x05\x80")
    read = {"type": "binary_records", "path": str(src), "schema": CALL, "glob": "*.ber"}
    rows = shape.with_lineage(registry.read_source(spark, read))
    assert sorted((r._eng_source_file, r.n) for r in rows.collect() if r.n) == [("a.ber", 1), ("a.ber", 2), ("b.ber", 3)] and rows.filter("n IS NULL").count() == 1
    streamed = registry.read_source(spark, read | {"stream": True}).select("n", "_metadata.file_name")
    assert sorted(r.n for r in flows.run_once(streamed, f"file://{tmp_path}/once").collect() if r.n) == [1, 2, 3]
    from sluice.sources import ber

    odd = spark.createDataFrame([(1, "f", bytearray(record(7)))], "`a b` int, _eng_source_file string, content binary")
    out = ber.decode_frame(odd, CALL)
    assert out.columns[:2] == ["a b", "_eng_source_file"] and tuple(out.first())[:3] == (1, "f", 7)


def test_key_lists(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.write("t", spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id bigint, v string"))
    keys = spark.createDataFrame([(2, "true"), (2, "true"), (3, "false"), (9, "true")], "id int, gone string")
    keys.write.parquet(f"file://{tmp_path}/keys")
    keys.write.option("header", "true").csv(f"file://{tmp_path}/plain")
    store.write("listed", keys.filter("gone = 'false'"))
    assert dispatch.soft_delete(store, "t", "listed", ["id"], "gone") == ("SKIPPED", 0) and store.manifest("t")["version"] == 1
    for location in (f"file://{tmp_path}/keys", f"file://{tmp_path}/plain"):
        assert dispatch.soft_delete(store, "t", location, ["id"], "gone") == ("COMPLETED", 2)
        assert {r.id: r.is_deleted for r in store.read("t").collect()} == {1: False, 2: True, 3: False}
    keys.createOrReplaceTempView("key_view")
    assert registry.read_keys(spark, "key_view").count() == 4
    with pytest.raises(PlanError, match="no key list"):
        registry.read_keys(spark, f"file://{tmp_path}/nowhere")
    with pytest.raises(LoadError, match="missing"):
        dispatch.soft_delete(store, "t", f"file://{tmp_path}/keys", ["id"], "other")


@pytest.fixture
def collector():
    """An HTTP server that refuses its first request."""
    got, answers = [], [503]

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = self.rfile.read(int(self.headers["Content-Length"]))
            status = answers.pop() if answers else 200
            if status == 200:
                got.append((self.headers.get("x-key"), json.loads(body)))
            self.send_response(status)
            self.send_header("Retry-After", "0.01")
            self.end_headers()

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1/logs", got
    server.shutdown()


def test_telemetry_stream(spark, tmp_path, collector):
    url, got = collector
    rows = spark.sql("SELECT concat('p', id % 2) AS pipeline, 'f' AS flow, 'INFO' AS level, concat('m', id) AS message, id AS time_ms FROM range(5)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    sinks.write_stream(stream, {"type": "otlp", "url": url, "headers": {"X-Key": "secret:k"}}, f"file://{tmp_path}/state", secrets={"k": "v"})
    bodies = [r["body"]["stringValue"] for key, b in got for x in b["resourceLogs"] for r in x["scopeLogs"][0]["logRecords"] if key == "v"]
    assert sorted(bodies) == [f"m{i}" for i in range(5)]
    refused = telemetry.to_http([], "http://127.0.0.1:9/", tries=3, sleep=lambda s: None)
    assert not refused.ok and "Error" in refused.detail


def test_late_rows_and_session_windows(spark, tmp_path):
    """A row behind the watermark is dropped; sessions of a stream close behind their gap."""
    at = lambda minute: f"timestamp '2024-01-01 00:00:00' + make_dt_interval(0, 0, {minute})"
    schema = spark.sql(f"SELECT 1 AS k, {at(0)} AS ts").schema
    src, state, out = tmp_path / "in", f"file://{tmp_path}/state", []
    src.mkdir()

    def feed(*minutes):
        spark.sql(" UNION ALL ".join(f"SELECT 1 AS k, {at(m)} AS ts" for m in minutes)).coalesce(1).write.mode("append").parquet(str(src))
        stream = flows.windowed(spark.readStream.schema(schema).parquet(str(src)), "10 minutes", ["k"], [F.count("*").alias("n")], delay="5 minutes", slide=None)
        stream.writeStream.outputMode("append").foreachBatch(lambda df, i: out.extend((r.window.start.minute, r.n) for r in df.collect())).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    feed(1, 2, 12)
    feed(30)  # closes what ends before 25
    feed(3, 31)  # minute 3 is late
    feed(59)
    assert sorted(out) == [(0, 2), (10, 1), (30, 2)]
    spark.sql(f"SELECT * FROM VALUES (1, {at(0)}), (1, {at(4)}), (1, {at(20)}), (2, {at(3)}), (9, {at(300)}) AS x(k, ts)").coalesce(1).write.parquet(str(tmp_path / "s"))
    sessions = flows.windowed(spark.readStream.schema(schema).parquet(str(tmp_path / "s")), "", ["k"], [F.count("*").alias("n")], delay="1 minute", gap="5 minutes")
    made = flows.run_once(sessions.select("k", F.minute("window.start").alias("m"), "n"), f"file://{tmp_path}/once")
    assert sorted(tuple(r) for r in made.collect()) == [(1, 0, 2), (1, 20, 1), (2, 3, 1)]


def test_unbounded_stream_dedup_warns(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    with pytest.warns(UserWarning, match="without a watermark"):
        shape.dedup(spark.readStream.schema("id long").parquet(str(tmp_path / "in")))


def test_governance(spark, tmp_path):
    df = spark.createDataFrame([(1, "Anna Example", "x"), (2, "Bo", "y"), (3, None, "x")], "id int, name string, area string")
    assert [r.name for r in governance.mask(df, ["name"]).collect()] == ["#mple", "#", None]
    assert [r.name for r in governance.mask(df, ["name"], F.col("area") == "y").collect()] == ["#mple", "Bo", None]
    allowed = governance.allowed_rows(df, spark.createDataFrame([("u", "x"), ("u", "x"), ("w", "y")], "user string, area string"), ["area"], "u")
    assert sorted(r.id for r in allowed.collect()) == [1, 3]
    tagged = governance.with_tags(governance.with_tags(df, {"name": {"pii": "yes"}}), {"name": {"owner": "hr"}})
    assert tagged.schema["name"].metadata["tags"] == {"pii": "yes", "owner": "hr"} and tagged.collect() == df.collect()
    with pytest.raises(ShapeError):
        governance.with_tags(df, {"nope": {}})
    governance.register_function(spark, "twice", lambda x: 2 * x, "int")
    assert spark.sql("SELECT twice(4) AS n").first().n == 8


def test_pgp_messages(tmp_path):
    import bz2
    import hashlib

    from sluice.functions import pgp

    for size in (0, 1, 15, 16, 17, 5000):
        data = os.urandom(size)
        for armor in (False, True):
            message = pgp.encrypt(data, "päss", "n.csv", armor)
            assert pgp.decrypt(message, "päss") == data and (message[:5] == b"-----") == armor
    message = pgp.encrypt(b"data" * 100, "a")
    for bad in (message[:-1] + bytes([message[-1] ^ 1]), message[:80] + bytes([message[80] ^ 1]) + message[81:]):
        with pytest.raises(EngineError):
            pgp.decrypt(bad, "a")
    with pytest.raises(EngineError, match="passphrase"):
        pgp.decrypt(message, "b")
    for text in (b"no message", b"", message[:40]):
        with pytest.raises(EngineError):
            pgp.decrypt(text, "a")
    # Old packet heads, lengths in parts, compressed content, and a session key that is itself encrypted.
    body = os.urandom(700)
    inner = b"b\0" + bytes(4) + body
    literal = bytes([0xC0 | pgp.LITERAL, 0xE9]) + inner[:512] + bytes([0xC0, len(inner) - 512 - 192]) + inner[512:]
    assert list(pgp.packets(literal)) == [(pgp.LITERAL, inner)]
    packed = bytes([0x80 | pgp.COMPRESSED << 2 | 3, 3]) + bz2.compress(literal)
    start, key = os.urandom(16), os.urandom(16)
    plain = start + start[-2:] + packed + pgp.CHECK_HEAD
    how = bytes([1, 2]) + os.urandom(8)
    made, _ = pgp._key("x", how, 32)
    session = bytes([4, 9]) + how + pgp._feedback_encrypt(made, b"\7" + key)
    old = lambda tag, b: bytes([0x80 | tag << 2 | 1]) + len(b).to_bytes(2, "big") + b
    message = old(pgp.PASSPHRASE_SESSION, session) + bytes([0xC0 | pgp.PROTECTED, 0xFF]) + (w := b"\1" + pgp._feedback_encrypt(key, plain + hashlib.sha1(plain).digest())).__len__().to_bytes(4, "big") + w
    assert pgp.decrypt(message, "x") == body
    # As an archive in a landing folder.
    (tmp_path / "x.csv.gz.pgp").write_bytes(pgp.encrypt(gzip.compress(b"a,b\n"), "x"))
    (out,) = landing.extract(str(tmp_path / "x.csv.gz.pgp"), str(tmp_path), decrypt=lambda b: pgp.decrypt(b, "x"))
    assert os.path.basename(out) == "x.csv" and open(out).read() == "a,b\n"
