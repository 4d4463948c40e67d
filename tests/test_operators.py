"""Unit tests of the reference's own operators on small frames."""

import itertools

import pytest

from sluice.errors import LoadError, QualityError, ShapeError, SpecError
from sluice.functions import crypto, hashing, params
from sluice.operators import loads, quality_rules, reconcile, shape
from sluice.operators.quality_rules import Rule


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_names_and_collisions(spark):
    assert [shape.normal_name(x) for x in (" A-b  C ", "__x__", "!!")] == ["a_b_c", "x", "_"]
    with pytest.raises(ShapeError):
        shape.normalise_names(spark.createDataFrame([(1, 2)], ["a b", "A_B"]))


def test_schema_config(spark):
    df = spark.createDataFrame([(1, "2", "x")], ["a", "b", "c"])
    out = shape.apply_schema(df, [{"name": "b", "rename": "n", "data_type": "int"}])
    assert out.dtypes == [("n", "int"), ("a", "bigint"), ("c", "string")]
    with pytest.raises(ShapeError):
        shape.apply_schema(df, [{"name": "zz"}])


def test_explode_keeps_empty_rows(spark):
    df = spark.createDataFrame([(1, [(1, "a"), (2, "b")]), (2, []), (3, None)], "id int, x array<struct<n:int,s:string>>")
    assert rows(shape.explode_columns(df, ["x"]), "id", "x_n") == [(1, 1, "a"), (1, 2, "b"), (2, None, None), (3, None, None)]
    assert rows(shape.explode_columns(df, []), "id", "x_n") == rows(shape.explode_columns(df, ["x"]), "id", "x_n")
    with pytest.raises(ShapeError):
        shape.explode_columns(df, ["id"])


def test_standardise_is_sequential_and_scalar(spark):
    df = spark.createDataFrame([(" x ",)], ["a"])
    assert shape.standardise(df, ["trim(a) AS a", "concat(a, '!') AS b"]).first()[:] == ("x", "x!")
    assert shape.standardise(df, ["if(a = 'where', 'group by', 'select') AS c"]).first().c == "select"  # words in text are no query
    for bad in ("trim(a)", "(select 1) AS c", "a in (select 1) AS c", "exists(select 1) AS c", "a, 1 AS c", "a from t AS c"):
        with pytest.raises(ShapeError):
            shape.standardise(df, [bad])


def test_json_inferred_and_declared(spark):
    df = spark.createDataFrame([('{"k": 3}',), (None,)], ["j"])
    assert [r.j.k if r.j else None for r in shape.parse_json(df, {"j": None}).collect()] == [3, None]
    with pytest.raises(ShapeError):
        shape.parse_json(spark.createDataFrame([(1,)], ["j"]), {"j": "k int"})


def test_json_schema_has_the_fields_of_all_rows(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('{"a": 2, "b": {"c": [1]}}',), (None,)], ["j"]).repartition(3)
    assert shape.parse_json(df, {"j": None}).schema["j"].dataType.simpleString() == "struct<a:bigint,b:struct<c:array<bigint>>>"
    assert shape.parse_json(df.limit(0), {"j": None}).count() == 0


def test_flatten_to_any_depth(spark):
    deep, ddl = (1,), "v:int"
    for i in range(14):
        deep, ddl = (deep,), f"s{i}:struct<{ddl}>"
    df = spark.createDataFrame([(0, deep)], f"id int, x struct<{ddl}>")
    out = shape.flatten_all(df)
    assert out.columns == ["id", "x_" + "_".join(f"s{i}" for i in reversed(range(14))) + "_v"] and out.first()[1] == 1
    df = spark.createDataFrame([(1, [[1, 2], [3]], [("p", [4, 5])]), (2, None, [])], "id int, a array<array<int>>, b array<struct<n:string,q:array<int>>>")
    out = shape.flatten_all(df)
    assert out.columns == ["id", "a", "b_n", "b_q"] and out.count() == 3 * 2 + 1


def test_quarantine_ignores_null_and_drop_does_not(spark):
    df = spark.createDataFrame([(1, 5), (2, -5), (3, None)], ["id", "v"])
    marked = quality_rules.with_quarantine(df, [Rule("pos", "v > 0", "quarantine")])
    assert [r.id for r in quality_rules.quarantined(marked).collect()] == [2]
    assert rows(quality_rules.clean(marked), "id") == [(1, 5), (3, None)]
    assert rows(quality_rules.apply_native(df, [Rule("pos", "v > 0", "drop")]), "id") == [(1, 5)]
    with pytest.raises(QualityError):
        quality_rules.check_fail(df, [Rule("pos", "v > 0", "fail")])
    with pytest.raises(SpecError):
        Rule("x", "true", "explode")


def test_parameters():
    assert params.in_sql("a = ${s} AND b > ${n}", {"s": "o'x", "n": 3}) == "a = 'o''x' AND b > 3"
    assert params.in_path("/in/${s}", {"s": "x"}) == "/in/x"
    with pytest.raises(SpecError):
        params.in_sql("${nope}", {})


def test_fingerprint_ignores_order(spark):
    data = [(i, f"v{i}") for i in range(50)]
    one, two = (hashing.fingerprint(hashing.with_hashes(spark.createDataFrame(d, ["k", "v"]), ["k"], ["v"])) for d in (data, data[::-1]))
    assert one == two and one.rows == 50 and len(one.keys) == 64


CDC = loads.Cdc(["k"], ["s"], "op = 'D'", ["op"])
EVENTS = [("a", 1, "x", "U"), ("a", 3, "z", "U"), ("a", 2, "y", "U"), ("b", 1, "x", "U"), ("b", 2, "x", "D"), ("c", 5, "q", "U"), ("c", 4, "p", "D")]


def test_scd1_is_the_same_for_any_split(spark):
    cdc = loads.Cdc(["k"], ["s"], "op = 'D'")
    frame = lambda part: spark.createDataFrame(part, "k string, s int, v string, op string")
    for cut in (0, 2, 5):
        for order in itertools.islice(itertools.permutations(EVENTS), 0, 5000, 2400):
            state = loads.scd1_state(None, frame(order[:cut]), cdc)
            state = loads.scd1_state(state, frame(order[cut:]), cdc)
            assert rows(loads.scd1(state).select("k", "v"), "k") == [("a", "z"), ("c", "q")]


def test_scd2_and_scd3(spark):
    df = spark.createDataFrame(EVENTS, "k string, s int, v string, op string")
    out = loads.scd2(df, loads.Cdc(["k"], ["s"], "op = 'D'", ["op"], ["v"])).select("k", "v", loads.START, loads.END)
    assert rows(out, "k", loads.START) == [("a", "x", 1, 2), ("a", "y", 2, 3), ("a", "z", 3, None), ("b", "x", 1, 2), ("c", "q", 5, None)]
    out = loads.scd3(df.filter("k = 'a'"), loads.Cdc(["k"], ["s"]), ["v"])
    assert rows(out, "k") == [("a", "z", "y")]
    with pytest.raises(LoadError):
        loads.scd2(df, loads.Cdc([], ["s"]))


def test_delete_by_operation_column(spark):
    df = spark.createDataFrame(EVENTS, "k string, s int, v string, op string")
    listed = loads.Cdc(["k"], ["s"], ("op", ["D", "X"]))
    assert rows(loads.scd1(loads.scd1_state(None, df, listed)).select("k", "v"), "k") == [("a", "z"), ("c", "q")]
    with pytest.raises(Exception, match="sequence is null"):
        loads.scd1_state(None, spark.createDataFrame([("a", 1, 2, None)], "k string, s int, t int, u int"), loads.Cdc(["k"], ["s", "t", "u"])).collect()


def test_snapshot_and_soft_delete(spark):
    old, new = (spark.createDataFrame(d, ["k", "v"]) for d in ([(1, "a"), (2, "b"), (3, "c")], [(2, "b"), (3, "x"), (4, "d")]))
    assert rows(loads.snapshot_diff(old, new, ["k"]).select("k", "change"), "k") == [(1, "delete"), (2, "unchanged"), (3, "update"), (4, "insert")]
    assert rows(loads.full_snapshot(old, new, ["k"]), "k") == [(2, "b"), (3, "x"), (4, "d")]
    with pytest.raises(LoadError):
        loads.full_snapshot(old, new.union(new), ["k"])
    keys = spark.createDataFrame([(1, True), (1, True), (2, False)], ["k", "gone"])
    once = loads.soft_delete(old, keys, ["k"], "gone")
    assert rows(once.select("k", "is_deleted"), "k") == [(1, True), (2, False), (3, False)]
    assert rows(loads.soft_delete(once, keys.filter("k = 2"), ["k"], "gone").select("k", "is_deleted"), "k") == [(1, True), (2, False), (3, False)]


def test_truncate_guard(spark):
    old = spark.createDataFrame([(1,)], ["k"])
    assert loads.truncate_and_load(old, old.limit(0)).count() == 1
    assert loads.truncate_and_load(old, old.limit(0), empty_target_if_source_empty=True).count() == 0


def test_reconciliation(spark):
    source = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (3, "c")], ["k", "v"])
    target = spark.createDataFrame([(1, "a"), (2, "x"), (9, "z")], ["k", "v"])
    out = reconcile.run(source, target, ["k"])
    assert (out.matched, out.value_drift, out.missing_in_target, out.missing_in_source) == (1, 1, 2, 1)
    healed, ledger = [], set()
    for status in ("SUCCESS", "SKIPPED_ALREADY_PROCESSED"):
        assert reconcile.run(source, target, ["k"], heal=lambda df: healed.append(df.count()), ledger=ledger).status == status
    assert healed == [3]
    assert reconcile.run(source, source, ["k"]).status == "MATCHED"
    assert reconcile.run(source, target, ["k"], compare=[]).value_drift == 0


def test_crypto(spark):
    key, df = "0123456789abcdef", spark.createDataFrame([(1, 2.5)], ["id", "v"])
    locked = crypto.encrypt(df, [crypto.Crypt("v", key, declared="double")])
    assert dict(locked.dtypes)["v"] == "binary"
    assert crypto.decrypt(locked, [crypto.Crypt("v", key, declared="double")]).first()[:] == (1, 2.5)
    with pytest.raises(ShapeError):
        crypto.encrypt(df, [crypto.Crypt("v", key, "XYZ")])
