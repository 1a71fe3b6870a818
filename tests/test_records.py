"""Record types against JSON records and typed rows."""

import pytest
from pyspark.sql import functions as F

from rowforge import types as t
from rowforge.functions import CHECKS
from rowforge.operators import records
from rowforge.operators.records import Rules
from rowforge.plans.record_queries import JSON


def results(spark, node, texts, rules=None):
    df = spark.createDataFrame([(x,) for x in texts], "s string").select(F.parse_json("s").alias("v"))
    return [r[0] for r in df.select(records.result_column(node, df, rules, variant="v")).collect()]


@pytest.mark.parametrize("name", JSON)
def test_json(spark, name):
    node, rules, samples = JSON[name]
    found = results(spark, node, [s.replace("{k}", "7") for s, _ in samples], rules)
    listed = ["; ".join(f"{e.path}: {e.message}" for e in r.errors or []) for r in found]
    assert listed == [e for _, e in samples]
    assert [r.ok for r in found] == [not e for _, e in samples]
    assert all((r.data is not None) == r.ok for r in found)


def test_no_record(spark):
    assert [r.errors[0].message for r in results(spark, t.object_(a=t.string), ["[]", "1", '"x"'])] == ["must be an object"] * 3


def test_data_is_coerced_and_projected(spark):
    node = t.object_(a=t.number, b=t.boolean, c=t.object_(d=t.number), e=t.array(t.object_(f=t.number)).maybe(), g=t.never, m=t.record(t.number))
    r = results(spark, node, ['{"a": " 12 ", "b": "TRUE", "c": {"d": "0x10", "x": 1}, "e": [{"f": "2"}], "g": 1, "m": {"k": "3"}, "z": 0}'])[0]
    assert r.ok and r.data.asDict(True) == {"a": 12.0, "b": True, "c": {"d": 16.0}, "e": [{"f": 2.0}], "m": {"k": 3.0}}


def test_typed_rows(spark):
    df = spark.createDataFrame([("1", 5, ["a"], (1.0, "x"), {"k": 1.5}), ("x", 6, None, None, {"k": None}), (None, None, ["a", None], (None, "y"), None)], "n string, i int, l array<string>, s struct<a:double,b:string>, m map<string,double>")
    node = t.object_(n=t.number, i=t.integer, l=t.array(t.string), s=t.object_(a=t.number), m=t.record(t.number))
    rows = [r[0] for r in df.select(records.result_column(node, df)).collect()]
    assert rows[0].ok and rows[0].data.asDict(True) == {"i": 5, "l": ["a"], "m": {"k": 1.5}, "n": 1.0, "s": {"a": 1.0}}
    assert [(e.path, e.message) for e in rows[1].errors] == [("l", "must be an array"), ("m.k", "must be a number"), ("n", "must be a number"), ("s", "must be an object")]
    assert [e.path for e in rows[2].errors] == ["i", "l[1]", "m", "n", "s.a"]


def test_operators(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, None)], "id long, v string")
    node = t.object_(id=t.number, v=t.string)
    assert [r.id for r in records.valid_rows(df, node).collect()] == [1]
    assert sorted(r.id for r in records.quarantine(df, node).collect()) == [2, 3]
    assert [tuple(r) for r in records.error_counts(df, node).collect()] == [("v", "must be a string", 2)]
    known = spark.createDataFrame([(1,), (1,), (None,)], "k long")
    assert sorted((r.id, r.known) for r in records.with_lookup(df, "id", known, "k", "known").collect()) == [(1, True), (2, False), (3, False)]
    checked = records.validate(df, node, Rules(fields={"id": [CHECKS["max"](0)]})).select("result.errors").collect()
    assert checked[0][0][0].message == "must be at most 0" and checked[1][0][0].path == "v"


def test_streaming(spark, tmp_path):
    spark.range(5).selectExpr("id", "cast(id as string) v").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, v string").parquet(str(tmp_path / "in"))
    node = t.object_(id=t.number, v=t.number.branded("small"))
    out = records.validate(stream, node, Rules(brands={"small": [CHECKS["max"](2)]})).select("id", "result.ok")
    query = out.writeStream.format("memory").queryName("validated").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.id, r.ok) for r in spark.sql("select * from validated").collect()) == [(0, True), (1, True), (2, True), (3, False), (4, False)]


def test_types():
    a, b = t.object_(x=t.string), t.object_(y=t.number)
    assert [n for n, _ in t.merge(b, a).fields] == ["x", "y"]
    assert all(f.optional for _, f in t.partial(a).fields) and not any(f.optional for _, f in t.required(t.partial(a)).fields)
    assert t.pick(t.merge(a, b), "y") == b and t.omit(t.merge(a, b), "y") == a
    assert t.union(t.string, t.null) == t.string.or_null()
    assert t.union(t.literal("a"), t.literal("b")).kind == "literal"
    assert [n for n, _ in t.object_({"b": t.string, "B": t.string, "a": t.string}).fields] == ["B", "a", "b"]
    with pytest.raises(TypeError):
        t.tuple_(t.string.maybe(), t.number)
    with pytest.raises(TypeError):
        t.boolean.branded("x")
