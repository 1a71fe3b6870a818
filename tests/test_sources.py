from rowforge import types as t
from rowforge.serde import Codec
from rowforge.serde.columns import RecordFormat
from rowforge.sources.frames import ParquetStore, load_registry, read_frames, read_records, save_registry, write_records
from rowforge.streaming.validation import error_rates, route


def test_files_of_frames(spark, tmp_path):
    codec = Codec()
    values = [{"a": i, "b": "x" * i} for i in range(5)]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "one.bin").write_bytes(b"".join(map(codec.encode, values)))
    (tmp_path / "f" / "two.bin").write_bytes(codec.encode([1, 2]) + codec.encode(None))
    (tmp_path / "f" / "empty.bin").write_bytes(b"")
    rows = read_frames(spark, str(tmp_path / "f"), codec.registry, pattern="*.bin").collect()
    got = sorted((r.path[-7:], r.offset, str(codec.decode(bytes(r.frame)))) for r in rows)
    assert [g[2] for g in got] == [*map(str, values), "[1, 2]", "None"] and got[0][1] == 0 < got[1][1]


def test_record_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, s string")
    form = RecordFormat(df.schema)
    write_records(df, str(tmp_path / "r"), form)
    assert sorted(map(tuple, read_records(spark, str(tmp_path / "r"), form).collect())) == [(1, "a"), (2, None)]


def test_schemas_are_kept(spark, tmp_path):
    path = str(tmp_path / "schemas")
    writer = Codec(store=ParquetStore(spark, path))
    data = [writer.encode({"a": 1}), writer.encode({"a": 1, "b": {"c": 2.5}})]
    reader = Codec(store=ParquetStore(spark, path))
    assert [reader.decode(x) for x in data] == [{"a": 1}, {"a": 1, "b": {"c": 2.5}}]
    save_registry(spark, writer.registry, str(tmp_path / "registry"))
    assert Codec(load_registry(spark, str(tmp_path / "registry"))).decode(data[1]) == {"a": 1, "b": {"c": 2.5}}


def test_streams_are_routed(spark, tmp_path):
    schema = "id long, v string, ts timestamp"
    folder = lambda name: str(tmp_path / name)
    node = t.object_(id=t.number, v=t.integer)
    for part in range(3):
        rows = spark.range(part * 10, part * 10 + 10).selectExpr("id", "if(id % 4 = 0, 'x', cast(id as string)) v", "timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, id) ts")
        rows.coalesce(1).write.mode("append").parquet(folder("in"))
        stream = spark.readStream.schema(schema).parquet(folder("in"))
        query = route(stream, node, folder("good"), folder("bad"), folder("state"), once=True)
        query.awaitTermination()
    good, bad = spark.read.parquet(folder("good")), spark.read.parquet(folder("bad"))
    assert sorted(r.id for r in good.collect()) == [i for i in range(30) if i % 4] and dict(good.dtypes)["v"] == "double"
    assert sorted(r.id for r in bad.collect()) == [i for i in range(30) if i % 4 == 0] and bad.first().errors[0].path == "v"
    rates = error_rates(spark.readStream.schema(schema).parquet(folder("in")), node, "ts", "10 minutes", "1 minute")
    query = rates.writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.rows, r.invalid) for r in spark.sql("select * from rates order by window").collect()] == [(10, 3), (10, 2), (10, 3)]
