"""Golden frames, round trips, damaged bytes, registries and columns."""

import random
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowforge.serde import BigInt, Clamped, Codec, CodecError, FieldSpec, Map, Registry, Set, decode_vector, encode_vector, vector_kind
from rowforge.serde.columns import RecordFormat, decode_flat, decode_json, split_frames
from rowforge.serde.schema import shape_hash

GOLDEN = [
    ({"name": "Alice"}, False, 2719591872, "08c0ad19a20600000005416c696365"),
    ({"active": True, "age": 30, "name": "Alice"}, False, 597032645, "08c5fe952308000000011e05416c696365"),
    ({"active": True, "age": 30, "name": "Alice"}, True, 597032645, "12c5fe952308000000011e05416c696365"),
    ({"active": True, "age": 30, "email": "alice@test.com", "name": "Alice", "role": "admin", "score": 99.5}, False, 1870306792, "08e89d7a6f25000000011e0e616c69636540746573742e636f6d05416c6963650561646d696e0000000000e05840"),
]
VALUES = [
    None, True, False, 0, 255, 256, 65536, -1, 2**31, -(2**31), 1.5, -0.0, 1e300, "", "héllo", "x" * 300, b"", b"ab", datetime(2024, 1, 1, tzinfo=UTC),
    [], [1, 2], [1, 300], [0.5, 1], [1, "a", None], [-0.0, 1], Map({1: "a", "b": [1]}), Set([1, "x"]), BigInt(2**62), np.array([1.5, 2], np.float32),
    Clamped(b"ab"), {"a": {"b": [{"c": 1}]}, "f": 2.5, "n": None},
]


def same(a, b):
    return np.array_equal(a, b) and a.dtype == b.dtype if isinstance(a, np.ndarray) else a == b


@pytest.mark.parametrize(("value", "compress", "hash_", "expected"), GOLDEN)
def test_golden(value, compress, hash_, expected):
    codec = Codec(compress=compress)
    data = codec.encode(value)
    assert data.hex() == expected and codec.registry.infer(value).hash == hash_ and codec.decode(data) == value
    assert codec.extract(data, "name") == "Alice" and codec.extract(data, "nothing") is None
    assert codec.size(value) == len(bytes.fromhex(expected))


@pytest.mark.parametrize("compress", [False, True])
@pytest.mark.parametrize("value", VALUES, ids=repr)
def test_round_trip_and_truncation(value, compress):
    codec = Codec(compress=compress)
    data = codec.encode(value)
    assert same(codec.decode(data), value)
    assert codec.size(value) in (len(data), -1) or compress
    for n in range(1, len(data)):
        with pytest.raises(CodecError):
            codec.decode(data[:n])


def test_packed_fields():
    codec = Codec(compress=True)
    names = "abcdefgh"
    hash_ = codec.define_schema([FieldSpec(n, k, True) for n, k in zip(names, ("uint16", "int32", "float64", "boolean", "uint32", "string", "array<int16>", "bigint"), strict=True)])
    for row in ([128, -1, 72.0, True, 2**32 - 1, "x", [1, -2], BigInt(5)], [None] * 8, [16384, -(2**31), 2.718, False, 0, "", [], BigInt(-1)], [0, 2**31 - 1, 1e10, True, 2**28, "é", [0], BigInt(2**63 - 1)]):
        value = dict(zip(names, row, strict=True))
        data = codec.encode(value, hash_)
        assert data[0] == 18 and codec.decode(data) == value and Codec(codec.registry).extract(data, "f") == value["f"]


def test_typed_objects_and_arrays():
    codec = Codec()
    inner = codec.define_schema([FieldSpec("city", "string"), FieldSpec("zip", "string")])
    outer = codec.define_schema([FieldSpec("home", f"object({inner})"), FieldSpec("others", f"array<object({inner})>"), FieldSpec("tags", "array<string>"), FieldSpec("deep", "array<array<uint8>>")])
    value = {"deep": [[1], []], "home": {"city": "N", "zip": "1"}, "others": [{"city": "x" * 200, "zip": ""}], "tags": ["a", "é"]}
    data = codec.encode(value)
    assert int.from_bytes(data[1:5], "little") == outer and codec.decode(data) == value
    assert codec.extract(data, "tags") == ["a", "é"]
    # an inner schema that is not known yet is written as a whole frame
    late = Codec()
    h = late.define_schema([FieldSpec("home", f"object({inner})")])
    data = late.encode({"home": {"city": "N", "zip": "1"}}, h)
    assert data[9] == 8 and late.decode(data) == {"home": {"city": "N", "zip": "1"}}


def test_random_records():
    rng = random.Random(3)

    def value(depth=0):
        kinds = [lambda: rng.randint(-(2**31), 2**31 - 1), lambda: rng.random() * 10**rng.randint(-5, 300), lambda: "".join(rng.choice("aé😀 \n") for _ in range(rng.randint(0, 40))), lambda: rng.random() < 0.5, lambda: bytes(rng.randrange(256) for _ in range(rng.randint(0, 9)))]
        if depth < 3:
            kinds += [lambda: [value(depth + 1) for _ in range(rng.randint(0, 4))], lambda: {f"f{rng.randint(0, 9)}": value(depth + 1) for _ in range(rng.randint(0, 4))}]
        return rng.choice(kinds)()

    for compress in (False, True):
        codec = Codec(compress=compress)
        data = b""
        values = [value() for _ in range(200)]
        for v in values:
            data += codec.encode(v)
        assert [v for _, v in codec.frames(data)] == values


def test_limits():
    codec = Codec()
    with pytest.raises(CodecError):
        codec.define_schema([FieldSpec("bad name", "string")])
    with pytest.raises(CodecError):
        codec.define_schema([FieldSpec("a", "text")])
    with pytest.raises(CodecError):
        codec.define_schema([FieldSpec(f"f{i}", "string", True) for i in range(17)])
    with pytest.raises(CodecError):
        codec.encode(BigInt(2**63))
    deep = None
    for _ in range(70):
        deep = [deep]
    with pytest.raises(CodecError):
        codec.decode(codec.encode(deep))
    for data in (bytes([19]), bytes([7, 255, 255, 255, 255]), bytes([8, 1, 2, 3, 4, 0, 0, 0, 0]), bytes([17, 11, 0, 0, 0, 0]), bytes([17, 0, 3, 0, 0, 0, 1, 2, 3])):
        with pytest.raises(CodecError):
            codec.decode(data)
    h = codec.define_schema([FieldSpec("a", "uint8")])
    with pytest.raises(CodecError):
        codec.encode({"a": "x"}, h)
    with pytest.raises(CodecError):
        codec.decode(b"\0", schema=12345)


def test_registry_and_store():
    class Kept(dict):
        def set(self, hash_, fields):
            self[hash_] = fields

    kept = Kept()
    writer = Codec(store=kept)
    data = writer.encode({"a": 1, "b": "x"})
    assert Codec(store=kept).decode(data) == {"a": 1, "b": "x"}
    blob = writer.registry.to_bytes()
    reader = Registry()
    reader.load(blob)
    assert reader.to_bytes() == blob and Codec(reader).decode(data) == {"a": 1, "b": "x"}
    for n in range(len(blob)):
        with pytest.raises(CodecError):
            Registry().load(blob[:n])
    with pytest.raises(CodecError):
        Registry().load((1025).to_bytes(2, "little"))
    assert shape_hash(["x", "y"], ["float64", "float64"]) == 3471888508


def test_vectors():
    for i, dtype in enumerate(("<f4", "<f8", "<i1", "<i2", "<i4", "<u1", None, "<u2", "<u4", "<i8", "<u8")):
        v = np.array([0, 1, 2], dtype) if dtype else Clamped(b"\0\1\2")
        data = encode_vector(v)
        assert data[:4] == bytes((0x54, i, 0, 0)) and same(decode_vector(data), v) and vector_kind(v) == i
    assert vector_kind([1]) == -1 and encode_vector(np.array([True])) is None
    assert all(decode_vector(x) is None for x in (None, b"", b"\x54\x0b\0\0", b"\x54\0\0\0\1", b"\x00\0\0\0"))


def test_columns(spark):
    rows = [(1, "a", 1.5, True, datetime(2024, 1, 1), b"x", [1, 2], {"k": 1}), (2, None, None, None, None, None, None, None), (3, "é" * 100, float("nan"), False, datetime(1969, 12, 31, 23, 59), b"", [], {})]
    df = spark.createDataFrame(rows, "id long, s string, d double, b boolean, t timestamp, y binary, l array<int>, m map<string,long>")
    for columns, compress in ((df.columns, False), (df.columns, True), (["id", "s", "d", "b", "t", "y"], False)):
        part = df.select(*columns)
        form = RecordFormat(part.schema, compress=compress)
        assert form.flat == (len(columns) == 6)
        frames = part.select(form.encode().alias("frame"))
        back = form.decoded(frames, "frame").select(*columns)
        assert sorted(map(str, back.collect())) == sorted(map(str, part.collect()))
        if form.flat:  # the bytes by column are those by row
            codec = Codec(form.registry)
            got = [bytes(r.frame) for r in frames.collect()]
            assert [codec.encode({**codec.decode(x)}, form.hash) for x in got] == got
            extracted = frames.select(*(form.extract(F.col("frame"), c).alias(c) for c in columns))
            assert sorted(map(str, extracted.collect())) == sorted(map(str, part.collect()))
            sizes = part.select(F.octet_length(form.encode()).alias("w"), form.size().alias("c")).collect()
            assert all(r.w == r.c for r in sizes)
    form = RecordFormat(df.select("id", "s").schema)
    split = split_frames(df.select(F.concat(form.encode(), form.encode()).alias("x")), "x", form.registry)
    assert form.decoded(split, "frame").select("id").distinct().count() == 3 and split.count() == 6
    assert spark.createDataFrame([(Codec().encode([1, "a"]),), (b"\x63",), (None,)], "x binary").select(decode_json(F.col("x"))).collect() == [('[1, "a"]',), (None,), (None,)]


def test_damaged_columns(spark):
    df = spark.createDataFrame([(1, "abc")], "id long, s string")
    form = RecordFormat(df.schema)
    frame = bytes(df.select(form.encode()).first()[0])
    for n in (0, 5, 9, 12, len(frame) - 1):
        with pytest.raises(Exception, match="truncated|past|frame"):
            form.decoded(spark.createDataFrame([(frame[:n],)], "frame binary"), "frame").collect()


def test_skip_is_where_reading_ends():
    """Of values of every kind, and of each of their beginnings, which aren't whole."""
    codec = Codec()
    inner = {"a": 1, "b": "x", "c": [1, "y", None]}
    values = [None, True, 5, -7, 70_000, 0.5, BigInt(1 << 40), "", "é", b"ab", [1, 2, 3], [300, 1], [0.5, 2], ["a", None, [1, [2]]], [], Map([("k", [1, Map()])]), Set([1, "x"]), inner, [inner, inner], datetime(2024, 1, 1, tzinfo=UTC), np.arange(3, dtype="<f4")]
    for value in values:
        data = codec.encode(value)
        assert codec.skip(data) == len(data) and codec.skip(b"\x00" + data + b"rest", 1) == len(data) + 1
        for n in range(len(data)):
            with pytest.raises(CodecError):
                codec.skip(data[:n])
    assert codec.skip(Codec().encode({"unknown": 1})) > 9
    with pytest.raises(CodecError):
        codec.skip(b"\x63")
    with pytest.raises(CodecError):
        codec.skip(b"\x07\x01\x00\x00\x00" * 5000)


@pytest.mark.parametrize("compress", [False, True])
def test_columns_write_what_the_codec_writes(spark, compress):
    """Frames made by column are those made value by value, and are read back; with nulls, limits and every flat type."""
    rng = random.Random(4)
    schema = T.StructType([T.StructField(n, t) for n, t in (("a", T.BooleanType()), ("b", T.ShortType()), ("c", T.IntegerType()), ("d", T.LongType()), ("e", T.DoubleType()), ("f", T.StringType()), ("g", T.BinaryType()), ("h", T.BooleanType()), ("i", T.ByteType()))])
    choices = [
        [True, False], [0, -1, 1, 63, -64, 64, -32768, 32767], [0, 8191, -8192, 1 << 20, -(1 << 31), (1 << 31) - 1], [0, -1, 1 << 62], [0.0, 0.5, -3.0, 2.0**31, -(2.0**31), 1e300, 127.0, float("inf")],
        ["", "é", "x" * 127, "y" * 128, "z" * 20_000], [b"", b"\x00\xff"], [True, False], [-128, 127, 0],
    ]
    rows = [tuple(rng.choice([*c, None]) for c in choices) for _ in range(300)]
    df = spark.createDataFrame(rows, schema).repartition(2)
    form = RecordFormat(schema, compress=compress)
    assert form.flat and form.packed == compress
    stored = df.withColumn("frame", form.encode())
    codec = Codec(form.registry, compress=compress)
    for r in stored.collect():
        value = {f.name: BigInt(r[f.name]) if f.name == "d" and r.d is not None else bytes(r.g) if f.name == "g" and r.g is not None else r[f.name] for f in schema}
        assert bytes(r.frame) == codec.encode(value, form.hash)
    back = form.decoded(stored.select("frame"), "frame").select(*schema.names)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    frames = pa.array([bytes(r.frame) for r in stored.limit(20).collect()], pa.binary())
    for cut in (1, 5, 9, 10, 12, 15):
        with pytest.raises(CodecError):
            decode_flat(pa.array([frames[0].as_py()[:cut]], pa.binary()), form.schema, compress)
    with pytest.raises(CodecError):
        decode_flat(frames, form.schema, not compress)
