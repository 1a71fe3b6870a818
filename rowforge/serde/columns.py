"""The serde over DataFrame columns.

Records of flat fields are written and read by column: numpy places the bytes of one field of all rows of an Arrow batch at
once. Other schemas go row by row through ``Codec``, still in Arrow batches. Sizes, and integers at a constant offset, are
computed by built-in expressions alone.

VARIANT columns are tagged values; they travel to Python and back as JSON, so what JSON has no form for comes back as text or
as arrays. Their objects are written as maps from texts, for a schema that one executor makes up is not known to another. Arrays can be sets on the wire (``types={"tags": "set"}``); they come back without repetitions.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from datetime import datetime
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .codec import ELEMENTS, OBJECT, PACKED, Codec, encode_vector, packed_order
from .schema import BigInt, FieldSpec, Map, Registry, Schema, Set
from .wire import FIXED, U32, CodecError

#: The wire type of each Spark type.
_WIRE = {
    T.BooleanType: "boolean", T.ByteType: "int8", T.ShortType: "int16", T.IntegerType: "int32", T.LongType: "bigint", T.FloatType: "float64",
    T.DoubleType: "float64", T.StringType: "string", T.BinaryType: "bytes", T.TimestampType: "date", T.VariantType: "mixed", T.MapType: "map",
}
_SPARK = {
    "boolean": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "uint8": T.ShortType(), "uint16": T.IntegerType(),
    "uint32": T.LongType(), "bigint": T.LongType(), "float64": T.DoubleType(), "date": T.TimestampType(), "string": T.StringType(), "bytes": T.BinaryType(),
}


def wire_type(dtype: T.DataType, registry: Registry) -> str:
    """The wire type of a Spark type; structs are defined in the registry first, inner ones before outer ones."""
    if isinstance(dtype, T.StructType):
        return f"object({registry.define(specs_of(dtype, registry))})"
    if isinstance(dtype, T.ArrayType):
        return f"array<{wire_type(dtype.elementType, registry)}>"
    for kind, name in _WIRE.items():
        if isinstance(dtype, kind):
            return name
    raise CodecError(f"{dtype.simpleString()} has no wire type")


def specs_of(schema: T.StructType, registry: Registry, types: dict[str, str] | None = None, nullable: bool = True) -> list[FieldSpec]:
    """The fields of a struct; ``types`` names other wire types, say unsigned ones."""
    return [FieldSpec(f.name, (types or {}).get(f.name) or wire_type(f.dataType, registry), nullable and f.nullable) for f in schema.fields]


def spark_type(wire: str, registry: Registry) -> T.DataType:
    if wire in _SPARK:
        return _SPARK[wire]
    if wire.startswith("array<"):
        return T.ArrayType(spark_type(wire[6:-1], registry))
    if wire.startswith("object("):
        return struct_of(registry.schemas[int(wire[7:-1])], registry)
    if wire == "array":
        return T.ArrayType(T.DoubleType())
    if wire == "map":
        return T.MapType(T.StringType(), T.StringType())
    raise CodecError(f"{wire} has no column type")


def struct_of(schema: Schema, registry: Registry) -> T.StructType:
    return T.StructType([T.StructField(f.name, spark_type(f.type, registry), True) for f in schema.fields])


def is_flat(schema: Schema) -> bool:
    return all(t.base in FIXED or t.base in ("string", "bytes") for t in schema.types)


# -- by column

_NUMPY = {"boolean": "u1", "int8": "<i1", "int16": "<i2", "int32": "<i4", "uint8": "<u1", "uint16": "<u2", "uint32": "<u4", "float64": "<f8", "bigint": "<i8", "date": "<f8"}
_RANGE = {"int8": (-128, 127), "int16": (-32768, 32767), "int32": (-(1 << 31), (1 << 31) - 1), "uint8": (0, 255), "uint16": (0, 65535), "uint32": (0, (1 << 32) - 1)}


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places from begin on, size of them each."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, begins and sizes of a string or binary column without nulls."""
    array = array.cast(pa.large_binary())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets[:-1], np.diff(offsets)


def _fixed_matrix(base: str, array: pa.Array, name: str) -> np.ndarray:
    """The bytes of a fixed-width field, rows x width."""
    if base == "date":
        # microseconds become whole milliseconds, towards the past
        micros = array.cast(pa.timestamp("us", array.type.tz) if pa.types.is_timestamp(array.type) else pa.timestamp("us")).cast(pa.int64()).to_numpy(zero_copy_only=False)
        values = (micros // 1000).astype("<f8")
    else:
        values = array.to_numpy(zero_copy_only=False)
        if base in _RANGE and len(values) and not (values.min() >= _RANGE[base][0] and values.max() <= _RANGE[base][1]):
            raise CodecError(f"{name}: a value is no {base}")
        values = values.astype(_NUMPY[base])
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize)


def _varint_bytes(values: np.ndarray) -> np.ndarray:
    return 1 + sum((values >= np.uint64(1) << np.uint64(7 * k)).astype(np.int64) for k in range(1, 5))


def _put_varints(out: np.ndarray, place: np.ndarray, values: np.ndarray, size: np.ndarray) -> None:
    for k in range(5):
        some = size > k
        out[place[some] + k] = (values[some] >> np.uint64(7 * k) & np.uint64(0x7F)).astype(np.uint8) | np.where(size[some] > k + 1, 0x80, 0).astype(np.uint8)


def _need(place: np.ndarray, width, limit: np.ndarray) -> None:
    if len(place) and (place + width > limit).any():
        raise CodecError("truncated field")


def _varints_at(data: np.ndarray, place: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers at some places, and the places behind them."""
    value, open_ = np.zeros(len(place), np.uint64), np.ones(len(place), bool)
    for k in range(5):
        _need(place[open_], 1, limit[open_])
        b = np.where(open_, data[np.minimum(place, max(len(data) - 1, 0))], 0).astype(np.uint64)
        value |= (b & np.uint64(0x7F if k < 4 else 0x0F)) << np.uint64(7 * k)
        place = place + open_
        open_ &= b >= 0x80
        if not open_.any():
            return value, place
    raise CodecError("varint of more than 5 bytes")


def _zigzag(values: np.ndarray) -> np.ndarray:
    return ((values << 1) ^ (values >> 63)).astype(np.uint64)


def _unzigzag(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(1)).astype(np.int64) ^ -(values & np.uint64(1)).astype(np.int64)


_VARIABLE = ("int16", "int32", "uint16", "uint32")


def _field_writer(base: str, array: pa.Array, name: str, packed: bool):
    """The bytes that each value takes, and a function that puts them at their places."""
    if base in ("string", "bytes"):
        data, begin, length = _raw(array)
        size = length.astype(np.uint64)
        head = _varint_bytes(size)

        def put(out: np.ndarray, place: np.ndarray) -> None:
            _put_varints(out, place, size, head)
            out[_spread(place + head, length)] = data[_spread(begin, length)]

        return head + length, put
    matrix = _fixed_matrix(base, array, name)
    if packed and base in _VARIABLE:
        values = matrix.view(_NUMPY[base])[:, 0].astype(np.int64)
        values = _zigzag(values) if base[0] == "i" else values.astype(np.uint64)
        head = _varint_bytes(values)
        return head, lambda out, place: _put_varints(out, place, values, head)
    if packed and base == "float64":
        values = matrix.view("<f8")[:, 0]
        with np.errstate(invalid="ignore"):
            small = (values == np.floor(values)) & (values >= -(1 << 31)) & (values < 1 << 31)
        whole = _zigzag(np.where(small, values, 0).astype(np.int64))
        head = _varint_bytes(whole)

        def put(out: np.ndarray, place: np.ndarray) -> None:
            out[place] = ~small
            _put_varints(out, place[small] + 1, whole[small], head[small])
            out[place[~small][:, None] + np.arange(1, 9)] = matrix[~small]

        return 1 + np.where(small, head, 8), put

    def put(out: np.ndarray, place: np.ndarray) -> None:
        out[place[:, None] + np.arange(matrix.shape[1])] = matrix

    return np.full(len(matrix), matrix.shape[1]), put


def encode_flat(columns: dict[str, pa.Array], n: int, schema: Schema, packed: bool = False) -> pa.Array:
    """Frames of records of flat fields in the plain or the packed layout."""
    bitmap = np.zeros((n, schema.bitmap_bytes), np.uint8)
    names = [schema.fields[i].name for i in schema.booleans] if packed else []
    flags = np.zeros((n, -(-len(names) // 8)), np.uint8)
    head = 9 + schema.bitmap_bytes + flags.shape[1]
    at, writers = np.full(n, head, np.int64), []
    for spec in schema.fields:
        array = columns[spec.name]
        if spec.nullable:
            valid = array.is_valid().to_numpy(zero_copy_only=False)
            bit = schema.bits[spec.name]
            bitmap[valid, bit // 8] |= 1 << bit % 8
        elif array.null_count:
            raise CodecError(f"{spec.name} is null in a field that isn't nullable")
    for i, name in enumerate(names):
        flags[pc.fill_null(columns[name], False).to_numpy(zero_copy_only=False), i // 8] |= 1 << i % 8
    for spec, kind in packed_order(schema) if packed else zip(schema.fields, schema.types, strict=True):
        array = columns[spec.name]
        rows = np.flatnonzero(array.is_valid().to_numpy(zero_copy_only=False)) if spec.nullable else np.arange(n)
        size, put = _field_writer(kind.base, array.drop_null(), spec.name, packed)
        writers.append((rows, at[rows], put))
        at[rows] += size
    begin = np.cumsum(at) - at
    out = np.zeros(int(at.sum()), np.uint8)
    out[begin] = PACKED if packed else OBJECT
    for i, b in enumerate(U32.pack(schema.hash)):
        out[begin + 1 + i] = b
    out[begin[:, None] + np.arange(5, 9)] = (at - 9).astype("<u4").view(np.uint8).reshape(n, 4)
    out[begin[:, None] + np.arange(9, head)] = np.concatenate([bitmap, flags], axis=1)
    for rows, own, put in writers:
        put(out, begin[rows] + own)
    offsets = np.append(begin, len(out)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _read_fixed(data: np.ndarray, place: np.ndarray, limit: np.ndarray, base: str) -> np.ndarray:
    width = FIXED[base].size
    _need(place, width, limit)
    return np.ascontiguousarray(data[place[:, None] + np.arange(width)]).view(_NUMPY[base]).reshape(len(place))


def decode_flat(frames: pa.Array, schema: Schema, packed: bool = False) -> list[pa.Array]:
    """The fields of frames in the plain or the packed layout, all of this schema."""
    data, begin, size = _raw(frames)
    n = len(frames)
    end = begin + size
    if n and size.min() < 9:
        raise CodecError("truncated frame")
    head = data[begin[:, None] + np.arange(9)] if n else np.zeros((0, 9), np.uint8)
    if n and not (head[:, 0] == (PACKED if packed else OBJECT)).all():
        raise CodecError("a frame is no packed record" if packed else "a frame is no plain record")
    if n and not (np.ascontiguousarray(head[:, 1:5]).view("<u4")[:, 0] == schema.hash).all():
        raise CodecError("a frame has another schema")
    if n and not (np.ascontiguousarray(head[:, 5:9]).view("<u4")[:, 0].astype(np.int64) + 9 <= size).all():
        raise CodecError("truncated frame")
    booleans = schema.booleans if packed else []
    width = schema.bitmap_bytes + -(-len(booleans) // 8)
    at = begin + 9
    _need(at, width, end)
    bits = data[at[:, None] + np.arange(width)] if n else np.zeros((0, width), np.uint8)
    at = at + width
    found: dict[str, pa.Array] = {}
    valid_of = lambda spec: np.ones(n, bool) if (bit := schema.bits.get(spec.name)) is None else (bits[:, bit // 8] >> bit % 8 & 1).astype(bool)
    for i, k in enumerate(booleans):
        found[schema.fields[k].name] = pa.array((bits[:, schema.bitmap_bytes + i // 8] >> i % 8 & 1).astype(bool), mask=~valid_of(schema.fields[k]))
    for spec, kind in packed_order(schema) if packed else zip(schema.fields, schema.types, strict=True):
        valid = valid_of(spec)
        rows = np.flatnonzero(valid)
        place, limit = at[rows], end[rows]
        if kind.base not in FIXED:
            length, place = _varints_at(data, place, limit)
            length = length.astype(np.int64)
            _need(place, length, limit)
            at[rows] = place + length
            sizes = np.zeros(n, np.int64)
            sizes[rows] = length
            offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
            body = data[_spread(place, length)]
            mask = pa.py_buffer(np.packbits(valid, bitorder="little")) if not valid.all() else None
            array = pa.BinaryArray.from_buffers(pa.binary(), n, [mask, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))])
            found[spec.name] = array.cast(pa.string()) if kind.base == "string" else array
            continue
        if packed and kind.base in _VARIABLE:
            values, at[rows] = _varints_at(data, place, limit)
            values = _unzigzag(values) if kind.base[0] == "i" else values.astype(np.int64)
        elif packed and kind.base == "float64":
            _need(place, 1, limit)
            small = data[place] == 0 if len(place) else np.zeros(0, bool)
            values, behind = np.zeros(len(rows)), place + 9
            whole, behind[small] = _varints_at(data, place[small] + 1, limit[small])
            values[small] = _unzigzag(whole)
            values[~small] = _read_fixed(data, place[~small] + 1, limit[~small], "float64")
            at[rows] = behind
        else:
            values = _read_fixed(data, place, limit, kind.base)
            at[rows] += FIXED[kind.base].size
        full = np.zeros(n, values.dtype)
        full[rows] = values
        if kind.base == "date":
            if len(values) and not np.isfinite(values).all():
                raise CodecError(f"{spec.name}: no date")
            found[spec.name] = pa.array((full * 1000).astype(np.int64), mask=~valid).cast(pa.timestamp("us", "UTC"))
        else:
            found[spec.name] = pa.array(full.astype(bool) if kind.base == "boolean" else full, mask=~valid)
    return [found[f.name] for f in schema.fields]


# -- rows of Python values

def _plain(value: Any, dtype: T.DataType) -> Any:
    """A value of a column as the codec takes it."""
    if value is None:
        return None
    if isinstance(dtype, T.LongType):
        return BigInt(value)
    if isinstance(dtype, T.VariantType):
        return json.loads(value, object_pairs_hook=Map)
    if isinstance(dtype, T.ArrayType):
        return [_plain(v, dtype.elementType) for v in value]
    if isinstance(dtype, T.StructType):
        return {f.name: _plain(value[f.name], f.dataType) for f in dtype.fields}
    if isinstance(dtype, T.MapType):
        return Map((k, _plain(v, dtype.valueType)) for k, v in (value.items() if isinstance(value, dict) else value))
    return value


def _loose(value: Any, objects: bool = False) -> Any:
    """A decoded value as JSON: dates and bytes as text, maps and sets as arrays; with ``objects`` maps from texts as objects."""
    if isinstance(value, datetime):
        return value.isoformat()
    if isinstance(value, bytes):
        return value.hex()
    if isinstance(value, np.ndarray):
        return value.tolist()
    if isinstance(value, Map) and not (objects and all(isinstance(k, str) for k in value)):
        return [[_loose(k, objects), _loose(v, objects)] for k, v in value.items()]
    if isinstance(value, dict):
        return {k: _loose(v, objects) for k, v in value.items()}
    return [_loose(v, objects) for v in value] if isinstance(value, list | tuple) else value


def _arrow(value: Any, variant: bool) -> Any:
    """A decoded value as Arrow takes it."""
    if variant:
        return None if value is None else json.dumps(_loose(value, True), ensure_ascii=False)
    return list(value.items()) if isinstance(value, Map) else value


def _holds_variant(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_holds_variant(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _holds_variant(dtype.elementType)
    return _holds_variant(dtype.valueType) if isinstance(dtype, T.MapType) else isinstance(dtype, T.VariantType)


class RecordFormat:
    """A schema shared by driver and executors: the wire form of some columns of a DataFrame."""

    def __init__(self, schema: T.StructType, *, types: dict[str, str] | None = None, nullable: bool = True, compress: bool = False):
        self.registry = Registry()
        self.hash = self.registry.define(specs_of(schema, self.registry, types, nullable))
        self.schema, self.compress, self.struct = self.registry.schemas[self.hash], compress, schema
        self.flat, self.packed = is_flat(self.schema), compress and self.schema.compressible
        if any(_holds_variant(f.dataType) and not isinstance(f.dataType, T.VariantType) for f in schema.fields):
            raise CodecError("VARIANT inside another type has no column form; make the whole column a VARIANT")

    def encode(self, columns: dict[str, Column] | None = None) -> Column:
        """The frame of each row's record."""
        order = [f.name for f in self.schema.fields]
        sets = {f.name for f in self.schema.fields if f.type == "set"}
        schema, struct, flat, packed, registry, compress, hash_ = self.schema, self.struct, self.flat, self.packed, self.registry, self.compress, self.hash

        @F.arrow_udf("binary")
        def encode(*arrays: pa.Array) -> pa.Array:
            if flat:
                return encode_flat(dict(zip(order, arrays, strict=True)), len(arrays[0]), schema, packed)
            codec = Codec(registry, compress=compress)
            kinds = {f.name: f.dataType for f in struct.fields}
            lists = [[Set(v) if n in sets and v is not None else v for v in (_plain(v, kinds[n]) for v in a.to_pylist(maps_as_pydicts="strict"))] for n, a in zip(order, arrays, strict=True)]
            return pa.array([codec.encode(dict(zip(order, row, strict=True)), hash_) for row in zip(*lists, strict=True)], pa.binary())

        variants = {f.name for f in struct.fields if isinstance(f.dataType, T.VariantType)}
        values = {n: (columns or {}).get(n, F.col(f"`{n}`")) for n in order}
        return encode(*(F.to_json(v) if n in variants else v for n, v in values.items()))

    def decoded(self, df: DataFrame, column: str) -> DataFrame:
        """df with the record's fields in place of its frames; null frames give null fields."""
        names = [c for c in df.columns if c != column]
        by_name = {f.name: f.dataType for f in self.struct.fields}
        variants = {f.name for f in self.schema.fields if isinstance(by_name[f.name], T.VariantType)}
        fields = T.StructType([T.StructField(f.name, T.StringType() if f.name in variants else by_name[f.name]) for f in self.schema.fields])
        schema, flat, packed, registry = self.schema, self.flat, self.packed, self.registry
        out = T.StructType([*(df.schema[c] for c in names), *fields.fields])
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(fields)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = Codec(registry)
            for batch in batches:
                frames = batch.column(column)
                if flat and not frames.null_count:
                    arrays = decode_flat(frames, schema, packed)
                else:
                    rows = [codec.decode(b, schema=schema.hash) if b is not None else None for b in frames.to_pylist()]
                    arrays = [pa.array([None if r is None else _arrow(r[f.name], f.name in variants) for r in rows], f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(a.cast(f.type) for a, f in zip(arrays, arrow, strict=True))], names=out.names)

        back = df.mapInArrow(run, out)
        return back.select(*(F.parse_json(F.col(f"`{c}`")).alias(c) if c in variants else F.col(f"`{c}`") for c in out.names)) if variants else back

    def size(self, columns: dict[str, Column] | None = None) -> Column:
        """The bytes of a plain frame, by built-in expressions; -1 where a field's size takes writing it."""
        total = F.lit(9 + self.schema.bitmap_bytes)
        for spec, kind in zip(self.schema.fields, self.schema.types, strict=True):
            own = (columns or {}).get(spec.name, F.col(f"`{spec.name}`"))
            size = _field_size(own, kind)
            if size is None:
                return F.lit(-1)
            total = total + (F.coalesce(size, F.lit(0)) if kind.base not in FIXED else F.when(own.isNotNull(), size).otherwise(0) if spec.nullable else size)
        return total

    def extract(self, frame: Column, name: str) -> Column:
        """One field of a frame. Integers behind fixed fields that are never null are cut out by built-in expressions."""
        at, index = 9 + self.schema.bitmap_bytes, None
        constant = True
        for i, (spec, kind) in enumerate(zip(self.schema.fields, self.schema.types, strict=True)):
            if spec.name == name:
                index = i
                break
            constant &= kind.base in FIXED and not spec.nullable
            at += FIXED[kind.base].size if kind.base in FIXED else 0
        if index is None:
            return F.lit(None)
        spec, kind = self.schema.fields[index], self.schema.types[index]
        if constant and not self.packed and kind.base in _NUMPY and kind.base not in ("float64", "date"):
            value = little_endian(frame, at, FIXED[kind.base].size, signed=kind.base in ("int8", "int16", "int32", "bigint"))
            value = value == 1 if kind.base == "boolean" else value.cast(_SPARK[kind.base])
            bit = self.schema.bits.get(name)
            if bit is not None:
                value = F.when(little_endian(frame, 9 + bit // 8, 1).bitwiseAND(1 << bit % 8) != 0, value)
            right = (F.substring(frame, 1, 5) == F.lit(bytes((OBJECT,)) + U32.pack(self.hash))) & (F.octet_length(frame) >= at + FIXED[kind.base].size)
            return F.when(right, value)
        registry, target = self.registry, spark_type(spec.type, self.registry)
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = to_arrow_type(target)

        @F.arrow_udf(target)
        def extract(frames: pa.Array) -> pa.Array:
            codec = Codec(registry)
            return pa.array([None if b is None else codec.extract(b, name) for b in frames.to_pylist()], arrow)

        return extract(frame)


def little_endian(value: Column, at: int, width: int, signed: bool = False) -> Column:
    """The integer of some bytes of a binary column."""
    digits = F.concat(*(F.hex(F.substring(value, at + i + 1, 1)) for i in reversed(range(width))))
    if width == 8:
        high = F.conv(F.substring(digits, 1, 8), 16, 10).cast("long")
        low = F.conv(F.substring(digits, 9, 8), 16, 10).cast("long")
        return F.shiftleft(high, 32).bitwiseOR(low)
    number = F.conv(digits, 16, 10).cast("long")
    return F.when(number >= 1 << 8 * width - 1, number - (1 << 8 * width)).otherwise(number) if signed else number


def varint_length(n: Column) -> Column:
    return functools.reduce(lambda otherwise, k: F.when(n < 1 << 7 * k, k).otherwise(otherwise), range(4, 0, -1), F.lit(5))


def _field_size(value: Column, kind) -> Column | None:
    if kind.base in FIXED:
        return F.lit(FIXED[kind.base].size)
    if kind.base in ("string", "bytes"):
        return varint_length(F.octet_length(value)) + F.octet_length(value)
    if kind.base == "array" and kind.element is not None:
        if kind.element.base in FIXED:
            return varint_length(F.size(value)) + F.size(value) * FIXED[kind.element.base].size
        if kind.element.base == "string":
            sizes = F.transform(value, lambda x: varint_length(F.octet_length(x)) + F.octet_length(x))
            return varint_length(F.size(value)) + F.aggregate(sizes, F.lit(0), lambda a, x: a + x)
    return None


def decode_json(frame: Column, registry: Registry | None = None) -> Column:
    """Tagged values, and records of known schemas, as JSON text; what can't be read is null."""

    def one(codec: Codec, data: bytes | None) -> str | None:
        try:
            return None if data is None else json.dumps(_loose(codec.decode(data)), ensure_ascii=False)
        except CodecError:
            return None

    @F.arrow_udf("string")
    def decode(frames: pa.Array) -> pa.Array:
        codec = Codec(registry)
        return pa.array([one(codec, x) for x in frames.to_pylist()], pa.string())

    return decode(frame)


def split_frames(df: DataFrame, column: str, registry: Registry) -> DataFrame:
    """A row for each value of concatenated ones: the offset and the value's own bytes in place of the column."""
    names = [c for c in df.columns if c != column]
    out = T.StructType([*(df.schema[c] for c in names), T.StructField("offset", T.LongType()), T.StructField("frame", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(registry)
        for batch in batches:
            rows, at, frames = [], [], []
            for i, data in enumerate(batch.column(column).to_pylist()):
                starts = [offset for offset, _ in codec.frames(data or b"")]
                for a, b in zip(starts, [*starts[1:], len(data or b"")], strict=True):
                    rows.append(i)
                    at.append(a)
                    frames.append(data[a:b])
            index = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(pc.take(batch.column(c), index) for c in names), pa.array(at, pa.int64()), pa.array(frames, pa.binary())], names=out.names)

    return df.mapInArrow(run, out)


_VECTOR = {T.FloatType: "<f4", T.DoubleType: "<f8", T.ByteType: "<i1", T.ShortType: "<i2", T.IntegerType: "<i4", T.LongType: "<i8"}


def vector_element(dtype: T.ArrayType) -> str:
    """The element type of vectors from an array column; a plan-time decision."""
    for kind, name in _VECTOR.items():
        if isinstance(dtype.elementType, kind):
            return name
    raise CodecError(f"{dtype.simpleString()} holds no vectors")


def encode_tagged(value: Column, dtype: T.DataType) -> Column:
    """Values without a schema: each with its tag, arrays of numbers packed, objects by a schema of their own shape."""
    variant = isinstance(dtype, T.VariantType)

    @F.arrow_udf("binary")
    def encode(values: pa.Array) -> pa.Array:
        codec = Codec()
        return pa.array([codec.encode(_plain(v, dtype)) for v in values.to_pylist(maps_as_pydicts="strict")], pa.binary())

    return encode(F.to_json(value) if variant else value)


def value_length(frames: Column) -> Column:
    """The bytes of the first value, found without decoding it; null where it isn't whole."""

    @F.arrow_udf("long")
    def length(values: pa.Array) -> pa.Array:
        codec, out = Codec(), []
        for data in values.to_pylist():
            try:
                out.append(codec.skip(data) if data else None)
            except CodecError:
                out.append(None)
        return pa.array(out, pa.int64())

    return length(frames)


def encode_vectors(value: Column, element: str) -> Column:
    """Arrays as vectors of an element type behind their header. All elements of a batch are converted at once."""
    head = np.frombuffer(encode_vector(np.zeros(0, element)), np.uint8)
    width = np.dtype(element).itemsize

    @F.arrow_udf("binary")
    def encode(arrays: pa.Array) -> pa.Array:
        n = len(arrays)
        sizes = pc.fill_null(pc.list_value_length(arrays), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        items = arrays.flatten()
        if items.null_count:
            raise CodecError("a vector has no nulls")
        body = items.to_numpy(zero_copy_only=False).astype(element).view(np.uint8)
        valid = arrays.is_valid().to_numpy(zero_copy_only=False)
        total = np.where(valid, 4 + sizes * width, 0)
        ends = np.cumsum(total)
        begin = ends - total
        out = np.zeros(int(ends[-1]) if n else 0, np.uint8)
        out[begin[valid][:, None] + np.arange(4)] = head
        out[_spread(begin[valid] + 4, sizes[valid] * width)] = body
        mask = None if valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little"))
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [mask, pa.py_buffer(np.append(0, ends)), pa.py_buffer(out)]).cast(pa.binary())

    return encode(value)


def decode_vectors(value: Column, element: str) -> Column:
    """Vectors of one element type as arrays; null where bytes are no such vector."""
    spark = {"f4": "float", "f8": "double", "i1": "tinyint", "i2": "smallint", "i4": "int", "i8": "bigint", "u1": "smallint", "u2": "int", "u4": "bigint"}[element[1:]]
    item = pa.from_numpy_dtype(np.dtype({"u1": "i2", "u2": "i4", "u4": "i8"}.get(element[1:], element)))
    width, head = np.dtype(element).itemsize, encode_vector(np.zeros(0, element))[:2]

    @F.arrow_udf(f"array<{spark}>")
    def decode(frames: pa.Array) -> pa.Array:
        n = len(frames)
        known = pc.fill_null(frames, b"")
        data, begin, size = _raw(known)
        right = (size >= 4) & ((size - 4) % width == 0)
        at = np.where(right, begin, 0)
        for i, b in enumerate(head):
            right &= (data[at + i] == b) if len(data) > i else False
        count = np.where(right, (size - 4) // width, 0)
        body = np.ascontiguousarray(data[_spread(begin[right] + 4, count[right] * width)]).view(element)
        offsets = np.append(0, np.cumsum(count)).astype(np.int32)
        mask = None if right.all() else pa.py_buffer(np.packbits(right, bitorder="little"))
        items = pa.array(body).cast(item)
        return pa.Array.from_buffers(pa.list_(item), n, [mask, pa.py_buffer(offsets)], children=[items])

    return decode(value)


__all__ = ["ELEMENTS", "RecordFormat", "decode_flat", "decode_json", "decode_vectors", "encode_flat", "encode_tagged", "encode_vectors", "little_endian", "specs_of", "split_frames", "struct_of", "value_length", "vector_element", "wire_type"]
