"""Record validation: a record type and a DataFrame's columns become ``struct<ok, data, errors>`` in built-in expressions.

``errors`` has ``{message, path}`` of every field that fails, fields in order of their names; arrays and records report their
first failing item. ``data`` has the declared fields alone, numbers and booleans coerced. Two inputs are taken: typed columns,
where null stands for a missing value of an optional field and for null of a nullable one; and VARIANT values, say of parsed
JSON, where a missing field and a null are told apart.

Fixed by the type, so decided on the driver: which tests a column needs, all messages and all static paths.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowforge.functions import Check
from rowforge.functions.numbers import is_finite
from rowforge.types import Node

from .coerce import text_to_boolean, text_to_number, to_boolean, to_number

ERROR = T.StructType([T.StructField("message", T.StringType()), T.StructField("path", T.StringType())])
_ERRORS = T.ArrayType(ERROR, True)
_VARIANT = T.VariantType()
#: What a value of each kind is told when it isn't one.
MESSAGES = {
    "string": "must be a string", "number": "must be a number", "integer": "must be an integer", "bigint": "must be a bigint",
    "boolean": "must be true or false", "date": "invalid date type", "literal": "invalid literal type", "enum": "invalid enum type",
    "null": "invalid null type", "array": "must be an array", "tuple": "invalid tuple type", "object": "must be an object",
    "record": "invalid record type", "union": "invalid union type",
}


@dataclass(frozen=True)
class Path:
    """Where a value stands: static names, and behind them perhaps an array index or a record's key, which is a column."""

    names: tuple[str, ...] = ()
    index: Column | None = None
    key: Column | None = None

    def child(self, name: str) -> Path:
        return Path((*self.names, name))

    def column(self) -> Column:
        static = ".".join(self.names)
        if self.index is not None:
            return F.concat(F.lit(f"{static}["), self.index.cast("string"), F.lit("]"))
        if self.key is not None:
            return F.concat(F.lit(f"{static}." if static else ""), self.key)
        return F.lit(static)

    def message_key(self) -> str:
        return "" if self.index is not None or self.key is not None else ".".join(self.names)


@dataclass(frozen=True)
class Rules:
    """Messages by path, and checks by brand and by field."""

    messages: Mapping[str, str] = field(default_factory=dict)
    brands: Mapping[str, Sequence[Check]] = field(default_factory=dict)
    fields: Mapping[str, Sequence[Check]] = field(default_factory=dict)


def _no_errors() -> Column:
    return F.array().cast(_ERRORS)


def _error(message: Column | str, path: Path) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    return F.struct(message.alias("message"), path.column().alias("path"))


def _one(node_message: str, path: Path, rules: Rules) -> Column:
    return F.array(_error(rules.messages.get(path.message_key(), node_message), path)).cast(_ERRORS)


def _first(errors_of_items: Column) -> Column:
    return F.coalesce(F.get(F.filter(errors_of_items, lambda e: F.size(e) > 0), F.lit(0)), _no_errors())


def _is_variant(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.VariantType)


class _Shaped(T.VariantType):
    """The type of a variant whose shape, what ``schema_of_variant`` says, is already at hand."""

    def __init__(self, shape: Column):
        self.shape = shape


def _bound(values: dict[str, Column], build) -> Column:
    """build over values that are computed once, however often it uses them: Spark shares nothing between branches."""
    return F.get(F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), lambda x: build(*(x.getField(k) for k in values))), F.lit(0))


def _with_shape(value: Column, dtype: T.DataType, build) -> Column:
    """build(value, dtype), where a variant's shape is found once."""
    if not _is_variant(dtype) or isinstance(dtype, _Shaped):
        return build(value, dtype)
    return _bound({"v": value, "shape": F.schema_of_variant(value)}, lambda v, shape: build(v, _Shaped(shape)))


def _variant_type(value: Column, dtype: T.DataType) -> Column:
    return dtype.shape if isinstance(dtype, _Shaped) else F.schema_of_variant(value)


def _get(value: Column, dtype: str) -> Column:
    return F.try_variant_get(value, "$", dtype)


def _is_null(value: Column, dtype: T.DataType) -> Column:
    return F.coalesce(F.is_variant_null(value), F.lit(False)) if _is_variant(dtype) else value.isNull()


def _is(kind: str, value: Column, dtype: T.DataType) -> Column:
    """Whether a value is of a kind without coercion. Null and missing values are of none."""
    if _is_variant(dtype):
        shape = _variant_type(value, dtype)
        tests = {
            "string": shape == "STRING",
            "number": shape.isin("BIGINT", "DOUBLE", "FLOAT") | shape.startswith("DECIMAL"),
            "bigint": shape == "BIGINT",
            "boolean": shape == "BOOLEAN",
            "date": shape.startswith("TIMESTAMP") | (shape == "DATE"),
            "array": shape.startswith("ARRAY"),
            "object": shape.startswith("OBJECT"),
        }
        return F.coalesce(tests[kind], F.lit(False))
    types = {
        "string": T.StringType, "number": T.NumericType, "bigint": T.LongType, "boolean": T.BooleanType,
        "date": (T.TimestampType, T.TimestampNTZType, T.DateType), "array": T.ArrayType, "object": (T.StructType, T.MapType),
    }
    return value.isNotNull() if isinstance(dtype, types[kind]) else F.lit(False)


def _number(value: Column, dtype: T.DataType) -> Column:
    if not _is_variant(dtype):
        return to_number(value, dtype)
    shape = _variant_type(value, dtype)
    return (
        F.when(_is("number", value, dtype) | (shape == "BOOLEAN"), _get(value, "double"))
        .when(shape == "STRING", text_to_number(_get(value, "string")))
        .when(shape.startswith("TIMESTAMP"), F.unix_millis(_get(value, "timestamp")).cast("double"))
    )


def _boolean(value: Column, dtype: T.DataType) -> Column:
    if not _is_variant(dtype):
        return to_boolean(value, dtype)
    number = _get(value, "double")
    return (
        F.when(_is("boolean", value, dtype), _get(value, "boolean"))
        .when(_is("number", value, dtype), F.when(number == 1, F.lit(True)).when(number == 0, F.lit(False)))
        .when(_is("string", value, dtype), text_to_boolean(_get(value, "string")))
    )


def _finite(number: Column, dtype: T.DataType) -> Column:
    exact = isinstance(dtype, T.IntegralType | T.DecimalType)
    return F.coalesce(number.isNotNull() if exact else is_finite(number), F.lit(False))


def _equals(value: Column, dtype: T.DataType, literal) -> Column:
    """Strict equality: of the same kind and the same value."""
    kind = "boolean" if isinstance(literal, bool) else "number" if isinstance(literal, int | float) else "string"
    if isinstance(literal, int) and not isinstance(literal, bool) and isinstance(dtype, T.LongType):
        return F.coalesce(value == literal, F.lit(False))
    typed = _get(value, {"boolean": "boolean", "number": "double", "string": "string"}[kind]) if _is_variant(dtype) else value
    if not _is_variant(dtype) and not isinstance(dtype, {"boolean": T.BooleanType, "number": T.NumericType, "string": T.StringType}[kind]):
        return F.lit(False)
    return _is(kind, value, dtype) & F.coalesce(typed == F.lit(literal), F.lit(False))


def _any(tests: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a | b, tests, F.lit(False))


def _items(value: Column, dtype: T.DataType) -> tuple[Column, T.DataType]:
    return (_get(value, "array<variant>"), _VARIANT) if _is_variant(dtype) else (value, dtype.elementType)


def _field(value: Column, dtype: T.DataType, name: str) -> tuple[Column, T.DataType] | None:
    """A field of an object, or None if a typed struct has none of that name."""
    if _is_variant(dtype):
        quoted = name.replace("\\", "\\\\").replace("'", "\\'")
        return F.try_variant_get(value, f"$['{quoted}']", "variant"), _VARIANT
    if isinstance(dtype, T.MapType):
        return F.try_element_at(value, F.lit(name)), dtype.valueType
    found = [f for f in dtype.fields if f.name == name]
    return (value.getField(name), found[0].dataType) if found else None


def _missing(dtype: T.DataType) -> tuple[Column, T.DataType]:
    return F.lit(None).cast("string"), T.StringType()


def _brand_errors(node: Node, value: Column, dtype: T.DataType, path: Path, rules: Rules) -> Column | None:
    checks = rules.brands.get(node.brand or "", ())
    if not checks:
        return None
    # brands speak for themselves: messages by path don't replace theirs
    found = [check.error(value, dtype) for check in checks]
    return F.filter(F.array(*(F.when(e.isNotNull(), _error(e, path)) for e in found)), lambda e: e.isNotNull()).cast(_ERRORS)


def errors_of(node: Node, value: Column, dtype: T.DataType, path: Path, rules: Rules) -> Column:
    """The errors of a present value, an array that is never null."""
    if node.kind in ("any", "never"):
        return _no_errors()
    if node.kind in ("number", "boolean", "literal", "enum", "tuple", "union"):  # these ask for the shape more than once
        return _with_shape(value, dtype, lambda v, d: _errors_of(node, v, d, path, rules))
    return _errors_of(node, value, dtype, path, rules)


def _errors_of(node: Node, value: Column, dtype: T.DataType, path: Path, rules: Rules) -> Column:
    kind = node.kind
    literal = kind == "boolean" and (node.optional or node.nullable)  # true, false and no third value: a union of literals
    message = MESSAGES["integer" if kind == "number" and node.brand == "integer" else "literal" if literal else kind]
    wrong = _one(message, path, rules)
    rest: Column | None = None
    if kind == "string":
        right = _is("string", value, dtype)
        rest = _brand_errors(node, _get(value, "string") if _is_variant(dtype) else value, T.StringType(), path, rules)
    elif kind == "number" and isinstance(dtype, _Shaped):
        typed = replace(node, nullable=False)
        found = _bound({"n": _number(value, dtype)}, lambda n: _errors_of(typed, n, T.DoubleType(), path, rules))
        return F.when(_is_null(value, dtype), _no_errors()).otherwise(found) if node.nullable else found
    elif kind == "number":
        number = _number(value, dtype)
        ntype = dtype if isinstance(dtype, T.NumericType) else T.DoubleType()
        right = _finite(number, ntype)
        if node.brand == "integer" and not isinstance(ntype, T.IntegralType):
            right = right & F.coalesce(number == (F.round(number) if isinstance(ntype, T.DecimalType) else F.rint(number)), F.lit(False))
        rest = _brand_errors(node, number, ntype, path, rules)
    elif kind in ("bigint", "date"):
        right = _is(kind, value, dtype)
    elif kind == "boolean":
        right = _is("boolean", value, dtype) if literal else _boolean(value, dtype).isNotNull()
    elif kind in ("literal", "enum"):
        right = _any([_equals(value, dtype, x) for x in node.literals])
    elif kind == "null":
        right = _is_null(value, dtype)
    elif kind == "array":
        right = _is("array", value, dtype)
        if _is_variant(dtype) or isinstance(dtype, T.ArrayType):
            items, itype = _items(value, dtype)
            rest = _first(F.transform(items, lambda x, i: errors_of(node.item, x, itype, Path(path.names, index=i), rules)))
    elif kind == "tuple":
        least, most = sum(not x.optional for x in node.items), len(node.items)
        if isinstance(dtype, T.StructType):
            right = value.isNotNull() if least <= len(dtype.fields) <= most else F.lit(False)
            parts = [(value.getField(f.name), f.dataType) for f in dtype.fields[:most]]
            size = F.lit(len(dtype.fields))
        elif _is_variant(dtype) or isinstance(dtype, T.ArrayType):
            items, itype = _items(value, dtype)
            size = F.size(items)
            right = _is("array", value, dtype) & F.coalesce(size.between(least, most), F.lit(False))
            parts = [(F.get(items, F.lit(i)), itype) for i in range(most)]
        else:
            right, parts, size = F.lit(False), [], F.lit(0)
        of = [errors_of(x, *p, Path((*path.names, f"[{i}]")), rules) for i, (x, p) in enumerate(zip(node.items, parts, strict=False))]
        rest = _all([F.when(size > i, e).otherwise(_no_errors()) if node.items[i].optional else e for i, e in enumerate(of)])
    elif kind == "object":
        right = _is("object", value, dtype)
        if _is_variant(dtype) or isinstance(dtype, T.StructType | T.MapType):
            rest = _all(_field_errors(node, value, dtype, path, rules))
    elif kind == "record":
        right = _is("object", value, dtype)
        entries = None
        if _is_variant(dtype):
            entries, vtype = F.map_entries(_get(value, "map<string,variant>")), _VARIANT
        elif isinstance(dtype, T.MapType):
            entries, vtype = F.map_entries(value), dtype.valueType
        if entries is not None and node.item is not None:
            rest = _first(F.transform(entries, lambda x: errors_of(node.item, x.getField("value"), vtype, Path(path.names, key=x.getField("key")), rules)))
        elif isinstance(dtype, T.StructType) and node.item is not None:
            of = [errors_of(node.item, value.getField(f.name), f.dataType, Path(path.names, key=F.lit(f.name)), rules) for f in dtype.fields]
            rest = _first(F.array(*of)) if of else None
    elif kind == "union":
        right = _any([_equals(value, dtype, x) for x in node.literals] + [_branch(x, value, dtype, path, rules) for x in node.items])
    else:
        raise TypeError(f"unknown kind {kind!r}")
    if node.nullable and kind != "enum":
        null = _is_null(value, dtype)
        return F.when(null, _no_errors()).when(~right, wrong).otherwise(_no_errors() if rest is None else F.coalesce(rest, _no_errors()))
    return F.when(~right, wrong).otherwise(_no_errors() if rest is None else F.coalesce(rest, _no_errors()))


def _branch(node: Node, value: Column, dtype: T.DataType, path: Path, rules: Rules) -> Column:
    """Whether a branch of a union takes a value; plain numbers, strings and booleans are not coerced there."""
    kind = {"tuple": "array", "record": "object"}.get(node.kind, node.kind)
    if kind not in ("array", "bigint", "boolean", "date", "number", "object", "string"):
        return F.lit(False)
    guard = _is(kind, value, dtype)
    if kind in ("bigint", "boolean") or (kind in ("number", "string") and node.brand is None):
        return guard
    return guard & (F.size(errors_of(replace(node, nullable=False), value, dtype, path, rules)) == 0)


def _all(parts: list[Column]) -> Column:
    return F.concat(_no_errors(), *parts) if parts else _no_errors()


def _field_errors(node: Node, value: Column, dtype: T.DataType, path: Path, rules: Rules) -> list[Column]:
    out = []
    for name, child in node.fields:
        if child.kind in ("never", "any"):
            continue
        found = _field(value, dtype, name)
        if found is None and child.optional:
            continue
        own, otype = found or _missing(dtype)
        errors = errors_of(child, own, otype, path.child(name), rules)
        # a typed null is a missing value; among variants only a missing field is
        out.append(F.when(own.isNotNull(), errors).otherwise(_no_errors()) if child.optional else errors)
    return out


def data_of(node: Node, value: Column, dtype: T.DataType, prune: bool = True) -> Column:
    """A valid value with numbers and required booleans coerced. Undeclared fields go from required objects only."""
    kind, variant = node.kind, _is_variant(dtype)
    if kind in ("number", "boolean"):
        return _with_shape(value, dtype, _number if kind == "number" else _boolean)
    if kind == "string" and variant:
        return _get(value, "string")
    if kind == "bigint" and variant:
        return _get(value, "bigint")
    if kind == "date" and variant:
        return _get(value, "timestamp")
    if kind in ("literal", "enum") and variant:
        types = {"boolean" if isinstance(x, bool) else "double" if isinstance(x, int | float) else "string" for x in node.literals}
        return _get(value, types.pop()) if len(types) == 1 else value
    if kind == "array" and (variant or isinstance(dtype, T.ArrayType)):
        items, itype = _items(value, dtype)
        return F.transform(items, lambda x: data_of(node.item, x, itype, False))
    if kind == "record" and node.item is not None:
        if variant:
            return F.transform_values(_get(value, "map<string,variant>"), lambda _, x: data_of(node.item, x, _VARIANT, False))
        if isinstance(dtype, T.MapType):
            return F.transform_values(value, lambda _, x: data_of(node.item, x, dtype.valueType, False))
    if kind == "object" and node.fields and (variant or isinstance(dtype, T.StructType)):
        declared = dict(node.fields)
        columns = []
        if not prune and isinstance(dtype, T.StructType):  # as it stands, declared fields coerced
            for f in dtype.fields:
                own = value.getField(f.name)
                columns.append((data_of(declared[f.name], own, f.dataType, False) if f.name in declared else own).alias(f.name))
        else:
            for name, child in node.fields:
                found = _field(value, dtype, name)
                if child.kind == "never" or found is None:
                    continue
                columns.append(data_of(child, *found, prune=prune and not child.optional).alias(name))
        if columns:
            return F.when(~_is_null(value, dtype) & value.isNotNull(), F.struct(*columns))
    return value


def _root(df: DataFrame, variant: str | None) -> tuple[Column, T.DataType]:
    if variant is not None:
        return F.col(variant), df.schema[variant].dataType
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)), df.schema


def result_column(node: Node, df: DataFrame, rules: Rules | None = None, *, variant: str | None = None) -> Column:
    """``struct<ok, data, errors>`` for each row. The record is the row itself, or one VARIANT column of it."""
    if node.kind != "object":
        raise TypeError("records are validated against an object type")
    rules = rules or Rules()
    if variant is None:  # fields of the row by their own columns, so that Parquet reads no other
        declared = [(n, c) for n, c in node.fields if c.kind != "never"]
        types = {f.name: f.dataType for f in df.schema.fields}
        parts, data = [], []
        for name, child in declared:
            own, dtype = (F.col(f"`{name}`"), types[name]) if name in types else _missing(T.StringType())
            if name in types:
                data.append(data_of(child, own, dtype, prune=not child.optional).alias(name))
            if child.kind == "any" or (name not in types and child.optional):
                continue
            errors = errors_of(child, own, dtype, Path((name,)), rules)
            parts.append(F.when(own.isNotNull(), errors).otherwise(_no_errors()) if child.optional else errors)
        body = F.struct(*data) if data else F.lit(None)
        fields = {n: (F.col(f"`{n}`"), types[n]) for n in types}
    else:
        value, dtype = _root(df, variant)
        if not _is_variant(dtype):
            raise TypeError(f"{variant} is no VARIANT column")
        parts, body = _field_errors(node, value, dtype, Path(), rules), data_of(node, value, dtype)
        fields = {n: (data_of(c, *_field(value, dtype, n)), None) for n, c in node.fields}
        parts.insert(0, F.when(_is("object", value, dtype), _no_errors()).otherwise(_one(MESSAGES["object"], Path(), rules)))
    errors = _all(parts)
    if rules.fields:
        own_errors = []
        for name, checks in sorted(rules.fields.items()):
            col, dtype = fields[name]
            dtype = dtype or _data_type(dict(node.fields)[name])
            col = col if variant is not None else data_of(dict(node.fields).get(name, Node("any")), col, dtype)
            dtype = T.DoubleType() if dict(node.fields).get(name, Node("any")).kind == "number" and not isinstance(dtype, T.NumericType) else dtype
            own_errors += [F.when(col.isNotNull() & ~check.passes(col, dtype), _error(check.text(dtype), Path((name,)))) for check in checks]
        extra = F.filter(F.array(*own_errors), lambda e: e.isNotNull()).cast(_ERRORS)
        only = lambda e: F.when(F.size(e) == 0, extra).otherwise(e)  # noqa: E731  only where all types are right
        errors = only(errors) if variant is None else _bound({"e": errors}, only)
    if variant is not None:  # one value, which a later select doesn't take apart and compute again for each of its fields
        return _bound({"e": errors}, lambda e: F.struct((F.size(e) == 0).alias("ok"), F.when(F.size(e) == 0, body).alias("data"), F.when(F.size(e) > 0, e).alias("errors")))
    ok = F.size(errors) == 0
    some = F.get(F.filter(F.array(errors), lambda e: F.size(e) > 0), F.lit(0))  # null without errors; shared with ok
    return F.struct(ok.alias("ok"), F.when(ok, body).alias("data"), some.alias("errors"))


def _data_type(node: Node) -> T.DataType:
    simple = {"string": T.StringType(), "number": T.DoubleType(), "bigint": T.LongType(), "boolean": T.BooleanType(), "date": T.TimestampType(), "literal": T.StringType()}
    if node.kind == "array":
        return T.ArrayType(_data_type(node.item))
    return simple.get(node.kind, _VARIANT)


def validate(df: DataFrame, node: Node, rules: Rules | None = None, *, variant: str | None = None, into: str = "result") -> DataFrame:
    """df with the result of each row beside its columns."""
    return df.withColumn(into, result_column(node, df, rules, variant=variant))


def valid_rows(df: DataFrame, node: Node, rules: Rules | None = None, *, variant: str | None = None) -> DataFrame:
    """The data of the rows that are valid."""
    return df.select(result_column(node, df, rules, variant=variant).alias("r")).where("r.ok").select("r.data.*")


def quarantine(df: DataFrame, node: Node, rules: Rules | None = None, *, variant: str | None = None) -> DataFrame:
    """The rows that are not valid, with their errors."""
    return validate(df, node, rules, variant=variant, into="__r").where("NOT __r.ok").withColumn("errors", F.col("__r.errors")).drop("__r")


def error_counts(df: DataFrame, node: Node, rules: Rules | None = None, *, variant: str | None = None) -> DataFrame:
    """How often each message occurs at each path; counted before anything is shuffled."""
    r = df.select(F.explode(result_column(node, df, rules, variant=variant).getField("errors")).alias("e"))
    return r.groupBy(F.col("e.path").alias("path"), F.col("e.message").alias("message")).agg(F.count("*").alias("n"))


def with_lookup(df: DataFrame, column: str, known: DataFrame, key: str, into: str) -> DataFrame:
    """df with whether a value is among the keys of another table: what checks that ask a store become."""
    keys = known.select(F.col(key).alias("__key")).where("__key IS NOT NULL").distinct().withColumn("__found", F.lit(True))
    return df.join(keys, F.col(column) == F.col("__key"), "left").withColumn(into, F.coalesce("__found", F.lit(False))).drop("__key", "__found")


