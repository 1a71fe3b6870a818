"""Queries for record validation: JSON records made from the keys of ``orders``, and typed rows of whole tables.

The SQL of a JSON query says for each kind of record which errors it has; that of a typed query computes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowforge import types as t
from rowforge.functions import CHECKS
from rowforge.operators import records
from rowforge.operators.records import Rules

_V = t.object_

#: name: type, rules, and records with the errors they have ("path: message", joined by "; ").
JSON: dict[str, tuple[t.Node, Rules, list[tuple[str, str]]]] = {
    "string": (_V(v=t.string), Rules(), [('{"v": "a{k}"}', ""), ('{"v": {k}}', "v: must be a string"), ('{"v": null}', "v: must be a string"), ("{}", "v: must be a string")]),
    "number": (
        _V(v=t.number),
        Rules(),
        [('{"v": {k}}', ""), ('{"v": "{k}"}', ""), ('{"v": " 0x1F "}', ""), ('{"v": ""}', ""), ('{"v": "1d"}', "v: must be a number"), ('{"v": null}', "v: must be a number"), ('{"v": "Infinity"}', "v: must be a number"), ('{"v": true}', ""), ('{"v": {}}', "v: must be a number")],
    ),
    "integer": (_V(v=t.integer), Rules(), [('{"v": {k}}', ""), ('{"v": {k}.5}', "v: must be an integer"), ('{"v": "{k}"}', ""), ('{"v": 1e300}', ""), ('{"v": "x"}', "v: must be an integer")]),
    "bigint": (_V(v=t.bigint), Rules(), [('{"v": {k}}', ""), ('{"v": "{k}"}', "v: must be a bigint"), ('{"v": true}', "v: must be a bigint")]),
    "boolean": (
        _V(v=t.boolean),
        Rules(),
        [('{"v": true}', ""), ('{"v": "TRUE"}', ""), ('{"v": 0}', ""), ('{"v": "1"}', ""), ('{"v": " true"}', "v: must be true or false"), ('{"v": 2}', "v: must be true or false"), ('{"v": null}', "v: must be true or false")],
    ),
    "boolean_optional": (
        _V(v=t.boolean.maybe(), w=t.boolean.or_null()),
        Rules(),
        [('{"w": true}', ""), ('{"v": false, "w": null}', ""), ('{"v": "true", "w": false}', "v: invalid literal type"), ('{"v": 1, "w": 0}', "v: invalid literal type; w: invalid literal type"), ('{"v": null}', "v: invalid literal type; w: invalid literal type")],
    ),
    "date": (_V(v=t.date), Rules(), [('{"v": "2024-01-01"}', "v: invalid date type"), ('{"v": {k}}', "v: invalid date type")]),
    "literal": (_V(v=t.literal("yes", "no", None)), Rules(), [('{"v": "yes"}', ""), ('{"v": null}', ""), ('{"v": "maybe"}', "v: invalid literal type"), ('{"v": true}', "v: invalid literal type")]),
    "literal_boolean": (_V(v=t.literal(True)), Rules(), [('{"v": true}', ""), ('{"v": false}', "v: invalid literal type"), ('{"v": "true"}', "v: invalid literal type")]),
    "enum": (_V(v=t.enum(0, 1, 2)), Rules(), [('{"v": 1}', ""), ('{"v": 5}', "v: invalid enum type"), ('{"v": "1"}', "v: invalid enum type"), ('{"v": null}', "v: invalid enum type")]),
    "null": (_V(v=t.null), Rules(), [('{"v": null}', ""), ('{"v": 0}', "v: invalid null type"), ("{}", "v: invalid null type")]),
    "array": (
        _V(v=t.array(t.string)),
        Rules(),
        [('{"v": ["a", "{k}"]}', ""), ('{"v": []}', ""), ('{"v": ["a", 1, 2]}', "v[1]: must be a string"), ('{"v": "a"}', "v: must be an array"), ('{"v": null}', "v: must be an array")],
    ),
    "nested_array": (_V(grid=t.array(t.array(t.number))), Rules(), [('{"grid": [[1, "2"], [{k}]]}', ""), ('{"grid": [[1], [2, "x", "y"]]}', "grid[1]: must be a number"), ('{"grid": [[1], 2]}', "grid[1]: must be an array")]),
    "array_of_objects": (
        _V(items=t.array(_V(id=t.number, name=t.string))),
        Rules(),
        [('{"items": [{"id": {k}, "name": "a"}]}', ""), ('{"items": [{"id": 1, "name": "a"}, {"id": "x", "name": 2}, {"id": "y"}]}', "items.id: must be a number; items.name: must be a string")],
    ),
    "tuple": (
        _V(v=t.tuple_(t.string, t.number, t.boolean.maybe())),
        Rules(),
        [('{"v": ["a", {k}]}', ""), ('{"v": ["a", 1, true]}', ""), ('{"v": ["a", 1, "true"]}', "v.[2]: invalid literal type"), ('{"v": ["a"]}', "v: invalid tuple type"), ('{"v": [1, "x"]}', "v.[0]: must be a string; v.[1]: must be a number"), ('{"v": ["a", 1, true, 4]}', "v: invalid tuple type")],
    ),
    "object": (
        _V(address=_V(street=t.string, zip=t.string), name=t.string),
        Rules(),
        [('{"address": {"street": "s{k}", "zip": "z"}, "name": "n"}', ""), ('{"address": {"street": 1}, "name": "n"}', "address.street: must be a string; address.zip: must be a string"), ('{"address": null, "name": "n"}', "address: must be an object"), ('{"address": [], "name": 1}', "address: must be an object; name: must be a string")],
    ),
    "record": (
        _V(v=t.record(t.number)),
        Rules(),
        [('{"v": {"a": 1, "b": "{k}"}}', ""), ('{"v": {}}', ""), ('{"v": {"a": 1, "b": "x"}}', "v.b: must be a number"), ('{"v": []}', "v: invalid record type"), ('{"v": null}', "v: invalid record type")],
    ),
    "union": (
        _V(v=t.union(t.string, t.number, _V(id=t.number), literals=(True,))),
        Rules(),
        [('{"v": "a"}', ""), ('{"v": {k}}', ""), ('{"v": true}', ""), ('{"v": false}', "v: invalid union type"), ('{"v": {"id": "{k}"}}', ""), ('{"v": {"id": "x"}}', "v: invalid union type"), ('{"v": null}', "v: invalid union type")],
    ),
    "optional": (_V(v=t.string.maybe()), Rules(), [("{}", ""), ('{"v": "a{k}"}', ""), ('{"v": null}', "v: must be a string"), ('{"v": 1}', "v: must be a string")]),
    "nullable": (_V(v=t.string.or_null(), w=_V(a=t.number).or_null()), Rules(), [('{"v": null, "w": null}', ""), ('{"v": "a", "w": {"a": {k}}}', ""), ('{"w": null}', "v: must be a string"), ('{"v": 1, "w": {"a": "x"}}', "v: must be a string; w.a: must be a number")]),
    "any": (_V(a=t.any_, b=t.string), Rules(), [('{"a": [1], "b": "x"}', ""), ('{"b": "x"}', ""), ('{"a": null, "b": {k}}', "b: must be a string")]),
    "never": (_V(hidden=t.never, name=t.string), Rules(), [('{"hidden": 1, "name": "n{k}"}', ""), ('{"name": 1}', "name: must be a string")]),
    "accumulated": (
        _V(a=t.string, b=t.number, c=t.boolean, d=t.array(t.string)),
        Rules(),
        [('{"a": "x", "b": {k}, "c": 1, "d": []}', ""), ('{"a": 1, "b": "x", "c": "y", "d": [1, 2]}', "a: must be a string; b: must be a number; c: must be true or false; d[0]: must be a string"), ('{"d": [], "c": 0}', "a: must be a string; b: must be a number")],
    ),
    "paths": (_V(first=_V(second=_V(value=t.number))), Rules(), [('{"first": {"second": {"value": {k}}}}', ""), ('{"first": {"second": {"value": "x"}}}', "first.second.value: must be a number"), ('{"first": {"second": 1}}', "first.second: must be an object")]),
    "messages": (
        _V(address=_V(city=t.string), age=t.number, tags=t.array(t.string)),
        Rules(messages={"age": "age is required", "address.city": "which city?", "tags": "list them"}),
        [('{"age": {k}, "address": {"city": "c"}, "tags": ["a"]}', ""), ('{"age": "x", "address": {"city": 1}, "tags": "a"}', "address.city: which city?; age: age is required; tags: list them"), ('{"age": 1, "address": {"city": "c"}, "tags": [1]}', "tags[0]: must be a string")],
    ),
    "brands": (
        _V(email=t.string.branded("email"), score=t.number.branded("percent")),
        Rules(messages={"email": "not used"}, brands={"email": [CHECKS["email"]()], "percent": [CHECKS["range"](0, 100)]}),
        [('{"email": "u{k}@x.yz", "score": 50}', ""), ('{"email": "nobody", "score": "101"}', "email: must be a valid email; score: must be between 0 and 100"), ('{"email": 1, "score": 1}', "email: not used")],
    ),
    "field_checks": (
        _V(age=t.number, name=t.string.maybe()),
        Rules(fields={"age": [CHECKS["min"](18), CHECKS["max"](99)], "name": [CHECKS["min"](2)]}),
        [('{"age": 20, "name": "ab"}', ""), ('{"age": "5", "name": "a"}', "age: must be at least 18; name: must be at least 2 characters"), ('{"age": "x", "name": "a"}', "age: must be a number"), ('{"age": 120}', "age: must be at most 99")],
    ),
}


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case(values: list[str]) -> str:
    return f"CASE o_orderkey % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _json_query(name: str):
    node, rules, samples = JSON[name]
    text = _case([f"replace({_quote(s)}, '{{k}}', CAST(o_orderkey AS STRING))" for s, _ in samples])

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.parse_json(F.expr(text)).alias("record"))
        listed = F.array_join(F.transform("result.errors", lambda e: F.concat(e["path"], F.lit(": "), e["message"])), "; ")
        return records.validate(orders, node, rules, variant="record").select("o_orderkey", "result.ok", F.coalesce(listed, F.lit("")).alias("errors"))

    errors = _case([_quote(e) for _, e in samples])
    return run, f"SELECT o_orderkey, {errors} = '' AS ok, {errors} AS errors FROM orders"


# -- typed rows

_CUSTOMER = _V(c_acctbal=t.number, c_custkey=t.bigint, c_mktsegment=t.literal("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"), c_name=t.string, phone=t.string.maybe(), balance_text=t.number)


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with fields that some of them lack or have wrong."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    phone = F.when(F.col("c_custkey") % 3 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("+1"), F.col("c_custkey").cast("string")))
    text = F.when(F.col("c_custkey") % 7 == 0, F.lit("n/a")).when(F.col("c_custkey") % 5 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(".5 ")))
    return c.withColumn("phone", phone).withColumn("balance_text", text)


_CUSTOMER_SQL = """
SELECT *, c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 AND c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY') AS ok FROM customer
"""


def validate_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records.validate(_customers(spark, sf_dir), _CUSTOMER)
    return r.select("c_custkey", "result.ok", F.col("result.data.balance_text").alias("balance"), F.size("result.errors").alias("n_errors"), F.get("result.errors", F.lit(0)).getField("path").alias("first_path"))


def valid_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.valid_rows(_customers(spark, sf_dir), _CUSTOMER).select("c_custkey", "c_name", "balance_text")


def quarantined_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.quarantine(_customers(spark, sf_dir), _CUSTOMER).select("c_custkey", F.array_join(F.transform("errors", lambda e: e["path"]), ",").alias("paths"))


def customer_error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.error_counts(_customers(spark, sf_dir), _CUSTOMER)


def customers_with_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers looked up among the orders; some have none."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    return records.with_lookup(customers, "c_custkey", orders, "o_custkey", "known")


def dated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed dates; every ninth is null, and a text is no date."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = o.select("o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate")).alias("ordered"), F.col("o_orderdate").alias("seen"), F.col("o_orderdate").cast("string").alias("said"))
    node = _V(o_orderkey=t.bigint, ordered=t.date, said=t.date.maybe(), seen=t.date.maybe())
    r = records.validate(rows.withColumn("said", F.when(F.col("o_orderkey") % 4 == 0, F.col("said"))), node)
    listed = F.array_join(F.transform("result.errors", lambda e: F.concat(e["path"], F.lit(": "), e["message"])), "; ")
    return r.select("o_orderkey", "result.ok", F.coalesce(listed, F.lit("")).alias("errors"), F.col("result.data.seen").alias("seen"))


def projected_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undeclared fields go; props are JSON objects of a number."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.parse_json("props").alias("props"))
    node = _V(k=t.integer)
    return records.validate(events, node, variant="props").select("event_id", "result.ok", "result.data.k")


def unique_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    node = _V(embedding=t.array(t.number), label=t.enum(*range(5)), vec_id=t.bigint)
    return records.validate(e, node).select("vec_id", "result.ok")


_PATHS = """
SELECT c_custkey, list_filter([
  CASE WHEN c_custkey % 7 = 0 OR c_custkey % 5 = 0 THEN 'balance_text' END,
  CASE WHEN c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY') THEN 'c_mktsegment' END], lambda x: x IS NOT NULL) AS paths FROM customer
"""
_TYPED = {
    "record_validate_customer": (
        validate_customer,
        f"SELECT c_custkey, len(paths) = 0 AS ok, CASE WHEN len(paths) = 0 THEN CAST(c_custkey + 0.5 AS DOUBLE) END AS balance, CASE WHEN len(paths) > 0 THEN CAST(len(paths) AS INTEGER) END AS n_errors, paths[1] AS first_path FROM ({_PATHS})",
    ),
    "record_valid_rows": (valid_customers, f"SELECT c_custkey, c_name, CAST(c_custkey + 0.5 AS DOUBLE) AS balance_text FROM ({_CUSTOMER_SQL}) WHERE ok"),
    "record_quarantine": (quarantined_customers, f"SELECT c_custkey, array_to_string(paths, ',') AS paths FROM ({_PATHS}) WHERE len(paths) > 0"),
    "record_error_counts": (
        customer_error_counts,
        f"SELECT path, CASE path WHEN 'balance_text' THEN 'must be a number' ELSE 'invalid literal type' END AS message, count(*) AS n FROM (SELECT unnest(paths) AS path FROM ({_PATHS})) GROUP BY path",
    ),
    "record_lookup": (customers_with_orders, "SELECT c_custkey, c_nationkey, c_custkey IN (SELECT o_custkey FROM orders) AS known FROM customer"),
    "record_dates": (
        dated_orders,
        "SELECT o_orderkey, o_orderkey % 9 <> 0 AND o_orderkey % 4 <> 0 AS ok, array_to_string(list_filter([CASE WHEN o_orderkey % 9 = 0 THEN 'ordered: invalid date type' END, "
        "CASE WHEN o_orderkey % 4 = 0 THEN 'said: invalid date type' END], lambda x: x IS NOT NULL), '; ') AS errors, CASE WHEN o_orderkey % 9 <> 0 AND o_orderkey % 4 <> 0 THEN o_orderdate END AS seen FROM orders",
    ),
    "record_projection": (projected_events, "SELECT event_id, true AS ok, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events"),
    "record_array_rows": (unique_embeddings, "SELECT vec_id, label BETWEEN 0 AND 4 AS ok FROM embeddings"),
}


def build() -> tuple[dict, dict[str, str]]:
    queries = {k: v[0] for k, v in _TYPED.items()}
    oracles = {k: v[1] for k, v in _TYPED.items()}
    for name in JSON:
        queries[f"record_{name}"], oracles[f"record_{name}"] = _json_query(name)
    return queries, oracles
