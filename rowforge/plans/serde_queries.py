"""Queries for the record serde: what is written must be read back, at the sizes that arithmetic gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowforge.serde import Codec, FieldSpec, Registry
from rowforge.serde.codec import ELEMENTS
from rowforge.serde.columns import RecordFormat, decode_json, decode_vectors, encode_tagged, encode_vectors, split_frames, value_length, vector_element
from rowforge.serde.schema import name_hash, shape_hash


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, with a name and a price that some lack."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.withColumn("p_name", F.when(F.col("p_partkey") % 5 != 0, F.col("p_name"))).withColumn("p_retailprice", F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice")))


_PART_SQL = "SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS p_name, p_brand, p_type, p_size, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS p_retailprice FROM part"


def _round_trip(table: str, compress: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _part(spark, sf_dir) if table == "part" else spark.read.parquet(f"{sf_dir}/{table}.parquet")
        form = RecordFormat(df.schema, compress=compress)
        return form.decoded(df.select(form.encode().alias("frame")), "frame").select(*df.columns)

    return run


def _unsigned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, RecordFormat]:
    """Keys as unsigned numbers of several widths."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        (F.col("l_orderkey") % 256).cast("short").alias("a"), (F.col("l_partkey") * 31 % 65536).cast("int").alias("b"), (F.col("l_orderkey") * 1000003 % 4294967296).alias("c"),
        F.col("l_linenumber").alias("d"), (F.col("l_quantity") > 25).alias("e"),
    )
    return df, RecordFormat(df.schema, types={"a": "uint8", "b": "uint16", "c": "uint32"}, nullable=False)


def unsigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, form = _unsigned(spark, sf_dir)
    return form.decoded(df.select(form.encode().alias("frame")), "frame").select(*df.columns)


def extract_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields at constant offsets, without decoding."""
    df, form = _unsigned(spark, sf_dir)
    frames = df.select(form.encode().alias("frame"))
    return frames.select(*(form.extract(F.col("frame"), n).alias(n) for n in df.columns))


def extract_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _part(spark, sf_dir)
    form = RecordFormat(df.schema)
    frames = df.select("p_partkey", form.encode().alias("frame"))
    return frames.select("p_partkey", *(form.extract(F.col("frame"), n).alias(f"x_{n}") for n in ("p_name", "p_type", "p_retailprice", "p_size")))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _part(spark, sf_dir)
    form = RecordFormat(df.schema)
    return df.select("p_partkey", F.octet_length(form.encode()).alias("written"), form.size().alias("computed"))


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structs, arrays and maps, written and read back."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    df = n.select(
        "n_nationkey",
        F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("place"),
        F.array(F.col("n_regionkey"), F.col("n_nationkey")).alias("keys"),
        F.array(F.struct(F.col("n_name").alias("name"))).alias("names"),
    )
    form = RecordFormat(df.schema)
    back = form.decoded(df.select(form.encode().alias("frame")), "frame")
    return back.select("n_nationkey", F.col("place.name").alias("name"), F.col("place.region").alias("region"), F.col("keys")[1].alias("second"), F.col("names")[0]["name"].alias("first"))


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    form = RecordFormat(df.schema)
    back = form.decoded(df.select(form.encode().alias("frame")), "frame")
    return back.select("event_id", F.unix_millis("ts").alias("ms"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two frames one behind the other, split again."""
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    form = RecordFormat(df.schema)
    joined = df.select("c_custkey", F.concat(form.encode(), form.encode({"c_custkey": -F.col("c_custkey"), "c_name": F.lit("x")})).alias("bytes"))
    split = split_frames(joined, "bytes", form.registry)
    return split.select(F.col("c_custkey").alias("k"), "offset", "frame").transform(lambda d: form.decoded(d, "frame")).select("k", "offset", "c_custkey", "c_name")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    element = vector_element(e.schema["embedding"].dataType)
    stored = e.select("vec_id", "embedding", encode_vectors(F.col("embedding"), element).alias("v"))
    return stored.select("vec_id", F.octet_length("v").alias("size"), F.hex(F.substring("v", 1, 4)).alias("head"), (decode_vectors(F.col("v"), element) == F.col("embedding")).alias("same"), F.col("embedding")[7].cast("double").alias("eighth"))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VARIANT columns as tagged values in a record, written and read back."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    nested = F.concat(F.lit('{"a":[1,"x",null,true,{"b":'), F.col("user_id").cast("string"), F.lit('}],"c":0.5}'))
    df = e.select("event_id", F.parse_json("props").alias("props"), F.parse_json(F.when(F.col("event_id") % 4 != 0, nested)).alias("nested"))
    form = RecordFormat(df.schema)
    back = form.decoded(df.select(form.encode().alias("frame")), "frame")
    return back.select("event_id", F.try_variant_get("props", "$.k", "int").alias("k"), F.to_json("nested").alias("nested"))


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values without a schema, and what follows them: arrays of small and of wide integers, of fractions, of texts and of nulls."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    numbers = F.when(F.col("l_linenumber") % 3 == 0, F.array("l_linenumber", F.lit(300.0))).when(F.col("l_linenumber") % 3 == 1, F.array("l_linenumber", F.lit(7.0))).otherwise(F.array("l_linenumber", F.lit(0.5)))
    df = rows.select("l_orderkey", "l_linenumber", numbers.cast("array<double>").alias("v"), F.array("l_returnflag", F.lit(None).cast("string")).alias("t"))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    df = df.select("l_orderkey", "l_linenumber", encode_tagged(F.col("v"), kinds["v"]).alias("v"), encode_tagged(F.col("t"), kinds["t"]).alias("t"))
    df = df.select("l_orderkey", "l_linenumber", F.concat("v", "t").alias("both"), "v", "t")
    texts = F.from_json(decode_json(F.col("t")), "array<string>")
    return df.select(
        "l_orderkey", "l_linenumber", F.octet_length("v").alias("size"), (value_length(F.col("both")) == F.octet_length("v")).alias("passed"), value_length(F.substring("both", 1, 6)).alias("cut"),
        F.from_json(decode_json(F.col("both")), "array<double>")[1].alias("second"), texts[0].alias("flag"), F.size(texts).alias("items"),
    )


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets, generic arrays and maps of texts through one record."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    df = p.select("p_partkey", F.array("p_brand", "p_type", "p_brand").alias("names"), F.array("p_size", "p_partkey").cast("array<double>").alias("numbers"), F.create_map(F.lit("brand"), "p_brand").alias("by_name"))
    form = RecordFormat(df.schema, types={"names": "set", "numbers": "array"})
    back = form.decoded(df.select(form.encode().alias("frame")), "frame")
    return back.select("p_partkey", F.size("names").alias("n_names"), F.col("names")[1].alias("type"), F.col("numbers")[1].alias("key"), F.col("by_name")["brand"].alias("brand"))


def registries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames read with schemas that another registry wrote out, some of them damaged: only whole ones give a record."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name")
    form = RecordFormat(s.schema)
    other = Registry()
    other.load(form.registry.to_bytes())
    frames = s.select("s_suppkey", form.encode().alias("frame"))
    frames = frames.select("s_suppkey", F.when(F.col("s_suppkey") % 4 == 0, F.substring("frame", 1, 12)).otherwise(F.col("frame")).alias("frame"))
    text = decode_json(F.col("frame"), other)
    return frames.select("s_suppkey", F.get_json_object(text, "$.s_name").alias("name"), F.lit(form.hash in other.schemas).alias("known"))


def vector_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of each element type that a column can have, every fifth with a byte too many."""
    ids = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id")
    out = None
    for element in ELEMENTS[:6] + ELEMENTS[7:10]:
        values = F.array(*((F.col("vec_id") + i) % 120 for i in range(3))).cast("array<double>")
        stored = ids.select("vec_id", values.alias("values"), encode_vectors(values, element).alias("v"))
        stored = stored.withColumn("v", F.when(F.col("vec_id") % 5 == 0, F.concat("v", F.lit(b"x"))).otherwise(F.col("v")) if element not in ("<i1", "<u1") else F.col("v"))
        own = stored.select(
            F.lit(element[1:]).alias("element"), "vec_id", F.octet_length("v").alias("size"), F.hex(F.substring("v", 1, 2)).alias("head"), decode_vectors(F.col("v"), element)[2].cast("double").alias("third")
        )
        out = own if out is None else out.unionByName(own)
    return out


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames whose bytes are known."""
    registry = Registry()
    inner = registry.define([FieldSpec("city", "string"), FieldSpec("zip", "string")])
    rows = [
        ("simple", Codec().encode({"name": "Alice"}).hex()),
        ("multi", Codec().encode({"active": True, "age": 30, "name": "Alice"}).hex()),
        ("packed", Codec(compress=True).encode({"active": True, "age": 30, "name": "Alice"}).hex()),
        ("nested", Codec().encode({"address": {"city": "NYC", "zip": "10001"}, "name": "Alice"}).hex()),
        ("inner hash", str(inner)),
        ("point hash", str(shape_hash(["x", "y"], ["float64", "float64"]))),
        ("name hash differs", str(name_hash(["x", "y"]) != shape_hash(["x", "y"], ["float64", "float64"])).lower()),
        ("registry", registry.to_bytes().hex()),
    ]
    return spark.createDataFrame(rows, "name string, value string")


_SIZE = "9 + 1 + 8 + CASE WHEN p_name IS NULL THEN 0 ELSE 1 + strlen(p_name) END + 1 + strlen(p_brand) + 1 + strlen(p_type) + 4 + CASE WHEN p_retailprice IS NULL THEN 0 ELSE 8 END"
_UNSIGNED_SQL = "SELECT CAST(l_orderkey % 256 AS SMALLINT) AS a, CAST(l_partkey * 31 % 65536 AS INTEGER) AS b, l_orderkey * 1000003 % 4294967296 AS c, l_linenumber AS d, l_quantity > 25 AS e FROM lineitem"
_QUERIES = {
    "serde_round_trip_part": (_round_trip("part", False), _PART_SQL),
    "serde_round_trip_part_packed": (_round_trip("part", True), _PART_SQL),
    "serde_round_trip_customer": (_round_trip("customer", False), "SELECT * FROM customer"),
    "serde_round_trip_nation_packed": (_round_trip("nation", True), "SELECT * FROM nation"),
    "serde_unsigned": (unsigned, _UNSIGNED_SQL),
    "serde_extract_native": (extract_native, _UNSIGNED_SQL),
    "serde_extract_scanned": (extract_scanned, f"SELECT p_partkey, p_name AS x_p_name, p_type AS x_p_type, p_retailprice AS x_p_retailprice, p_size AS x_p_size FROM ({_PART_SQL})"),
    "serde_sizes": (sizes, f"SELECT p_partkey, CAST({_SIZE} AS INTEGER) AS written, CAST({_SIZE} AS INTEGER) AS computed FROM ({_PART_SQL})"),
    "serde_nested": (nested, "SELECT n_nationkey, n_name AS name, n_regionkey AS region, n_nationkey AS second, n_name AS first FROM nation"),
    "serde_dates": (dates, "SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events"),
    "serde_frames": (frames, "SELECT c_custkey AS k, CAST(0 AS BIGINT) AS \"offset\", c_custkey, c_name FROM customer UNION ALL SELECT c_custkey, CAST(9 + 1 + 8 + 1 + strlen(c_name) AS BIGINT), -c_custkey, 'x' FROM customer"),
    "serde_vectors": (vectors, "SELECT vec_id, CAST(4 + 4 * len(embedding) AS INTEGER) AS size, '54000000' AS head, true AS same, CAST(embedding[8] AS DOUBLE) AS eighth FROM embeddings"),
    "serde_variants": (
        variants,
        "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, CASE WHEN event_id % 4 <> 0 THEN '{\"a\":[1,\"x\",null,true,{\"b\":' || user_id || '}],\"c\":0.5}' END AS nested FROM events",
    ),
    "serde_tagged": (
        tagged,
        "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 13 WHEN 1 THEN 7 ELSE 21 END AS size, true AS passed, CAST(NULL AS BIGINT) AS cut, CASE l_linenumber % 3 WHEN 0 THEN 300.0 WHEN 1 THEN 7.0 ELSE 0.5 END::DOUBLE AS second, "
        "l_returnflag AS flag, 2 AS items FROM lineitem",
    ),
    "serde_collections": (collections, "SELECT p_partkey, 2 AS n_names, p_type AS type, CAST(p_partkey AS DOUBLE) AS key, p_brand AS brand FROM part"),
    "serde_registries": (registries, "SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 0 THEN s_name END AS name, true AS known FROM supplier"),
    "serde_vector_kinds": (
        vector_kinds,
        "SELECT element, vec_id, CAST(4 + 3 * width + CASE WHEN vec_id % 5 = 0 AND width > 1 THEN 1 ELSE 0 END AS INTEGER) AS size, '54' || printf('%02X', id) AS head, CASE WHEN vec_id % 5 <> 0 OR width = 1 THEN CAST((vec_id + 2) % 120 AS DOUBLE) END AS third "
        "FROM embeddings, (VALUES ('f4', 0, 4), ('f8', 1, 8), ('i1', 2, 1), ('i2', 3, 2), ('i4', 4, 4), ('u1', 5, 1), ('u2', 7, 2), ('u4', 8, 4), ('i8', 9, 8)) AS k(element, id, width)",
    ),
    "serde_golden": (
        golden,
        "SELECT * FROM (VALUES ('simple', '08c0ad19a20600000005416c696365'), ('multi', '08c5fe952308000000011e05416c696365'), ('packed', '12c5fe952308000000011e05416c696365'), "
        "('nested', '08966b06e91900000008896334640a000000034e594305313030303105416c696365'), ('inner hash', '1681154953'), ('point hash', '3471888508'), ('name hash differs', 'true'), "
        "('registry', '01008963346402000400636974790600737472696e670003007a69700600737472696e6700')) AS v(name, value)",
    ),
}


def build() -> tuple[dict, dict[str, str]]:
    return {k: v[0] for k, v in _QUERIES.items()}, {k: v[1] for k, v in _QUERIES.items()}
