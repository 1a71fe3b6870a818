"""Encoded records in files, and schemas kept beyond a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowforge.serde import FieldSpec, Registry
from rowforge.serde.columns import RecordFormat, split_frames


def read_frames(spark: SparkSession, path: str, registry: Registry, *, pattern: str = "*") -> DataFrame:
    """A row (path, offset, frame) for each value in files of concatenated values."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return split_frames(files.select("path", "content"), "content", registry)


def write_records(df: DataFrame, path: str, form: RecordFormat, *, keys: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """The records of df as frames in a Parquet table, beside key columns that readers can prune and filter by."""
    df.select(*keys, form.encode().alias("frame")).write.mode(mode).parquet(path)


def read_records(spark: SparkSession, path: str, form: RecordFormat) -> DataFrame:
    return form.decoded(spark.read.parquet(path), "frame")


class ParquetStore:
    """A schema store in a Parquet folder: one row a field, appended when a schema is first defined, read once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.known: dict[int, tuple[FieldSpec, ...]] = {}
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            rows = spark.read.parquet(path).orderBy("hash", "place").collect()  # a row a field of a registry
            for r in rows:
                self.known[r.hash] = (*self.known.get(r.hash, ()), FieldSpec(r.name, r.type, r.nullable))

    def get(self, hash_: int) -> tuple[FieldSpec, ...] | None:
        return self.known.get(hash_)

    def set(self, hash_: int, fields: tuple[FieldSpec, ...]) -> None:
        if hash_ in self.known:
            return
        self.known[hash_] = fields
        rows = [(hash_, i, f.name, f.type, f.nullable) for i, f in enumerate(fields)]
        self.spark.createDataFrame(rows, "hash long, place int, name string, type string, nullable boolean").coalesce(1).write.mode("append").parquet(self.path)


def save_registry(spark: SparkSession, registry: Registry, path: str) -> None:
    """The exchange form of a registry as a table of one row."""
    spark.createDataFrame([(bytearray(registry.to_bytes()),)], "registry binary").coalesce(1).write.mode("overwrite").parquet(path)


def load_registry(spark: SparkSession, path: str) -> Registry:
    registry = Registry()
    for r in spark.read.parquet(path).select(F.col("registry")).collect():
        registry.load(bytes(r.registry))
    return registry


