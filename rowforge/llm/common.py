"""What the operators share: the shared scratch folder, written intermediate tables and Arrow batches cut by bytes."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The usual name of the row identity that operators add; it is unique and stable only in a written table.
UID = "__uid"


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or what ``setCheckpointDir`` was given.

    Without either, a session inside one machine, as in tests, gets a temporary folder of its own. On a cluster it is an error: such
    a folder would be another one on each machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            root = str(kept.get())
        elif spark.sparkContext.master.split("[")[0] == "local":
            root = "file://" + tempfile.mkdtemp(prefix="scratch-")
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/rowforge-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, *, compression: str = "zstd") -> DataFrame:
    """df as a written table: lineage ends here, and a lost executor costs no earlier work."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(*tables: DataFrame) -> None:
    """Deletes the tables from ``written`` that these frames read: of a table itself, or all that a result was made from.

    An operator drops what its result doesn't read. What the result does read stays until its user, who alone knows when it has
    been read for the last time, calls this with it.
    """
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.rsplit("/", 1)[1].startswith("rowforge-"):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def hash_sample(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """One row for each of the ``rows`` distinct keys of the smallest hashes, or of all keys where there are fewer.

    The same on any cluster and partitioning. A bound on the hash keeps what is sorted to about twice as many rows: it comes from
    an estimate of the distinct keys and is widened until enough are found, so it never changes which keys are chosen.
    """
    key = F.xxhash64(*keys)
    share = 2 * rows / max(1, df.agg(F.approx_count_distinct(key).alias("n")).first().n)
    while True:
        part = df if share >= 1 else df.where(key < -(1 << 63) + int(share * (1 << 64)))
        part = part.dropDuplicates(keys)
        if share >= 1 or part.count() >= rows:
            return part.orderBy(key, *keys).limit(rows)
        share *= 4


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], n: str, *, how: str = "inner", most: int = 8192) -> DataFrame:
    """The inner or left join of rows with ``counted``, a written table of one row a key whose column n says how many rows have it.

    Keys of at least a ``most``-th of all rows, so no more than ``most`` keys, are broadcast and their rows don't move; the
    others are shuffled, and no task gets more than a ``most``-th of the rows by one key.
    """
    least = max(16, math.ceil((counted.agg(F.sum(n)).first()[0] or 0) / most))
    hot = counted.where(F.col(n) >= least)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(counted.where(F.col(n) < least), keys, how)
    return rows.join(F.broadcast(hot), keys).select(*cold.columns).union(cold)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores in front until no column of df has it (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_column(df: DataFrame, name: str = "text"):
    """The text as a string, null as empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the strings or bytes of one column sum to about ``most``; a longer value stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        begin = 0
        while begin < batch.num_rows:
            base = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column as uint8, and the offsets of its rows; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and len(column) else np.zeros(0, np.uint8)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of SplitMix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def others(df: DataFrame, *names: str) -> list[str]:
    """The columns of df that a result under these names doesn't replace."""
    replaced = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in replaced]


def with_uid(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """df with a row identity, as a written table, and the identity's name, which no column of df had.

    Partition and place of a row are ``uid >> 33`` and ``uid & (2**33 - 1)``.

    It must be written: a scan that is planned again, say after executors were lost, can deal its rows out otherwise.
    """
    name = free_name(df, UID)
    return written(df.withColumn(name, F.monotonically_increasing_id()), label), name
