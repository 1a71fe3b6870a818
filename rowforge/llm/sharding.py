"""Uniform random shards of exact sizes by a hypergeometric communication matrix.

How many rows each partition sends to each shard is drawn exactly, from the multivariate hypergeometric distribution that a
uniform random permutation of all rows would give; shard sizes differ by one row at most. Each partition deals its rows to
shards by a random permutation of its own (the first local permutation), rows move to their shards, and a random order of
each shard's rows (the second) numbers them. Every permutation of all rows is equally likely up to the generator.

All draws come from the seed and the written place of a row, so a task that runs again decides alike. A shard's second
permutation is a sort on random keys, done bin by bin: bins cut the range of the keys, and the rows of each bin are counted
beforehand, so that the slot of a row is exact and no task holds a whole shard. Bins follow the bytes of the rows.

The matrix is drawn down a binary tree over the partitions: at each node what the left half gets of each shard is a multivariate
hypergeometric draw from what the node has. Totals of up to a thousand million go to numpy; larger ones to an exact rejection
sampler, which has no bound.

Nulls count as empty texts. Rows are never compared, so repeated rows, ties and hot values are dealt like any others. An
empty table gives no rows. Very long texts move as they are and count by their bytes in the bins. Extra columns stay, whatever
their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, others, text_column, with_uid, written

SHARDS = 40
_PLACE = (1 << 33) - 1
_KEYS = 1 << 62
#: numpy draws from fewer rows than this.
NUMPY_ROWS = 1_000_000_000


def _remainder(n: int) -> float:
    """log n! - (n log n - n), by Stirling's series from 16 on."""
    if n < 16:
        return math.lgamma(n + 1) - (n * math.log(n) - n if n else 0.0)
    return 0.5 * math.log(2 * math.pi * n) + 1 / (12 * n) - 1 / (360 * n**3) + 1 / (1260 * n**5)


def _deviance(n: int, expected: float, off: float) -> float:
    """n log(n / e) + e - n, given off = n - e; exact where n and e are close."""
    t = off / expected
    if abs(t) > 0.1:
        return (n * math.log(n / expected) if n else 0.0) - off
    term, total, j = t * t, 0.0, 2
    while abs(term) > 1e-18 * t * t and j < 40:
        total += term / (j * (j - 1)) * (1 if j % 2 == 0 else -1)
        term *= t
        j += 1
    return expected * total


def _log_probability(k: int, good: int, bad: int, sample: int) -> float:
    """The logarithm of the hypergeometric probability of k, without differences of large numbers."""
    total = good + bad
    rows, columns = (sample, total - sample), (good, bad)
    cells = ((k, sample - k), (good - k, bad - sample + k))
    off = (k * total - sample * good) / total  # an exact difference of integers, rounded once
    out = sum(map(_remainder, (*rows, *columns))) - _remainder(total)
    for i in (0, 1):
        for j in (0, 1):
            out -= _remainder(cells[i][j]) + _deviance(cells[i][j], rows[i] * columns[j] / total, off if i == j else -off)
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of ``sample`` rows, drawn from good + bad without replacement, are good; for any totals.

    Large totals: rejection from the envelope min(1, exp(1 - p |x|)) about the mode, whose probability is p, which is above every
    log-concave distribution on the integers; three to four tries on average.
    """
    if not 0 <= sample <= good + bad:
        raise ValueError("the sample must be a part of the whole")
    low, high = max(0, sample - bad), min(good, sample)
    if low == high:
        return low
    if good + bad < NUMPY_ROWS:
        return int(rng.hypergeometric(good, bad, sample))
    mode = min(max((sample + 1) * (good + 1) // (good + bad + 2), low), high)
    top = _log_probability(mode, good, bad, sample)
    p = math.exp(top)
    w = 1 + p / 2
    while True:
        u, v, accept = 1 - rng.random(3)
        y = v * w / p if u <= w / (1 + w) else (w - math.log(v)) / p
        k = mode + (round(y) if rng.random() < 0.5 else -round(y))
        if low <= k <= high and math.log(accept) + min(0.0, w - p * y) <= _log_probability(k, good, bad, sample) - top:
            return k


def _part_of(rng: np.random.Generator, have: np.ndarray, sample: int) -> np.ndarray:
    """A draw of ``sample`` rows of a whole that has so many of each kind."""
    total = int(have.sum())
    if total < NUMPY_ROWS:
        return rng.multivariate_hypergeometric(have, sample, method="marginals")
    out = np.zeros(len(have), np.int64)
    for i, n in enumerate(have.tolist()):
        total -= n
        out[i] = hypergeometric(rng, n, total, sample)
        sample -= int(out[i])
    return out


def communication_matrix(rows: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Rows from each partition to each shard; columns sum to shard sizes that differ by one at most."""
    total = int(rows.sum())
    rng = np.random.default_rng([seed, 0])
    have = np.full(shards, total // shards, np.int64)
    have[: total % shards] += 1
    rng.shuffle(have)  # which shards have the row more
    out = np.zeros((len(rows), shards), np.int64)
    before = np.append(0, np.cumsum(rows, dtype=np.int64))
    nodes = [(0, len(rows), have)]
    while nodes:
        begin, end, have = nodes.pop()
        if end - begin == 1:
            out[begin] = have
            continue
        middle = (begin + end) // 2
        left = _part_of(rng, have, int(before[middle] - before[begin]))
        nodes += [(middle, end, have - left), (begin, middle, left)]
    return out


def _deal(counts: np.ndarray, seed: int, part: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each row of a partition, and its random key for the order in the shard (62 bits)."""
    rng = np.random.default_rng([seed, 1, part])
    shard = rng.permutation(np.repeat(np.arange(len(counts), dtype=np.int32), counts))
    return shard, rng.integers(0, _KEYS, len(shard), dtype=np.int64)


def _bins_of(key: np.ndarray, bins: int) -> np.ndarray:
    return key // np.int64((_KEYS - 1) // bins + 1)


def _count(seed: int, bins: int):
    """Rows (part, counts): how many rows of the partition fall into each bin of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "counts")), strict=True):
                shard, key = _deal(np.array(counts), seed, part)
                cell, n = np.unique(shard * np.int64(bins) + _bins_of(key, bins), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((cell // bins).astype(np.int32)), pa.array(cell % bins), pa.array(n)], names=["shard", "bin", "n"])

    return run


def _dealt(matrix, seed: int, bins: int, first: np.ndarray, uid_name: str, names: list[str]):
    """Adds shard, bin and key. ``first`` has the number of rows before a written partition in its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, now, dealt = matrix.value, -1, None
        for batch in batches:
            uid = batch.column(uid_name).to_numpy()
            part, place = uid >> 33, uid & _PLACE
            shard, key = np.zeros(len(uid), np.int32), np.zeros(len(uid), np.int64)
            for p in np.unique(part).tolist():
                row = p % len(counts)
                if row != now:
                    now, dealt = row, _deal(counts[row], seed, row)
                own = part == p
                at = place[own] + first[p]
                shard[own], key[own] = dealt[0][at], dealt[1][at]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard), pa.array(_bins_of(key, bins)), pa.array(key)], names=names)

    return run


def shuffle_into_shards(
    docs: DataFrame, *, shards: int = SHARDS, seed: int = 20_240_229, bin_rows: int = 50_000, bin_bytes: int = 8 << 20,
    most_partitions: int = 1 << 18, into=("__shard", "__slot"),
) -> DataFrame:
    """docs with the shard (0 to shards - 1) and the slot (0 to the shard's rows - 1); columns of these names are replaced.

    A task orders about ``bin_rows`` rows and ``bin_bytes`` bytes of text at once. ``most_partitions`` bounds the matrix, which the
    driver draws and sends: written partitions beyond it are dealt as one, and no row is lost.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    spark = docs.sparkSession
    docs = docs.select(*(F.col(f"`{c}`") for c in others(docs, *into)))
    names = docs.columns
    size = free_name(docs, "__size")
    long = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)).cast("long") for f in docs.schema if isinstance(f.dataType, T.StringType | T.BinaryType)]
    stored, uid = with_uid(docs.withColumn(size, sum(long, F.lit(0).cast("long"))), "rows")
    found = stored.groupBy(F.shiftright(F.col(uid), 33).alias("part")).agg(F.count("*").alias("n"), F.sum(F.col(size)).alias("bytes")).collect()  # a row a partition
    stored = stored.drop(size)
    shard, bin_, key = (free_name(stored, c) for c in ("__shard", "__bin", "__key"))
    written_parts = max([r.part for r in found], default=-1) + 1
    parts = max(1, min(written_parts, most_partitions))
    own = np.zeros(max(written_parts, 1), np.int64)
    for r in found:
        own[r.part] = r.n
    first, rows = np.zeros(len(own), np.int64), np.zeros(parts, np.int64)
    for p, n in enumerate(own.tolist()):
        first[p] = rows[p % parts]
        rows[p % parts] += n
    counts = communication_matrix(rows, shards, seed)
    bins = max(1, math.ceil(int(rows.sum()) / shards / bin_rows), math.ceil(sum(r.bytes for r in found) / shards / bin_bytes))
    matrix = spark.sparkContext.broadcast(counts)
    schema = T.StructType([*stored.schema.fields, T.StructField(shard, T.IntegerType()), T.StructField(bin_, T.LongType()), T.StructField(key, T.LongType())])
    dealt = stored.mapInArrow(_dealt(matrix, seed, bins, first, uid, schema.names), schema)
    order = Window.partitionBy(shard, bin_).orderBy(key, uid)
    slot = (F.row_number().over(order) - 1).cast("long")
    out, at = dealt.withColumn(free_name(dealt, "__slot"), slot), F.col(free_name(dealt, "__slot"))
    if bins > 1:
        plan = spark.createDataFrame(pa.table({"part": pa.array(range(parts), pa.int64()), "counts": pa.array(counts.tolist(), pa.list_(pa.int64()))}))
        sizes = plan.repartition(min(parts, 1024)).mapInArrow(_count(seed, bins), "shard int, bin long, n long").groupBy("shard", "bin").agg(F.sum("n").alias("n"))
        before = F.sum("n").over(Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
        before = sizes.select(F.col("shard").alias(shard), F.col("bin").alias(bin_), F.coalesce(before, F.lit(0)).alias(free_name(out, "__before")))
        before = written(before, "bins")
        at = at + F.col(before.columns[2])
        if shards * bins <= 1_000_000:  # a cell takes a few bytes; beyond it the table is joined by its key, with the same rows
            before = F.broadcast(before)
        out = out.join(before, [shard, bin_])
    return out.select(*(F.col(f"`{c}`") for c in names), F.col(shard).alias(into[0]), at.alias(into[1]))


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = shuffle_into_shards(docs)
    text = text_column(rows)
    return rows.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("__shard").alias("shard"),
        F.col("__slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
