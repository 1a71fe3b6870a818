"""Benchmark decontamination by winnowing.

Of every ``w`` consecutive k-gram hashes the smallest is kept as a fingerprint, of documents and of benchmark items alike,
so texts that share ``k + w - 1`` words share a fingerprint. Fingerprints of documents and of the benchmark are joined, and what
meets is extended: the windows of ``k + w - 1`` words around a document's fingerprint are joined with the windows of the items.
With k = w = 7 that finds every shared span of 13 words. Items of fewer than 13 words are one window each and are joined by the
hash of that many words.

Documents are written once with their words counted and with the fingerprints that may be the benchmark's, by a Bloom filter of
at most ``filter_bytes``; only those are shuffled, and a filter too small for its benchmark lets more of them through but
changes no result. Nothing that is sent to executors grows with the benchmark beyond that, and the driver sees the filter alone.
Fingerprints and windows that are frequent among the documents are joined by broadcast, ordinary ones by shuffle, so neither a
passage in a third of all documents nor one in a third of all items meets in one task, and no pair of a document and an item is
made before a window of the item is known to occur.

Nulls and empty texts have no words and are never contaminated. Repeated documents get equal results each; items that occur
more than once under one id count once; a null id counts as empty; items without words, and a benchmark without rows, hit nothing.
A very long text is read whole, in segments of a bounded size. All columns of the documents are kept, whatever their names; the
result is one struct column, which replaces one of its name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_written, free_name, join_counted, mix, others, slices, text_column, written
from .words import Words, grams, segments_of, words_of

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)
_CANDIDATE = pa.struct([("print", pa.int64()), ("window", pa.int64()), ("size", pa.int32()), ("starts", pa.list_(pa.int64()))])
_CANDIDATES = T.ArrayType(T.StructType([T.StructField("print", T.LongType()), T.StructField("window", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("starts", T.ArrayType(T.LongType()))]))


def _rolling(x: np.ndarray, n: int, pick, fill) -> np.ndarray:
    """pick over the n values from each position on; positions beyond the end count as fill."""
    out, width = x, 1
    while width < n:
        step = min(width, n - width)
        moved = np.full(len(x), fill, x.dtype)
        moved[: max(0, len(x) - step)] = out[step:]
        out, width = pick(out, moved), width + step
    return out


def fingerprints(hashes: np.ndarray, whole: np.ndarray, w: int) -> np.ndarray:
    """Positions of k-gram hashes that are the smallest of some w consecutive ones of a text (ties: all of them).

    ``whole`` marks k-grams that lie in one text; other positions never count.
    """
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    hashes = np.where(whole, hashes, top)
    full = _rolling(whole.astype(np.uint8), w, np.minimum, 0).astype(bool)
    # w consecutive whole k-grams are of one text: between two texts lie k - 1 positions that are not whole, if k > 1
    smallest = np.where(full, _rolling(hashes, w, np.minimum, top), 0)
    back = _rolling(smallest[::-1], w, np.maximum, np.uint64(0))[::-1]
    return np.flatnonzero(whole & (back == hashes) & (hashes != 0))


def _prints(words: Words, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """The positions and the hashes of the fingerprints."""
    h, whole = grams(words, k)
    at = fingerprints(h, whole, w)
    return at, h[at]


def _windows_of(words: Words, size: int) -> np.ndarray:
    """A hash for each position, of the window of ``size`` words there; windows of different sizes have different hashes."""
    g, _ = grams(words, size)
    return mix(g ^ mix(np.array([size], np.uint64))[0])


def _items(k: int, w: int):
    """Of each item its fingerprints (kind 0) and the distinct windows (kind 1, with their size), as (id, kind, size, hash)."""
    span = k + w - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", 1 << 20):
            words = words_of(batch.column("t"))
            n, first = np.diff(words.first), words.first
            at, found = _prints(words, k, w)
            text_of = words.text_of()
            parts = [(text_of[at], np.zeros(len(at), np.int32), np.full(len(at), span, np.int32), found)]
            room = np.arange(len(text_of)) + span <= np.repeat(first[1:], n)
            parts.append((text_of[room], np.ones(room.sum(), np.int32), np.full(room.sum(), span, np.int32), _windows_of(words, span)[room]))
            for size in sorted({int(x) for x in n if 0 < x < span}):
                of = np.flatnonzero(n == size)
                parts.append((of, np.ones(len(of), np.int32), np.full(len(of), size, np.int32), _windows_of(words, size)[first[of]]))
            item, kind, size, value = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(item)), pa.array(kind), pa.array(size), pa.array(value.view(np.int64))], names=["id", "kind", "size", "hash"])

    return run


class Filter:
    """A Bloom filter of hashes with two bits each, and the sizes of the short windows in it."""

    def __init__(self, words: np.ndarray, sizes: list[int]):
        self.words, self.sizes = words, sizes

    @staticmethod
    def places(column, bits: int) -> list:
        """The two bits of a hash column, as Spark expressions; ``bits`` is a power of two."""
        return [F.pmod(F.shiftright(column, shift), F.lit(bits)) for shift in (0, 31)]

    def may_have(self, value: np.ndarray) -> np.ndarray:
        signed, bits, out = value.view(np.int64), len(self.words) * 64, np.ones(len(value), bool)
        for shift in (0, 31):
            at = (signed >> shift) & (bits - 1)
            out &= (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        return out


def _filter_of(known: DataFrame, filter_bytes: int, span: int) -> Filter:
    """The filter of all fingerprints and windows; the driver gets its words, at most ``filter_bytes`` and their numbers."""
    counts = known.groupBy("size").agg(F.count("*").alias("n")).collect()  # a row a size: span of them at most
    wanted = 32 * sum(r.n for r in counts)
    bits = 1 << min(max(16, math.ceil(math.log2(max(wanted, 1)))), int(math.log2(filter_bytes * 8)))
    place = F.explode(F.array(*Filter.places(F.col("hash"), bits)))
    set_ = known.select(place.alias("at")).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 AS int))").alias("bit"))
    rows = set_.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(bits >> 6, np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return Filter(words, sorted(r["size"] for r in counts if r["size"] < span))


def _candidates(words: Words, may: Filter, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, fingerprint, window, size) of each window of a document that may be an item's, with the fingerprint in it."""
    span = k + w - 1
    n = np.diff(words.first)
    last = np.repeat(words.first[1:], n)
    at, found = _prints(words, k, w)
    hit = may.may_have(found)
    at, found = at[hit], found[hit]
    out = []
    if len(at):
        first = np.repeat(words.first[:-1], n)
        begin = (at[:, None] - np.arange(w)[None, :]).ravel()
        print_ = np.repeat(found, w)
        own = np.repeat(at, w)
        fits = (begin >= first[own]) & (begin + span <= last[own])
        begin, print_ = begin[fits], print_[fits]
        window = _windows_of(words, span)[begin] if len(begin) else np.zeros(0, np.uint64)
        hit = may.may_have(window)
        out.append((begin[hit], print_[hit], window[hit], np.full(hit.sum(), span)))
    for size in may.sizes:
        window = _windows_of(words, size)
        begin = np.flatnonzero(may.may_have(window) & (np.arange(len(window)) + size <= last))
        out.append((begin, np.zeros(len(begin), np.uint64), window[begin], np.full(len(begin), size)))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _scan(may, body: str, names: list[str], into: list[str], k: int, w: int):
    """Adds the number of words and the candidates of each text; texts of more than a segment go segment by segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = may.value
        for batch in slices(batches, body, 2 << 20):
            n_words = np.zeros(batch.num_rows, np.int64)
            found: list[dict[tuple[int, int, int], list[int]]] = [{} for _ in range(batch.num_rows)]
            for words, row, before, own in segments_of(batch.column(body), k + w - 2):
                # positions of a segment's last words are the next one's; windows that begin there are found in either
                text_of = words.text_of()
                n_words[row : row + len(own)] += own
                for p, *key in zip(*(x.tolist() for x in _candidates(words, known, k, w)), strict=True):
                    i = int(text_of[p])
                    found[row + i].setdefault(tuple(key), []).append(before + p - int(words.first[i]))
            rows = [[{"print": _signed(a), "window": _signed(b), "size": c, "starts": sorted(set(starts))} for (a, b, c), starts in x.items()] for x in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(n_words), pa.array(rows, pa.list_(_CANDIDATE))], names=[*names, *into])

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The union of the spans of each document, and how many words are in it."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        n_hit, spans = [], []
        for hits in batch.column("hits").to_pylist():
            own = _union([(a, a + h["size"]) for h in hits for a in h["starts"]])
            n_hit.append(sum(b - a for a, b in own))
            spans.append([{"start": a, "end": b} for a, b in own])
        yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(n_hit, pa.int64()), pa.array(spans, kind)], names=["uid", "n_hit", "spans"])


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _of_known(rows: DataFrame, key: str, known: DataFrame, label: str, made: list[DataFrame]) -> DataFrame:
    """The rows whose key is in the column of that name of ``known``, which has each key once. ``made`` gets what was written."""
    counted = written(rows.groupBy(key).agg(F.count("*").alias("__n")).join(known, key, "left_semi"), label)
    made.append(counted)
    return join_counted(rows, counted, [key], "__n").drop("__n")


def mark_contamination(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    into: str = "contamination", k: int = 7, w: int = 7, filter_bytes: int = 16 << 20, most_broadcast: int = 32 << 20,
) -> DataFrame:
    """docs with a struct: n_words, n_hit, the items found (ids as strings, sorted) and the hit spans in words.

    ``filter_bytes`` bounds the filter that is sent to the executors. What was found goes to the documents by broadcast where it is
    at most ``most_broadcast`` bytes, else by a shuffled join, with the same result.
    """
    spark, span = docs.sparkSession, k + w - 1
    items = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("id"), text_column(benchmark, item_text).alias("t"))
    items = written(items.mapInArrow(_items(k, w), "id string, kind int, size int, hash long").distinct(), "items")
    known = items.select("kind", "size", "hash").distinct()
    may = spark.sparkContext.broadcast(_filter_of(known, filter_bytes, span))
    names = others(docs, into)
    uid, n_words, found = (free_name(docs, c) for c in ("__uid", "__n_words", "__candidates"))
    body = free_name(docs, "__body")
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField(n_words, T.LongType()), T.StructField(found, _CANDIDATES)])
    scanned = docs.select(*(F.col(f"`{c}`") for c in names), text_column(docs, text).alias(body)).mapInArrow(_scan(may, body, names, [n_words, found], k, w), schema)
    stored = written(scanned.withColumn(uid, F.monotonically_increasing_id()), "scanned")
    near = stored.where(F.size(F.col(found)) > 0).select(F.col(uid).alias("uid"), F.inline(F.col(found)))
    prints = items.where((F.col("kind") == 0)).select(F.col("hash").alias("print")).distinct()
    made = [items]
    long = _of_known(near.where(F.col("size") == span), "print", prints, "prints", made)
    near = written(long.unionByName(near.where(F.col("size") < span)).select("uid", "window", "size", "starts").distinct(), "windows")
    windows = items.where("kind = 1").select(F.col("hash").alias("window")).distinct()
    hits = written(_of_known(near, "window", windows, "counts", made), "hits")
    spans = hits.groupBy("uid").agg(F.collect_list(F.struct("size", "starts")).alias("hits")).mapInArrow(_spans, "uid long, n_hit long, spans array<struct<start: long, end: long>>")
    holders = items.where("kind = 1").select(F.col("hash").alias("window"), "id")
    # both sides are written: Spark splits a window that many documents have or many items hold
    places = written(hits.select("uid", "window").distinct(), "places")
    ids = places.join(holders, "window").groupBy("uid").agg(F.array_sort(F.collect_set("id")).alias("items"))
    place, hit = free_name(stored, "__place"), free_name(stored, "__hit")
    result = written(spans.join(ids, "uid").select(F.col("uid").alias(place), F.struct("n_hit", "items", "spans").alias(hit)), "found")
    drop_written(near, hits, places, *made)
    size = result.agg(F.sum(64 + 16 * F.size(f"{hit}.spans") + F.aggregate(F.col(hit)["items"], F.lit(0), lambda n, x: n + 16 + F.octet_length(x)))).first()[0] or 0
    result = F.broadcast(result) if size <= most_broadcast else result
    joined = stored.drop(found).join(result, F.col(uid) == F.col(place), "left")
    empty = (("n_hit", F.lit(0).cast("long")), ("items", F.array().cast("array<string>")), ("spans", F.array().cast(RESULT["spans"].dataType)))
    value = F.struct(F.col(n_words).alias("n_words"), *(F.coalesce(F.col(hit)[c], none).alias(c) for c, none in empty))
    return joined.select(*(F.col(f"`{c}`") for c in names), value.alias(into))


def contaminated(into: str = "contamination"):
    """The rule: some word is hit, and at least every twentieth."""
    hit, words = F.col(f"{into}.n_hit"), F.col(f"{into}.n_words")
    return (hit > 0) & (20 * hit >= words)


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = mark_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    c = F.col("contamination")
    return marked.select(
        "doc_id",
        c.n_words.alias("n_words"),
        c.n_hit.alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


#: Every window of every item against every window of that length of every document.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS gram
  FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS r(i) WHERE len(w) > 0
), dw AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM d, (SELECT DISTINCT n FROM bw) s, unnest(range(1, len(w) - n + 2)) AS r(i) WHERE len(w) >= n
), hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.gram = bw.gram),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS r(p) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""
