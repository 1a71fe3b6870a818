"""Lexical retrieval packing.

Documents become token ids with an end id behind them. Whole windows are cut off the front; the rest of each document, less
than a window, is what has to be packed. Rests are ordered by the two heaviest terms of their documents, so that lexically close ones stand
together, and cut into shards of a bounded number of rests. Each shard has a BM25 inverted index over the documents of its
rests, each with its whole text, windows cut off included (terms are token ids; document frequencies and the mean length are
counted over the whole documents of the whole corpus). The first unused rest is a seed; the
index scores the unused rests by all terms of the seed, and the best greedily fill the window; what still lacks is cut off the
best neighbour left, whose remainder stays unused. A window that a shard can't fill goes on to the next shard of the task, so that
only the last window of a task is padded.

Nulls are empty texts (one piece: the end id). Ties in retrieval go to the earlier rest. Repeated rows are packed as often as
they come. An empty table gives no pieces. A task holds one shard, however many documents share their terms. A very long text is
tokenized alone in its batch and cut like any other. Columns but the two named ones aren't kept, so their names don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, text_column, written
from .tokenization import vocabulary

WINDOW, END = 1024, 0
_NONE = -1
#: A term of more than one in so many rests of a shard is common.
COMMON = 16


def _cut(path: str, window: int, end: int, wide: bool):
    dtype = np.dtype("<u4" if wide else "<u2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, windows = vocabulary(path), TaskContext.get().partitionId() << 33
        for batch in slices(batches, "t"):
            ids = vocab.arrays(batch.column("t").to_pylist(), end)
            body = [len(x) // window * window for x in ids]
            first = windows + np.cumsum([0, *body]) // window  # written with the ids: numbers of whole windows
            windows = int(first[-1])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("uid"),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array(first[:-1], pa.int64()),
                    pa.array([x[:b].astype(dtype).tobytes() for x, b in zip(ids, body, strict=True)], pa.binary()),
                    pa.array([x[b:].astype(dtype).tobytes() for x, b in zip(ids, body, strict=True)], pa.binary()),
                ],
                names=["id", "uid", "doc_tokens", "first", "body", "rest"],
            )

    return run


def _counted(rows: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, times) of the distinct terms of each row, ordered by row and term; and the rows' lengths."""
    length = np.array([len(x) for x in rows], np.int64)
    if not length.sum():
        none = np.zeros(0, np.int64)
        return none, none, none, length
    key = np.concatenate(rows).astype(np.int64) + np.repeat(np.arange(len(rows)), length) * size
    key.sort()
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    times = np.diff(np.append(begin, len(key)))
    return key[begin] // size, key[begin] % size, times, length


def _terms(column: pa.Array, dtype: np.dtype, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return _counted([np.frombuffer(x, dtype) for x in column.to_pylist()], size)


def _heaviest_first(row: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The order by row and falling weight, of entries in order of row and term; equal weights keep it. Weights are below 512."""
    return np.argsort(row * 1024.0 - weight, kind="stable")


def _frequencies(dtype: np.dtype, size: int):
    """The document frequencies of a task's documents, and under the term -1 their number and their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows, tokens = np.zeros(size, np.int64), 0, 0
        for batch in slices(batches, "whole"):
            _, term, _, length = _terms(batch.column("whole"), dtype, size)
            total += np.bincount(term, minlength=size)
            rows, tokens = rows + len(length), tokens + int(length.sum())
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(found, _NONE), pa.int64()), pa.array(np.append(total[found], rows)), pa.array(np.append(np.zeros(len(found), np.int64), tokens))],
            names=["term", "n", "tokens"],
        )

    return run


class Bm25:
    """The weights of terms: idf from corpus-wide counts, saturation and length norm with the usual k1 and b."""

    def __init__(self, frequency: np.ndarray, rows: int, mean: float, k1: float = 1.2, b: float = 0.75):
        self.idf = np.log1p((rows - frequency + 0.5) / (frequency + 0.5)).astype(np.float32)
        self.mean, self.k1, self.b = max(mean, 1.0), k1, b

    def weigh(self, term: np.ndarray, times: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self.idf[term] * times * (self.k1 + 1) / (times + self.k1 * (1 - self.b + self.b * length / self.mean))


def _keyed(model, dtype: np.dtype, size: int):
    """Replaces the ids of the whole document by its distinct terms and their counts, and adds its two heaviest terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bm25 = model.value
        for batch in slices(batches, "whole"):
            row, term, times, length = _terms(batch.column("whole"), dtype, size)
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist()
            bags = [[x[a:b].astype(t).tobytes() for a, b in zip(ends, ends[1:], strict=False)] for x, t in ((term, dtype), (times, "<u4"))]
            weight = bm25.weigh(term, times, length[row])
            order = _heaviest_first(row, weight)
            row, term = row[order], term[order]
            first = np.searchsorted(row, np.arange(batch.num_rows))
            n = np.bincount(row, minlength=batch.num_rows)
            padded = np.append(term, [_NONE, _NONE])
            one = np.where(n > 0, padded[np.minimum(first, len(term))], _NONE)
            two = np.where(n > 1, padded[np.minimum(first + 1, len(term))], _NONE)
            kept = [c for c in batch.schema.names if c != "whole"]
            columns = [*(batch.column(c) for c in kept), *(pa.array(x, pa.binary()) for x in bags), pa.array(one, pa.int64()), pa.array(two, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "terms", "times", "one", "two"])

    return run


class Shard:
    """An inverted index over the documents of one shard; a query has all terms of its document, or the ``query_terms`` heaviest."""

    def __init__(self, ids: list[np.ndarray], bm25: Bm25, size: int, query_terms: int | None = None):
        self._index(*_counted(ids, size), bm25, size, query_terms)

    @classmethod
    def of_terms(cls, terms: list[np.ndarray], times: list[np.ndarray], length: list[int], bm25: Bm25, size: int, query_terms: int | None = None) -> Shard:
        """The index over documents whose distinct terms, in order, and their counts are known."""
        shard, row = cls.__new__(cls), np.repeat(np.arange(len(terms)), [len(x) for x in terms])
        shard._index(row, np.concatenate(terms).astype(np.int64), np.concatenate(times).astype(np.int64), np.array(length, np.int64), bm25, size, query_terms)
        return shard

    def _index(self, row: np.ndarray, term: np.ndarray, times: np.ndarray, length: np.ndarray, bm25: Bm25, size: int, query_terms: int | None) -> None:
        weight = bm25.weigh(term, times, length[row]).astype(np.float32)
        heavy = np.arange(len(row)) if query_terms is None else _heaviest_first(row, weight)
        order = np.argsort(term, kind="stable")
        self.row, self.weight, self.n = row[order], weight[order], len(length)
        terms, self.begin = np.unique(term[order], return_index=True)
        self.end = np.append(self.begin[1:], len(order))
        at = np.searchsorted(terms, term[heavy])
        most = size if query_terms is None else query_terms
        self.query = [at[a : min(b, a + most)] for a, b in zip(*(np.searchsorted(row, np.arange(len(length)) + i) for i in (0, 1)), strict=True)]
        # terms of many rests have a weight for each rest, so that their lists are added whole
        common = np.flatnonzero((self.end - self.begin) * COMMON > self.n)
        self.place = np.full(len(terms), _NONE)
        self.place[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.n), np.float32)
        for i, (a, b) in enumerate(zip(self.begin[common].tolist(), self.end[common].tolist(), strict=True)):
            self.dense[i, self.row[a:b]] = self.weight[a:b]

    def scores(self, seed: int) -> np.ndarray:
        at = self.query[seed]
        place = self.place[at]
        rare = at[place < 0]
        out = self.dense[place[place >= 0]].sum(axis=0, dtype=np.float32).astype(np.float64)
        if len(rare):
            lists = [slice(a, b) for a, b in zip(self.begin[rare].tolist(), self.end[rare].tolist(), strict=True)]
            out += np.bincount(np.concatenate([self.row[s] for s in lists]), np.concatenate([self.weight[s] for s in lists]), self.n)
        return out


def _fill(shard: Shard, left: np.ndarray, window: int, least: int, look: int) -> Iterator[list[tuple[int, int]]]:
    """Windows as lists of (rest, tokens taken). ``left`` has the tokens not taken yet of each rest."""
    free = left > 0
    seed = 0
    while True:
        ahead = np.flatnonzero(free[seed:])
        if not len(ahead):
            return
        seed += int(ahead[0])
        room = window - int(left[seed])
        taken = [(seed, int(left[seed]))]
        free[seed], left[seed] = False, 0
        if room > 0:
            scores = np.where(free, shard.scores(seed), -1.0)
            scores[free] -= np.arange(len(scores))[free] * 1e-9  # ties: the earlier rest
            while room > 0 and free.any():
                n = min(look, int(free.sum()))
                best = np.argpartition(-scores, n - 1)[:n]
                best = best[np.argsort(-scores[best], kind="stable")]
                best = best[free[best]]
                fits = False
                for i in best.tolist():
                    if left[i] <= room:
                        room -= int(left[i])
                        taken.append((i, int(left[i])))
                        free[i], left[i], scores[i], fits = False, 0, -np.inf, True
                        if not room:
                            break
                if room and not fits:
                    if room < least:
                        break
                    i = int(best[0])
                    taken.append((i, room))
                    left[i] -= room
                    room = 0
        yield taken


def _pack(model, dtype: np.dtype, size: int, window: int, shard_rests: int, least: int, query_terms: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bm25, kind = model.value, None
        pool: list[list] = []  # [id, doc_tokens, start, ids, uid, terms, times]

        def shard(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal pool
            if not pool:
                return
            index = Shard.of_terms([p[5] for p in pool], [p[6] for p in pool], [p[1] for p in pool], bm25, size, query_terms)
            left = np.array([len(p[3]) for p in pool])
            used = np.zeros(len(pool), np.int64)
            rows: list[tuple] = []
            carried: list[list] = []
            for taken in _fill(index, left, window, least, 64):
                if not last and sum(n for _, n in taken) < window - least:  # only where no rest is left
                    carried = [[*pool[i][:2], pool[i][2] + int(used[i]), pool[i][3][used[i] : used[i] + n], *pool[i][4:]] for i, n in taken]
                    continue
                # a rest is a seed once at most, so that its uid names the window
                sequence, offset = pool[taken[0][0]][4] << 1 | 1, 0
                for i, n in taken:
                    doc, tokens, start, ids = pool[i][:4]
                    rows.append((doc, start + int(used[i]), n, tokens, sequence, offset, ids[used[i] : used[i] + n].astype("<u4").tobytes()))
                    used[i] += n
                    offset += n
            pool = carried
            if rows:
                yield _pieces(kind, rows)

        for batch in batches:
            kind = batch.schema.field("id").type
            columns = [batch.column(c).to_pylist() for c in ("id", "doc_tokens", "rest", "uid", "terms", "times")]
            for doc, tokens, rest, uid, terms, times in zip(*columns, strict=True):
                ids = np.frombuffer(rest, dtype)
                pool.append([doc, tokens, tokens - len(ids), ids, uid, np.frombuffer(terms, dtype), np.frombuffer(times, "<u4")])
                if len(pool) >= shard_rests:
                    yield from shard(False)
        yield from shard(True)

    return run


def _pieces(kind: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
    types = [kind, *[pa.int64()] * 5, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])


def _windows(dtype: np.dtype, window: int):
    """The whole windows of the documents, each a sequence of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body"):
            rows = []
            for doc, tokens, first, body in zip(*(batch.column(c).to_pylist() for c in ("id", "doc_tokens", "first", "body")), strict=True):
                ids = np.frombuffer(body, dtype).astype("<u4")
                for k, start in enumerate(range(0, len(ids), window)):
                    rows.append((doc, start, window, tokens, (first + k) << 1, 0, ids[start : start + window].tobytes()))
            if rows:
                yield _pieces(batch.schema.field("id").type, rows)

    return run


def pack(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", path: str | None = None, window: int = WINDOW, end: int = END,
    shard_rests: int = 2048, rests_per_task: int = 4096, most_tasks: int = 1 << 16, least_cut: int = 16, query_terms: int | None = None,
) -> DataFrame:
    """The pieces of all documents: id, start, length, doc_tokens, sequence_id, offset and the token ids (uint32, little-endian).

    ``shard_rests`` bounds what an index holds; ``least_cut`` is the smallest piece that is cut off to fill a window; a seed
    asks for all its terms, or for the ``query_terms`` heaviest.
    """
    spark = docs.sparkSession
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    size = vocabulary(path).size
    wide = size > 1 << 16
    dtype = np.dtype("<u4" if wide else "<u2")
    kind = docs.schema[doc_id].dataType
    head = [T.StructField("id", kind), T.StructField("uid", T.LongType()), T.StructField("doc_tokens", T.LongType())]
    rest = T.StructField("rest", T.BinaryType())
    cut = docs.select(F.col(f"`{doc_id}`").alias("id"), F.monotonically_increasing_id().alias("uid"), text_column(docs, text).alias("t"))
    cut = cut.mapInArrow(_cut(path, window, end, wide), T.StructType([*head, T.StructField("first", T.LongType()), T.StructField("body", T.BinaryType()), rest]))
    cut = written(cut, "tokens")
    whole = F.concat("body", "rest").alias("whole")
    rests = cut.where(F.octet_length("rest") > 0).select("id", "uid", "doc_tokens", "rest", whole)
    counts = cut.select(whole).mapInArrow(_frequencies(dtype, size), "term long, n long, tokens long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))
    frequency, rows, tokens = np.zeros(size), 0, 0
    for r in counts.collect():  # a row for each id of the vocabulary at most
        if r.term == _NONE:
            rows, tokens = r.n, r.tokens
        else:
            frequency[r.term] = r.n
    model = spark.sparkContext.broadcast(Bm25(frequency, rows, tokens / max(rows, 1)))
    keyed = rests.mapInArrow(_keyed(model, dtype, size), T.StructType([*head, rest, T.StructField("terms", T.BinaryType()), T.StructField("times", T.BinaryType()), T.StructField("one", T.LongType()), T.StructField("two", T.LongType())]))
    keyed = written(keyed, "rests", compression="snappy")
    tasks = max(1, min(most_tasks, math.ceil(rows / rests_per_task)))
    keyed = keyed.repartitionByRange(tasks, "one", "two", "uid").sortWithinPartitions("one", "two", "uid")
    out = T.StructType([T.StructField("id", kind), *(T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")), T.StructField("ids", T.BinaryType())])
    packed = keyed.mapInArrow(_pack(model, dtype, size, window, shard_rests, least_cut, query_terms), out)
    windows = cut.where(F.octet_length("body") > 0).select("id", "doc_tokens", "first", "body").mapInArrow(_windows(dtype, window), out)
    return windows.union(packed)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3(spark, sf_dir: str) -> DataFrame:
    return digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))
