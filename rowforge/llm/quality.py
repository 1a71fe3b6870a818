"""Quality classifier on document statistics.

Random Fourier features approximate a Gaussian kernel over standardized document statistics. Each partition sums its normal
equations per fold; the sums are added row by row, and one matrix of fixed size reaches the driver, where ridge weights are
solved. Leaving one fold's sums out gives scores of rows that the weights have not seen: they choose the kernel's width and
the ridge penalty, and an isotonic fit of labels to those scores calibrates. Weights for scoring use all training folds.

A score depends on the text alone. Null texts count as empty and get a score too. Without labels of both classes every
score is 1: nothing is known against a document. Repeated rows are scored alike, ties in a score are one step of the calibration.
Very long texts are read whole, in segments, so that what stays in memory is their distinct words, word triples and lines. An
empty table gives no rows. Extra columns stay; one of the result's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .calibration import Isotonic
from .common import drop_written, free_name, others, raw_bytes, slices, text_column, written
from .labelled import fold, training_labels
from .words import grams, merged, segments_of

STATISTICS = (
    "log_words", "word_length", "distinct_words", "repeated_neighbours", "distinct_trigrams", "capitals", "digits", "spaces",
    "lines", "repeated_lines", "sentence_marks", "exclamations", "symbols", "bars", "beyond_ascii", "log_sentence",
)
_CLASSES = 12


def _classes() -> np.ndarray:
    """The class of each byte: small letter, capital, digit, space, line end, mark, exclamation, symbol, bar, other, lead, tail."""
    c = np.full(256, 9, np.int64)
    c[97:123], c[65:91], c[48:58], c[32], c[9], c[10] = 0, 1, 2, 3, 3, 4
    for b in b".,;:?'\"-()":
        c[b] = 5
    c[ord("!")] = 6
    for b in b"#$%&*@^~+=<>/\\_{}[]`":
        c[b] = 7
    c[ord("|")] = 8
    c[128:192], c[192:] = 11, 10
    return c


_CLASS = _classes()


def statistics(column: pa.Array) -> np.ndarray:
    """The statistics of each text, rows x len(STATISTICS), all finite."""
    n = len(column)
    data, offsets = raw_bytes(column)
    c = np.zeros((n, _CLASSES))
    for i in range(n):  # a mebibyte at once
        for at in range(int(offsets[i]), int(offsets[i + 1]), 1 << 20):
            c[i] += np.bincount(_CLASS[data[at : min(at + (1 << 20), int(offsets[i + 1]))]], minlength=_CLASSES)
    w, repeated = np.zeros(n), np.zeros(n)
    seen: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[], []]
    for words, row, _, own in segments_of(column, 2):
        text, count = words.text_of(), np.diff(words.first)
        new = np.arange(len(text)) - np.repeat(words.first[:-1], count) >= np.repeat(count - own, count)
        same = (words.hash[1:] == words.hash[:-1]) & (text[1:] == text[:-1]) & new[1:]
        repeated[row : row + len(own)] += np.bincount(text[1:][same], minlength=len(own))
        w[row : row + len(own)] += own
        g, whole = grams(words, 3)
        for kind, (of, value) in enumerate(((text, words.hash), (text[whole], g[whole]))):
            seen[kind].append(merged(of + row, value, np.ones(len(of), np.int64)))

    def distinct(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        if not parts:
            return np.zeros(n)
        text, _, _ = merged(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        return np.bincount(text.astype(np.int64), minlength=n).astype(float)

    lines, other_lines = np.zeros(n), np.zeros(n)
    for i, t in enumerate(column):
        own = [x for x in (t.as_py() or "").split("\n") if x.strip()]
        lines[i], other_lines[i] = len(own), len(set(own))
    chars = np.maximum(c.sum(1) - c[:, 11], 1)
    letters = np.maximum(c[:, 0] + c[:, 1] + c[:, 10], 1)
    per_word = np.maximum(w, 1)
    d, d3, w3 = distinct(seen[0]), distinct(seen[1]), np.maximum(w - 2, 1)
    return np.stack(
        [
            np.log1p(w),
            np.minimum((letters + c[:, 2]) / per_word, 50),
            np.log1p(d) / np.log1p(per_word),
            repeated / per_word,
            d3 / w3,
            c[:, 1] / letters,
            c[:, 2] / chars,
            c[:, 3] / chars,
            np.minimum(lines / per_word, 2),
            1 - other_lines / np.maximum(lines, 1),
            np.minimum(c[:, 5] / per_word, 5),
            np.minimum(c[:, 6] / per_word, 5),
            np.minimum(c[:, 7] / per_word, 5),
            np.minimum(c[:, 8] / per_word, 5),
            c[:, 10] / letters,
            np.log1p(w / (c[:, 5] + 1)),
        ],
        axis=1,
    )


def _statistics(names: list[str], body: str, into: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, body, 2 << 20):
            x = statistics(batch.column(body))
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * x.shape[1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=[*names, into])

    return run


class Fourier:
    """cos(Wz + b) over standardized statistics z, for several kernel widths; a constant stands last."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, size: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.w = rng.standard_normal((len(mean), size)) / width
        self.b = rng.uniform(0, 2 * np.pi, size)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -8, 8)
        return np.concatenate([np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b)), np.ones((len(x), 1))], axis=1)


def _matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    return batch.column(column).flatten().to_numpy().reshape(batch.num_rows, -1)


def _equations(fourier: list[Fourier]):
    """Per partition, width and training fold: the rows of the normal equations, each with its right-hand side behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(fourier[0].b) + 1
        total = np.zeros((len(fourier), 5, size, size + 1))
        for batch in batches:
            x, y, k = _matrix(batch), batch.column("label").to_numpy(), batch.column("fold").to_numpy()
            for i, f in enumerate(fourier):
                z = f(x)
                for own in range(1, 5):
                    a = z[k == own]
                    total[i, own] += a.T @ np.concatenate([a, y[k == own, None]], axis=1)
        for i in range(len(fourier)):
            for own in range(1, 5):
                if total[i, own, -1, -2]:
                    offsets = pa.array(np.arange(size + 1, dtype=np.int32) * (size + 1))
                    ids = [(i * 5 + own) * size + r for r in range(size)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(total[i, own].ravel()))], names=["id", "row"])

    return run


def _add(rows: pa.Table) -> pa.Table:
    total = sum(_matrix(b, "row").sum(axis=0) for b in rows.to_batches() if b.num_rows)
    return pa.table({"id": rows.column("id").slice(0, 1), "row": pa.array([total], pa.list_(pa.float64()))})


class Model:
    def __init__(self, fourier: Fourier, weights: np.ndarray, calibrate: Isotonic):
        self.fourier, self.weights, self.calibrate = fourier, weights, calibrate

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.calibrate(self.fourier(x) @ self.weights)


def _held(models: list[list], cells: int):
    """Per partition: counts, labels and scores of rows by score cell, scored by the weights without the row's fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(models), cells, 3))
        error = np.zeros(len(models))
        for batch in batches:
            x, y, k = _matrix(batch), batch.column("label").to_numpy(), batch.column("fold").to_numpy()
            for i, (f, weights) in enumerate(models):
                score = np.einsum("ij,ij->i", f(x), weights[k])
                cell = np.clip(((score + 0.5) / 2 * cells).astype(np.int64), 0, cells - 1)
                total[i, :, 0] += np.bincount(cell, minlength=cells)
                total[i, :, 1] += np.bincount(cell, y, cells)
                total[i, :, 2] += np.bincount(cell, score, cells)
                error[i] += ((score - y) ** 2).sum()
        i, cell = np.nonzero(total[:, :, 0])
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(cell), *(pa.array(total[i, cell, j]) for j in range(3)), pa.array(np.zeros(len(i)))], names=["model", "cell", "n", "y", "score", "error"])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(models))), pa.array(np.full(len(models), -1)), *(pa.array(np.zeros(len(models))) for _ in range(3)), pa.array(error)], names=["model", "cell", "n", "y", "score", "error"])

    return run


def fit(described: DataFrame, labels: DataFrame, *, features: int = 192, widths=(2.0, 4.0), penalties=(1e-3, 1e-1), cells: int = 2048, seed: int = 7) -> Model | None:
    """A model from rows (doc_id, fold, x) and labels (doc_id, label); None without labels of both classes."""
    size = len(STATISTICS)
    spread = described.select(*[F.avg(F.get("x", F.lit(i))).alias(f"m{i}") for i in range(size)], *[F.stddev_pop(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(size)]).first()
    labelled = written(described.join(labels, "doc_id").select("fold", "x", "label"), "labelled")
    classes = labelled.agg(F.min("label"), F.max("label")).first()
    if classes[0] is None or classes[0] == classes[1]:
        drop_written(labelled)
        return None
    mean, deviation = (np.array([spread[f"{p}{i}"] for i in range(size)], float) for p in "ms")
    fourier = [Fourier(mean, deviation, features, w * np.sqrt(size) / 4, seed) for w in widths]
    sums = labelled.mapInArrow(_equations(fourier), "id long, row array<double>").groupBy("id").applyInArrow(_add, "id long, row array<double>")
    n = features + 1
    total = np.zeros((len(widths), 5, n, n + 1))
    for r in sums.toLocalIterator():
        total.reshape(-1, n + 1)[r.id] = r.row
    solve = lambda a, p: np.linalg.solve(a[:, :-1] + p * (1 + a[-1, -2] * 1e-4) * np.eye(n), a[:, -1])
    models = []
    for i, f in enumerate(fourier):
        whole = total[i].sum(axis=0)
        for p in penalties:
            without = [solve(whole - total[i, k], p) if k and total[i, k].any() else solve(whole, p) for k in range(5)]
            models.append([f, np.stack(without)])
    found = labelled.mapInArrow(_held(models, cells), "model long, cell long, n double, y double, score double, error double")
    found = found.groupBy("model", "cell").agg(*(F.sum(c).alias(c) for c in ("n", "y", "score", "error"))).collect()  # models x cells at most
    drop_written(labelled)
    best = min((r.error, r.model) for r in found if r.cell < 0)[1]
    rows = [r for r in found if r.model == best and r.cell >= 0]
    n_, y_, s_ = (np.array([r[c] for r in rows]) for c in ("n", "y", "score"))
    # weights[0] leave no training fold out
    return Model(models[best][0], models[best][1][0], Isotonic(s_ / n_, y_ / n_, n_))


def _scorer(model, names: list[str], x: str, into: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = model.value
        for batch in batches:
            score = np.ones(batch.num_rows) if scores is None else scores(_matrix(batch, x))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(score)], names=[*names, into])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "quality", into: str = "quality", **options) -> DataFrame:
    """docs with a score from 0 to 1; a column of its name is replaced.

    The statistics are written beside the documents' columns, so that neither texts nor scores are ever joined.
    """
    names, body, x = others(docs, into), free_name(docs, "__text"), free_name(docs, "__statistics")
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField(x, T.ArrayType(T.DoubleType()))])
    described = written(docs.withColumn(body, text_column(docs, text)).mapInArrow(_statistics(names, body, x), schema), "statistics")
    model = fit(described.select(F.col(f"`{doc_id}`").alias("doc_id"), fold(doc_id).alias("fold"), F.col(x).alias("x")), training_labels(labels, label), **options)
    model = docs.sparkSession.sparkContext.broadcast(model)
    return described.mapInArrow(_scorer(model, names, x, into), T.StructType([*schema.fields[:-1], T.StructField(into, T.DoubleType())]))


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = F.col("quality")
    return quality_scores(docs, labels).select("doc_id", (fold() == 0).alias("held_out"), score.alias("score"), F.when(score >= 0.3, 1).otherwise(0).alias("predicted"))
