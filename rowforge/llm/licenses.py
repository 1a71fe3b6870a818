"""Licence scan by a trained paragraph classifier.

Sparse word n-gram logistic regression over hashed words and word pairs tells licence families from one another and from an
unknown class. It is trained on the standard notices, cut, shortened and with words replaced, against paragraphs that speak of
licences and grant none, against a bounded sample of the corpus' own paragraphs, and against those with a clause of a notice in
them. A temperature calibrates the families among themselves; an isotonic fit calibrates the unknown class, on paragraphs of the
corpus and notices that the weights have not seen. Every paragraph of every text is classified; a family counts only if a
template confirms it. A paragraph and a notice are compared by word triples: of the notice so large a share must stand in the
paragraph, or of the paragraph in the notice if that is ten triples or more; fewer than three common triples confirm only a
notice that has no more. A paragraph that negates what it shares is not confirmed. Headings of one or two words must be equal.

A paragraph is a line. Nulls and empty texts have no paragraph. Repeated rows are scanned alike. Of equally probable families the
first in order counts. Very long texts are read in pieces that end at lines; a line is read whole. An empty table gives no rows.
Extra columns stay; one of the result's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .calibration import Isotonic
from .common import free_name, hash_sample, mix, others, raw_bytes, slices, text_column
from .license_templates import HEADINGS, NEGATIONS, OTHER, TEMPLATES
from .words import Words, grams, words_of

FAMILIES = ("unknown", *TEMPLATES)
HIT = T.StructType(
    [
        T.StructField("paragraph", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("family", T.StringType()),
        T.StructField("probability", T.DoubleType()),
        T.StructField("similarity", T.DoubleType()),
        T.StructField("confirmed", T.BooleanType()),
    ]
)
_HIT = pa.struct([("paragraph", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64()), ("confirmed", pa.bool_())])


@dataclass
class Paragraphs:
    """The paragraphs that have words, of several texts: their text, place in it, bytes, and words from first to first."""

    text: np.ndarray
    place: np.ndarray
    start: np.ndarray
    end: np.ndarray
    words: Words


def paragraphs(column: pa.Array) -> Paragraphs:
    data, offsets = raw_bytes(column)
    words = words_of(column)
    cuts = np.union1d(offsets[:-1], np.flatnonzero(data == 10) + 1)
    cuts = cuts[cuts < len(data)]
    ends = np.append(cuts[1:], len(data))
    text = np.searchsorted(offsets, cuts, side="right") - 1
    first = np.searchsorted(words.start, cuts)
    n = np.diff(np.append(first, len(words.start)))
    line = np.arange(len(cuts)) - np.searchsorted(text, text)
    keep = np.flatnonzero(n)
    bounds = np.append(first[keep], len(words.start))
    own = Words(words.data, words.start, words.end, words.hash, bounds)
    start = cuts - offsets[text]
    stop = np.where((ends > 0) & (data[np.maximum(ends - 1, 0)] == 10), ends - 1, ends) - offsets[text]
    return Paragraphs(text[keep], line[keep], start[keep], stop[keep], own)


def features(words: Words, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, weight) of the words and word pairs of each paragraph; a row's weights have the norm 1 or less."""
    n = np.diff(words.first)
    row = words.text_of()
    pair, whole = grams(words, 2)
    rows = np.concatenate([row, row[whole]])
    bucket = np.concatenate([mix(words.hash), mix(pair[whole] + np.uint64(1))]) >> np.uint64(64 - bits)
    weight = 1 / np.sqrt(np.maximum(2 * n - 1, 1))
    return rows, bucket.astype(np.int64), weight[rows]


def examples(corpus: list[str], seed: int = 11, variants: int = 24, filler_words: int = 4000) -> tuple[list[str], np.ndarray]:
    """Paragraphs and their classes: notices whole, cut to a window of words, and with words dropped or replaced.

    Unknown are paragraphs that speak of licences, those of the corpus, and every fourth of these with a short clause of a notice.
    ``filler_words`` of the corpus' words stand in for replaced ones.
    """
    rng = np.random.default_rng(seed)
    filler = [w for p in (*OTHER, *corpus) for w in p.split()][:filler_words]
    notices = [t.split() for own in TEMPLATES.values() for t in own]
    texts, labels = [], []

    def add(text: str, label: int) -> None:
        texts.append(text)
        labels.append(label)

    for label, family in enumerate(FAMILIES[1:], 1):
        for heading in HEADINGS[family]:
            for _ in range(variants // 4):
                add(heading, label)
        for template in TEMPLATES[family]:
            words = template.split()
            for v in range(variants):
                own = list(words)
                if v and len(own) > 12:  # a window of at least twelve words, as when a notice is wrapped
                    size = int(rng.integers(12, len(own) + 1))
                    begin = int(rng.integers(0, len(own) - size + 1))
                    own = own[begin : begin + size]
                if v % 3 == 2:
                    own = [filler[int(rng.integers(len(filler)))] if rng.random() < 0.05 else w for w in own if rng.random() > 0.03]
                if v % 4 == 3:
                    own = [filler[int(rng.integers(len(filler)))] for _ in range(int(rng.integers(1, 6)))] + own
                add(" ".join(own), label)
    for text in OTHER:
        for _ in range(variants):
            words = text.split()
            add(" ".join(w for w in words if rng.random() > 0.1) or text, 0)
    for i, text in enumerate(corpus):
        add(text, 0)
        if i % 4 == 0:
            own, notice = text.split(), notices[int(rng.integers(len(notices)))]
            size = min(len(notice), int(rng.integers(2, 6)))
            begin, at = int(rng.integers(0, len(notice) - size + 1)), int(rng.integers(0, len(own) + 1))
            add(" ".join(own[:at] + notice[begin : begin + size] + own[at:]), 0)
    return texts, np.array(labels)


class Model:
    """Weights per bucket and family, the calibration, and the word triples of each notice.

    A fifth of the notices' variants and of the corpus' paragraphs is held out of the fit; the calibration uses it alone.
    """

    def __init__(self, corpus: list[str], bits: int = 18, rounds: int = 60, rate: float = 4.0, penalty: float = 1e-5):
        self.bits = bits
        texts, labels = examples(corpus)
        words = words_of(pa.array(texts, pa.string()))
        row, bucket, weight = features(words, bits)
        used, column = np.unique(bucket, return_inverse=True)
        held = np.arange(len(texts)) % 5 == 0
        k = len(FAMILIES)
        # a class weighs alike however many examples it has; the unknown class weighs as much as all others together
        share = np.bincount(labels, minlength=k).astype(float)
        each = np.where(np.arange(k) == 0, k - 1.0, 1.0)[labels] / share[labels]
        train = np.where(held, 0.0, each)
        train = (train / train.sum() * k).astype(np.float32)
        # the same entries by row and by bucket, so that both sums are over neighbours
        by_row, by_column = np.argsort(row, kind="stable"), np.argsort(column, kind="stable")
        rows, columns = row[by_row], column[by_column]
        first_row, first_column = (np.flatnonzero(np.append(True, x[1:] != x[:-1])) for x in (rows, columns))
        weight = weight.astype(np.float32)[:, None]
        w, bias = np.zeros((len(used), k), np.float32), np.zeros(k, np.float32)
        speed_w, speed_b = np.zeros_like(w), np.zeros(k, np.float32)
        target = np.eye(k, dtype=np.float32)[labels]

        def logits() -> np.ndarray:
            out = np.tile(bias, (len(texts), 1))
            out[rows[first_row]] += np.add.reduceat(w[column[by_row]] * weight[by_row], first_row, axis=0)
            return out

        for _ in range(rounds):  # gradient steps with momentum on the whole training set: deterministic
            g = (target - _softmax(logits())) * train[:, None]
            step = np.add.reduceat(weight[by_column] * g[row[by_column]], first_column, axis=0) - np.float32(penalty) * w
            speed_w = np.float32(0.9) * speed_w + np.float32(rate * 10) * step
            speed_b = np.float32(0.9) * speed_b + np.float32(rate * 0.1) * g.sum(0)
            w += speed_w
            bias += speed_b
        z, own = logits()[held].astype(float), labels[held]
        self.temperature = min(np.geomspace(0.25, 4, 33), key=lambda t: self._loss(z / t, own))
        self.table = np.zeros((1 << bits, k), np.float32)
        self.table[used] = w
        self.says = np.abs(self.table).max(1) > 1e-3
        self.bias = bias.astype(float)
        # both sides weigh alike: the number of variants says nothing about the corpus
        sides = np.maximum(np.bincount((own > 0).astype(int), minlength=2), 1)
        self.known = Isotonic(1 - _softmax(z / self.temperature)[:, 0], (own > 0).astype(float), 1 / sides[(own > 0).astype(int)])
        self.notices = {f: [self._triples(t) for t in TEMPLATES[f]] for f in FAMILIES[1:]}
        self.headings = {f: {self._sequence(t) for t in (*HEADINGS[f], *TEMPLATES[f])} for f in FAMILIES[1:]}
        self.negations = {int(words_of(pa.array([n])).hash[0]) for n in NEGATIONS}

    @staticmethod
    def _loss(z: np.ndarray, labels: np.ndarray) -> float:
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), labels]).mean())

    @staticmethod
    def _triples(text: str) -> frozenset[int]:
        g, whole = grams(words_of(pa.array([text], pa.string())), 3)
        return frozenset(g[whole].tolist())

    @staticmethod
    def _sequence(text: str) -> tuple[int, ...]:
        return tuple(words_of(pa.array([text], pa.string())).hash.tolist())

    def probabilities(self, words: Words, most: int = 1 << 18) -> np.ndarray:
        """Calibrated, paragraphs x families; ``most`` words are looked at at once."""
        n, count = len(words.first) - 1, np.diff(words.first)
        row, z = words.text_of(), np.tile(self.bias, (n, 1))
        weight = 1 / np.sqrt(np.maximum(2 * count - 1, 1))
        pair, whole = grams(words, 2)
        for begin in range(0, len(row), most):
            part = slice(begin, begin + most)
            for own, value in ((row[part], mix(words.hash[part])), (row[part][whole[part]], mix(pair[part][whole[part]] + np.uint64(1)))):
                bucket = (value >> np.uint64(64 - self.bits)).astype(np.int64)
                some = self.says[bucket]
                own, bucket = own[some], bucket[some]
                if len(own):
                    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                    z[own[first]] += np.add.reduceat(self.table[bucket] * weight[own, None], first, axis=0)
        p = _softmax(z / self.temperature)
        known = self.known(1 - p[:, 0])
        p[:, 1:] *= (known / np.maximum(1 - p[:, 0], 1e-12))[:, None]
        p[:, 0] = 1 - known
        return p

    def similarity(self, family: str, words: list[int], triples: list[int]) -> float:
        """How much of a notice stands in the paragraph, or of the paragraph in a notice, from its words and triples in order."""
        if tuple(words) in self.headings[family]:
            return 1.0
        own, best = frozenset(triples), 0.0
        for notice in self.notices[family]:
            common = own & notice
            if len(common) >= min(3, max(1, len(notice))) and not self._negated(words, triples, common):
                best = max(best, len(common) / len(notice), len(common) / len(own) if len(common) >= 10 else 0.0)
        return best

    def _negated(self, words: list[int], triples: list[int], common: frozenset[int]) -> bool:
        """Whether a negation stands among the three words before the first common triple."""
        first = next(i for i, t in enumerate(triples) if t in common)
        return any(w in self.negations for w in words[max(0, first - 3) : first])

    def scan(self, column: pa.Array, threshold: float, likeness: float) -> list[list[dict]]:
        """The hits of each text."""
        out: list[list[dict]] = [[] for _ in range(len(column))]
        p = paragraphs(column)
        if not len(p.text):
            return out
        probability = self.probabilities(p.words)
        best = probability[:, 1:].argmax(1) + 1
        sure = probability[np.arange(len(best)), best]
        for i in np.flatnonzero(sure >= threshold).tolist():
            first, last = int(p.words.first[i]), int(p.words.first[i + 1])
            own = p.words.hash[first:last]
            g, whole = grams(Words(p.words.data, p.words.start[first:last], p.words.end[first:last], own, np.array([0, last - first])), 3)
            family = FAMILIES[best[i]]
            like = self.similarity(family, own.tolist(), g[whole].tolist())
            out[p.text[i]].append(
                {"paragraph": int(p.place[i]), "start": int(p.start[i]), "end": int(p.end[i]), "family": family, "probability": float(sure[i]), "similarity": like, "confirmed": like >= likeness}
            )
        return out


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _pieces(data: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(from, to) of pieces of about ``most`` bytes that end behind line ends."""
    begin = 0
    while begin < len(data):
        end = min(len(data), begin + most)
        while end < len(data) and data[end - 1] != 10:
            ahead = data[end : end + 65_536] == 10
            end += int(ahead.argmax()) + 1 if ahead.any() else len(ahead)
        yield begin, end
        begin = end


def _scanner(model, names: list[str], body: str, into: str, threshold: float, likeness: float, most: int = 4 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in slices(batches, body, 2 << 20):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(scan_texts(m, batch.column(body), threshold, likeness, most), pa.list_(_HIT))], names=[*names, into])

    return run


def scan_texts(model: Model, column: pa.Array, threshold: float, likeness: float, most: int = 4 << 20) -> list[list[dict]]:
    """The hits of each text; a text longer than ``most`` bytes goes piece by piece."""
    data, offsets = raw_bytes(column)
    if len(column) != 1 or len(data) <= most:
        return model.scan(column, threshold, likeness)
    out, lines = [], 0
    for begin, end in _pieces(data, most):
        part = data[begin:end]
        for h in model.scan(pa.array([part.tobytes()], pa.binary()), threshold, likeness)[0]:
            out.append(h | {"paragraph": h["paragraph"] + lines, "start": h["start"] + begin, "end": h["end"] + begin})
        lines += int((part == 10).sum())
    return [out]


def corpus_paragraphs(docs: DataFrame, rows: int = 500, lines: int = 3000, longest: int = 2000) -> list[str]:
    """Paragraphs that share no word triple with a notice and are no heading: examples of unknown.

    Of the ``rows`` texts with the smallest hashes, the ``lines`` paragraphs of the smallest hashes, none over ``longest`` characters.
    """
    chosen = hash_sample(docs.where(F.octet_length("t") > 0), ["t"], rows)
    found = chosen.select(F.explode(F.split("t", "\n")).alias("line")).where(F.length(F.trim("line")).between(1, longest)).distinct()
    known = frozenset().union(*(Model._triples(t) for notices in TEMPLATES.values() for t in notices))
    headings = {Model._sequence(t) for own in HEADINGS.values() for t in own}
    sample = [r.line for r in hash_sample(found, ["line"], lines).collect()]
    return [line for line in sample if not Model._triples(line) & known and Model._sequence(line) not in headings]


def license_hits(
    docs: DataFrame, *, text: str = "text", into: str = "licenses", threshold: float = 0.5, likeness: float = 0.6,
    sample_rows: int = 500, sample_lines: int = 3000, longest_line: int = 2000,
) -> DataFrame:
    """docs with the licence paragraphs of each text; a column of that name is replaced.

    ``sample_rows`` bounds the documents of which ``sample_lines`` paragraphs, none over ``longest_line`` characters, join the
    training set; every paragraph of all documents is scanned. A paragraph of at least the probability ``threshold`` is a hit, and
    is confirmed by the similarity ``likeness``.
    """
    names, body = others(docs, into), free_name(docs, "__text")
    corpus = corpus_paragraphs(docs.select(text_column(docs, text).alias("t")), sample_rows, sample_lines, longest_line)
    model = docs.sparkSession.sparkContext.broadcast(Model(corpus))
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField(into, T.ArrayType(HIT))])
    return docs.withColumn(body, text_column(docs, text)).mapInArrow(_scanner(model, names, body, into, threshold, likeness), schema)


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    hits = F.filter("licenses", lambda h: h["confirmed"])
    return license_hits(docs).select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_predicted"),
        F.size(hits).cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["family"]))), ",").alias("families"),
        F.array_max(F.transform(hits, lambda h: h["probability"])).alias("probability"),
    )
