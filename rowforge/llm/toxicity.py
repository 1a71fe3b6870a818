"""Toxicity classifier: gradient-boosted trees over dense features of whole texts, calibrated isotonically.

Features are lexicon densities, nearness of a lexicon word to the second person, capitals, punctuation and obfuscation. The
lexicon is a short fixed list of English insults and what the training labels teach: words and word beginnings that are much
more frequent in toxic texts, so other languages need no list. A token is looked up as it stands, without its outer marks,
and with its obfuscation undone (digits and signs for letters, marks between letters).

The fit uses at most ``fit_rows`` labelled rows, those of the smallest hash; the lexicon seen by a row in the fit comes from
the other half of the training folds, and calibration uses scores by trees that have not seen the row's fold. Scoring reads
every text whole and keeps nothing from the corpus.

A score depends on the text alone; null counts as empty. Without labels of both classes every score is 0: nothing is known
against a document. Repeated rows are scored alike, ties in a score are one step of the calibration. Very long texts are read
whole, piece by piece. An empty table gives no rows. Extra columns stay; one of the result's name is replaced.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boosting import BoostedTrees
from .calibration import Isotonic
from .common import drop_written, free_name, hash_sample, others, slices, text_column, written
from .labelled import fold, training_labels

#: Common English insults, and second-person words of English, German, French and Spanish.
INSULTS = frozenset(
    "arsehole asshole bastard bitch clown coward creep cretin crap cunt damn degenerate dick dickhead disgusting douchebag dumb dumbass "
    "dumbo fag faggot filth filthy freak fuck fucker fucking garbage hate hideous idiot idiotic idiots imbecile jackass jerk kill lame "
    "liar loser losers lunatic maggot moron moronic morons motherfucker nasty pathetic pervert pig prick psycho retard retarded rotten "
    "scum scumbag shit shitty slut stupid suck sucks trash troll ugly useless vermin vile whore worthless".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur ya youre you're du dich dir dein deine deinen deiner ihr euch euer eure "
    "tu toi te ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro vuestra os".split()
)
_SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e", "+": "t"})
_OUTER = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W_]+")
_OBSCURE = re.compile(r"[^\W\d_](?:[*@$!|€+#%.\-_]|\d)+[^\W\d_]")
SHORTEST, LONGEST = 3, 8
#: Longer tokens aren't kept between texts; their features are computed each time.
KEPT = 40
#: Tokens to either side that are near.
NEAR = 5

FEATURES = (
    "log_tokens", "insults", "insult_density", "learned", "learned_density", "strongest", "evidence", "evidence_density", "beginnings",
    "beginning_density", "beginning_evidence", "second_person", "near_second_person", "capital_tokens", "exclamations", "questions",
    "runs_of_marks", "obscured", "obscured_density", "unmasked", "single_letters", "distinct_hits",
)


def beginnings(word: str) -> list[str]:
    return [word[:n] for n in range(SHORTEST, min(LONGEST, len(word) - 1) + 1)]


def terms(text: str) -> set[str]:
    """What the lexicon is learned from: ``=word`` for words and ``^start`` for beginnings of longer ones."""
    out = set()
    for token in set(text.lower().split()):
        word = _OUTER.sub("", token)
        if len(word) >= SHORTEST:
            out.add("=" + word)
            out.update("^" + b for b in beginnings(word))
    return out


class Tokens(dict):
    """From a token to its row in a table of token features; a row is made when its token is first seen.

    Row 0 is that of plain words which nothing is known about, the bulk of any text: what is computed of a text leaves them out.
    At most ``most`` tokens are kept, and as many again that aren't plain; others are looked at each time.
    """

    def __init__(self, lexicon: dict[str, float], most: int = 1 << 18):
        super().__init__()
        self.most = most
        self.words = {t[1:]: v for t, v in lexicon.items() if t[0] == "="}
        self.starts = {t[1:]: v for t, v in lexicon.items() if t[0] == "^"}
        self.lengths = sorted({len(t) for t in self.starts})
        self.known, self.pending, self.late = np.zeros((1, 11)), [], []

    def __missing__(self, token: str) -> int:
        word = token if token.isalpha() else token[:-1] if token[-1] in ".,;:" and token[:-1].isalpha() else ""
        if len(word) > 1:  # a plain word: nothing to undo
            low, get, start = word.lower(), self.starts.get, 0.0
            for n in self.lengths:
                if n >= len(low):
                    break
                start = max(start, get(low[:n], 0.0))
            learned, insult, you, capital = self.words.get(low, 0.0), low in INSULTS, low in SECOND_PERSON, token.upper() == token and token.lower() != token
            if not (start or learned or insult or you or capital):
                if len(self) < self.most and len(token) <= KEPT:
                    self[token] = 0
                return 0
            row = (insult, learned, start, you, capital, 0, 0, False, False, False, False)
        else:
            row = self._row(token)
        if len(self) < 2 * self.most and len(token) <= KEPT:
            self[token] = at = len(self.known) + len(self.pending)
            self.pending.append(row)
            return at
        self.late.append(row)
        return -len(self.late)

    def _row(self, token: str) -> tuple[float, ...]:
        low = token.lower()
        word = _OUTER.sub("", low)
        plain = _INNER.sub("", word.translate(_SIGNS)) if word else ""
        obscured = bool(_OBSCURE.search(_OUTER.sub("", token)))
        insult, unmasked = word in INSULTS, False
        learned, start = self.words.get(word, 0.0), max((self.starts.get(b, 0.0) for b in beginnings(word)), default=0.0)
        if plain != word and not insult and learned == 0 and (plain in INSULTS or self.words.get(plain, 0.0) > 0):
            unmasked, insult, learned = True, plain in INSULTS, self.words.get(plain, 0.0)
        capital = len(word) > 1 and token.upper() == token and low != token
        marks = len(token) - len(token.rstrip("!?.*#%$&@"))
        return (insult, learned, start, word in SECOND_PERSON, capital, token.count("!"), token.count("?"), marks > 1, obscured, unmasked, len(word) == 1 and word.isalpha())

    def table(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The places of the tokens that aren't plain, all texts one after another, and their features."""
        self.late.clear()
        at = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64, sum(map(len, texts)))
        if self.pending:
            self.known = np.concatenate([self.known, np.array(self.pending, float)])
            self.pending.clear()
        place = np.flatnonzero(at)
        at = at[place]
        if not self.late:
            return place, self.known[at]
        return place, np.concatenate([self.known, np.array(self.late, float)])[np.where(at < 0, len(self.known) - 1 - at, at)]


def pieces(text: str, most: int = 1 << 20) -> Iterator[tuple[list[str], int, int]]:
    """The tokens of a text in pieces of about ``most`` characters, each with up to NEAR tokens of its neighbours: (tokens, from, to)."""
    if len(text) <= most:
        tokens = text.split()
        yield tokens, 0, len(tokens)
        return
    place, before = 0, []
    while place < len(text):
        cut = place + most
        while cut < len(text) and not text[cut].isspace():
            cut += 1
        own = text[place:cut].split()
        after, ahead = [], 1 << 10
        while cut < len(text):
            part = text[cut : cut + ahead]
            after = part.split()
            if cut + ahead >= len(text) or len(after) > NEAR:
                break
            ahead *= 2
        after = after[:NEAR]
        yield before + own + after, len(before), len(before) + len(own)
        before = (before + own)[-NEAR:]
        place = cut


def features(texts: list[str | None], tokens: Tokens, most: int = 1 << 20) -> np.ndarray:
    """rows x len(FEATURES)."""
    n = len(texts)
    sums, strongest, distinct, count = np.zeros((14, n)), np.zeros(n), [set() for _ in range(n)], np.zeros(n)
    own, size = [], 0
    for i, t in enumerate(texts):
        for piece in pieces(t or "", most):
            own.append((i, *piece))
            size += len(piece[0])
            if size > most // 4:
                _add(own, tokens, sums, strongest, distinct, count)
                own, size = [], 0
    _add(own, tokens, sums, strongest, distinct, count)
    words = np.maximum(count, 1)
    insults, learned, evidence, starts, start_evidence, you, close, capital, bang, ask, marks, obscured, unmasked, single = sums
    return np.stack(
        [
            np.log1p(count), insults, insults / words, learned, learned / words, strongest, evidence, evidence / words,
            starts, starts / words, start_evidence, you / words, close, capital / words, bang / words, ask / words,
            marks / words, obscured, obscured / words, unmasked, single / words, np.array([len(d) for d in distinct], float),
        ],
        axis=1,
    )


def _add(own: list[tuple[int, list[str], int, int]], tokens: Tokens, sums: np.ndarray, strongest: np.ndarray, distinct: list[set], count: np.ndarray) -> None:
    """Adds the pieces (row, tokens, from, to) to the sums of their rows."""
    if not own:
        return
    n, row = len(strongest), np.array([p[0] for p in own])
    end = np.cumsum([len(p[1]) for p in own])
    begin = end - [len(p[1]) for p in own]
    first, last = begin + [p[2] for p in own], begin + [p[3] for p in own]
    count += np.bincount(row, last - first, n)
    place, known = tokens.table([p[1] for p in own])
    if not len(place):
        return
    piece = np.searchsorted(end, place, side="right")
    counts = (place >= first[piece]) & (place < last[piece])
    insult, learned, start, you, capital, bang, ask, marks, obscured, unmasked, single = known.T
    hit = (insult > 0) | (learned > 0)
    start = np.where(hit, 0, start)
    addressed = np.zeros(int(end[-1]) + 1, bool)
    addressed[place[you > 0]] = True
    close = np.zeros(len(place), bool)
    for shift in (*range(-NEAR, 0), *range(1, NEAR + 1)):  # in the same text
        other = place + shift
        close |= (other >= begin[piece]) & (other < end[piece]) & addressed[np.clip(other, 0, len(addressed) - 1)]
    text = row[piece][counts]
    for i, v in enumerate((insult, learned > 0, learned, start > 0, start, you, hit & close, capital, bang, ask, marks, obscured, unmasked, single)):
        sums[i] += np.bincount(text, v[counts], n)
    np.maximum.at(strongest, text, np.maximum(learned, start)[counts])
    for i in np.flatnonzero(hit & counts).tolist():
        p = piece[i]
        distinct[row[p]].add(own[p][1][place[i] - begin[p]])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition: in how many texts a term occurs, by class and half of the folds."""
    found: dict[tuple[int, int], Counter] = defaultdict(Counter)
    for batch in batches:
        for t, toxic, half in zip(*(batch.column(c).to_pylist() for c in ("t", "label", "half")), strict=True):
            found[int(toxic > 0), half].update(terms(t))
    for (toxic, half), counts in found.items():
        names, n = pa.array(list(counts), pa.string()), len(counts)
        columns = [names, pa.array(np.full(n, toxic)), pa.array(np.full(n, half)), pa.array(list(counts.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "toxic", "half", "n"])


def _lexicons(sample: DataFrame, least: int, size: int) -> list[dict[str, float]]:
    """Lexicons from half 0, half 1 and both: the lower bound of a term's log-odds, where it is well above 0; the ``size`` largest."""
    totals = {(r.half, r.toxic): r.n for r in sample.groupBy("half", (F.col("label") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    counts = sample.mapInArrow(_terms, "term string, toxic long, half long, n long").groupBy("term")
    counts = counts.agg(*(F.sum(F.when((F.col("half") == h) & (F.col("toxic") == c), F.col("n")).otherwise(0)).alias(f"{'ny'[c]}{h}") for h in (0, 1) for c in (0, 1)))
    counts = written(counts.where((F.col("y0") >= least) | (F.col("y1") >= least) | (F.col("y0") + F.col("y1") >= least)), "terms")
    out = []
    for halves in ((0,), (1,), (0, 1)):
        yes, no = (sum((F.col(f"{c}{h}") for h in halves), F.lit(0)) for c in "yn")
        all_yes, all_no = (sum(totals.get((h, c), 0) for h in halves) for c in (1, 0))
        odds = F.log((yes + 0.5) / (all_yes + 1.0)) - F.log((no + 0.5) / (all_no + 1.0))
        bound = odds - F.sqrt(1 / (yes + 0.5) + 1 / (no + 0.5))
        best = counts.where(yes >= least).select("term", bound.alias("bound")).where("bound >= 0.7").orderBy(F.desc("bound"), "term").limit(size)
        out.append({r.term: float(r.bound) for r in best.collect()})  # size bounds the lexicon
    drop_written(counts)
    return out


class Model:
    def __init__(self, lexicon: dict[str, float], trees: BoostedTrees, calibrate: Isotonic):
        self.lexicon, self.trees, self.calibrate = lexicon, trees, calibrate


def _features_by_half(lexicons):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = [Tokens(x) for x in lexicons.value]
        for batch in slices(batches, "t", 1 << 20):
            texts, half = batch.column("t").to_pylist(), batch.column("half").to_pylist()
            other = [features(texts, tokens[1 - h]) for h in (0, 1)]
            x = np.stack([other[h][i] for i, h in enumerate(half)]) if texts else np.zeros((0, len(FEATURES)))
            offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("fold"), batch.column("label"), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=["fold", "label", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, *, fit_rows: int = 20_000, lexicon_terms: int = 8192, least_texts: int = 3) -> Model | None:
    """A model from rows (doc_id, t) and labels (doc_id, label), or None without labels of both classes."""
    spark = docs.sparkSession
    chosen = hash_sample(labels, ["doc_id"], fit_rows)
    # at most fit_rows labels, so small enough to broadcast
    sample = docs.join(F.broadcast(chosen), "doc_id").select(fold().alias("fold"), "label", "t").withColumn("half", F.when(F.col("fold") <= 2, 0).otherwise(1))
    sample = written(sample, "sample")
    classes = sample.agg(F.min("label"), F.max("label")).first()
    if classes[0] is None or classes[0] == classes[1]:
        drop_written(sample)
        return None
    lexicons = _lexicons(sample, least_texts, lexicon_terms)
    rows = sample.mapInArrow(_features_by_half(spark.sparkContext.broadcast(lexicons)), "fold int, label double, x array<double>").toArrow()
    drop_written(sample)
    rows = rows.combine_chunks()
    k, y = rows.column("fold").to_numpy(), rows.column("label").to_numpy()
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(len(k), -1)
    order = np.lexsort((*x.T[::-1], y, k))  # the order of partitions must not matter
    k, y, x = k[order], y[order], x[order]
    held = np.zeros(len(k))
    for own in np.unique(k):
        rest = k != own
        held[~rest] = BoostedTrees(x[rest], y[rest])(x[~rest]) if rest.any() and 0 < y[rest].sum() < rest.sum() else 0.0
    return Model(lexicons[2], BoostedTrees(x, y), Isotonic(held, y))


def _scorer(model, names: list[str], body: str, into: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        tokens = Tokens(m.lexicon) if m else None
        for batch in slices(batches, body, 1 << 20):
            score = m.calibrate(m.trees(features(batch.column(body).to_pylist(), tokens))) if m else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(score)], names=[*names, into])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", into: str = "toxicity", **options) -> DataFrame:
    """docs with a score from 0 to 1; a column of its name is replaced.

    Options of ``fit``: it uses at most ``fit_rows`` labelled rows, and a lexicon of at most ``lexicon_terms`` terms, each from at
    least ``least_texts`` toxic texts.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_column(docs, text).alias("t"))
    model = fit(rows, training_labels(labels, label), **options)
    model = docs.sparkSession.sparkContext.broadcast(model)
    names, body = others(docs, into), free_name(docs, "__text")
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField(into, T.DoubleType())])
    return docs.withColumn(body, text_column(docs, text)).mapInArrow(_scorer(model, names, body, into), schema)


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = toxicity_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = F.col("toxicity")
    return scored.select("doc_id", (fold() == 0).alias("held_out"), score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("predicted"))
