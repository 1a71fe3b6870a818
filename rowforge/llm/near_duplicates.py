"""Near-duplicate classes by ProbMinHash.

A text is the weighted set of its shingles of five words (a shorter text is one shingle), a shingle that occurs n times
weighing 1 + ln n. Every shingle sends Poisson arrivals to the registers of a sketch, at a rate that is its weight; a
register keeps its first arrival, and a shingle stops as soon as its next arrival comes later than all registers were
taken. Two registers agree with the probability Jaccard similarity of the two texts. Each shingle visits the registers in
an order without repetition (an affine walk, their number being prime), the gaps between arrivals stretched accordingly, so
each register sees the arrivals of a Poisson process of its own.

Registers are cut into bands. Texts of equal words are one representative from the start. In each band bucket the member
that shares most buckets with others is the hub; every member is compared with the hub on the exact similarity. Where members
of a bucket are then still in different classes, each member is compared with all that are not of the bucket's largest
class, block by block inside the tasks, so that a hub hides no link and no table of pairs is made. Links become classes by
distributed component search. Nothing is capped. Buckets, copies and hubs are counted before their rows meet: the rows of frequent
ones don't move, and hubs and blocks are dealt over as many tasks as their members and bytes ask for.

Nulls count as empty texts. Texts without words are copies of one another only if they are equal. A repeated row is a copy.
A class is named by its smallest doc_id (nulls last), ties by the row. An empty table gives an empty result. Very long texts are
read in segments; what stays in memory is 16 bytes for each of their distinct shingles. Other columns stay, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UID, drop_written, join_counted, mix, slices, text_column, with_uid, written
from .graph import components
from .words import grams, merged, segments_of

#: Registers: a prime that holds all bands.
REGISTERS, BANDS, ROWS = 157, 26, 6
SHINGLE, SIMILARITY = 5, 0.8
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Described:
    """Of some texts: their distinct shingles (``text, value, weight``, by text and value), words and two keys of the word sequence."""

    def __init__(self, column: pa.Array, k: int = SHINGLE, most: int = 4 << 20):
        rows = len(column)
        self.words, self.keys = np.zeros(rows, np.int64), np.zeros((2, rows), np.uint64)
        short: dict[int, np.uint64] = {}
        parts, cut = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))], False
        for words, row, before, own in segments_of(column, k - 1, most):
            n, text = np.diff(words.first), words.text_of()
            cut |= self.words[row] > 0  # a text goes on
            g, whole = grams(words, k)
            parts.append(merged(text[whole] + row, g[whole], np.ones(int(whole.sum()), np.int64)))
            for size in range(1, k):
                of = np.flatnonzero(n == size)
                if len(of):
                    gram, _ = grams(words, size)
                    short |= zip((of + row).tolist(), mix(gram[words.first[of]] + np.uint64(size)), strict=True)
            at = before + np.arange(len(text)) - np.repeat(words.first[:-1], n)
            new = np.arange(len(text)) - np.repeat(words.first[:-1], n) >= np.repeat(n - own, n)
            for i in (0, 1):
                term = np.where(new, mix(words.hash + (at.astype(np.uint64) * np.uint64(2) + np.uint64(i + 1)) * _ODD), np.uint64(0))
                total = np.append(np.uint64(0), np.cumsum(term))
                self.keys[i, row : row + len(n)] += total[words.first[1:]] - total[words.first[:-1]]
            self.words[row : row + len(n)] += own
        self.keys = mix((self.keys + self.words.astype(np.uint64)).ravel()).reshape(2, rows)
        few = [i for i in short if self.words[i] < k]  # a text of so few words has all of them in its last segment
        parts.append((np.array(few, np.int64), np.array([short[i] for i in few], np.uint64), np.ones(len(few), np.int64)))
        text, value, times = (np.concatenate(x) for x in zip(*parts, strict=True))
        if cut or few:
            text, value, times = merged(text, value, times)
        self.text, self.value, self.weight = text, value, 1 + np.log(times)


def shingles(column: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, weight) of the distinct shingles, ordered by text and hash."""
    d = Described(column, k)
    return d.text, d.value, d.weight


def sketch(text: np.ndarray, value: np.ndarray, weight: np.ndarray, texts: int, m: int = REGISTERS, most: int = 1 << 19) -> np.ndarray:
    """The winning shingle of each register, texts x m. Texts without shingles have zeros. ``most`` shingles are drawn at once."""
    first = np.full(texts * m, np.inf)
    winner = np.zeros(texts * m, np.uint64)
    for begin in range(0, len(value), most):
        part = slice(begin, begin + most)
        _arrivals(first, winner, text[part], value[part], weight[part], texts, m)
    return winner.reshape(texts, m)


def _arrivals(first: np.ndarray, winner: np.ndarray, text: np.ndarray, value: np.ndarray, weight: np.ndarray, texts: int, m: int) -> None:
    seed = mix(value)
    step = (mix(seed ^ _ODD) % np.uint64(m - 1)).astype(np.int64) + 1
    register = (seed % np.uint64(m)).astype(np.int64)
    time = np.zeros(len(value))
    active = np.arange(len(value))
    for j in range(m):
        draw = mix(seed[active] + np.uint64((j + 1) * int(_ODD) & 0xFFFFFFFFFFFFFFFF))
        gap = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        time[active] += gap * m / ((m - j) * weight[active])
        at = text[active] * m + register[active]
        np.minimum.at(first, at, time[active])
        won = first[at] == time[active]
        winner[at[won]] = value[active[won]]
        last = first.reshape(texts, m).max(axis=1)
        active = active[time[active] < last[text[active]]]
        if not len(active):
            break
        register[active] = (register[active] + step[active]) % m


def bands_of(registers: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A key for each band; the keys of different bands differ."""
    out = np.zeros((len(registers), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(registers), (b + 1) * int(_ODD) & 0xFFFFFFFFFFFFFFFF, np.uint64)
        for r in range(rows):
            key = mix(key ^ registers[:, b * rows + r])
        out[:, b] = key
    return out.astype(np.int64)


def probability_jaccard(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """The probability Jaccard similarity of two weighted sets with ascending hashes."""
    if not len(ha) or not len(hb):
        return 0.0
    at = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    both = hb[at] == ha
    x, y = wa[both], wb[at[both]]
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    order = np.argsort(-x / y, kind="stable")
    x, y = x[order], y[order]
    ratio = x / y
    # elements of a strictly larger ratio count with their x, the others with their y
    larger = np.searchsorted(-ratio, -ratio, side="left")
    sum_x, sum_y = np.append(0, np.cumsum(x)), np.append(0, np.cumsum(y))
    return float((1 / ((only_a + sum_x[larger]) / x + (only_b + sum_y[-1] - sum_y[larger]) / y)).sum())


def _sketches(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 2 << 20):
            d = Described(batch.column(text))
            some = d.words > 0
            bands = bands_of(sketch(d.text, d.value, d.weight, batch.num_rows))
            offsets = np.append(0, np.cumsum(np.where(some, BANDS, 0))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands[some].ravel()))
            size = pc.cast(pc.fill_null(pc.binary_length(batch.column(text)), 0), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(UID), batch.column(text), pa.array(~some), *(pa.array(x.astype(np.int64)) for x in d.keys), lists, size],
                names=[UID, text, "wordless", "k1", "k2", "bands", "size"],
            )

    return run


def _compare(threshold: float):
    """Over rows ordered by hub, salt and role: the similarity of each member with the hub above it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = hub_set = None
        for batch in slices(batches, "t", 2 << 20):
            text, value, weight = shingles(batch.column("t"))
            edge = np.searchsorted(text, np.arange(batch.num_rows + 1))
            hubs, ids, roles = (batch.column(c).to_numpy() for c in ("hub", "uid", "role"))
            out_hub, out_uid = [], []
            for i in range(batch.num_rows):
                own = value[edge[i] : edge[i + 1]], weight[edge[i] : edge[i + 1]]
                if roles[i] == 0:
                    hub, hub_set = hubs[i], own
                elif probability_jaccard(*hub_set, *own) >= threshold - 1e-9:  # sums of floats
                    out_hub.append(hub)
                    out_uid.append(ids[i])
            yield pa.RecordBatch.from_arrays([pa.array(out_hub, pa.int64()), pa.array(out_uid, pa.int64())], names=["a", "b"])

    return run


def _links(pairs: DataFrame, texts: DataFrame, threshold: float, *, least: int = 64, most: int = 512) -> DataFrame:
    """The pairs (hub, uid) that are similar, as (a, b), from a written table.

    A hub's text goes along with each share of its members; shares have so many rows that there are some for each task.
    """
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = min(most, max(least, math.ceil(pairs.count() / (4 * tasks))))
    members = written(pairs.groupBy("hub").agg(F.count("*").alias("n")).withColumn("shares", F.ceil(F.col("n") / share)), "members")
    salted = join_counted(pairs, members, ["hub"], "n").withColumn("salt", F.pmod(F.xxhash64("uid"), "shares"))
    rows = salted.join(texts, "uid").select("hub", "salt", F.lit(1).alias("role"), "uid", "t")
    dealt = members.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("salt"))
    hubs = dealt.join(texts.withColumnRenamed("uid", "hub"), "hub").select("hub", "salt", F.lit(0).alias("role"), F.col("hub").alias("uid"), "t")
    rows = rows.union(hubs).repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role", "uid")
    return rows.mapInArrow(_compare(threshold), "a long, b long")


def _compare_blocks(threshold: float):
    """Over rows ordered by group and role: each member of a group (role 1) against all its outsiders (role 0).

    The outsiders of a group stand in one index from shingle to outsider. What they share with a member bounds the
    similarity from above; only where the bound reaches the threshold is the similarity itself computed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, outsiders, index = None, [], None
        for batch in slices(batches, "t", 2 << 20):
            text, value, weight = shingles(batch.column("t"))
            edge = np.searchsorted(text, np.arange(batch.num_rows + 1))
            keys, blocks, salts = (batch.column(c).to_numpy() for c in ("key", "block", "salt"))
            ids, roots, roles = (batch.column(c).to_numpy() for c in ("uid", "root", "role"))
            out_a, out_b = [], []
            for i in range(batch.num_rows):
                if group != (now := (keys[i], blocks[i], salts[i])):
                    group, outsiders, index = now, [], None
                h, x = value[edge[i] : edge[i + 1]], weight[edge[i] : edge[i + 1]]
                if roles[i] == 0:
                    outsiders.append((ids[i], roots[i], h, x))
                    continue
                if index is None:
                    hashes, owner = np.concatenate([o[2] for o in outsiders]), np.repeat(np.arange(len(outsiders)), [len(o[2]) for o in outsiders])
                    order = np.argsort(hashes, kind="stable")
                    index = hashes[order], owner[order], np.concatenate([o[3] for o in outsiders])[order]
                    uids, classes = np.array([o[0] for o in outsiders]), np.array([o[1] for o in outsiders])
                    totals = np.array([o[3].sum() for o in outsiders])
                low, high = np.searchsorted(index[0], h, "left"), np.searchsorted(index[0], h, "right")
                n = high - low
                at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
                own, y, x_at = index[1][at], index[2][at], np.repeat(x, n)
                cx, cy = np.bincount(own, x_at, len(uids)), np.bincount(own, y, len(uids))
                only_x, only_y = x.sum() - cx, totals - cy
                bound = np.bincount(own, 1 / (only_x[own] / x_at + only_y[own] / y + np.maximum(cx[own] / x_at, cy[own] / y)), len(uids))
                for j in np.flatnonzero((bound >= threshold - 1e-6) & (classes != roots[i])).tolist():
                    if probability_jaccard(h, x, outsiders[j][2], outsiders[j][3]) >= threshold - 1e-9:
                        out_a.append(ids[i])
                        out_b.append(outsiders[j][0])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return run


def _across(mixed: DataFrame, texts: DataFrame, threshold: float, *, least: int = 128, most: int = 4096, most_bytes: int = 16 << 20) -> DataFrame:
    """Links between members of one bucket that stand in different classes, from written rows (key, uid, root, size).

    All members of a bucket but those of its largest class are outsiders; every pair to be tested has one. Outsiders are cut
    into blocks and members into shares, so a task holds one block of texts and streams one share, however large the bucket. Both
    have about ``step`` rows, so many that there are some cells for each task (fewer rows are sent more often), and ``most_bytes``.
    """
    per_class = mixed.groupBy("key", "root").agg(F.count("*").alias("m"), F.sum("size").alias("b"))
    per_key = per_class.groupBy("key").agg(F.max_by(F.struct("root", "m", "b"), F.struct("m", "root")).alias("main"), F.sum("m").alias("n"), F.sum("b").alias("bytes"))
    per_key = written(per_key.select("key", F.col("main.root").alias("main"), "n", "bytes", (F.col("n") - F.col("main.m")).alias("out"), (F.col("bytes") - F.col("main.b")).alias("out_bytes")), "mixed")
    tests = per_key.agg(F.sum(F.col("n").cast("double") * F.col("out"))).first()[0] or 0.0
    tasks = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    step = min(most, max(least, math.ceil(math.sqrt(tests / (2 * tasks)))))
    cut = lambda rows, size: F.greatest(F.ceil(F.col(rows) / step), F.ceil(F.col(size) / most_bytes), F.lit(1))
    rows = join_counted(mixed, per_key, ["key"], "n").withColumn("blocks", cut("out", "out_bytes")).withColumn("shares", cut("n", "bytes"))
    spread = F.xxhash64("uid")
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    outsiders = rows.where("root <> main").select("key", "uid", "root", F.pmod(spread, "blocks").alias("block"), all_of("shares").alias("salt"), F.lit(0).alias("role"))
    members = rows.select("key", "uid", "root", all_of("blocks").alias("block"), F.pmod(spread, "shares").alias("salt"), F.lit(1).alias("role"))
    sides = outsiders.union(members).join(texts, "uid").select("key", "block", "salt", "role", "uid", "root", "t")
    sides = sides.repartition("key", "block", "salt").sortWithinPartitions("key", "block", "salt", "role", "uid")
    return sides.mapInArrow(_compare_blocks(threshold), "a long, b long").distinct()


def near_duplicate_classes(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", threshold: float = SIMILARITY) -> tuple[DataFrame, DataFrame, str]:
    """(uid, doc_id, class_id, kept) for each row of docs, the stored rows with their uid, and the uid's name there.

    ``kept`` marks one row of each class, that with the smallest doc_id.
    """
    stored, own = with_uid(docs, "documents")
    texts = stored.select(F.col(own).alias(UID), text_column(stored, text).alias("t"))
    schema = "t string, wordless boolean, k1 long, k2 long, bands array<long>, size long"
    sketched = texts.mapInArrow(_sketches("t"), f"{UID} long, {schema}")
    raw = F.when(F.col("wordless"), F.xxhash64("t")).otherwise(F.col("k1"))
    raw2 = F.when(F.col("wordless"), F.xxhash64(F.lit(1), "t")).otherwise(F.col("k2"))
    sketched = written(sketched.select(F.col(UID).alias("uid"), raw.alias("k1"), raw2.alias("k2"), "bands", "size"), "sketches")
    # copies: one representative for equal words
    first = written(sketched.groupBy("k1", "k2").agg(F.min("uid").alias("rep"), F.count("*").alias("n")).where("n > 1"), "copies")
    member = join_counted(sketched, first, ["k1", "k2"], "n", how="left").withColumn("rep", F.coalesce("rep", "uid"))
    member = written(member.select("uid", "rep", F.when(F.col("rep") == F.col("uid"), F.col("bands")).alias("bands"), "size"), "members")
    buckets = member.where("uid = rep").select("uid", "size", F.explode("bands").alias("key"))
    shared = written(buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    near = written(join_counted(buckets, shared, ["key"], "n").select("key", "uid", "size", "n"), "candidates")
    score = near.groupBy("uid").agg(F.sum("n").alias("score"))
    hubs = near.join(score, "uid").groupBy("key").agg(F.max_by("uid", F.struct("score", -F.col("uid"))).alias("hub"), F.count("*").alias("n"))
    hubs = written(hubs, "hubs")
    pairs = join_counted(near.select("key", "uid"), hubs, ["key"], "n").where("hub <> uid").select("hub", "uid").distinct()
    pairs = written(pairs, "pairs")
    bodies = texts.select(F.col(UID).alias("uid"), "t")
    links = written(_links(pairs, bodies, threshold), "links")
    roots = components(links)
    # what a hub hides: members of one bucket that are still in different classes
    known = near.select("key", "uid", "size").join(roots.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    known = written(known, "classed")
    mixed = known.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low < high").select("key", "n")
    mixed = written(mixed, "mixed")
    apart = written(join_counted(known, mixed, ["key"], "n").select("key", "uid", "root", "size"), "apart")
    more = written(_across(apart, bodies, threshold), "links")
    if more.take(1):
        found, roots = roots, components(links.union(more))
        drop_written(found)
    drop_written(sketched, first, shared, near, hubs, pairs, links, known, mixed, apart, more)
    whole = member.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("uid", F.coalesce("root", "rep").alias("root"))
    whole = whole.join(stored.select(F.col(own).alias("uid"), F.col(f"`{doc_id}`").alias("doc_id")), "uid")
    best = whole.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("best"), F.count("*").alias("n")).where("n > 1")
    best = written(best.select("root", F.col("best.doc_id").alias("best_id"), F.col("best.uid").alias("best_uid")), "classes")
    alone = F.col("best_uid").isNull()
    classes = whole.join(best, "root", "left").select(
        "uid", "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("best_id")).alias("class_id"), (alone | (F.col("best_uid") == F.col("uid"))).alias("kept")
    )
    return classes, stored, own


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs with one of each class left."""
    classes, stored, own = near_duplicate_classes(docs, **options)
    gone = classes.where("NOT kept").select(F.col("uid").alias(own))  # the smaller side as a rule
    return stored.join(gone, own, "left_anti").drop(own)


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    classes, _, _ = near_duplicate_classes(docs)
    return classes.select("doc_id", "class_id", "kept")
