import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowforge.llm import sharding
from rowforge.llm.sharding import communication_matrix, hypergeometric, op4, shuffle_into_shards


def test_matrix_has_exact_margins():
    rows = np.array([0, 5, 1000, 17, 3, 0, 999])
    m = communication_matrix(rows, 40, 1)
    assert (m.sum(1) == rows).all() and m.sum(0).max() - m.sum(0).min() <= 1 and (m >= 0).all()
    assert (communication_matrix(rows, 40, 1) == m).all() and not (communication_matrix(rows, 40, 2) == m).all()
    assert communication_matrix(np.zeros(1, int), 3, 1).sum() == 0


def test_matrix_is_hypergeometric():
    """Mean and variance of a cell over many seeds are those of dealing a shuffled deck."""
    rows, shards, n = np.array([30, 50, 20]), 4, 4000
    cells = np.array([communication_matrix(rows, shards, s)[1, 2] for s in range(n)])
    mean, variance = 25 * 0.5, 25 * 0.5 * 0.5 * (100 - 25) / 99
    assert abs(cells.mean() - mean) < 5 * np.sqrt(variance / n) and abs(cells.var() / variance - 1) < 0.15


def test_margins_beyond_numpy():
    rows = np.array([0, 1, 3_000_000_001, 6_000_000_000, 17, 999_999_999_999, 1_000_000_000])
    m = communication_matrix(rows, 40, 3)
    assert (m.sum(1) == rows).all() and m.sum(0).max() - m.sum(0).min() <= 1 and (m >= 0).all()
    assert (communication_matrix(rows, 40, 3) == m).all()


@pytest.mark.parametrize(("good", "bad", "sample"), [(5, 7, 4), (50, 30, 40), (1000, 39_000, 500), (3, 100, 100), (300, 200, 499), (0, 9, 4), (4, 0, 4)])
def test_rejection_draws_have_the_probabilities_of_the_definition(monkeypatch, good, bad, sample):
    monkeypatch.setattr(sharding, "NUMPY_ROWS", 0)
    rng, n = np.random.default_rng(7), 6000
    low, high = max(0, sample - bad), min(good, sample)
    expected = [math.comb(good, k) * math.comb(bad, sample - k) / math.comb(good + bad, sample) * n for k in range(low, high + 1)]
    seen = np.bincount([hypergeometric(rng, good, bad, sample) - low for _ in range(n)], minlength=len(expected))
    often = [(a, b) for a, b in zip(seen, expected, strict=True) if b > 5]
    assert sum((a - b) ** 2 / b for a, b in often) < len(often) + 5 * math.sqrt(2 * len(often))


def test_large_draws_have_the_right_mean_and_variance():
    rng, total = np.random.default_rng(8), 10**13
    good, sample = total // 40, total // 2
    draws = np.array([hypergeometric(rng, good, total - good, sample) for _ in range(1500)], float)
    mean, variance = sample / 40, sample / 40 * (39 / 40) * 0.5
    assert abs(draws.mean() - mean) < 4 * math.sqrt(variance / 1500) and abs(draws.var() / variance - 1) < 0.2


def check(rows, shards):
    by = {}
    for s, slot in rows:
        by.setdefault(s, []).append(slot)
    sizes = [len(by.get(i, [])) for i in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(by) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shards(spark):
    df = spark.range(2003, numPartitions=5).withColumn("v", F.lit("same"))
    for bins in (50_000, 7):
        out = shuffle_into_shards(df, shards=9, bin_rows=bins)
        rows = out.collect()
        assert len({r.id for r in rows}) == 2003
        check([(r["__shard"], r["__slot"]) for r in rows], 9)
        again = shuffle_into_shards(df, shards=9, bin_rows=bins)
        assert sorted(again.collect()) == sorted(rows)  # the seed decides
    long = df.withColumn("text", F.repeat(F.lit("x"), 100))
    check([(r["__shard"], r["__slot"]) for r in shuffle_into_shards(long, shards=9, bin_bytes=3000, most_partitions=2).collect()], 9)
    few = shuffle_into_shards(spark.range(3), shards=9).collect()
    check([(r["__shard"], r["__slot"]) for r in few], 9)


def test_order_is_uniform(spark):
    """Places of rows in the whole order are uncorrelated with where they came from, and every shard is as likely."""
    places, shards = [], []
    for seed in range(40):
        rows = shuffle_into_shards(spark.range(200, numPartitions=4), shards=4, seed=seed, bin_rows=20).collect()
        order = sorted(rows, key=lambda r: (r["__shard"], r["__slot"]))
        places.append(np.corrcoef([r.id for r in order], np.arange(200))[0, 1])
        shards.append(next(r["__shard"] for r in rows if r.id == 17))
    assert abs(np.mean(places)) < 0.05 and min(np.bincount(shards, minlength=4)) >= 2


def test_edges(edge_docs, no_docs):
    out = shuffle_into_shards(edge_docs, shards=4, into=("SCORE", "slot"))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "__uid", "contamination", "SCORE", "slot"]
    check([(r.SCORE, r.slot) for r in out.collect()], 4)
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r.doc_id) for r in edge_docs.collect())
    assert shuffle_into_shards(no_docs).count() == 0


def test_query(spark, sf_dir):
    rows = op4(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    check([(r.shard, r.slot) for r in rows], 40)
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    assert all(r["size"] == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.law == "rows" and r.grown_shard is None for r in rows)
