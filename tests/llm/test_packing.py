import inspect
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rowforge.llm.packing import Bm25, Shard, digest, op3, pack
from rowforge.llm.tokenization import Vocabulary, vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [0]


def check(rows, texts, window=1024, padding=None):
    """Every id lies in one piece, sequences are gapless and fit, checksums are those of the ids."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids, at = np.array(ids_of(texts[doc]), "<u4"), 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    pad = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        pad += window - at
    if padding is not None:
        assert pad <= padding
    return pad


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_ids_are_those_of_the_library(text):
    assert vocabulary(PATH).encode(text) == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_ids_of_odd_texts():
    for text in ("", " ", "<|endoftext|> a<|endoftext|>", "a" * 30_000, " \n\t " * 500, "é😀ß" * 300, "don't 123'll x\r\n"):
        expected = TOKENIZER.encode(text, add_special_tokens=False).ids
        assert vocabulary(PATH).encode(text) == expected == Vocabulary(PATH, fast=False).encode(text)


def test_index_scores_are_bm25():
    rng = np.random.default_rng(1)
    ids = [rng.integers(0, 50, rng.integers(1, 80)).astype(np.uint16) for _ in range(40)]
    frequency = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=64)
    mean = np.mean([len(x) for x in ids])
    model = Bm25(frequency, len(ids), mean)
    shard = Shard(ids, model, 64, 1000)
    for seed in range(5):
        expected = np.zeros(len(ids))
        for t in np.unique(ids[seed]):
            idf = np.log1p((len(ids) - frequency[t] + 0.5) / (frequency[t] + 0.5))
            for d, x in enumerate(ids):
                tf = (x == t).sum()
                expected[d] += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / mean)) if tf else 0
        assert np.allclose(shard.scores(seed), expected, rtol=1e-4)
        assert shard.scores(seed).argmax() == expected.argmax()


def test_queries_have_all_terms():
    """What ``pack`` asks by default is BM25 over all terms: the best ten are those of brute force."""
    rng = np.random.default_rng(4)
    ids = [rng.zipf(1.3, 300).clip(max=4000).astype(np.uint16) for _ in range(200)]
    times = np.array([np.bincount(x, minlength=4001) for x in ids])
    frequency, length = (times > 0).sum(axis=0), times.sum(axis=1)
    model = Bm25(frequency, len(ids), length.mean())
    weight = model.idf * times * 2.2 / (times + 1.2 * (0.25 + 0.75 * length[:, None] / length.mean()))
    shard = Shard(ids, model, 4001, inspect.signature(pack).parameters["query_terms"].default)
    for seed in range(200):
        expected = weight[:, times[seed] > 0].sum(axis=1)
        got = shard.scores(seed)
        assert np.allclose(got, expected, rtol=1e-4)
        assert expected[np.argsort(-got)[:10]].min() >= np.sort(expected)[-10] * (1 - 1e-4)


@pytest.mark.parametrize("options", [{}, {"shard_rests": 16, "rests_per_task": 64}, {"window": 64, "least_cut": 4}])
def test_pieces(spark, options):
    rng = random.Random(2)
    texts = {i: " ".join(rng.choice(["alpha", "beta", "gamma", "δ", "x1", "and", "\n"]) for _ in range(rng.choice([0, 1, 30, 300, 900, 2500]))) for i in range(150)}
    texts[150] = None
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    rows = digest(pack(df, **options)).collect()
    window = options.get("window", 1024)
    check(rows, texts, window, padding=4 * window + options.get("least_cut", 16) * len(rows))


def test_similar_texts_meet(spark):
    """Documents of the same topic share windows more often than chance has it."""
    rng = random.Random(3)
    topics = [[f"{a}{b}" for b in ("river", "stone", "cloud", "metal", "glass")] for a in "abcdefgh"]
    texts = {i: " ".join(rng.choice(topics[i % 8]) for _ in range(80)) for i in range(400)}
    rows = digest(pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))).collect()
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, set()).add(r.doc_id % 8)
    assert np.mean([len(w) for w in windows.values()]) < 2


def test_long_documents_are_retrieved_by_their_whole_text(spark):
    """The rests of all documents are the same filler; only the windows cut off before them tell the two topics apart."""
    rng = random.Random(5)
    topics = [["river", "stone", "cloud", "metal"], ["paper", "glass", "horse", "table"]]
    texts = {}
    for i in range(40):
        words = "".join(" " + rng.choice(topics[i % 2]) for _ in range(64))
        texts[i] = words + " and" * 21
    assert {len(ids_of(t)) // 64 for t in texts.values()} == {1}
    rows = digest(pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2), window=64, least_cut=64)).collect()
    check(rows, texts, 64)
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, set()).add(r.doc_id)
    shared = [{d % 2 for d in w} for w in windows.values() if len(w) > 1]
    assert len(shared) >= 10 and sum(len(w) > 1 for w in shared) <= 2


def test_edges(spark, edge_docs, no_docs, edge_rows):
    rows = digest(pack(edge_docs)).collect()
    total = sum(len(ids_of(r[1])) for r in edge_rows)
    assert sum(r.length for r in rows) == total
    assert sum(r.doc_id is None for r in rows) == 2 and sum(r.doc_tokens == 1 for r in rows) == 4
    assert digest(pack(no_docs)).count() == 0
    clash = edge_docs.selectExpr("*", "1 id", "2 uid", "3 t", "4 ids", "5 terms", "6 first", "7 body", "8 rest", "9 whole", "10 term")
    assert sorted(map(str, digest(pack(clash)).drop("sequence_id", "offset").collect())) == sorted(map(str, digest(pack(edge_docs)).drop("sequence_id", "offset").collect()))


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    check(op3(spark, sf_dir).collect(), texts, padding=4096)
