import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowforge.llm.decontamination import Filter, _candidates, _filter_of, contaminated, mark_contamination
from rowforge.llm.words import segments_of, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    """Every window of every item at every place of every document."""
    out = []
    for text in docs:
        w, hit, found = words(text), set(), set()
        for item, body in items:
            b = words(body)
            n = min(13, len(b))
            windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
            for p in range(len(w) - n + 1 if n else 0):
                if tuple(w[p : p + n]) in windows:
                    hit.update(range(p, p + n))
                    found.add(str(item))
        out.append((len(w), len(hit), sorted(found)))
    return out


def run(spark, docs, items, **options):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = mark_contamination(d, b, **options).orderBy("doc_id").collect()
    return [(r.contamination.n_words, r.contamination.n_hit, list(r.contamination["items"])) for r in rows]


@pytest.mark.parametrize("options", [{}, {"filter_bytes": 8, "most_broadcast": 0}])
def test_against_brute_force(spark, options):
    rng = random.Random(5)
    vocabulary = ["a", "b", "c", "Dd", "é", "9"]  # few words: many chance matches and overlaps
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, sentence(rng.choice([1, 2, 5, 7, 12, 13, 14, 20, 40]))) for i in range(25)] + [(100, None), (101, ""), (102, "..."), (3, "zz zz"), (3, "zz zz")]
    docs = [sentence(rng.randint(0, 120)) for _ in range(60)] + [None, "", "!?"]
    for _ in range(30):
        i, j = rng.randrange(25), rng.randrange(len(docs) - 3)
        body = items[i][1].split()
        a = rng.randrange(len(body))
        docs[j] += " ,. " + " - ".join(body[a : a + rng.randint(1, 30)]).upper()
    assert run(spark, docs, items, **options) == brute(docs, items)


def test_long_texts_in_segments():
    """Words and candidates of a text cut into segments are those of the whole text."""
    rng = random.Random(9)
    texts = ["", "a b", " ".join(f"w{rng.randrange(50)}" for _ in range(900)), "x" * 700 + " y", " " * 500 + "z " + " " * 500 + "é" * 300 + " b c", "only spaces".replace("only", " ") * 90]
    column = pa.array(texts)
    whole = words_of(column)
    everything = Filter(np.full(1 << 10, 0xFFFFFFFFFFFFFFFF, np.uint64), [1, 2, 12])
    expected = set()
    for p, f, g, size in zip(*(x.tolist() for x in _candidates(whole, everything, 7, 7)), strict=True):
        i = int(whole.text_of()[p])
        expected.add((i, p - int(whole.first[i]), g, size))
    for most in (64, 200, 1000, 1 << 20):
        seen, counted = set(), np.zeros(len(texts), np.int64)
        for words, row, before, own in segments_of(column, 12, most):
            counted[row : row + len(own)] += own
            for p, _, g, size in zip(*(x.tolist() for x in _candidates(words, everything, 7, 7)), strict=True):
                i = int(words.text_of()[p])
                seen.add((row + i, before + p - int(words.first[i]), g, size))
        assert counted.tolist() == np.diff(whole.first).tolist() and seen == expected


def test_a_passage_of_all_documents_and_items(spark):
    """One window in a third of all rows on either side, and no broadcast of what was found."""
    common = "once upon a time in a small town by the sea there lived a keeper of bees"
    docs = [f"document {i} begins {common} and ends {i}" if i % 3 == 0 else f"document {i} is its own" for i in range(300)]
    items = [(i, f"item {i} " + (common if i % 3 == 0 else "is short")) for i in range(60)]
    assert run(spark, docs, items, most_broadcast=0) == brute(docs, items)


def test_filter_is_bounded(spark):
    """What is sent to executors has a bounded size; a filter too small lets more through and loses nothing."""
    may = _filter_of(spark.createDataFrame([(13, h * 7919 << 17) for h in range(3000)], "size int, hash long"), 64, 13)
    assert len(may.words) * 8 <= 64 and may.may_have(np.array([h * 7919 << 17 for h in range(3000)], np.int64).view(np.uint64)).all()
    small = _filter_of(spark.createDataFrame([(13, h * 7919 << 17) for h in range(300)] + [(4, 5)], "size int, hash long"), 1 << 20, 13)
    assert small.sizes == [4] and small.may_have(np.arange(10**6, 10**6 + 5000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).mean() < 0.05


def test_every_long_shared_span_is_found(spark):
    rng = random.Random(6)
    docs, items = [], []
    for i in range(40):  # rare words: nothing but the planted span can match
        body = [f"w{i}x{k}" for k in range(30)]
        items.append((i, " ".join(body)))
        a = rng.randint(0, 17)
        docs.append(" ".join([f"d{i}q{k}" for k in range(rng.randint(0, 9))] + body[a : a + 13] + ["end"]))
        docs.append(" ".join(["start", *body[a : a + 12], "end"]))
    found = run(spark, docs, items)
    assert [r[1] for r in found] == [13, 0] * 40 and found == brute(docs, items)


def test_edges(spark, edge_docs, no_docs, edge_rows):
    bench = spark.createDataFrame([(1, "lazy dog"), (None, "word"), (2, None)], "item_id long, text string")
    marked = mark_contamination(edge_docs, bench, into="Contamination")
    assert [c.lower() for c in marked.columns] == ["doc_id", "text", "lang", "source", "n_chars", "__uid", "score", "contamination"]
    got = sorted((r.doc_id or -1, r.Contamination.n_words, r.Contamination.n_hit, list(r.Contamination["items"])) for r in marked.collect())
    expected = sorted((r[0] or -1, len(words(r[1])), h, i) for r, (h, i) in zip(edge_rows, [(2, ["1"])] * 2 + [(0, [])] * 6 + [(1, [""])] + [(0, [])] * 2, strict=True))
    assert got == expected
    assert marked.where(contaminated("Contamination")).count() == 3
    assert mark_contamination(no_docs, bench).count() == 0
    clash = edge_docs.selectExpr("*", "1 n_hit", "2 items", "3 spans", "4 __place", "5 __hit", "6 hash", "7 print", "8 n_words")
    assert mark_contamination(clash, bench).columns == [*[c for c in clash.columns if c != "contamination"], "contamination"]
    assert mark_contamination(clash, bench, into="items").agg(F.sum("items.n_hit")).first()[0] == 5
    assert mark_contamination(edge_docs, bench.limit(0)).agg(F.sum("contamination.n_hit")).first()[0] == 0
