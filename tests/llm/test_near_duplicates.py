import random

import numpy as np
import pyarrow as pa
import pytest

from rowforge.llm.graph import components
from rowforge.llm.near_duplicates import REGISTERS, Described, near_duplicate_classes, op6, probability_jaccard, shingles, sketch, without_near_duplicates


def sets_of(texts):
    text, value, weight = shingles(pa.array(texts, pa.string()))
    return [(value[text == i], weight[text == i]) for i in range(len(texts))]


def naive(a, b):
    """The definition: the sum over shared elements of 1 / sum_j max(x_j / x_i, y_j / y_i)."""
    x, y = dict(zip(a[0].tolist(), a[1].tolist(), strict=True)), dict(zip(b[0].tolist(), b[1].tolist(), strict=True))
    keys = set(x) | set(y)
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in keys) for i in set(x) & set(y))


def corpus(rng, n=40):
    def text(k):
        return [f"w{rng.randrange(3000)}" for _ in range(k)]

    out = []
    for _ in range(n):
        base = text(rng.randint(1, 200))
        for _ in range(rng.choice([1, 1, 1, 2, 5])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(3000)}"
            if rng.random() < 0.2:
                copy += copy[:30] * 3
            out.append(" ".join(copy))
    return out


def brute_classes(texts, threshold=0.8):
    sets, root = sets_of(texts), list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            equal = texts[i] == texts[j] if not len(sets[i][0]) else False
            if equal or naive(sets[i], sets[j]) >= threshold - 1e-9:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def test_texts_in_segments():
    """Shingles, keys and sketches of texts cut into segments are those of whole texts."""
    rng = random.Random(6)
    texts = ["", "a b", "one two three four", " ".join(f"w{rng.randrange(40)}" for _ in range(700)), "x" * 900 + " y" + " " * 600 + "z", " " * 400 + "a b c d e f g"]
    column = pa.array(texts)
    whole = Described(column)
    for most in (50, 300, 2000):
        part = Described(column, most=most)
        for name in ("text", "value", "weight", "words", "keys"):
            assert (getattr(part, name) == getattr(whole, name)).all(), (most, name)
    args = whole.text, whole.value, whole.weight, len(texts)
    assert (sketch(*args) == sketch(*args, most=37)).all()
    assert [len(s[0]) for s in sets_of(texts)] == [0, 1, 1, len(set(zip(*(texts[3].split()[i : 696 + i] for i in range(5)), strict=True))), 1, 3]


def test_similarity_is_the_definition():
    sets = sets_of(corpus(random.Random(1), 15))
    for a in sets:
        for b in sets[:10]:
            assert probability_jaccard(*a, *b) == pytest.approx(naive(a, b), abs=1e-9)
    binary = (np.array([1, 2, 3, 4], np.uint64), np.ones(4)), (np.array([2, 3, 9], np.uint64), np.ones(3))
    assert probability_jaccard(*binary[0], *binary[1]) == pytest.approx(2 / 5)


def test_registers_agree_as_often_as_similar():
    rng = np.random.default_rng(2)
    texts, expected, n = [], [], 400
    pieces_t, pieces_v, pieces_w = [], [], []
    for i in range(n):  # pairs of weighted sets with half of their elements shared
        values = rng.integers(1, 2**63, 60, dtype=np.int64).astype(np.uint64)
        weights = rng.uniform(0.2, 4, 60)
        for k, part in enumerate((slice(0, 45), slice(15, 60))):
            order = np.argsort(values[part])
            w = weights[part] * (1 if k == 0 else rng.uniform(0.5, 2, 45))
            pieces_t.append(np.full(45, 2 * i + k))
            pieces_v.append(values[part][order])
            pieces_w.append(w[order])
        expected.append(naive((pieces_v[-2], pieces_w[-2]), (pieces_v[-1], pieces_w[-1])))
        texts.append(i)
    s = sketch(np.concatenate(pieces_t), np.concatenate(pieces_v), np.concatenate(pieces_w), 2 * n)
    got = (s[::2] == s[1::2]).mean(axis=1)
    assert s.shape == (2 * n, REGISTERS) and abs(got.mean() - np.mean(expected)) < 0.01
    assert np.abs(got - expected).max() < 0.2


def test_classes_against_brute_force(spark):
    texts = corpus(random.Random(3)) + ["", "", "...", "?!", "one two", "One, two!", "one two three"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    classes, _, _ = near_duplicate_classes(df)
    got = {r.doc_id: (r.class_id, r.kept) for r in classes.collect()}
    expected = brute_classes(texts)
    assert [got[i][0] for i in range(len(texts))] == expected
    assert [got[i][1] for i in range(len(texts))] == [i == c for i, c in enumerate(expected)]
    left = without_near_duplicates(df)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == sorted(set(expected))


def test_hub_hides_no_link(spark):
    """A chain: neighbours are similar, ends are not; and a large group around one text."""
    rng = random.Random(4)
    base = [f"c{i}" for i in range(120)]
    chain = []
    for k in range(12):
        copy = list(base)
        copy[:k] = [f"n{i}" for i in range(k)]
        copy[60 : 60 + k] = [f"m{i}" for i in range(k)]
        chain.append(" ".join(copy))
    star = [f"s{i}" for i in range(150)]
    group = [" ".join(star)]
    for i in range(60):
        copy = list(star)
        for j in rng.sample(range(150), 3):
            copy[j] = f"x{i}y{j}"
        group.append(" ".join(copy))
    texts = chain + group
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in near_duplicate_classes(df)[0].collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_edges(spark, edge_docs, no_docs):
    classes, stored, own = near_duplicate_classes(edge_docs)
    assert own == "___uid" and stored.count() == edge_docs.count()
    rows = classes.collect()
    empty = {(r.doc_id, r.class_id, r.kept) for r in rows if r.class_id == 2}
    assert empty == {(2, 2, True), (3, 2, False), (None, 2, False)} and sum(r.class_id == 2 for r in rows) == 4
    assert sorted(r.kept for r in rows if r.doc_id == 1) == [False, True]
    left = without_near_duplicates(edge_docs)
    assert left.columns == edge_docs.columns and left.count() == 7
    assert near_duplicate_classes(no_docs)[0].count() == 0
    clash = edge_docs.selectExpr("*", "1 uid", "2 t", "3 k1", "4 bands", "5 rep", "6 size", "7 n", "8 kept", "9 class_id")
    assert without_near_duplicates(clash).columns == clash.columns and without_near_duplicates(clash).where("uid <> 1 or t <> 2 or n <> 7").count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {n: n for e in edges for n in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query(spark, sf_dir):
    rows = op6(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert len(rows) == len(texts)
    by_text = {}
    for r in rows:
        assert by_text.setdefault(texts[r.doc_id], r.class_id) == r.class_id  # exact copies
    sample = sorted(texts)[:150]
    got = {r.doc_id: r.class_id for r in rows}
    expected = brute_classes([texts[i] for i in sample])
    assert all((got[sample[i]] == got[sample[j]]) >= (expected[i] == expected[j]) for i in range(150) for j in range(i))
