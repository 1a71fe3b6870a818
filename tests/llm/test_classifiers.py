import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowforge.llm import quality, toxicity
from rowforge.llm.boosting import BoostedTrees
from rowforge.llm.calibration import Isotonic
from rowforge.llm.labelled import fold, training_labels


def test_isotonic_is_the_least_squares_fit():
    rng = np.random.default_rng(1)
    x = np.sort(rng.random(60))
    y = (rng.random(60) < x).astype(float)
    fit = Isotonic(x, y)
    assert (np.diff(fit.y) > 0).all() and np.isclose((Isotonic(x, y)(x)).mean(), y.mean(), atol=0.05)
    # the definition: the max over lower ends of the min over upper ends of means
    blocks = [max(min(y[a : b + 1].mean() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    assert np.allclose(np.unique(np.round(blocks, 9)), np.unique(np.round(fit.y, 9)))
    weighted, repeated = Isotonic(np.array([1.0, 2.0]), np.array([0.0, 1.0]), np.array([3.0, 1.0])), Isotonic(np.array([1.0, 1, 1, 2]), np.array([0.0, 0, 0, 1]))
    assert (weighted.x == repeated.x).all() and (weighted.y == repeated.y).all()


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    a = BoostedTrees(x[:2000], y[:2000])
    assert ((a(x[2000:]) > 0) == y[2000:]).mean() > 0.95
    assert (BoostedTrees(x[:2000], y[:2000])(x) == a(x)).all()
    constant = BoostedTrees(np.zeros((5, 2)), np.ones(5))
    assert np.isfinite(constant(np.zeros((3, 2)))).all()


def test_ridge_by_partitions_is_the_direct_solution(spark):
    """Partition-summed normal equations give the weights that one matrix of all rows gives."""
    rng = np.random.default_rng(3)
    x = rng.random((200, len(quality.STATISTICS)))
    y = (x[:, 0] + 0.1 * rng.random(200) > 0.5).astype(float)
    df = spark.createDataFrame([(i, 1 + i % 4, x[i].tolist(), float(y[i])) for i in range(200)], "doc_id long, fold int, x array<double>, label double").repartition(5)
    model = quality.fit(df.drop("label"), df.select("doc_id", "label"), features=16, widths=(2.0,), penalties=(0.1,))
    z = model.fourier(x)
    n = z.shape[1]
    direct = np.linalg.solve(z.T @ z + 0.1 * (1 + len(z) * 1e-4) * np.eye(n), z.T @ y)
    assert np.allclose(model.weights, direct, atol=1e-6)


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 6))
    f = quality.Fourier(np.zeros(6), np.ones(6), 20_000, 2.0, 1)
    z = f(x)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * 4.0))
    assert np.abs(z @ z.T - kernel).max() < 0.05


def naive_statistics(text):
    """The statistics from their names, on Python strings and bytes."""
    data = text.encode()
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(b + 32 if 65 <= b <= 90 else b for b in data))
    w, per = len(words), max(len(words), 1)
    count = lambda chars: sum(b in chars for b in data)
    small, capital, digit = count(range(97, 123)), count(range(65, 91)), count(range(48, 58))
    lead = sum(b >= 192 for b in data)
    chars, letters = max(sum(not 128 <= b < 192 for b in data), 1), max(small + capital + lead, 1)
    triples = [tuple(words[i : i + 3]) for i in range(w - 2)]
    lines = [x for x in text.split("\n") if x.strip()]
    marks = count(b".,;:?'\"-()")
    return [
        np.log1p(w), min((letters + digit) / per, 50), np.log1p(len(set(words))) / np.log1p(per), sum(a == b for a, b in zip(words, words[1:], strict=False)) / per,
        len(set(triples)) / max(w - 2, 1), capital / letters, digit / chars, count(b" \t") / chars, min(len(lines) / per, 2), 1 - len(set(lines)) / max(len(lines), 1),
        min(marks / per, 5), min(data.count(b"!") / per, 5), min(count(b"#$%&*@^~+=<>/\\_{}[]`") / per, 5), min(data.count(b"|") / per, 5), lead / letters, np.log1p(w / (marks + 1)),
    ]


def odd_texts():
    rng = random.Random(8)
    return ["", "a", "!!! ???", "A A a b. b b\n\nx | y\nx | y", "é ü 😀 ÄÖ 12 3", "x" * 3000, " " * 2000 + "z", " ".join(rng.choice(["a", "Bb", "c!", "d\n", "é."]) for _ in range(4000))]


@pytest.mark.parametrize("most", [100, 1000, 4 << 20])
def test_statistics_against_naive_ones(monkeypatch, most):
    """Also of texts that are read in segments."""
    whole = quality.segments_of
    monkeypatch.setattr(quality, "segments_of", lambda column, overlap: whole(column, overlap, most))
    texts = odd_texts()
    assert np.allclose(quality.statistics(pa.array(texts)), [naive_statistics(t) for t in texts], atol=1e-12)


def naive_toxic_features(text, lexicon):
    """The features token by token, each looked up in the lexicon by its definition."""
    found = []
    for token in text.split():
        low = token.lower()
        word = re.sub(r"^[\W_]+|[\W_]+$", "", low)
        plain = re.sub(r"[\W_]+", "", word.translate(toxicity._SIGNS))
        insult, learned = word in toxicity.INSULTS, lexicon.get("=" + word, 0.0)
        start = max([lexicon.get("^" + word[:n], 0.0) for n in range(3, 9) if n < len(word)], default=0.0)
        unmasked = plain != word and not insult and learned == 0 and (plain in toxicity.INSULTS or lexicon.get("=" + plain, 0.0) > 0)
        if unmasked:
            insult, learned = plain in toxicity.INSULTS, lexicon.get("=" + plain, 0.0)
        obscured = re.search(r"[^\W\d_](?:[*@$!|€+#%.\-_]|\d)+[^\W\d_]", re.sub(r"^[\W_]+|[\W_]+$", "", token)) is not None
        tail = len(token) - len(token.rstrip("!?.*#%$&@"))
        found.append((token, insult, learned, start, word in toxicity.SECOND_PERSON, len(word) > 1 and token.upper() == token and low != token, token.count("!"), token.count("?"), tail > 1, obscured, unmasked, len(word) == 1 and word.isalpha()))
    n, per = len(found), max(len(found), 1)
    hit = [f[1] or f[2] > 0 for f in found]
    start = [0 if h else f[3] for f, h in zip(found, hit, strict=True)]
    near = sum(h and any(found[j][4] for j in range(max(0, i - 5), min(n, i + 6)) if j != i) for i, h in enumerate(hit))
    add = lambda k: float(sum(f[k] for f in found))
    known, starts = sum(f[2] > 0 for f in found), sum(s > 0 for s in start)
    return [
        np.log1p(n), add(1), add(1) / per, known, known / per, max([0.0, *(max(f[2], s) for f, s in zip(found, start, strict=True))]), add(2), add(2) / per, starts, starts / per, sum(start),
        add(4) / per, near, add(5) / per, add(6) / per, add(7) / per, add(8) / per, add(9), add(9) / per, add(10), add(11) / per, len({f[0] for f, h in zip(found, hit, strict=True) if h}),
    ]


@pytest.mark.parametrize("most", [40, 300, 1 << 20])
def test_toxic_features_against_naive_ones(most):
    rng = random.Random(9)
    lexicon = {"=grubby": 1.5, "^grub": 0.9, "^foo": 0.8, "=dummkopf": 2.0, "=tag": 0.7}
    words = ["you", "You!", "idiot", "1d1ot", "i.d.i.o.t", "GRUBBY", "grubbiest", "fool", "foo", "the", "a", "Dummkopf!!", "d*mn", "é", "...", "_", "x" * 60, "x" * 400, "tag", "-", "ALL", "s7upid", "what??"]
    texts = ["", " ", *words, *(" ".join(rng.choice(words) for _ in range(rng.randint(1, 200))) for _ in range(40))]
    x = toxicity.features([None, *texts], toxicity.Tokens(lexicon, most=15), most)
    assert np.allclose(x, [naive_toxic_features(t, lexicon) for t in ["", *texts]])


def naive_tree_scores(x, y, rounds, depth, rate, penalty, least):
    """Boosting by its definition: every split of every node searched over all values that part the rows, row by row."""
    n, d = x.shape
    mean = (y.sum() + 0.5) / (n + 1)
    score = np.full(n, np.log(mean / (1 - mean)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        nodes = [np.arange(n)]
        for _ in range(depth):
            after = []
            for rows in nodes:
                best, left, right = 1e-9, rows, rows[:0]
                for j in range(d):
                    for cut in sorted(set(x[:, j]))[:-1]:
                        a = rows[x[rows, j] <= cut]
                        b = rows[x[rows, j] > cut]
                        if h[a].sum() < least / 4 or h[b].sum() < least / 4:
                            continue
                        gain = g[a].sum() ** 2 / (h[a].sum() + penalty) + g[b].sum() ** 2 / (h[b].sum() + penalty) - g[rows].sum() ** 2 / (h[rows].sum() + penalty)
                        if gain > best + 1e-9:
                            best, left, right = gain, a, b
                after += [left, right]
            nodes = after
        for rows in nodes:
            score[rows] += rate * g[rows].sum() / (h[rows].sum() + penalty)
    return score


def test_trees_against_a_naive_split_search():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 9, (150, 3)).astype(float)  # so few values that each has a bin
    y = ((x[:, 0] > 4) ^ (x[:, 1] > 2) ^ (rng.random(150) < 0.1)).astype(float)
    trees = BoostedTrees(x, y, rounds=6, depth=3, rate=0.3, bins=64, penalty=2.0, least=3.0)
    assert np.allclose(trees(x), naive_tree_scores(x, y, 6, 3, 0.3, 2.0, 3.0), atol=1e-6)


def test_statistics_of_odd_texts():
    import pyarrow as pa

    x = quality.statistics(pa.array(["", None, "a", "!!!", "\n\n", "A A A", "x" * 9999, "é|%$ 1"], pa.string()))
    assert x.shape == (8, len(quality.STATISTICS)) and np.isfinite(x).all() and (x[0] == x[1]).all()


def test_token_features():
    tokens = toxicity.Tokens({"=blarg": 3.0, "^grum": 2.0})
    names = toxicity.FEATURES
    rows = toxicity.features(["you are an 1d10t and a M.o.R.o.N", "a grumble, Blarg! blarg", "", None, "THE END", "fine words here"], tokens)
    row = lambda i: dict(zip(names, rows[i], strict=True))
    assert row(0)["insults"] == 2 and row(0)["unmasked"] == 2 and row(0)["near_second_person"] == 1
    assert row(1)["learned"] == 2 and row(1)["beginnings"] == 1 and row(1)["exclamations"] == pytest.approx(1 / 4)
    assert not rows[2].any() and not rows[3].any() and row(4)["capital_tokens"] == 1 and row(5)["insults"] == 0
    few = toxicity.Tokens({"=blarg": 3.0, "^grum": 2.0}, most=1)  # tokens beyond the table's size count alike
    texts = ["you are an 1d10t and a M.o.R.o.N", "a grumble, Blarg! blarg", "X!! y?? Z"]
    assert np.array_equal(toxicity.features(texts, few), toxicity.features(texts, toxicity.Tokens({"=blarg": 3.0, "^grum": 2.0})))


@pytest.mark.parametrize(("run", "label", "threshold", "accuracy"), [(quality.op1, "quality", 0.3, 0.95), (toxicity.op8, "toxic", 0.5, 0.93)])
def test_held_out_accuracy(spark, sf_dir, run, label, threshold, accuracy):
    rows = run(spark, sf_dir).cache()
    assert rows.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert rows.where(f"score is null or score < 0 or score > 1 or predicted <> (case when score >= {threshold} then 1 else 0 end)").count() == 0
    assert rows.where("held_out <> (crc32(cast(doc_id as string)) % 5 = 0)").count() == 0
    held = rows.where("held_out").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    assert held.where(F.col("predicted") == F.col(label)).count() >= accuracy * held.count()


@pytest.mark.parametrize("kind", ["quality", "toxicity"])
def test_edges(spark, edge_docs, no_docs, kind):
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 9)] + [(1, None, 1), (None, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")

    def scores(docs, labels):
        out = (toxicity.toxicity_scores if kind == "toxicity" else quality.quality_scores)(docs, labels, into="Score")
        assert sorted(out.columns) == sorted([*(c for c in docs.columns if c != "score"), "Score"])
        return [(r.text, r.Score) for r in out.collect()]

    found = scores(edge_docs, labels)
    assert len(found) == edge_docs.count() and all(0 <= s <= 1 for _, s in found)
    by_text = {}
    for t, s in found:
        assert by_text.setdefault(t or "", s) == s
    neutral = 1.0 if kind == "quality" else 0.0
    for none in (labels.limit(0), labels.where("quality = 1 and toxic = 0").limit(1), labels.selectExpr("doc_id", "cast(null as int) quality", "cast(null as int) toxic")):
        assert {s for _, s in scores(edge_docs, none)} == {neutral}
    assert scores(no_docs, labels) == []


def test_held_out_labels_are_never_read(spark):
    labels = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, toxic int")
    left = training_labels(labels, "toxic")
    assert left.where(fold() == 0).count() == 0 and 0 < left.count() < 100


def test_scores_do_not_see_ids(spark, sf_dir):
    """Other ids, languages and sources of unlabelled documents change no score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    unlabelled = docs.join(labels, "doc_id", "left_anti").limit(50).selectExpr("doc_id + 1000000000 doc_id", "text", "'zz' lang", "'zz' source", "0L n_chars")
    out = toxicity.toxicity_scores(docs.unionByName(unlabelled), labels).select("text", "toxicity").distinct()
    assert out.groupBy("text").count().where("count > 1").count() == 0
