import random
import re

import numpy as np
import pyarrow as pa
import pytest

from rowforge.llm.license_templates import HEADINGS, NEGATIONS, OTHER, TEMPLATES
from rowforge.llm.licenses import FAMILIES, Model, corpus_paragraphs, license_hits, op2, paragraphs, scan_texts
from rowforge.llm.words import words_of


@pytest.fixture(scope="module")
def model():
    return Model([f"plain words number {i} of a story about the sea" for i in range(100)])


def test_paragraphs():
    texts = ["a b\n\nc\n", None, "", "\n\n", "x", "é\nü w"]
    p = paragraphs(pa.array(texts, pa.string()))
    got = [(int(t), int(i), (texts[t] or "").encode()[a:b].decode()) for t, i, a, b in zip(p.text, p.place, p.start, p.end, strict=True)]
    assert got == [(0, 0, "a b"), (0, 2, "c"), (4, 0, "x"), (5, 0, "é"), (5, 1, "ü w")]
    assert np.diff(p.words.first).tolist() == [2, 1, 1, 1, 2]


def test_notices_and_others(model):
    for family, notices in TEMPLATES.items():
        for hits in model.scan(pa.array(notices + HEADINGS[family]), 0.5, 0.6):
            assert [(h["family"], h["confirmed"]) for h in hits] == [(family, True)]
    assert not any(h["confirmed"] for hits in model.scan(pa.array(OTHER), 0.5, 0.6) for h in hits)


#: Lines that no example has: of licences, and of everything else.
UNSEEN = {
    "This module is licensed under the MIT license.": "MIT", "Licensed under the Apache License, Version 2.0 (see LICENSE).": "Apache", "// SPDX-License-Identifier: BSD-3-Clause": "BSD",
    "This library is licensed under the GNU General Public License, version 3.": "GPL", "Photo: Licensed under CC BY-SA 4.0.": "CC-BY-SA", "Copyright 2019 Some Press. All rights reserved.": "Proprietary",
    "Released under the terms of the peace agreement": "", "This project is not licensed under the MIT license.": "", "The text was never released under the MIT License.": "",
    "The court said that permission is hereby granted, free of charge, to the witness who came late.": "", "Hunting without a licence is punished in that state.": "",
    "The MIT license plate was missing.": "", "She holds a license to teach in two states.": "", "The terms of the general agreement were public.": "", "License": "", "the the the": "",
}


def test_unseen_lines(model):
    got = {line: [h["family"] for h in hits if h["confirmed"]] for line, hits in zip(UNSEEN, model.scan(pa.array(list(UNSEEN)), 0.5, 0.6), strict=True)}
    assert got == {line: [f] if f else [] for line, f in UNSEEN.items()}


def test_unknown_is_calibrated_on_paragraphs_of_the_corpus(spark, sf_dir):
    """Of paragraphs that the model has not seen, without a word of a notice, hardly any is said to be a licence."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("coalesce(text, '') t")
    lines = corpus_paragraphs(docs, rows=400, lines=2400)
    model = Model(lines[::2])
    p = model.probabilities(words_of(pa.array(lines[1::2])))
    assert (p[:, 0] > 0.5).mean() > 0.995 and abs((1 - p[:, 0]).mean()) < 0.01
    assert np.allclose(p.sum(1), 1) and (p >= 0).all()


def naive_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def naive_similarity(family, line):
    """The template comparison from its description, on strings."""
    triples = lambda w: [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    words = naive_words(line)
    if words in [naive_words(t) for t in (*HEADINGS[family], *TEMPLATES[family])]:
        return 1.0
    own, best = triples(words), 0.0
    for notice in (set(triples(naive_words(t))) for t in TEMPLATES[family]):
        common = set(own) & notice
        first = next((i for i, t in enumerate(own) if t in common), 0)
        if len(common) >= min(3, max(1, len(notice))) and not set(words[max(0, first - 3) : first]) & set(NEGATIONS):
            best = max([best, len(common) / len(notice), *([len(common) / len(set(own))] if len(common) >= 10 else [])])
    return best


def naive_scan(model, text, threshold, likeness):
    """Every line on its own: a dense softmax over all its words and pairs, and the naive template comparison."""
    out = []
    for i, line in enumerate((text or "").split("\n")):
        one = words_of(pa.array([line]))
        n = len(one.hash)
        if not n:
            continue
        z = model.bias.copy()
        buckets = [model_bucket(one, j, 1, model.bits) for j in range(n)] + [model_bucket(one, j, 2, model.bits) for j in range(n - 1)]
        for b in buckets:
            z = z + model.table[b] / np.sqrt(max(2 * n - 1, 1)) * (np.abs(model.table[b]).max() > 1e-3)
        p = np.exp(z / model.temperature - (z / model.temperature).max())
        p /= p.sum()
        known = float(model.known(np.array([1 - p[0]]))[0])
        p = p * known / max(1 - p[0], 1e-12)
        best = 1 + int(np.argmax(p[1:]))
        if p[best] >= threshold:
            like = naive_similarity(FAMILIES[best], line)
            out.append((i, FAMILIES[best], round(float(p[best]), 6), round(like, 9), like >= likeness))
    return out


def model_bucket(words, j, size, bits):
    from rowforge.llm.common import mix
    from rowforge.llm.words import grams

    value = words.hash[j] if size == 1 else grams(words, 2)[0][j] + np.uint64(1)
    return int(mix(np.array([value]))[0] >> np.uint64(64 - bits))


def test_scan_against_brute_force(model):
    rng = random.Random(3)
    notices = [n for own in TEMPLATES.values() for n in own]
    lines = [*notices[::3], *OTHER, *UNSEEN, "", "...", *(h for own in HEADINGS.values() for h in own[:2])]
    for _ in range(120):  # pieces of notices among other words
        n, o = rng.choice(notices).split(), rng.choice(OTHER).split()
        a, b = rng.randrange(len(n)), rng.randrange(len(o))
        lines.append(" ".join(o[:b] + n[a : a + rng.randint(1, 30)] + o[b:]))
    rng.shuffle(lines)
    texts = ["\n".join(lines[i : i + 7]) for i in range(0, len(lines), 7)] + [None, ""]
    got = [[(h["paragraph"], h["family"], round(h["probability"], 6), round(h["similarity"], 9), h["confirmed"]) for h in hits] for hits in model.scan(pa.array(texts), 0.5, 0.6)]
    assert got == [naive_scan(model, t, 0.5, 0.6) for t in texts]
    # in pieces as at once
    long = "\n".join(lines) + "\n\né end"
    assert scan_texts(model, pa.array([long]), 0.5, 0.6, 500) == model.scan(pa.array([long]), 0.5, 0.6)


def test_altered_notices(model):
    """Notices with a copyright line in front, other punctuation and a few words changed."""
    rng, right, total = random.Random(1), 0, 0
    for family, notices in TEMPLATES.items():
        for notice in notices:
            words = notice.upper().replace(",", " ;").split()
            if len(words) >= 15:
                words[rng.randrange(len(words))] = "something"
            hits = model.scan(pa.array(["Some story.\nCopyright 2021 by A. Person " + " ".join(words) + "\nThe end."]), 0.5, 0.6)[0]
            total += 1
            right += [(h["paragraph"], h["family"]) for h in hits if h["confirmed"]] == [(1, family)]
    assert right >= 0.9 * total


def test_probabilities_are_calibrated(model):
    """Sums are one, and paragraphs without a word of a licence are unknown."""
    p = model.probabilities(words_of(pa.array(["the cat sat on the mat", "", "Released under the MIT License."])))
    assert np.allclose(p.sum(1), 1) and p[0].argmax() == 0 and FAMILIES[p[2].argmax()] == "MIT"


def test_edges(spark, edge_docs, no_docs):
    out = license_hits(edge_docs, into="score")
    assert sorted(out.columns) == sorted(edge_docs.columns) and out.count() == edge_docs.count()
    assert license_hits(no_docs).count() == 0
    clash = edge_docs.selectExpr("*", "1 t", "2 line", "3 __text", "4 licenses", "5 hash")
    assert license_hits(clash).columns == [*[c for c in clash.columns if c != "licenses"], "licenses"]
    assert corpus_paragraphs(no_docs.selectExpr("text t")) == []
    df = spark.createDataFrame([(1, "x\nAll rights reserved.\nLicensed under CC BY-SA 4.0."), (1, "x\nAll rights reserved.\nLicensed under CC BY-SA 4.0.")], "doc_id long, text string")
    rows = license_hits(df).collect()
    assert [[(h.paragraph, h.start, h.end, h.family) for h in r.licenses] for r in rows] == [[(1, 2, 22, "Proprietary"), (2, 23, 51, "CC-BY-SA")]] * 2


def test_query(spark, sf_dir):
    """The statements that the test documents contain, found by regular expression."""
    known = {"GPL": r"licensed under the GNU General Public License", "Proprietary": r"All rights reserved\.", "CC-BY-NC": r"Licensed under CC BY-NC \d", "MIT": r"Released under the MIT License", "Apache": r"Licensed under the Apache License"}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in op2(spark, sf_dir).collect():
        assert r.families == ",".join(sorted(f for f, p in known.items() if re.search(p, texts[r.doc_id])))
