"""One text of 50 MB goes through each scan in less than a gigabyte."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from rowforge.llm import quality, toxicity
from rowforge.llm.decontamination import Filter, _scan
from rowforge.llm.licenses import Model, scan_texts
from rowforge.llm.near_duplicates import Described, sketch

SIZE = 50 << 20


@pytest.fixture(scope="module")
def long():
    """Lines of words from a vocabulary of a million, so that nearly all shingles differ."""
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 20, SIZE // 6)
    lines = [" ".join(map("{:x}".format, words[i : i + 4096].tolist())) for i in range(0, len(words), 4096)]
    return pa.array(["\n".join(lines)])


class Sent:
    def __init__(self, value):
        self.value = value


def shingled(column):
    d = Described(column)
    sketch(d.text, d.value, d.weight, 1)


def scanned(column):
    run = _scan(Sent(Filter(np.zeros(1 << 10, np.uint64), [3])), "t", [], ["n", "c"], 7, 7)
    return list(run(iter([pa.RecordBatch.from_arrays([column], names=["t"])])))


@pytest.fixture(scope="module")
def licences():
    return Model(["plain words of a story"] * 20, rounds=5)


@pytest.mark.parametrize("name", ["shingles", "windows", "statistics", "tokens", "licences"])
def test_memory(long, licences, name):
    scan = {
        "shingles": shingled, "windows": scanned, "statistics": quality.statistics,
        "tokens": lambda _: toxicity.features(["you are one of many plain words and an idiot. " * (SIZE // 200)], toxicity.Tokens({})), "licences": lambda c: scan_texts(licences, c, 0.5, 0.6),
    }[name]
    tracemalloc.start()
    try:
        scan(long)
        assert tracemalloc.get_traced_memory()[1] < 1 << 30
    finally:
        tracemalloc.stop()
