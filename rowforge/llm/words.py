"""Words and word n-grams of whole texts as numpy arrays, without a Python object for each word.

A word is a maximal run of the characters ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z have become a-z: digits, ASCII
letters and everything beyond ASCII. Work is on UTF-8 bytes, where that class is the same for each byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import mix, raw_bytes

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)
_AT_ONCE = 1 << 17


def powers(n: int) -> np.ndarray:
    """Powers of an odd constant modulo 2**64, kept between calls."""
    global _powers
    if len(_powers) < n:
        _powers = np.full(max(n, 64), np.uint64(0x100000001B3), dtype=np.uint64)
        _powers[0] = 1
        np.multiply.accumulate(_powers, out=_powers)
    return _powers[:n]


@dataclass
class Words:
    """The words of several texts one after another. ``first[d]:first[d + 1]`` are those of text d."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def words(self, begin: int, end: int) -> list[bytes]:
        return [self.word(i) for i in range(begin, end)]


def words_of(column: pa.Array) -> Words:
    return _words(*raw_bytes(column))


def _words(data: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    low = LOWER[data]
    inside = IS_WORD[low]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    edges = offsets[1:-1]
    before[edges[edges < n]] = False  # a text never continues a word of the one before it
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    if not len(start):
        return Words(low, start, end, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    hashed = np.empty(len(start), np.uint64)
    for i in range(0, len(start), _AT_ONCE):  # a few bytes of working memory for each byte of so many words
        a, b = start[i : i + _AT_ONCE], end[i : i + _AT_ONCE]
        size = b - a
        first = np.cumsum(size) - size
        at = np.arange(int(size.sum())) - np.repeat(first, size)
        part = slice(a[0], b[-1])
        value = (low[part][inside[part]].astype(np.uint64) + np.uint64(1)) * powers(int(size.max()))[at]
        hashed[i : i + _AT_ONCE] = mix(np.add.reduceat(value, first) + size.astype(np.uint64) * _ODD)
    return Words(low, start, end, hashed, np.searchsorted(start, offsets))


def merged(text: np.ndarray, value: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal (text, value) as one, in order, with the sum of their times."""
    if not len(text):
        return text, value, times
    order = np.lexsort((value, text))
    text, value, times = text[order], value[order], times[order]
    begin = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (value[1:] != value[:-1])))
    return text[begin], value[begin], np.add.reduceat(times, begin)


def grams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word position, of the k words from there, and whether all k belong to the same text."""
    n = len(words.hash)
    out = np.zeros(n, np.uint64)
    weight = powers(k + 1)
    for i in range(min(k, n)):
        out[: n - i] += words.hash[i:] * mix(weight[i : i + 1] + _ODD)[0]
    whole = np.arange(n) + k <= np.repeat(words.first[1:], np.diff(words.first))
    return mix(out), whole


def segments_of(column: pa.Array, overlap: int, most: int = 4 << 20) -> Iterator[tuple[Words, int, int, np.ndarray]]:
    """The words of the texts in segments of about ``most`` bytes, for texts of any length: (words, row, before, own).

    The words are those of the rows from ``row`` on, and before the first of them stand ``before`` others of its text; ``own`` says
    how many words of each row haven't been in a segment before. A text longer than ``most`` has segments of its own, each of which
    begins with the last ``overlap`` words of the one before, so that whatever spans up to overlap + 1 words is whole in one of them.
    """
    data, offsets = raw_bytes(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        begin, stop = int(offsets[row]), int(offsets[end])
        if stop - begin <= most:
            words = _words(data[begin:stop], offsets[row : end + 1] - begin)
            yield words, row, 0, np.diff(words.first)
            row = end
            continue
        place, counted, size = begin, 0, most
        while True:
            cut = min(stop, place + size)
            while cut < stop and IS_WORD[LOWER[data[cut - 1]]]:  # a word is never cut, however long
                inside = IS_WORD[LOWER[data[cut : min(stop, cut + 65_536)]]]
                cut += len(inside) if inside.all() else int(inside.argmin())
                if not inside.all():
                    break
            words = _words(data[place:cut], np.array([0, cut - place], np.int64))
            n, repeated = len(words.hash), min(counted, overlap)
            yield words, row, counted - repeated, np.array([n - repeated], np.int64)
            counted += n - repeated
            if cut >= stop:
                break
            again = min(n, overlap)
            place = place + int(words.start[n - again]) if again else cut
            size = max(most, 2 * (cut - place))  # more is read at once where few words fill a segment
        row = end
