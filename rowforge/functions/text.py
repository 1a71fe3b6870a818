"""Checks of what a string contains, its length in several units, and its normal form."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .checks import SPACE, Check, on_strings


def matches(pattern: str, error: str | None = None) -> Check:
    """A match anywhere, as a regular expression search."""
    return on_strings("matches", f"must match pattern /{pattern}/", lambda v: v.rlike(pattern), error)


def includes(s: str, error: str | None = None) -> Check:
    return on_strings("includes", f"must include '{s}'", lambda v: v.contains(s), error)


def excludes(s: str, error: str | None = None) -> Check:
    return on_strings("excludes", f"must not include '{s}'", lambda v: ~v.contains(s), error)


def starts_with(s: str, error: str | None = None) -> Check:
    return on_strings("starts_with", f"must start with '{s}'", lambda v: v.startswith(s), error)


def ends_with(s: str, error: str | None = None) -> Check:
    return on_strings("ends_with", f"must end with '{s}'", lambda v: v.endswith(s), error)


def trimmed(error: str | None = None) -> Check:
    return on_strings("trim", "must be trimmed", lambda v: ~v.rlike(rf"^[{SPACE}]|[{SPACE}]\z"), error)


def trimmed_start(error: str | None = None) -> Check:
    return on_strings("trim_start", "must have no leading whitespace", lambda v: ~v.rlike(f"^[{SPACE}]"), error)


def trimmed_end(error: str | None = None) -> Check:
    return on_strings("trim_end", "must have no trailing whitespace", lambda v: ~v.rlike(rf"[{SPACE}]\z"), error)


def _normalized(form: str):
    @F.pandas_udf("boolean")
    def check(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: None if x is None else unicodedata.is_normalized(form, x)).astype("boolean")

    # pure ASCII is normalized in every form: most text never leaves the JVM's answer
    return lambda v: F.when(v.rlike(r"^[\x00-\x7F]*\z"), F.lit(True)).otherwise(check(v))


def normalized(form: str = "NFC", error: str | None = None) -> Check:
    """In a Unicode normal form. Spark has no function for it, so this check alone runs Python, in Arrow batches."""
    return on_strings(f"normalize_{form.lower()}", f"must be {form} normalized", _normalized(form), error)


#: Runs of word characters and of white space; ASCII first, which is most text and has the cheaper test. A run is never given back.
_WORD, _GAP = rf"(?:[!-~]++|[^{SPACE}])++", rf"(?: ++|[{SPACE}])++"


def word_count(value: Column) -> Column:
    return F.regexp_count(value, F.lit(_WORD))


def grapheme_count(value: Column) -> Column:
    return F.regexp_count(value, F.lit(r"\X"))


def _least_words(value: Column, n: int) -> Column:
    """Whether there are n words; what follows them isn't read."""
    return value.rlike(rf"^(?:{_GAP})?+(?:{_WORD}{_GAP}){{{n - 1}}}+{_WORD}") if n > 0 else value.isNotNull()


def _least_graphemes(value: Column, n: int) -> Column:
    return value.rlike(rf"^\X{{{n}}}+") if n > 0 else value.isNotNull()


def _least_bytes(value: Column, n: int) -> Column:
    return F.octet_length(value) >= n


def _measured(name: str, unit: str, at_least):
    """Checks from one test, whether a value has at least so many units."""

    def exactly(n: int, error: str | None = None) -> Check:
        return on_strings(name, f"must be exactly {n} {unit}", lambda v: at_least(v, n) & ~at_least(v, n + 1) if n >= 0 else F.lit(False), error)

    def most(n: int, error: str | None = None) -> Check:
        return on_strings(f"{name}_max", f"must be at most {n} {unit}", lambda v: ~at_least(v, n + 1) if n >= 0 else F.lit(False), error)

    def least(n: int, error: str | None = None) -> Check:
        return on_strings(f"{name}_min", f"must be at least {n} {unit}", lambda v: at_least(v, n), error)

    return exactly, most, least


words, words_max, words_min = _measured("words", "words", _least_words)
graphemes, graphemes_max, graphemes_min = _measured("graphemes", "graphemes", _least_graphemes)
bytes_, bytes_max, bytes_min = _measured("bytes", "bytes", _least_bytes)
