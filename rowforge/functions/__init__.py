"""All value checks by name: ``CHECKS[name](*parameters, error=None)`` gives a Check."""

from __future__ import annotations

import functools

from . import dates, formats, numbers, text
from .checks import Check

CHECKS = {
    "min": numbers.minimum, "max": numbers.maximum, "range": numbers.between, "length": numbers.length, "multiple_of": numbers.multiple_of,
    "positive": numbers.positive, "negative": numbers.negative, "non_negative": numbers.non_negative, "non_positive": numbers.non_positive,
    "integer": numbers.integer, "safe_integer": numbers.safe_integer, "finite": numbers.finite, "unique": numbers.unique,
    "date_valid": dates.valid, "date_min": dates.not_before, "date_max": dates.not_after, "date_past": dates.past, "date_future": dates.future,
    "date_string": dates.date_string,
    "matches": text.matches, "includes": text.includes, "excludes": text.excludes, "starts_with": text.starts_with, "ends_with": text.ends_with,
    "trim": text.trimmed, "trim_start": text.trimmed_start, "trim_end": text.trimmed_end,
    **{f"normalize{s}": functools.partial(text.normalized, f) for s, f in (("", "NFC"), ("_nfd", "NFD"), ("_nfkc", "NFKC"), ("_nfkd", "NFKD"))},
    "words": text.words, "words_max": text.words_max, "words_min": text.words_min,
    "graphemes": text.graphemes, "graphemes_max": text.graphemes_max, "graphemes_min": text.graphemes_min,
    "bytes": text.bytes_, "bytes_max": text.bytes_max, "bytes_min": text.bytes_min,
    **{name: functools.partial(formats.pattern_check, name) for name in formats.PATTERNS},
    "cc": formats.cc, "emoji": formats.emoji, "hostname": formats.hostname, "imei": formats.imei, "ip": formats.ip, "ip_v4": formats.ip_v4,
    "ip_v4_cidr": formats.ip_v4_cidr, "ip_v6_cidr": formats.ip_v6_cidr, "isbn": formats.isbn, "iso_duration": formats.iso_duration,
    "json_string": formats.json_string,
}

__all__ = ["CHECKS", "Check"]
