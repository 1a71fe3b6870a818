"""Checks of points in time."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .checks import DATE, Check, on_strings


def _dates(name: str, message: str, test, error: str | None) -> Check:
    return Check(name, message, {DATE: lambda v, _: test(v)}).saying(error)


def _iso(at: datetime) -> str:
    at = at.astimezone(UTC) if at.tzinfo else at
    return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"


def valid(error: str | None = None) -> Check:
    return _dates("date_valid", "must be a valid date", lambda v: v.isNotNull(), error)


def not_before(at: datetime, error: str | None = None) -> Check:
    return _dates("date_min", f"must be on or after {_iso(at)}", lambda v: v >= F.lit(at), error)


def not_after(at: datetime, error: str | None = None) -> Check:
    return _dates("date_max", f"must be on or before {_iso(at)}", lambda v: v <= F.lit(at), error)


def past(error: str | None = None) -> Check:
    """Before now, which is one moment for a whole query."""
    return _dates("date_past", "must be a past date", lambda v: v < F.current_timestamp(), error)


def future(error: str | None = None) -> Check:
    return _dates("date_future", "must be a future date", lambda v: v > F.current_timestamp(), error)


#: Formats of date strings beyond ISO 8601.
FORMATS = (
    "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss", "d MMM yyyy", "MMM d, yyyy HH:mm:ss", "MMM d, yyyy", "MMMM d, yyyy", "M/d/yyyy HH:mm:ss", "M/d/yyyy", "yyyy/M/d",
)
_ISO = r"^[+-]?\d{4,6}(-\d\d(-\d\d)?)?(T\d\d:\d\d(:\d\d([.]\d+)?)?(Z|[+-]\d\d:?\d\d)?)?\z"


def parses(value: Column) -> Column:
    """Whether a string is a date: ISO 8601 or one of FORMATS, with or without a weekday; other host-dependent spellings are not taken."""
    plain = F.regexp_replace(value, "(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*,? ", "")
    iso = value.rlike(_ISO) & F.try_to_timestamp(value).isNotNull()
    return F.coalesce(iso, F.lit(False)) | F.coalesce(*(F.try_to_timestamp(plain, F.lit(f)) for f in FORMATS)).isNotNull()


def date_string(error: str | None = None) -> Check:
    return on_strings("date_string", "must be a valid date string", parses, error)
