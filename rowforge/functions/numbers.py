"""Checks of numbers, lengths and collections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .checks import ARRAY, NUMBER, STRING, Check, number_text, on_strings, utf16_length

SAFE = 9007199254740991


def _float(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.FractionalType) and not isinstance(dtype, T.DecimalType)


def _nan_passes(test):
    """Comparisons with NaN are false, so checks that reject by comparison let it pass."""
    return lambda v, t: (F.isnan(v) | test(v)) if _float(t) else test(v)


def _sized(name: str, message: str, test) -> Check:
    """test(measure): of a number itself, of a string in UTF-16 units, of an array its size."""
    tests = {NUMBER: _nan_passes(test), STRING: lambda v, _: test(utf16_length(v)), ARRAY: lambda v, _: test(F.size(v))}
    return Check(name, message, tests, {STRING: f"{message} characters", ARRAY: f"{message} items"}, strict=True)


def minimum(n: float, error: str | None = None) -> Check:
    return _sized("min", f"must be at least {number_text(n)}", lambda m: m >= F.lit(n)).saying(error)


def maximum(n: float, error: str | None = None) -> Check:
    return _sized("max", f"must be at most {number_text(n)}", lambda m: m <= F.lit(n)).saying(error)


def between(low: float, high: float, error: str | None = None) -> Check:
    return _sized("range", f"must be between {number_text(low)} and {number_text(high)}", lambda m: (m >= F.lit(low)) & (m <= F.lit(high))).saying(error)


def length(n: int, error: str | None = None) -> Check:
    return on_strings("length", f"must be exactly {number_text(n)} characters", lambda v: utf16_length(v) == n, error)


def _numbers(name: str, message: str, test, error: str | None) -> Check:
    return Check(name, message, {NUMBER: test}).saying(error)


def multiple_of(n: float, error: str | None = None) -> Check:
    return _numbers("multiple_of", f"must be a multiple of {number_text(n)}", lambda v, _: F.try_mod(v, F.lit(n)) == 0, error)


def positive(error: str | None = None) -> Check:
    return _numbers("positive", "must be positive", _nan_passes(lambda v: v > 0), error)


def negative(error: str | None = None) -> Check:
    return _numbers("negative", "must be negative", _nan_passes(lambda v: v < 0), error)


def non_negative(error: str | None = None) -> Check:
    return _numbers("non_negative", "must be non-negative", _nan_passes(lambda v: v >= 0), error)


def non_positive(error: str | None = None) -> Check:
    return _numbers("non_positive", "must be non-positive", _nan_passes(lambda v: v <= 0), error)


def is_finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def is_integral(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.IntegralType):
        return value.isNotNull()
    if isinstance(dtype, T.DecimalType):
        return value == F.round(value)
    return is_finite(value) & (F.rint(value) == value)


def integer(error: str | None = None) -> Check:
    return _numbers("integer", "must be an integer", is_integral, error)


def safe_integer(error: str | None = None) -> Check:
    return _numbers("safe_integer", "must be a safe integer", lambda v, t: is_integral(v, t) & v.between(-SAFE, SAFE), error)


def finite(error: str | None = None) -> Check:
    return _numbers("finite", "must be finite", lambda v, t: is_finite(v) if _float(t) else v.isNotNull(), error)


def unique(error: str | None = None) -> Check:
    """No item twice. -0.0 equals 0.0; structs and arrays are compared by value, for rows have no identity."""

    def test(v: Column, t: T.DataType) -> Column:
        items = F.transform(v, lambda x: F.when(x == 0, F.lit(0.0).cast(t.elementType)).otherwise(x)) if _float(t.elementType) else v
        return F.size(F.array_distinct(items)) == F.size(items)

    return Check("unique", "must contain unique items", {ARRAY: test}, wrong_type="must be an array").saying(error)
