"""Coercion of values to numbers and booleans as dynamically typed records need it, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowforge.functions.checks import SPACE

_DECIMAL = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\z"
_TRUE, _FALSE = ("true", "1"), ("false", "0")


def _radix(text: Column, mark: str, digits: str, base: int) -> Column:
    body = F.substring(text, 3, 1 << 20)
    return F.when(text.rlike(rf"^0[{mark}{mark.upper()}][{digits}]+\z"), F.conv(body, base, 10).cast("double"))


def text_to_number(value: Column) -> Column:
    """White space around is dropped; empty is 0; decimal, 0x, 0o and 0b forms are read; anything else is null.

    Radix forms keep 64 bits.
    """
    trimmed = F.regexp_replace(value, rf"^[{SPACE}]+|[{SPACE}]+\z", "")
    general = F.get(F.transform(F.array(trimmed), _number_of), F.lit(0))  # trimmed once, not in each branch
    return F.when(value.rlike(r"^[0-9]{1,15}\z"), value.try_cast("double")).otherwise(general)


def _number_of(text: Column) -> Column:
    return (
        F.when(text == "", F.lit(0.0))
        .when(text.rlike(_DECIMAL), text.try_cast("double"))
        .when(text.startswith("0"), F.coalesce(_radix(text, "x", "0-9a-fA-F", 16), _radix(text, "o", "0-7", 8), _radix(text, "b", "01", 2)))
    )


def to_number(value: Column, dtype: T.DataType) -> Column:
    """The number that a value stands for; null where there is none or the value is null."""
    if isinstance(dtype, T.NumericType):
        return value
    if isinstance(dtype, T.StringType):
        return text_to_number(value)
    if isinstance(dtype, T.BooleanType):
        return value.cast("double")
    if isinstance(dtype, T.TimestampType):
        return F.unix_millis(value).cast("double")
    return F.lit(None).cast("double")


def text_to_boolean(value: Column) -> Column:
    text = F.lower(value)
    return F.when(text.isin(*_TRUE), F.lit(True)).when(text.isin(*_FALSE), F.lit(False))


def to_boolean(value: Column, dtype: T.DataType) -> Column:
    """true, 'true', 1 and '1', and their opposites, in any case; null for anything else. White space isn't dropped."""
    if isinstance(dtype, T.BooleanType):
        return value
    if isinstance(dtype, T.NumericType):
        return F.when(value == 1, F.lit(True)).when(value == 0, F.lit(False))
    if isinstance(dtype, T.StringType):
        return text_to_boolean(value)
    return F.lit(None).cast("boolean")
