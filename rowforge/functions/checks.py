"""Value checks: a predicate over a column and the message of a value that fails it.

``Check.passes`` gives a boolean column that is never null, for ``where`` and ``select``; ``Check.error`` the message or null.
A null value, and a column of a type that a check isn't made for, fail it. Everything is decided when the plan is built, so
only built-in expressions reach the executors, unless a check says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER, STRING, ARRAY, DATE, BOOLEAN, OTHER = "number", "string", "array", "date", "boolean", "other"

#: White space of the string functions: the class of Java and RE2 with the Unicode spaces written out.
SPACE = r"\s\x{A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0B}"


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return NUMBER
    if isinstance(dtype, T.StringType | T.VarcharType | T.CharType):
        return STRING
    if isinstance(dtype, T.ArrayType):
        return ARRAY
    if isinstance(dtype, T.TimestampType | T.TimestampNTZType | T.DateType):
        return DATE
    return BOOLEAN if isinstance(dtype, T.BooleanType) else OTHER


@dataclass(frozen=True)
class Check:
    """``tests`` has a predicate for each kind of value; ``messages`` a message for each kind where they differ."""

    name: str
    message: str
    tests: dict[str, Callable[[Column, T.DataType], Column]]
    messages: dict[str, str] | None = None
    wrong_type: str | None = None
    strict: bool = False

    def passes(self, value: Column, dtype: T.DataType) -> Column:
        kind = kind_of(dtype)
        if kind not in self.tests:
            if self.strict:
                raise TypeError(f"{self.name} can only be applied to {', '.join(self.tests)} columns, not {dtype.simpleString()}")
            return F.lit(False)
        return F.coalesce(self.tests[kind](value, dtype), F.lit(False))

    def text(self, dtype: T.DataType) -> str:
        kind = kind_of(dtype)
        if kind not in self.tests and self.wrong_type is not None:
            return self.wrong_type
        return (self.messages or {}).get(kind, self.message)

    def error(self, value: Column, dtype: T.DataType) -> Column:
        return F.when(~self.passes(value, dtype), F.lit(self.text(dtype)))

    def saying(self, error: str | None) -> Check:
        """The check with a message of the caller's."""
        return self if error is None else replace(self, message=error, messages=None, wrong_type=error if self.wrong_type else None)


def on_strings(name: str, message: str, test: Callable[[Column], Column], error: str | None) -> Check:
    return Check(name, message, {STRING: lambda v, _: test(v)}).saying(error)


def utf16_length(value: Column) -> Column:
    """The length in UTF-16 units, in which characters beyond the basic plane count twice."""
    return (F.octet_length(F.encode(value, "UTF-16BE")) / 2).cast("int")


def number_text(n: float) -> str:
    """A number as a dynamically typed language prints it: whole ones without a point, others in the shortest form."""
    if isinstance(n, bool) or not isinstance(n, int | float):
        return str(n)
    if n != n:
        return "NaN"
    if n in (float("inf"), float("-inf")):
        return "Infinity" if n > 0 else "-Infinity"
    sign, digits, exponent = Decimal(repr(float(n))).normalize().as_tuple()
    shown, point = "".join(map(str, digits)), len(digits) + exponent  # the point stands behind so many digits
    if shown == "0":
        return "0"
    if len(shown) <= point <= 21:
        out = shown + "0" * (point - len(shown))
    elif 0 < point <= 21:
        out = shown[:point] + "." + shown[point:]
    elif -6 < point <= 0:
        out = "0." + "0" * -point + shown
    else:
        out = shown[0] + ("." + shown[1:] if len(shown) > 1 else "") + f"e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return "-" * sign + out
