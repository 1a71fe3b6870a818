"""Each check on values that pass and values that fail, and what it says."""

import re
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowforge.functions import CHECKS
from rowforge.functions.checks import number_text
from rowforge.functions.formats import PATTERNS
from rowforge.plans.golden import GOLDEN

NAN, INF = float("nan"), float("inf")
STRINGS = [
    ("alpha", (), ["abc", "Z"], ["", "a1", "a\n", "é"]),
    ("alphanumeric", (), ["a1"], ["", "a-1"]),
    ("base64", (), ["YQ==", "="], ["", "a b"]),
    ("bic", (), ["DEUTDEFF", "DEUTDEFF500"], ["deutdeff"]),
    ("cc", (), ["4111 1111 1111 1111", "4111-1111-1111-1111"], ["4111111111111112", "411111", ""]),
    ("domain", (), ["a.example.com"], ["a", "-a.com", "a.c"]),
    ("email", (), ["a@b.c"], ["a@b", "a b@c.d", "a\u00a0b@c.d"]),
    ("email_html5", (), ["a@b"], ["a@-b", "a@" + "x" * 64]),
    ("email_rfc5322", (), ['"a..b"@x.yz', "a@[1.2.3.4]"], ["a..b@x.yz"]),
    ("emoji", (), ["😀", "👩‍👩‍👧", "❤️"], ["", "a", "❤", "👍🏽"]),
    ("epoch", (), ["0"], ["-1", "1.0"]),
    ("hash_md5", (), ["a" * 32], ["g" * 32, "a" * 31]),
    ("hex_color", (), ["#fff", "#FFFFFF80"], ["#ff", "fff"]),
    ("hostname", (), ["a", "a-b.c"], ["", "-a", "a" * 254]),
    ("imei", (), ["490154203237518"], ["490154203237519", "49015420323751"]),
    ("ip", (), ["1.2.3.4", "::1"], ["1.2.3", "x"]),
    ("ip_v4", (), ["255.0.0.1", "001.2.3.4"], ["256.0.0.1", "1.2.3.4\n"]),
    ("ip_v4_cidr", (), ["10.0.0.0/8"], ["10.0.0.0/33", "10.0.0.0"]),
    ("ip_v6", (), ["::", "1:2:3:4:5:6:7:8", "fe80::1%eth0", "::ffff:1.2.3.4", "2001:DB8::1"], ["1::2::3", ":::", "12345::"]),
    ("ip_v6_cidr", (), ["::/0", "::1/128"], ["::1/129", "::1", "::/1/2"]),
    ("isbn", (), ["0-306-40615-2", "978-0-306-40615-7", "080442957X"], ["0306406153", "080442957x"]),
    ("iso_date", (), ["2024-02-31"], ["2024-13-01"]),
    ("iso_duration", (), ["P1Y2M3DT4H5M6S", "PT1.5S", "P1YT"], ["P", "PT", "1Y"]),
    ("iso_timestamp", (), ["2024-01-02T03:04:05Z"], ["2024-01-02T03:04:05"]),
    ("iso_week", (), ["2024-W53"], ["2024-W54"]),
    ("json_string", (), ['{"a":1,"a":2}', "1", '"x"', " [] "], ["{invalid}", "NaN", "01", "[1,]", "", "1 2"]),
    ("mac", (), ["00:1A:2b:3C:4d:5E", "00:1A:2b:3C:4d:5E:6F:70"], ["00:1A"]),
    ("semver", (), ["1.2.3-rc.1+b", "01.2.3"], ["1.2", "1.2.3-a-b"]),
    ("url", (), ["x://y"], ["x:/y", "x://"]),
    ("url_http", (), ["http://x"], ["HTTP://x"]),
    ("uuid", (), ["00000000-0000-0000-0000-000000000000"], ["0"]),
    ("uuid_v4", (), ["00000000-0000-4000-a000-000000000000"], ["00000000-0000-4000-7000-000000000000", "00000000-0000-1000-a000-000000000000"]),
    ("date_string", (), ["2024-01-15", "2024-01-15T10:30:00Z", "Mon, 15 Jan 2024 10:30:00 GMT"], ["not-a-date", ""]),
    ("matches", ("b+",), ["abbc"], ["ac"]),
    ("includes", ("x",), ["axb"], ["ab"]),
    ("excludes", ("x",), ["ab"], ["axb"]),
    ("starts_with", ("x",), ["xa"], ["ax"]),
    ("ends_with", ("x",), ["ax"], ["xa"]),
    ("trim", (), ["a b", ""], [" a", "a\u00a0", "a\n", "\ufeffa"]),
    ("trim_start", (), ["a "], ["\u2003a"]),
    ("trim_end", (), [" a"], ["a\n", "a\u3000"]),
    ("normalize", (), ["é", "abc"], ["e\u0301"]),
    ("normalize_nfd", (), ["e\u0301"], ["é"]),
    ("normalize_nfkc", (), ["fi"], ["\ufb01"]),
    ("words", (2,), ["a b", " a\u00a0b "], ["a", ""]),
    ("words_max", (1,), ["", "a"], ["a b"]),
    ("graphemes", (1,), ["👩‍👩‍👧", "e\u0301"], ["ab", ""]),
    ("bytes", (2,), ["é", "ab"], ["a"]),
    ("length", (2,), ["ab", "😀"], ["a", "😀😀"]),
    ("min", (2,), ["ab", "😀"], ["a"]),
]
NUMBERS = [
    ("min", (2,), [2.0, NAN, INF], [1.0]),
    ("max", (2,), [2.0, NAN, -INF], [3.0]),
    ("range", (1, 2), [1.0, 2.0, NAN], [0.9, 2.1]),
    ("multiple_of", (0.5,), [1.5, 0.0], [1.2, NAN]),
    ("multiple_of", (0,), [], [1.0, 0.0]),
    ("positive", (), [1.0, NAN, INF], [0.0, -0.0, -1.0]),
    ("negative", (), [-1.0, NAN], [0.0, 1.0]),
    ("non_negative", (), [0.0, -0.0, NAN], [-1.0]),
    ("non_positive", (), [0.0, NAN], [1.0]),
    ("integer", (), [1.0, -0.0, 1e300], [1.5, NAN, INF]),
    ("safe_integer", (), [2.0**53 - 1], [2.0**53, 0.5, NAN]),
    ("finite", (), [1e308], [NAN, INF, -INF]),
]


def test_golden_texts(spark):
    """Every format on at least ten texts that it takes and ten that it refuses."""
    texts = sorted({v for a, b in GOLDEN.values() for v in (*a, *b)})
    df = spark.createDataFrame([(v,) for v in texts], "v string")
    got = {r.v: r for r in df.select("v", *(CHECKS[n]().passes(F.col("v"), T.StringType()).alias(n) for n in GOLDEN)).collect()}
    wrong = [(n, v) for n, (a, b) in GOLDEN.items() for v in (*a, *b) if got[v][n] != (v in a)]
    assert wrong == [] and all(len(set(x)) >= 10 for pair in GOLDEN.values() for x in pair)
    assert set(PATTERNS) <= set(GOLDEN)


def test_numbers_in_messages():
    shown = {10.0: "10", 10: "10", 1e21: "1e+21", 1e20: "100000000000000000000", 1e-7: "1e-7", 0.000001: "0.000001", 1.5e-9: "1.5e-9", -2.5: "-2.5", 0.1: "0.1", 123456.789: "123456.789", INF: "Infinity"}
    assert {n: number_text(n) for n in shown} == shown
    assert CHECKS["min"](10.0).message == "must be at least 10" and CHECKS["range"](0.5, 1e21).message == "must be between 0.5 and 1e+21"
    assert CHECKS["max"](1e-7).message == "must be at most 1e-7" and CHECKS["multiple_of"](5.0).message == "must be a multiple of 5"


@pytest.mark.parametrize("unit", ["words", "graphemes", "bytes"])
def test_lengths_against_a_count(spark, unit):
    texts = ["", " ", "a", " a", "a b", "a  b ", "\u00a0a\ufeffb\u3000", "é ü", "👩‍👩‍👧 e\u0301", "a\nb\tc d e", "x" * 50, "a " * 40]
    count = {"words": lambda s: len(re.findall(r"[^\s\ufeff]+", s)), "graphemes": lambda s: len(s) - 4 * s.count("👩‍👩‍👧") - s.count("\u0301"), "bytes": lambda s: len(s.encode())}[unit]
    for n in (0, 1, 2, 3, 5, 40, 50):
        for suffix, expected in (("", lambda c, n=n: c == n), ("_max", lambda c, n=n: c <= n), ("_min", lambda c, n=n: c >= n)):
            assert flags(spark, CHECKS[unit + suffix](n), texts, T.StringType()) == [expected(count(s)) for s in texts], (n, suffix)


def flags(spark, check, values, dtype):
    df = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("v", dtype)]))
    return [r[0] for r in df.select(check.passes(F.col("v"), dtype)).collect()]


@pytest.mark.parametrize(("name", "parameters", "good", "bad"), STRINGS, ids=lambda x: x if isinstance(x, str) else "")
def test_strings(spark, name, parameters, good, bad):
    assert flags(spark, CHECKS[name](*parameters), [*good, *bad, None], T.StringType()) == [True] * len(good) + [False] * (len(bad) + 1)


@pytest.mark.parametrize(("name", "parameters", "good", "bad"), NUMBERS)
def test_numbers(spark, name, parameters, good, bad):
    assert flags(spark, CHECKS[name](*parameters), [*good, *bad, None], T.DoubleType()) == [True] * len(good) + [False] * (len(bad) + 1)


def test_arrays(spark):
    kind = T.ArrayType(T.DoubleType())
    assert flags(spark, CHECKS["unique"](), [[1.0, 2.0], [], [0.0, -0.0], [NAN, NAN]], kind) == [True, True, False, False]
    assert flags(spark, CHECKS["min"](1), [[1.0], []], kind) == [True, False]


def test_dates(spark):
    old, new = datetime(2000, 1, 1, tzinfo=UTC), datetime(2100, 1, 1, tzinfo=UTC)
    at = datetime(2000, 1, 1, tzinfo=UTC)
    for name, parameters, expected in (("date_past", (), [True, False]), ("date_future", (), [False, True]), ("date_min", (at,), [True, True]), ("date_max", (at,), [True, False]), ("date_valid", (), [True, True])):
        assert flags(spark, CHECKS[name](*parameters), [old, new, None], T.TimestampType()) == [*expected, False]
    assert CHECKS["date_min"](at).message == "must be on or after 2000-01-01T00:00:00.000Z"


def test_wrong_types_and_messages(spark):
    assert flags(spark, CHECKS["alpha"](), [1.0], T.DoubleType()) == [False]
    with pytest.raises(TypeError):
        CHECKS["min"](1).passes(F.col("v"), T.BooleanType())
    assert CHECKS["min"](3).text(T.StringType()) == "must be at least 3 characters"
    assert CHECKS["min"](3).text(T.ArrayType(T.LongType())) == "must be at least 3 items"
    assert CHECKS["unique"]().text(T.StringType()) == "must be an array"
    assert all(CHECKS[n](error="no").text(T.StringType()) == "no" for n in PATTERNS)
    assert len(CHECKS) == 101
    df = spark.createDataFrame([("a",), ("1",)], "v string")
    assert [r[0] for r in df.select(CHECKS["alpha"]().error(F.col("v"), T.StringType())).collect()] == [None, "must contain only letters"]
