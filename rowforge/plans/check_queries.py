"""A query for each value check over a whole table, and the same flags in SQL.

Format checks run over ``orders``: the key chooses one of the texts of ``golden``, of which it is written down whether the format
takes them; the SQL has that answer and no pattern. Other checks run over columns, and the SQL computes what they say by itself.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowforge.functions import CHECKS
from rowforge.functions.checks import SPACE

from .golden import GOLDEN

#: Formats of values that no pattern describes: (taken, refused).
OTHERS: dict[str, tuple[list[str], list[str]]] = {
    "emoji": (["😀", "👩‍👩‍👧", "❤️", "1️"], ["👍🏽", "❤", "a", "", "😀😀", "🇩🇪"]),
    "date_string": (["2024-01-15", "2024-01-15T10:30:00Z", "Mon, 15 Jan 2024 10:30:00 GMT", "Jan 15, 2024", "15 Jan 2024", "1/15/2024"], ["not-a-date", "2024-13-01"]),
}


def _quote(s: str) -> str:
    """A literal that Spark and DuckDB read alike; line ends and backslashes are given by chr."""
    parts = [f"'{p.replace(chr(39), chr(39) * 2)}'" for p in s.replace("\\", "\0\\\0").replace("\n", "\0\n\0").split("\0")]
    return parts[0] if len(parts) == 1 else "concat(" + ", ".join("chr(92)" if p == "'\\'" else "chr(10)" if p == "'\n'" else p for p in parts) + ")"


def _choice(values: list[str], key: str) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _spark(sql: str) -> str:
    return sql.replace("VARCHAR(20)", "STRING").replace("chr(", "char(")


def _luhn(digits: str) -> str:
    """The check sum of digits in DuckDB, from the right, every second one doubled and its digits added."""
    n = f"length({digits})"
    d = f"CAST(substr({digits}, {n} - i, 1) AS INTEGER)"
    return f"list_sum(list_transform(range(0, {n}), lambda i: CASE WHEN i % 2 = 1 THEN (2 * {d}) // 10 + (2 * {d}) % 10 ELSE {d} END)) % 10 = 0"


def _format_query(name: str, taken: list[str], refused: list[str]):
    text = _choice([_quote(v) for v in (*taken, *refused)], "o_orderkey")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.expr(_spark(text)).alias("value"))
        check = CHECKS[name]()
        return orders.select("o_orderkey", "value", check.passes(F.col("value"), orders.schema["value"].dataType).alias("ok"))

    return run, f"SELECT o_orderkey, {text} AS value, o_orderkey % {len(taken) + len(refused)} < {len(taken)} AS ok FROM orders"


def _digit_query(name: str, spark_sql: str, duck_sql: str, test: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.expr(spark_sql).alias("value"))
        return orders.select("o_orderkey", "value", CHECKS[name]().passes(F.col("value"), orders.schema["value"].dataType).alias("ok"))

    return run, f"SELECT o_orderkey, value, {test} AS ok FROM (SELECT o_orderkey, {duck_sql} AS value FROM orders)"


def _column_query(name: str, table: str, keys: list[str], value: str, duck_value: str, parameters: tuple, test: str):
    """A check over a column or expression; test is its SQL over ``value``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*keys, F.expr(value).alias("value"))
        check = CHECKS[name](*parameters)
        dtype = rows.schema["value"].dataType
        return rows.select(*keys, check.passes(F.col("value"), dtype).alias("ok"), check.error(F.col("value"), dtype).alias("error"))

    return run, lambda message: f"SELECT {', '.join(keys)}, coalesce({test}, false) AS ok, CASE WHEN coalesce({test}, false) THEN NULL ELSE {_quote(message)} END AS error FROM (SELECT {', '.join(keys)}, {duck_value} AS value FROM {table})"


_LINE, _ORDER, _DOC = ["l_orderkey", "l_linenumber"], ["o_orderkey"], ["doc_id"]
_SIGNED = "CASE WHEN l_linenumber % 7 = 0 THEN CAST('NaN' AS DOUBLE) WHEN l_linenumber % 5 = 0 THEN 0.0 WHEN l_linenumber % 2 = 0 THEN -l_discount ELSE l_tax END"
_WIDE = "CASE WHEN l_linenumber % 5 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN l_linenumber % 4 = 0 THEN l_extendedprice ELSE l_quantity END"
_PADDED = "CASE doc_id % 5 WHEN 0 THEN concat(' ', text) WHEN 1 THEN concat(text, '\u00a0') WHEN 2 THEN concat(text, chr(10)) WHEN 3 THEN text ELSE concat('\ufeff', text, ' ') END"
_MARKS = "CASE doc_id % 4 WHEN 0 THEN concat(text, 'e\u0301') WHEN 1 THEN concat('\u00e9', text) WHEN 2 THEN concat(text, '\ufb01x') ELSE text END"
#: Letters of the test texts that are one character composed and two decomposed, and characters that stand for others.
_COMPOSED = "[\u00c0-\u00c5\u00c7-\u00cf\u00d1-\u00d6\u00d9-\u00dd\u00e0-\u00e5\u00e7-\u00ef\u00f1-\u00f6\u00f9-\u00fd\u00ff]"
_COMPATIBLE = "[\u00a0\u00a8\u00aa\u00af\u00b2-\u00b5\u00b8-\u00ba\u00bc-\u00be\u2026\u2122\ufb01\ufb02]"
_DATES = "CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL '200' YEAR ELSE o_orderdate END"
_W = f"[{SPACE}]"
_NAN = "isnan(value)"
_DAY = datetime(1995, 6, 1, tzinfo=UTC)
_A_DAY, _ISO_DAY = "TIMESTAMP '1995-06-01 00:00:00'", "1995-06-01T00:00:00.000Z"

#: name, check, table, keys, value, parameters, SQL test, message
_COLUMNS = [
    ("min", "min", "lineitem", _LINE, "l_quantity", (10,), "value >= 10", "must be at least 10"),
    ("min_string", "min", "part", ["p_partkey"], "p_name", (12,), "length(value) >= 12", "must be at least 12 characters"),
    ("max", "max", "lineitem", _LINE, "l_quantity", (30,), "value <= 30", "must be at most 30"),
    ("max_array", "max", "embeddings", ["vec_id"], "embedding", (32,), "len(value) <= 32", "must be at most 32 items"),
    ("range", "range", "lineitem", _LINE, _SIGNED, (0, 0.05), f"{_NAN} OR value BETWEEN 0 AND 0.05", "must be between 0 and 0.05"),
    ("length", "length", "documents", _DOC, "lang", (2,), "length(value) = 2", "must be exactly 2 characters"),
    ("multiple_of", "multiple_of", "lineitem", _LINE, "l_quantity", (5,), "value % 5 = 0", "must be a multiple of 5"),
    ("positive", "positive", "lineitem", _LINE, _SIGNED, (), f"{_NAN} OR value > 0", "must be positive"),
    ("negative", "negative", "lineitem", _LINE, _SIGNED, (), f"{_NAN} OR value < 0", "must be negative"),
    ("non_negative", "non_negative", "lineitem", _LINE, _SIGNED, (), f"{_NAN} OR value >= 0", "must be non-negative"),
    ("non_positive", "non_positive", "lineitem", _LINE, _SIGNED, (), f"{_NAN} OR value <= 0", "must be non-positive"),
    ("integer", "integer", "lineitem", _LINE, _WIDE, (), "isfinite(value) AND value = trunc(value)", "must be an integer"),
    ("safe_integer", "safe_integer", "lineitem", _LINE, "CASE WHEN l_linenumber % 3 = 0 THEN l_quantity * 1e15 ELSE l_quantity END", (), "isfinite(value) AND value = trunc(value) AND abs(value) <= 9007199254740991", "must be a safe integer"),
    ("finite", "finite", "lineitem", _LINE, _WIDE, (), "isfinite(value)", "must be finite"),
    ("unique", "unique", "embeddings", ["vec_id"], "embedding", (), "len(list_distinct(list_transform(value, lambda x: x + 0.0))) = len(value)", "must contain unique items"),
    ("date_valid", "date_valid", "orders", _ORDER, "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderdate END", (), "value IS NOT NULL", "must be a valid date"),
    ("date_min", "date_min", "orders", _ORDER, "o_orderdate", (_DAY,), f"value >= {_A_DAY}", f"must be on or after {_ISO_DAY}"),
    ("date_max", "date_max", "orders", _ORDER, "o_orderdate", (_DAY,), f"value <= {_A_DAY}", f"must be on or before {_ISO_DAY}"),
    ("date_past", "date_past", "orders", _ORDER, _DATES, (), "value < TIMESTAMP '2025-01-01'", "must be a past date"),
    ("date_future", "date_future", "orders", _ORDER, _DATES, (), "value > TIMESTAMP '2100-01-01'", "must be a future date"),
    ("matches", "matches", "documents", _DOC, "text", ("[0-9]{4}",), "regexp_matches(value, '[0-9]{4}')", "must match pattern /[0-9]{4}/"),
    ("includes", "includes", "documents", _DOC, "text", ("the",), "contains(value, 'the')", "must include 'the'"),
    ("excludes", "excludes", "documents", _DOC, "text", ("the",), "NOT contains(value, 'the')", "must not include 'the'"),
    ("starts_with", "starts_with", "documents", _DOC, "text", ("The",), "starts_with(value, 'The')", "must start with 'The'"),
    ("ends_with", "ends_with", "documents", _DOC, "text", (".",), "ends_with(value, '.')", "must end with '.'"),
    ("trim", "trim", "documents", _DOC, _PADDED, (), f"NOT regexp_matches(value, '^{_W}|{_W}$')", "must be trimmed"),
    ("trim_start", "trim_start", "documents", _DOC, _PADDED, (), f"NOT regexp_matches(value, '^{_W}')", "must have no leading whitespace"),
    ("trim_end", "trim_end", "documents", _DOC, _PADDED, (), f"NOT regexp_matches(value, '{_W}$')", "must have no trailing whitespace"),
    ("normalize", "normalize", "documents", _DOC, _MARKS, (), "value = nfc_normalize(value)", "must be NFC normalized"),
    ("normalize_nfd", "normalize_nfd", "documents", _DOC, _MARKS, (), f"NOT regexp_matches(value, '{_COMPOSED}')", "must be NFD normalized"),
    ("normalize_nfkc", "normalize_nfkc", "documents", _DOC, _MARKS, (), f"value = nfc_normalize(value) AND NOT regexp_matches(value, '{_COMPATIBLE}')", "must be NFKC normalized"),
    ("normalize_nfkd", "normalize_nfkd", "documents", _DOC, _MARKS, (), f"NOT regexp_matches(value, '{_COMPOSED}|{_COMPATIBLE}')", "must be NFKD normalized"),
    ("words", "words", "conversations", ["conv_id", "turn"], "text", (12,), f"len(regexp_extract_all(value, '[^{SPACE}]+')) = 12", "must be exactly 12 words"),
    ("words_max", "words_max", "documents", _DOC, "text", (200,), f"len(regexp_extract_all(value, '[^{SPACE}]+')) <= 200", "must be at most 200 words"),
    ("words_min", "words_min", "documents", _DOC, "text", (50,), f"len(regexp_extract_all(value, '[^{SPACE}]+')) >= 50", "must be at least 50 words"),
    ("graphemes", "graphemes", "documents", _DOC, "text", (100,), "length_grapheme(value) = 100", "must be exactly 100 graphemes"),
    ("graphemes_max", "graphemes_max", "documents", _DOC, "text", (1000,), "length_grapheme(value) <= 1000", "must be at most 1000 graphemes"),
    ("graphemes_min", "graphemes_min", "documents", _DOC, "text", (1000,), "length_grapheme(value) >= 1000", "must be at least 1000 graphemes"),
    ("bytes", "bytes", "part", ["p_partkey"], "p_brand", (8,), "strlen(value) = 8", "must be exactly 8 bytes"),
    ("bytes_max", "bytes_max", "documents", _DOC, "text", (2000,), "strlen(value) <= 2000", "must be at most 2000 bytes"),
    ("bytes_min", "bytes_min", "documents", _DOC, "text", (2000,), "strlen(value) >= 2000", "must be at least 2000 bytes"),
]


def build() -> tuple[dict, dict[str, str]]:
    queries, oracles = {}, {}
    for name, check, table, keys, value, parameters, test, message in _COLUMNS:
        queries[f"check_{name}"], sql = _column_query(check, table, keys, value.replace("chr(", "char("), value, parameters, test)
        oracles[f"check_{name}"] = sql(message)
    for name, (taken, refused) in (GOLDEN | OTHERS).items():
        queries[f"check_{name}"], oracles[f"check_{name}"] = _format_query(name, taken, refused)
    for name, spark_sql, test in (
        ("cc", "concat('4', lpad(CAST(o_orderkey AS VARCHAR(20)), 14, '7'), CAST(o_orderkey % 10 AS VARCHAR(20)))", _luhn("value")),
        ("imei", "concat('35', lpad(CAST(o_orderkey AS VARCHAR(20)), 12, '0'), CAST(o_orderkey % 10 AS VARCHAR(20)))", _luhn("value")),
        (
            "isbn",
            "CASE WHEN o_orderkey % 2 = 0 THEN concat('978-', lpad(CAST(o_orderkey AS VARCHAR(20)), 9, '0'), CAST(o_orderkey % 10 AS VARCHAR(20))) "
            "ELSE concat(lpad(CAST(o_orderkey AS VARCHAR(20)), 9, '0'), ' ', CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE CAST(o_orderkey % 10 AS VARCHAR(20)) END) END",
            "CASE WHEN o_orderkey % 2 = 0 THEN list_sum(list_transform(range(0, 13), lambda i: (1 + 2 * (i % 2)) * CAST(substr(replace(value, '-', ''), i + 1, 1) AS INTEGER))) % 10 = 0 "
            "ELSE (list_sum(list_transform(range(0, 9), lambda i: (10 - i) * CAST(substr(value, i + 1, 1) AS INTEGER))) + CASE WHEN ends_with(value, 'X') THEN 10 ELSE CAST(right(value, 1) AS INTEGER) END) % 11 = 0 END",
        ),
    ):
        queries[f"check_{name}"], oracles[f"check_{name}"] = _digit_query(name, _spark(spark_sql), spark_sql.replace("VARCHAR(20)", "VARCHAR"), test)
    return queries, oracles

