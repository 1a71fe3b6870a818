"""Checks as SQL functions: ``SELECT is_email(v)``. They are SQL UDFs, which Catalyst inlines, so filters stay native."""

from __future__ import annotations

from pyspark.sql import SparkSession

from rowforge.functions.checks import SPACE
from rowforge.functions.formats import PATTERNS, anchored


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: name: parameters beside the value, body over ``v``.
_OTHERS = {
    "cc": ("", f"CASE WHEN regexp_replace(v, {_literal(f'[{SPACE}-]')}, '') RLIKE {_literal(r'^[0-9]{12,19}\z')} THEN luhn_check(regexp_replace(v, {_literal(f'[{SPACE}-]')}, '')) ELSE false END"),
    "imei": ("", f"CASE WHEN v RLIKE {_literal(r'^[0-9]{15}\z')} THEN luhn_check(v) ELSE false END"),
    "trimmed": ("", f"NOT v RLIKE {_literal(rf'^[{SPACE}]|[{SPACE}]\z')}"),
    "words": (", low INT, high INT", f"regexp_count(v, {_literal(f'[^{SPACE}]+')}) BETWEEN low AND high"),
    "bytes": (", low INT, high INT", "octet_length(v) BETWEEN low AND high"),
    "length": (", low INT, high INT", "octet_length(encode(v, 'UTF-16BE')) / 2 BETWEEN low AND high"),
}


def register_checks(spark: SparkSession) -> list[str]:
    """Defines ``is_<check>`` for this session and returns the names."""
    bodies = {n: ("", f"v RLIKE {_literal(anchored(p))}") for n, (p, _) in PATTERNS.items()} | _OTHERS
    for name, (parameters, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION is_{name}(v STRING{parameters}) RETURNS BOOLEAN RETURN coalesce({body}, false)")
    return [f"is_{n}" for n in bodies]
