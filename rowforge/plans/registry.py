"""Queries over the test tables, one for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import check_queries, record_queries, serde_queries

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


for _queries, _oracles in (check_queries.build(), record_queries.build(), serde_queries.build()):
    _QUERIES |= _queries
    _ORACLES |= _oracles


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_queries.validate_customer(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
