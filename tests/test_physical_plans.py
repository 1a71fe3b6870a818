"""What Spark makes of the queries: native expressions, pruned scans, and no exchange for what looks at one row."""

import os
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowforge.functions import CHECKS
from rowforge.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
PYTHON = re.compile(r"Python|ArrowEval|MapIn")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in registry.queries() if n.startswith(("check_", "record_"))))
def test_checks_and_records_are_native(spark, name):
    text = plan(registry.queries()[name](spark, SF))
    if not re.search("normalize|json_string", name):
        assert not PYTHON.search(text)
    if name not in ("record_error_counts", "record_lookup"):
        assert "Exchange" not in text


def test_scans_are_pruned(spark):
    text = plan(registry.queries()["check_range"](spark, SF))
    columns = re.search(r"ReadSchema: struct<([^>]*)>", text)[1]
    assert "l_shipdate" not in columns and "l_comment" not in columns and columns.count(":") <= 5
    text = plan(registry.queries()["record_projection"](spark, SF))
    assert re.search(r"ReadSchema: struct<event_id:bigint,props:string>", text)


def test_simple_checks_reach_the_scan(spark):
    line = spark.read.parquet(f"{SF}/lineitem.parquet")
    quantity = F.col("l_returnflag")
    text = plan(line.where(CHECKS["starts_with"]("A").passes(quantity, T.StringType())).select("l_orderkey"))
    assert "l_returnflag" in re.search(r"PushedFilters: \[([^\]]*)\]", text)[1] or "StartsWith" in text


def test_native_reads_of_frames(spark):
    assert PYTHON.search(plan(registry.queries()["serde_unsigned"](spark, SF)))
    from rowforge.plans.serde_queries import _unsigned

    df, form = _unsigned(spark, SF)
    frames = spark.createDataFrame([], "frame binary")
    for name in df.columns:
        assert not PYTHON.search(plan(frames.select(form.extract(F.col("frame"), name))))
    assert not PYTHON.search(plan(df.select(form.size())))
