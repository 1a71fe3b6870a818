from pyspark.sql import functions as F

from rowforge.functions import CHECKS
from rowforge.functions.formats import PATTERNS
from rowforge.plans.golden import GOLDEN
from rowforge.plans.sql import register_checks


def test_sql_functions_are_the_checks(spark):
    names = register_checks(spark)
    assert len(names) == len(PATTERNS) + 6
    for name in [*PATTERNS, "cc", "imei"]:
        values = [*(v for part in GOLDEN.get(name, (["4111 1111 1111 1111", "490154203237518"], ["x", "1" * 15])) for v in part), None]
        df = spark.createDataFrame([(v,) for v in values], "v string")
        rows = df.select(F.expr(f"is_{name}(v)"), CHECKS[name]().passes(F.col("v"), df.schema["v"].dataType)).collect()
        assert all(a == b for a, b in rows), name
    row = spark.sql("select is_words('a b', 1, 2), is_length('😀', 2, 2), is_bytes('é', 1, 1), is_trimmed(' a')").first()
    assert tuple(row) == (True, True, False, False)
    plan = spark.sql("select * from values ('a@b.c'), ('x') t(v) where is_email(v)")._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan.upper() or "LocalRelation" in plan
