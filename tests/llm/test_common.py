import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from rowforge.llm.common import drop_written, hash_sample, join_counted, scratch_root, written


def test_sample_is_of_distinct_keys(spark):
    """Of rows of which nearly all repeat three texts; the rows of the smallest hashes, whatever their number."""
    df = spark.range(20_000).select(F.when(F.col("id") < 19_000, F.col("id") % 3).otherwise(F.col("id")).cast("string").alias("t"))
    keys = [r.t for r in df.distinct().orderBy(F.xxhash64("t"), "t").collect()]
    for n in (1, 54, 500, 1003, 5000):
        rows = [r.t for r in hash_sample(df.repartition(3), ["t"], n).collect()]
        assert sorted(rows) == sorted(keys[:n])
    assert hash_sample(df.limit(0), ["t"], 5).count() == 0


@pytest.mark.parametrize("most", [4, 8192])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_counted_join_is_the_join(spark, most, how):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97).alias("k"), "id")
    counted = written(rows.where("k < 60").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top")), "counts")
    out = join_counted(rows, counted, ["k"], "n", how=how, most=most)
    expected = rows.join(counted, "k", how)
    assert sorted(map(str, out.select(*expected.columns).collect())) == sorted(map(str, expected.collect()))
    drop_written(counted)


def test_written_tables_go(spark):
    df = written(spark.range(5), "x")
    folder = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(folder)
    drop_written(df.where("id > 1"))
    assert not os.path.exists(folder)


def test_no_machine_local_folder_on_a_cluster():
    """Without a shared folder a cluster's session is refused."""
    class Conf:
        def get(self, *_):
            return None

    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    for master in ("spark://host:7077", "local-cluster[3,2,1024]", "yarn", "k8s://https://host"):
        context.master = master
        with pytest.raises(ValueError, match="share"):
            scratch_root(SimpleNamespace(conf=Conf(), sparkContext=context))
