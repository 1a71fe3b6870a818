"""A corpus from ``documents``: toxic and poor documents go, one of each group of near-duplicates stays, documents with
benchmark passages go, and the rest is packed into sequences.

Each stage takes (spark, docs, sf_dir) and reads what its predecessor kept; all but the last return the columns of docs.

Null and empty texts are scored like any text, by the models; those that are kept are copies of one another and are no benchmark
passage, and pack as their end id. Documents whose doc_id is null are scored and deduplicated like others. Very long texts are
read whole by every stage. A repeated row is a copy of the first: one of them stays, that with the smallest doc_id, ties by the
row. Extra columns go along, whatever their names. An empty table gives an empty table at each stage, and no pieces. Without
labels of both classes no document is rejected. Whatever a stage writes for itself is deleted once its result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowforge.llm import decontamination, near_duplicates, packing, quality, toxicity
from rowforge.llm.common import drop_written, free_name, written


def _columns(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*(F.col(f"`{c}`") for c in like.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    into = free_name(docs, "toxicity")
    scored = toxicity.toxicity_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), into=into)
    return _columns(scored.where(F.col(into) < 0.5), docs)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    into = free_name(docs, "quality")
    scored = quality.quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), into=into)
    return _columns(scored.where(F.col(into) >= 0.3), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    into = free_name(docs, "contamination")
    marked = decontamination.mark_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), into=into)
    return _columns(marked.where(~decontamination.contaminated(into)), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Trained models, sketches and token ids have no SQL; the pipeline is tested against its stages and brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, made = docs, stage(spark, docs, sf_dir)
        docs = written(made, name)
        drop_written(made, before)  # what the stage wrote for itself, and what its predecessor kept
    return STAGES[-1][1](spark, docs, sf_dir)
