"""Labels and the folds of documents, shared by the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text modulo 5. Fold 0 is held out; a null id counts as empty."""
    return (F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))) % 5).cast("int")


def training_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) outside the held-out fold; of repeated labels the larger counts, nulls don't."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold() != 0))
    return known.groupBy("doc_id").agg(F.max(F.col(label)).cast("double").alias("label"))
