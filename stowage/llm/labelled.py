"""Labelled rows for the two classifiers, and the fold that is held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Labelled rows that a model is fitted on, at most.
SAMPLE = 20_000
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model learns from; a null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, text, y`` of at most ``sample`` labelled documents outside the held-out fold.

    The rows are those with the smallest hashes of their doc_id. A doc_id with several
    labels gets the most frequent one, 1 on a tie; null labels don't count. Of several
    documents with one doc_id, the smallest text in byte order takes part, a null one only
    if there is no other, so there is one row for each doc_id.
    """
    known = labels.select(F.col("doc_id").alias("__id"), F.col(label).alias("__y")).dropna()
    known = known.filter(~held_out(F.col("__id"))).groupBy("__id").agg((F.avg("__y") >= 0.5).cast("double").alias("y"))
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    # The chosen rows are bounded by the parameter: 16 bytes each.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    return rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")
