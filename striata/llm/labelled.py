"""Labelled documents for fitting classifiers: all, or a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def labels_by_id(labels: DataFrame, label: str, keep: Column | None = None) -> DataFrame:
    """(doc_id, label) of each labelled document, once, with the largest of its labels; null ids and labels stay out."""
    by_id = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).dropna()
    if keep is not None:
        by_id = by_id.where(keep)
    return by_id.groupBy("doc_id").agg(F.max("label").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, keep: Column | None = None) -> DataFrame:
    """(doc_id, text, label) of at most `rows` documents, evenly by a hash of doc_id; null ids and labels stay out.

    A document with several labels has their largest; of several rows of one doc_id the text with the least hash counts,
    so rows bounds what is broadcast and the rows that a fit may collect. The result is dealt to the shuffle's partitions.
    """
    chosen = labels_by_id(labels, label, keep).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    one = found.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least"))
    return one.select("doc_id", "least.text", "label")
