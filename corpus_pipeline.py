"""A corpus pipeline over `documents`: each stage works on all rows that the one before kept, and judges rows, not ids.

Null or empty text: scored like an empty text by both classifiers, a copy of nothing, never contaminated, of size 0, so the
mix takes nothing of it. Null doc_id: judged by its text like any other row, but not learned from. Repeated rows, or rows
of one doc_id: each is judged by itself; of equal or near texts one row stays (the smallest doc_id, nulls last). Null
source: a source of its own. Ties: the smallest doc_id stays in a group; equal finish times are ordered by rank of the source, hash
and doc_id. Very long texts: processed whole, in pieces. Empty tables: no labels drop nothing as toxic and score all 0.5 for
quality, no benchmark drops nothing, no documents give no rows. Extra columns, also with names that operators use: kept up
to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from striata.llm import decontaminate, mixing, near_dup, quality, toxicity
from striata.llm.common import materialize, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.one_of_each(docs, k=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), k=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as a manifest: how many words of each document it takes, repeats counted; documents it doesn't take go."""
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken").where("taken > 0")


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near_dup", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: The classifiers' scores have no SQL; tests/llm/test_pipeline.py holds run() against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
