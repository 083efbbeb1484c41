"""A corpus pipeline of five operators: each stage works on all that the one before kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; ``run`` writes each
result as Parquet in the shared folder and reads it as the next stage's input.
All but the last return the columns of ``documents``.  No SQL can express the
Jaccard groups or the learned spans, so there is no oracle; tests compare the
stages with brute force.

A document's identity is its doc_id: rows that share one are versions of one
document and stay or go together; a row with a null doc_id is judged by the
quality rules alone and is otherwise kept.  Rows that repeat are each judged;
a null text counts as an empty one (the quality rules reject it); texts of any
length are handled whole; of near copies with equal ids all rows of the
smallest id stay; further columns pass through all stages but the last,
whatever their names; empty tables give an empty result.

Each stage bounds the batches in which its session reads whole texts
(``common.settle``), as its input may come from that session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirefold.llm import decontam, jaccard_join, pieces, pii, quality_rules
from wirefold.llm.common import Scratch, bounded, read_table, settle

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current rule policy keeps."""
    settle(spark)
    return quality_rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    settle(spark)
    groups = jaccard_join.groups(docs)
    return _without(docs, groups.where("component_id <> doc_id").select("doc_id"), "copies")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    settle(spark)
    return _without(docs, decontam.contaminated(docs, read_table(spark, sf_dir, "benchmark")).select("doc_id"), "leaks")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows."""
    settle(spark)
    return pii.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select([F.col(f"`{c}`") for c in docs.columns])


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to it."""
    settle(spark)
    return pieces.encode(docs, pieces.default_path())


def _without(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    # the list is written first: if it is small, its size is known and Spark need not shuffle the texts
    ids = Scratch(docs.sparkSession, name).keep(gone.dropna().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).select("doc_id"), "ids")
    return bounded(docs).join(ids, "doc_id", "left_anti").select([F.col(f"`{c}`") for c in docs.columns])


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("sentencepiece", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        docs = scratch.keep(out, name)
    return docs
