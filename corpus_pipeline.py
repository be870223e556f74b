"""From raw documents to packed training sequences.

Five stages, each on all that the one before kept: quality rules, toxicity, near duplicates, personal data and packing.
``run`` writes each stage's rows as Parquet to the shared checkpoint folder and reads them again, so that
a lost executor costs the running stage's lost tasks only, and then removes what the next stage doesn't read.

Rows with nulls, empty or very long texts, ties, repeated rows, empty tables and further columns: each stage
does what its operator's docstring says. A null or empty text is rejected by no stage but the first, whose rule
for texts without words votes against it; it would be in no sequence anyway.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from engram.llm import packing, pii, quality, simhash, toxicity
from engram.llm.common import checkpoints, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are good with a posterior probability of 0.5 at least."""
    return quality.keep(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; stems and threshold are learned from the labels, of which a bounded
    number is read, and the texts that they belong to."""
    return toxicity.drop(docs, toxicity.learned(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.drop(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by their kind."""
    return pii.redact(docs, pii.labelled_table(spark))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed sequences: see ``packing.pack``."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("near duplicates", near_duplicate_stage),
    ("personal data", pii_stage),
    ("packing", packing_stage),
]

#: SQL can't express the model of the votes, the trained models and the best fit; tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    checkpoints(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        path = f"{base}/pipeline-{uuid.uuid4().hex}-{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            jpath = spark._jvm.org.apache.hadoop.fs.Path(before)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
        before = path
    return docs
