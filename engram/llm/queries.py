"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from engram.llm import ann, licenses, packing, pieces, pii, quality, secrets, sharding, simhash, toxicity
from engram.llm.common import table

#: Folder of the public tokenizers' files.
TOKENIZERS = os.environ.get("ENGRAM_TOKENIZERS", "/opt/tokenizers")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"), pii.labelled_table(spark))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.flag(docs, toxicity.learned(docs, table(spark, sf_dir, "labels")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose id 20 divides, searched against all rows."""
    return ann.neighbours(table(spark, sf_dir, "embeddings"), queries=lambda key: key % 20 == 0)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.duplicates(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = (op1_pii, op2_pieces, op3_packing, op4_sharding, op5_licenses, op6_toxicity, op7_quality, op8_neighbours, op9_near_duplicates, op10_secrets, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the operator; the others are tested against brute force in ``tests/llm``."""
    import corpus_pipeline

    out = {"op10_secrets": secrets.scan_sql()}
    if corpus_pipeline.ORACLE_SQL:
        out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
