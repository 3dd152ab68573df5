"""Corpus pipeline: from raw documents to packed training sequences.

    quality          rows that fail the quality rules go (op 2)
    toxicity         rows that score as toxic go (op 9)
    near_duplicates  one row of each SimHash group stays (op 6)
    pii              personal data in the texts is replaced by its kind (op 5)
    packing          the texts' token ids are packed into sequences (op 3)

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of
``documents``.  A stage's rows are written as Parquet under the shared checkpoint folder and
read again as the next stage's input, so a lost executor costs one stage at most.

The perplexity model, the label model and the tokenizer cannot be expressed in SQL, so there is
no SQL twin; ``tests/llm/test_pipeline.py`` holds the rows against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepool.llm import packing, pii, quality, simhash, toxicity
from tidepool.llm.common import materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs, labels=table(spark, sf_dir, "labels"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_filter(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(docs, shingle=4, max_bits=4)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, with_ids=True)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: one row per piece of a packed sequence."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


ORACLE_SQL = None
