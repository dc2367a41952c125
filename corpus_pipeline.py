"""From raw documents to packed sequences: five stages of the text operators.

Each stage takes the documents that the stage before it kept, whole, and is
stored before the next one begins. ``run`` gives the packed pieces.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hydrolith.llm.common import remove, shared_dir, table
from hydrolith.llm.mixing import mix
from hydrolith.llm.neardup import deduplicated
from hydrolith.llm.packing import pack
from hydrolith.llm.pii import redact
from hydrolith.llm.toxicity import kept

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose score is 0.5 or more."""
    return kept(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the least id.

    Shingles are of three words and fingerprints link at two bits, as the
    operator's contract has it."""
    return deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with every span of personal data masked."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, in shards and shuffled."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence and offset."""
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL has neither the tokenizer nor the fitted models; tests hold each stage
#: against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``. Each lies in the shared folder until
    the next one has been written; the last is left for the caller to read. When a
    stage fails, none is left."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    try:
        for i, (name, stage) in enumerate(STAGES):
            path = f"{base}/{i}-{name}"
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            if i:
                remove(spark, f"{base}/{i - 1}-{STAGES[i - 1][0]}")
    except BaseException:
        remove(spark, base)
        raise
    return docs
