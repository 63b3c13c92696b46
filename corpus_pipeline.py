"""From raw documents to packed training sequences: five stages, each one operator of ``zonewatch.llm``.

Every stage works on all that the one before it kept, written as Parquet and read again. All but the last return
documents with their own columns: the first two drop the documents they reject, the third leaves one
document of each group of near duplicates, the fourth gives the mix (texts cut to the blocks that were drawn, once
for each time they were drawn), and the last gives the pieces of packed sequences.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from zonewatch.llm import kneser_ney, mixing, near_dup, packing, quality_rules
from zonewatch.session import checkpoint_dir, ship


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_passing(docs)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return kneser_ney.Classifier(ship(spark), docs, labels).keep_good(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_first(docs, near_dup.Similarity(words=5, percent=80))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, packing.contract_packing())


def _shipped(fn: Callable) -> Callable:
    return lambda spark, docs, sf_dir: fn(ship(spark), docs, sf_dir)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", _shipped(rules)), ("quality classifier", _shipped(classify)), ("near duplicates", _shipped(deduplicate)),
    ("mixing", _shipped(mix)), ("packing", _shipped(pack)),
]

#: The classifier, the mix and the tokens can't be said in SQL; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what each one returns is written below the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/stages/pipeline-{uuid.uuid4().hex}"
    for k, (_, fn) in enumerate(STAGES):
        done = fn(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return done
        done.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(done.schema).parquet(f"{folder}/{k}")
    return docs
