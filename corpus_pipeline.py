"""The corpus pipeline: quality, exact copies, near copies, the mix of sources, packing.

Each stage reads what the one before has written. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wavemill.llm import exact_dedup, mixing, packing, quality_classifier, simhash
from wavemill.llm.common import keep_until_exit, release, remove, scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents outside the classifier's sample go; nulls, empty texts, ties and repeated rows as in ``drop_low_quality``."""
    return quality_classifier.drop_low_quality(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays; nulls, ties and repeated rows as in ``drop_exact_copies``."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies one document stays; nulls, ties and repeated rows as in ``drop_near_copies``."""
    return simhash.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, a document taken twice is two rows; nulls and repeated rows as in ``mixed_documents``."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, each with a checksum of its ids; nulls and repeated rows as in ``pack_documents``."""
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("exact dedup", exact_copies),
    ("simhash near-dedup", near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: Trained models, connected components and tokenizers are beyond SQL; tests compare with plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in ``sf_dir``. A stage's table is deleted once the next one is written."""
    docs, folder = table(spark, sf_dir, "documents"), f"{scratch(spark)}/pipeline-{uuid.uuid4().hex}"
    keep_until_exit(spark, folder)
    *first, (_, last) = STAGES
    for k, (_, stage) in enumerate(first):
        with release(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{folder}/{k}")
            keep_until_exit(spark, folder)
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return last(spark, docs, sf_dir)
