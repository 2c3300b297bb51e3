"""From raw documents to packed sequences: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gravelock.llm import mixing, packing, pii, quality, simhash
from gravelock.llm.common import documents, scratch
from gravelock.llm.queries import word_bpe

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """4: documents that fail the quality rules go; of the others, lines that many documents share go."""
    return quality.cleaned(docs)


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """5: of each group of near copies the document with the least doc_id stays."""
    return simhash.deduplicated(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """7: personal data is generalised, terms that disclose it are removed; all documents stay."""
    return pii.sanitised(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """9: documents of each source as often as its target weight asks for."""
    return mixing.sampled(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """1: packs what is left into windows; the last stage, its rows are pieces."""
    return packing.pack(docs, word_bpe())


STAGES: list[tuple[str, Stage]] = [("quality", good), ("near_dedup", single), ("personal_data", private), ("mixing", mixed), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Tokenizing and near-copy groups are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
