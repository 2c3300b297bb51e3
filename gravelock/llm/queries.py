"""The operators of this subpackage over the whole table documents, one query for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gravelock.llm import oracles
from gravelock.llm.common import documents
from gravelock.llm.fingerprints import fingerprints
from gravelock.llm.mixing import mix
from gravelock.llm.ngram_lm import lm_scores
from gravelock.llm.packing import pack
from gravelock.llm.pii import personal_data
from gravelock.llm.quality import quality
from gravelock.llm.secret_scan import secrets
from gravelock.llm.simhash import near_duplicates
from gravelock.llm.suffix import suffix_dedup
from gravelock.llm.tokens import token_counts


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": lambda spark, sf_dir: pack(documents(spark, sf_dir), word_bpe()),
    "op2_fingerprints": lambda spark, sf_dir: fingerprints(documents(spark, sf_dir)),
    "op3_lm_scores": lambda spark, sf_dir: lm_scores(documents(spark, sf_dir)),
    "op4_quality": lambda spark, sf_dir: quality(documents(spark, sf_dir)),
    "op5_simhash": lambda spark, sf_dir: near_duplicates(documents(spark, sf_dir)),
    "op6_suffix_dedup": lambda spark, sf_dir: suffix_dedup(documents(spark, sf_dir)),
    "op7_personal_data": lambda spark, sf_dir: personal_data(documents(spark, sf_dir)),
    "op8_secrets": lambda spark, sf_dir: secrets(documents(spark, sf_dir)),
    "op9_mixing": lambda spark, sf_dir: mix(documents(spark, sf_dir)),
    "op10_token_counts": lambda spark, sf_dir: token_counts(documents(spark, sf_dir), word_bpe()),
}

#: The other operators hash, tokenize or link; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op4_quality": oracles.QUALITY, "op9_mixing": oracles.MIXING}
