"""The driver's queries over the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyweave.llm.common import documents


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyweave.llm.decontam import contamination

    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_diagonal_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyweave.llm.licenses import license_scan

    return license_scan(documents(spark, sf_dir))


def op3_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyweave.llm import secrets

    docs = documents(spark, sf_dir)
    ledger = secrets.update(docs, secrets.ledger_folder(spark))
    return secrets.digest(secrets.findings(docs, ledger), secrets.BASE)


def op4_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyweave.llm.quality import compression_bands

    return compression_bands(documents(spark, sf_dir))


def op5_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyweave.llm.bpe import bpe_round_trip

    return bpe_round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyweave.llm.debruijn import substring_dedup

    return substring_dedup(documents(spark, sf_dir))


def op7_disclosing_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyweave.llm import pii

    return pii.digest(pii.personal_data(documents(spark, sf_dir)))


def op8_pigeonring_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyweave.llm.simhash import simhash_components

    return simhash_components(documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyweave.llm.counting import token_counts

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op10_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyweave.llm.katz import katz_scores

    return katz_scores(documents(spark, sf_dir))


def op11_reversed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyweave.llm.search import reversed_search

    return reversed_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_euler_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyweave.llm.trie import prefix_trie

    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_neighbour_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyweave.llm.neighbours import quality_votes

    return quality_votes(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from tallyweave.llm import oracles

    return {"op1_template_decontamination": oracles.template_decontamination(), "op2_diagonal_licenses": oracles.diagonal_licenses(), "op3_blob_ledger": oracles.blob_ledger(), "op6_debruijn_dedup": oracles.SUBSTRINGS, "op11_reversed_search": oracles.SEARCH, "op12_euler_prefix_trie": oracles.TRIE}
