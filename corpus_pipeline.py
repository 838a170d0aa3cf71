"""The corpus pipeline: quality rules, near-duplicates, decontamination, secrets, encoding.

Every stage takes null ids, equal ids and repeated rows: rows are told apart by id and text. Columns beside those of documents stay
up to the last stage, whatever their names; an empty table gives none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.bpe import bpe_round_trip
from tallyweave.llm.decontam import decontaminated
from tallyweave.llm.quality import passing
from tallyweave.llm.secrets import findings, ledger_folder, redact, update
from tallyweave.llm.simhash import one_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows that the quality rules keep; null and empty texts go."""
    return passing(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates, the one of the smallest id (a null id is larger than all); see `one_of_each` for ties."""
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose texts hold a benchmark item; other rows of their id stay."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; n_chars, where there is one, follows the text. All rows stay, null texts as they are."""
    clean = redact(docs, findings(docs, update(docs, ledger_folder(spark))))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each row's text, with digests of the ids and of the bytes decoded from them: what a trainer reads instead of the text."""
    return bpe_round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("quality", quality), ("near_duplicates", deduplicate), ("decontamination", decontaminate), ("secrets", redact_secrets), ("encoding", encode)]

#: SQL can't express zstandard ratios, shingle similarity or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
