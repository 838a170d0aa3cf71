"""Helpers shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions.lineage import checkpointed, shared_folder

__all__ = ["ascii_lower", "checkpointed", "documents", "heavy_keys", "id_and_text", "id_key", "nested", "slices", "spread_join", "with_sizes", "written"]

#: The ASCII letters that the contracts lower-case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys whose rows a join deals out further (their number is the bound of what is broadcast), the rows from which a key may
#: be one of them, and the parts that such a key gets, as many as a long has bits.
HEAVY, HEAVY_ROWS, PARTS = 1000, 300, 64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a table in the folder that the cluster shares: made once, where a checkpoint is made twice, and read by column."""
    folder = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and leaves every other character."""
    return F.translate(text, UPPER, LOWER)


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *extra: Column) -> DataFrame:
    """(doc_id, text, ...) alone, so that other columns of the input, whatever their names, can't clash; a null text is empty."""
    return df.select(df[id_col].alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"), *extra)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into runs of rows of about `most_bytes` of text, so that a task's Python objects stay few; one longer text is a run of its own."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).to_pylist()
        start = size = 0
        for i, n in enumerate(lengths):
            n = n or 0
            if size and size + n > most_bytes:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)


def id_key(id_: Column) -> Column:
    """An id as a string that is never null, so that rows of null ids can be joined and grouped like others."""
    return F.coalesce(id_.cast("string"), F.lit("\0null"))


def nested(df: DataFrame, *extra: Column) -> DataFrame:
    """All columns of `df` within one, `row`, beside `extra`, so that no name of the input can clash with an operator's."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), *extra)


def with_sizes(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The rows that share their `keys` with others, with n, how many do.

    A key's rows are dealt to PARTS parts by a hash of `by`, and its count tells which parts there are as the bits of one
    number, so the count goes to each of them and to no others: a hot key's rows meet it in PARTS tasks, however many keys
    are hot, and a rare key's count is repeated no more often than it has rows.
    """
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(by), F.lit(PARTS)).cast("int"))
    sizes = dealt.groupBy(*keys).agg(F.count("*").alias("n"), F.bit_or(F.expr("shiftleft(1L, part)")).alias("parts")).where("n > 1")
    every = F.filter(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda p: F.getbit("parts", p) == 1)
    return dealt.join(sizes.select(*keys, "n", F.explode(every).alias("part")), [*keys, "part"]).drop("part")


def heavy_keys(counts: DataFrame, key: str, n: str) -> DataFrame:
    """(heavy) the keys of (key, n) with the most rows, at most HEAVY; the others are not left out, they need no parts."""
    return counts.where(F.col(n) >= HEAVY_ROWS).orderBy(F.desc(n)).limit(HEAVY).select(F.col(key).alias("heavy"))


def spread_join(rows: DataFrame, table: DataFrame, key: str, by: str, heavy: DataFrame, how: str = "inner") -> DataFrame:
    """`rows` joined with `table` on `key`. The rows of a heavy key are dealt to PARTS parts by a hash of `by`, and the table's
    rows of that key are repeated in each, so that no key lands in one task."""
    many = F.broadcast(heavy)  # HEAVY keys at most
    part = F.when(F.col("heavy").isNotNull(), F.pmod(F.xxhash64(by), F.lit(PARTS)).cast("int")).otherwise(0)
    left = rows.join(many, F.col(key) == F.col("heavy"), "left").withColumn("part", part).drop("heavy")
    every = F.when(F.col("heavy").isNotNull(), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    right = table.join(many, F.col(key) == F.col("heavy"), "left").withColumn("part", F.explode(every)).drop("heavy")
    return left.join(right, [key, "part"], how).drop("part")
