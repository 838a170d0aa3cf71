"""Reordering a table into the order of a roster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweave.functions import rules
from tallyweave.functions.text import in_order, strip, whole_number


def clean_roster(roster: DataFrame) -> DataFrame:
    """(batch_id, pos, seq, name): rows with a number and a name; the last number of a name counts; pos is the place by number, then row."""
    rows = roster.select("batch_id", "row_ord", whole_number(F.col("seq")).alias("seq"), strip(F.col("name")).alias("name")).where("seq is not null and name <> ''")
    rows = rows.withColumn("pos", F.row_number().over(W.partitionBy("batch_id").orderBy("seq", "row_ord")).cast("bigint"))
    return rows.withColumn("seq", F.max("seq").over(W.partitionBy("batch_id", "name")))


def reorder(roster: DataFrame, table: DataFrame) -> DataFrame:
    """`table` (batch_id, row_ord, name, ...) with roster_seq first: matched rows in roster order, once for each roster row of their name, then the rest numbered one past the roster's length.

    Result rows carry (part, pos, row_ord), their order.
    """
    own = clean_roster(roster)
    rest = [c for c in table.columns if c not in ("batch_id", "row_ord", "name")]
    rows = table.withColumn("name", strip(F.coalesce("name", F.lit(""))))
    matched = own.drop("row_ord").join(rows, ["batch_id", "name"]).select(F.col("seq").alias("roster_seq"), "batch_id", "name", *rest, F.lit(0).alias("part"), "pos", "row_ord")
    counts = own.groupBy("batch_id").agg((F.count("*") + 1).alias("roster_seq"))
    extra = rows.join(own.select("batch_id", "name").distinct(), ["batch_id", "name"], "left_anti").join(counts, "batch_id", "left")
    extra = extra.select(F.coalesce("roster_seq", F.lit(1).cast("bigint")).alias("roster_seq"), "batch_id", "name", *rest, F.lit(1).alias("part"), F.col("row_ord").alias("pos"), "row_ord")
    return matched.unionByName(extra)


def missing(roster: DataFrame, table: DataFrame) -> DataFrame:
    """Roster rows whose name the table lacks."""
    names = table.select("batch_id", strip(F.coalesce("name", F.lit(""))).alias("name")).distinct()
    return clean_roster(roster).join(names, ["batch_id", "name"], "left_anti")


def extra_names(roster: DataFrame, table: DataFrame) -> DataFrame:
    """Distinct names that the roster lacks, with their first place."""
    names = table.select("batch_id", strip(F.coalesce("name", F.lit(""))).alias("name"), "row_ord")
    return names.join(clean_roster(roster).select("batch_id", "name").distinct(), ["batch_id", "name"], "left_anti").groupBy("batch_id", "name").agg(F.min("row_ord").alias("first"))


def duplicated_names(roster: DataFrame) -> DataFrame:
    """Names that the roster bears several times, with their first place."""
    return clean_roster(roster).groupBy("batch_id", "name").agg(F.count("*").alias("n"), F.min("pos").alias("first")).where("n > 1")


def warnings(roster: DataFrame, table: DataFrame) -> DataFrame:
    """(batch_id, kind, warning) of names that the table lacks, that the roster lacks, and that the roster bears several times, each in order; a batch is one file."""
    text = lambda place: in_order(F.collect_list(F.struct(F.col(place).cast("bigint").alias("place"), F.col("name").alias("text"))))
    each = (
        ("missing", rules.WARN_MISSING, missing(roster, table), "pos"),
        ("extra", rules.WARN_EXTRA, extra_names(roster, table), "first"),
        ("twice", rules.WARN_TWICE, duplicated_names(roster), "first"),
    )
    parts = [rows.groupBy("batch_id").agg(F.concat(F.lit(begin), text(place)).alias("warning")).select("batch_id", F.lit(kind).alias("kind"), "warning") for kind, begin, rows, place in each]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def numbered(rows: DataFrame) -> DataFrame:
    """Adds place, the running number from 0 in each batch of a result of `reorder`."""
    order = W.partitionBy("batch_id").orderBy("part", "pos", "row_ord")
    return rows.withColumn("place", (F.row_number().over(order) - 1).cast("bigint"))


def preview(rows: DataFrame, n: int = 20) -> DataFrame:
    """The first rows of the result."""
    return rows.orderBy("part", "pos", "row_ord").limit(n)


def lookup(rows: DataFrame, dimension: DataFrame, key: str, value: str, order: str = "row_ord") -> DataFrame:
    """Adds the dimension's first value for a trimmed key, '' if there is none. Spark broadcasts the dimension if its size allows."""
    first = dimension.groupBy(strip(F.col(key)).alias("__key")).agg(F.min_by(value, order).alias("__value"))
    return rows.join(first, strip(F.col(key)) == F.col("__key"), "left").withColumn(value, F.coalesce("__value", F.lit(""))).drop("__key", "__value")
