"""Consolidation of several rows per person into one record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import rules
from tallyweave.functions.text import money, strip

REQUIRED = ("person_id", "name", "pay_code", "pay_amt", "prof_code", "prof_amt", "duty_code", "duty_amt")


def require(df: DataFrame, columns: tuple[str, ...]) -> None:
    """Fails with the names of missing columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {', '.join(missing)}")


def cleaned(af: DataFrame) -> DataFrame:
    """Trimmed rows with a person id in capitals; rows without one are left out."""
    require(af, REQUIRED)
    text = lambda c: strip(F.coalesce(F.col(c).cast("string"), F.lit("")))
    dept = text("dept") if "dept" in af.columns else F.lit("")
    out = af.select(
        "batch_id", "row_ord", F.upper(text("person_id")).alias("person_id"), text("name").alias("name"), dept.alias("dept"),
        text("pay_code").alias("pay_code"), money(F.col("pay_amt")).alias("pay_amt"), text("prof_code").alias("prof_code"), money(F.col("prof_amt")).alias("prof_amt"),
        F.upper(text("duty_code")).alias("duty_code"), money(F.col("duty_amt")).alias("duty_amt"),
    )
    return out.where("person_id <> ''")


def consolidate(af: DataFrame) -> DataFrame:
    """One record per batch and person id: first name, last department, last pay and allowance with a code, sums by duty code, rows.

    Numbers are aggregated by hash, with sums on the map side. Texts would force sorts, so their rows' places are aggregated
    instead: a text's place and its number in its batch's list of texts are one number, and the lists, names and departments
    of one file, are joined in the end.
    """
    rows = cleaned(af)
    has = lambda key: F.when(F.col(key) != "", F.col("row_ord"))
    last = lambda value, key: F.coalesce(F.max_by(value, has(key)), F.lit(0)).cast("bigint")
    duty = lambda codes: F.coalesce(F.sum(F.when(F.col("duty_code").isin(*codes), F.col("duty_amt"))), F.lit(0)).cast("bigint")
    text = lambda c: F.xxhash64(c)
    numbers = rows.groupBy("batch_id", "person_id").agg(
        F.min_by(text("name"), F.col("row_ord")).alias("name_key"), F.max_by(text("dept"), has("dept")).alias("dept_key"), last("pay_amt", "pay_code").alias("pay"), last("prof_amt", "prof_code").alias("prof"),
        duty(rules.MANAGER_CODES).alias("mgr"), duty(rules.TEACHER_CODES).alias("tutor"), F.count("*").alias("n_rows"), F.min("row_ord").alias("row_ord"),
    )
    named = lambda c: rows.select("batch_id", text(c).alias(f"{c}_key"), c).distinct()
    out = numbers.join(named("name"), ["batch_id", "name_key"]).join(named("dept"), ["batch_id", "dept_key"], "left")
    return out.select("batch_id", "person_id", "name", F.coalesce("dept", F.lit("")).alias("dept"), "pay", "prof", "mgr", "tutor", "n_rows", "row_ord")


def unknown_codes(af: DataFrame) -> DataFrame:
    """Duty codes in no rule, with their first five names in order."""
    known = (*rules.MANAGER_CODES, *rules.TEACHER_CODES)
    rows = cleaned(af).where((F.col("duty_code") != "") & ~F.col("duty_code").isin(*known))
    names = rows.select("batch_id", "duty_code", "name").distinct()
    return first_names(names, ["batch_id", "duty_code"], "name")


def first_names(df: DataFrame, keys: list[str], name: str, n: int = 5) -> DataFrame:
    """The first `n` distinct names of each key, in order, comma-joined, by a rank that keeps no more than they in any task."""
    from pyspark.sql import Window as W

    ranked = df.select(*keys, name).distinct().withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(name))).where(F.col("rank") <= n)
    return ranked.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(name)), "、").alias("names"))


def names(records: DataFrame) -> DataFrame:
    """(batch_id, names): each batch's distinct names in order; a batch is one file."""
    return records.groupBy("batch_id").agg(F.array_sort(F.collect_set("name")).alias("names"))


def warnings(af: DataFrame, records: DataFrame) -> DataFrame:
    """(batch_id, warning) of unknown duty codes and of namesakes."""
    filled = lambda form, *values: F.concat(*[x for part, v in zip(form.split("{}"), (*values, None), strict=True) for x in ((F.lit(part), v) if v is not None else (F.lit(part),))])
    codes = unknown_codes(af).select("batch_id", filled(rules.WARN_CODE, F.col("duty_code"), F.col("names")).alias("warning"))
    return codes.unionByName(namesakes(records).select("batch_id", filled(rules.WARN_NAMESAKES, F.col("n").cast("string"), F.col("name")).alias("warning")))


def namesakes(records: DataFrame, keys: list[str] = ["batch_id"], name: str = "name") -> DataFrame:  # noqa: B006
    """Names that several records bear."""
    return records.groupBy(*keys, name).agg(F.count("*").alias("n")).where("n > 1")
