"""Comparing matched registers: differences, outcome, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweave.functions import rules
from tallyweave.operators.match import label, match_cascade
from tallyweave.operators.validate import corrected


def differences(left: str = "l", right: str = "r"):
    """An array of (field, label, left_val, right_val, delta) for the measures that differ; delta is right less left."""
    each = [F.struct(F.lit(m).alias("field"), F.lit(rules.MEASURE_LABELS[m]).alias("label"), F.col(f"{left}_{m}").alias("left_val"), F.col(f"{right}_{m}").alias("right_val"), (F.col(f"{right}_{m}") - F.col(f"{left}_{m}")).alias("delta")) for m in rules.MEASURES]
    return F.filter(F.array(*each), lambda d: d["delta"] != 0)


def compare(left: DataFrame, right: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """One row per pair, per left row without a partner (unless its name is ambiguous) and per right row without one.

    Columns: batch_id, status (diff, pdf_only, af_only, ok), name, title, dept, person_id, match_basis, needs_confirm (pairs
    only), diffs, left_ord, right_ord, secondary, secondary_reason. A pair has the right row's name, department and id and
    the left row's title; what a row alone lacks is ''.
    """
    matched = match_cascade(left, right) if matched is None else matched
    lefts = matched.where("side = 'L'").select("batch_id", F.col("row_ord").alias("left_ord"), "partner", "basis", "ambiguous", "k_dept", *[F.col(m).alias(f"l_{m}") for m in rules.MEASURES])
    rights = matched.where("side = 'R'").select("batch_id", F.col("row_ord").alias("right_ord"), F.col("partner").alias("taken"), *[F.col(m).alias(f"r_{m}") for m in rules.MEASURES])
    extra = [c for c in ("secondary", "secondary_reason") if c in left.columns]
    about = left.select("batch_id", F.col("row_ord").alias("left_ord"), F.col("name").alias("l_name"), "title", *extra)
    shown = lambda c: F.coalesce(F.col(c), F.lit(""))
    place = right.select("batch_id", F.col("row_ord").alias("right_ord"), F.col("name").alias("r_name"), shown("dept").alias("dept"), shown("person_id").alias("person_id"))
    lefts = lefts.join(about, ["batch_id", "left_ord"])
    rights = rights.join(place, ["batch_id", "right_ord"])
    pairs = lefts.where("partner is not null").join(rights, (lefts.batch_id == rights.batch_id) & (lefts.partner == rights.right_ord)).drop(rights.batch_id)
    pairs = pairs.withColumn("diffs", differences()).select(
        "batch_id", F.when(F.size("diffs") > 0, "diff").otherwise("ok").alias("status"), F.col("r_name").alias("name"), shown("title").alias("title"), "dept", "person_id", label(F.col("basis"), F.col("title"), F.col("r_name")).alias("match_basis"),
        (F.col("basis") != rules.BASIS_NAME).alias("needs_confirm"), "diffs", "left_ord", "right_ord", *extra,
    )
    none = lambda *names: [F.lit("").alias(c) for c in names]
    no_diffs = F.array().cast(pairs.schema["diffs"].dataType).alias("diffs")
    own = [F.lit(False).alias(c) if c == "secondary" else F.lit(None).cast("string").alias(c) for c in extra]
    left_only = lefts.where("partner is null and not ambiguous").select("batch_id", F.lit("pdf_only").alias("status"), F.col("l_name").alias("name"), shown("title").alias("title"), *none("dept", "person_id", "match_basis"), no_diffs, "left_ord", *extra)
    right_only = rights.where("taken is null").select("batch_id", F.lit("af_only").alias("status"), F.col("r_name").alias("name"), *none("title"), "dept", "person_id", *none("match_basis"), no_diffs, "right_ord", *own)
    return pairs.unionByName(left_only, allowMissingColumns=True).unionByName(right_only, allowMissingColumns=True)


def status_rank():
    return F.array_position(F.array(*[F.lit(s) for s in rules.STATUS_ORDER]), F.col("status"))


def ordered(results: DataFrame) -> DataFrame:
    """By outcome (differences first), then name, then the rows' order."""
    return results.orderBy("batch_id", status_rank(), "name", F.coalesce("left_ord", "right_ord"))


def placed(results: DataFrame) -> DataFrame:
    """Adds place, a row's number from 0 in its batch's order."""
    order = W.partitionBy("batch_id").orderBy(status_rank(), "name", F.coalesce("left_ord", "right_ord"))
    return results.withColumn("place", (F.row_number().over(order) - 1).cast("bigint"))


def parts(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The main rows and those set aside."""
    aside = F.coalesce(F.col("secondary"), F.lit(False))
    return results.where(~aside), results.where(aside)


def with_corrections(good: DataFrame, fixed: DataFrame, records: DataFrame) -> DataFrame:
    """The comparison of the rows that passed and those that a person corrected; these carry no id and are never set aside."""
    return compare(corrected(good, fixed), records)


def summary(results: DataFrame, matched: DataFrame) -> DataFrame:
    """Counts per batch: ok, diff, pdf_only and af_only of the main rows, ambiguous names, and all and differing secondary rows."""
    sub = F.coalesce(F.col("secondary"), F.lit(False)) if "secondary" in results.columns else F.lit(False)
    count = lambda s: F.count_if(~sub & (F.col("status") == s)).alias(s)
    counts = results.groupBy("batch_id").agg(count("ok"), count("diff"), count("pdf_only"), count("af_only"), F.count_if(sub).alias("secondary"), F.count_if(sub & (F.col("status") != "ok")).alias("secondary_diff"))
    waiting = matched.where("ambiguous").select("batch_id", "k_name").distinct().groupBy("batch_id").agg(F.count("*").alias("ambiguous"))
    return counts.join(waiting, "batch_id", "left").withColumn("ambiguous", F.coalesce("ambiguous", F.lit(0).cast("bigint")))
