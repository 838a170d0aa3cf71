"""Checks of scanned rows: names, sums, quarantine and corrections."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import rules
from tallyweave.functions.text import in_order, money, strip, sum_check, without_leading_number
from tallyweave.operators.match import Likeness

MEASURES = rules.MEASURES


def annotate_sums(people: DataFrame, measures: tuple[str, ...] = (*MEASURES, "region", "other")) -> DataFrame:
    """Adds arith_ok (null without a gross amount) and arith_diff."""
    parts = [F.col(m) for m in measures if m in people.columns]
    ok, diff = sum_check(F.col("gross"), *parts)
    return people.withColumns({"arith_ok": ok, "arith_diff": diff})


def fix_names(rows: DataFrame, known: DataFrame, cutoff: float = rules.NAME_CUTOFF) -> DataFrame:
    """Adds fixed_name: the name where it is blank or known in its batch, else the closest known name from `cutoff` on, else the name.

    Names with nothing exact are compared with their own batch's names, which lie in one task once; a batch is one file.
    """
    # New columns, as both frames may come from one.
    names = known.select(F.col("batch_id").alias("batch_id"), F.col("name").alias("name")).distinct()
    exact = rows.join(names.withColumn("__known", F.lit(True)), ["batch_id", "name"], "left")
    open_ = exact.where((F.col("name") != "") & F.col("__known").isNull()).select("batch_id", "name").distinct()
    def best(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return own.assign(closest=pd.Series(dtype=object))
        likeness = Likeness(others.name)
        return own.assign(closest=[likeness.closest(n, cutoff) for n in own.name])

    found = open_.groupBy("batch_id").cogroup(names.select(F.col("batch_id").alias("batch_id"), F.col("name").alias("name")).groupBy("batch_id")).applyInPandas(best, f"batch_id {rows.schema['batch_id'].dataType.simpleString()}, name string, closest string")
    return exact.join(found, ["batch_id", "name"], "left").withColumn("fixed_name", F.coalesce("closest", "name")).withColumn("name_known", F.coalesce("__known", F.lit(False)) | F.col("closest").isNotNull()).drop("__known", "closest")


def validate(scanned: DataFrame, af: DataFrame) -> DataFrame:
    """Every scanned row with its name as resolved (by a valid id, exactly, or by likeness), its sums, `good`, and the reasons if it isn't.

    `scanned`: batch_id, row_ord, name, title, person_id, id_valid, measures, gross, confidence. A row is good if its name is
    known and its four measures add up to a gross amount that isn't 0.
    """
    text = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    rows = scanned.select("batch_id", "row_ord", text("name").alias("name"), without_leading_number(F.col("title")).alias("title"), F.upper(text("person_id")).alias("person_id"), F.coalesce("id_valid", F.lit(False)).alias("id_valid"), *[money(F.col(m)).alias(m) for m in (*MEASURES, "gross")], "confidence")
    ids = af.where("person_id <> ''").groupBy("batch_id", "person_id").agg(F.max_by("name", "row_ord").alias("id_name"))
    rows = fix_names(rows.join(ids, ["batch_id", "person_id"], "left"), af)
    by_id = F.col("id_valid") & F.col("id_name").isNotNull()
    total = sum((F.col(m) for m in MEASURES), F.lit(0))
    rows = rows.withColumns({"id_ok": by_id, "resolved": F.when(by_id, F.col("id_name")).otherwise(F.col("fixed_name")), "name_ok": by_id | F.col("name_known"), "total": total.cast("bigint")})
    sum_ok = (F.col("gross") != 0) & (F.col("total") == F.col("gross"))
    amount = lambda form, x: F.format_string(form, x)
    reasons = F.array(
        F.when(~F.col("name_ok") & (F.col("person_id") != "") & ~F.col("id_valid"), F.concat(F.lit("身分證「"), "person_id", F.lit("」檢查碼不符，可能辨識錯誤"))),
        F.when(~F.col("name_ok"), F.concat(F.lit("姓名「"), F.when(F.col("name") != "", F.col("name")).otherwise("空白"), F.lit("」無法對應 AF 名單"))),
        F.when(F.col("gross") == 0, "未讀到應發金額，無法驗算").when(~sum_ok, F.concat(F.lit("四項相加 "), amount("%,d", F.col("total")), F.lit(" 與應發金額 "), amount("%,d", F.col("gross")), F.lit(" 不符（差 "), amount("%+,d", F.col("gross") - F.col("total")), F.lit("）"))),
        F.when(F.col("confidence") < rules.LOW_CONFIDENCE, F.concat(F.lit("辨識信心偏低（"), F.col("confidence").cast("string"), F.lit("）"))),
    )
    good = F.col("name_ok") & sum_ok
    return rows.select("batch_id", "row_ord", F.col("name").alias("raw_name"), F.col("resolved").alias("name"), "title", "person_id", "id_ok", "name_ok", sum_ok.alias("sum_ok"), good.alias("good"), "gross", *MEASURES, F.when(~good, F.filter(reasons, lambda r: r.isNotNull())).alias("reasons"))


def bad_sums(people: DataFrame) -> DataFrame:
    """(batch_id, warning) for batches of `annotate_sums` with rows that don't add up, their names in the rows' order; a batch is one file."""
    of = in_order(F.collect_list(F.struct("row_ord", F.col("name").alias("text"))))
    return people.where("arith_ok = false").groupBy("batch_id").agg(F.replace(F.lit(rules.WARN_SUMS), F.lit("{}"), of).alias("warning"))


def people_of(validated: DataFrame) -> DataFrame:
    """Every scanned row (batch_id, row_ord, name, title), whether good or not, as title statistics take them: a doubtful one under the name suggested, else as read."""
    name = F.when(F.col("good") | F.col("name_ok"), F.col("name")).otherwise(F.col("raw_name"))
    return validated.select("batch_id", "row_ord", name.alias("name"), "title")


def good_rows(validated: DataFrame) -> DataFrame:
    """Rows fit for comparison; an id that wasn't valid is left out."""
    return validated.where("good").select("batch_id", "row_ord", "name", "title", F.when(F.col("id_ok"), F.col("person_id")).otherwise("").alias("person_id"), *MEASURES, "gross")


def quarantined(validated: DataFrame) -> DataFrame:
    """Rows for a person to correct, with a suggested name where one is known."""
    return validated.where("not good").select("batch_id", "row_ord", "raw_name", F.when(F.col("name_ok"), F.col("name")).otherwise("").alias("suggested_name"), "title", "person_id", "gross", *MEASURES, "reasons")


def corrected(good: DataFrame, fixed: DataFrame) -> DataFrame:
    """The good rows and the corrected ones; those without a name are skipped, and corrected rows carry no id."""
    rows = fixed.where(strip(F.coalesce("name", F.lit(""))) != "")
    rows = rows.select("batch_id", "row_ord", strip(F.col("name")).alias("name"), F.coalesce("title", F.lit("")).alias("title"), F.lit("").alias("person_id"), *[money(F.col(m)).alias(m) for m in (*MEASURES, "gross")])
    return good.unionByName(rows)


def promote(good: DataFrame, need: DataFrame) -> DataFrame:
    """Adds quarantined rows that are set aside (secondary) to the good ones, under the first of their names that isn't blank."""
    first = lambda *names: F.coalesce(*[F.when(F.col(n) != "", F.col(n)) for n in names], F.lit(""))
    rows = need.where("secondary").select("batch_id", "row_ord", first("suggested_name", "raw_name").alias("name"), "title", F.lit("").alias("person_id"), *MEASURES, "gross")
    return good.unionByName(rows)
