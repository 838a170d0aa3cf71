"""Parsing payslip registers out of table cells: (batch_id, tbl, r, c, text)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweave.functions import rules
from tallyweave.functions.lineage import checkpointed
from tallyweave.functions.text import has_any, is_number_cell, money, strip

FIELDS = ("pay", "prof", "mgr", "_tutor", "_special", "region", "gross", "net")


def extracted(files: DataFrame, extract: Callable[[bytes], list[list[list[str | None]]]]) -> DataFrame:
    """(batch_id, tables, error) of files (path, content): what `extract` makes of each file's bytes, a list of tables of rows of texts.

    Any library goes in here, one that reads PDF files for instance; it runs where the files are. A file that it can't take
    gives a row without tables that says why, and the others go on; a null content is such a file. `cells` takes what comes
    out, `refused` what doesn't.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch.path, batch.content, strict=True):
                tables, error = None, None
                try:
                    tables = [[[None if x is None else str(x) for x in row] for row in t] for t in extract(bytes(content))]
                except Exception as e:  # a file's fault, whatever the library calls it
                    error = f"{type(e).__name__}: {e}"[:200]
                out.append((path.rpartition("/")[2], tables, error))
            yield pd.DataFrame(out, columns=["batch_id", "tables", "error"])

    return files.select("path", "content").mapInPandas(run, "batch_id string, tables array<array<array<string>>>, error string")


def refused(documents: DataFrame) -> DataFrame:
    """(batch_id, error) of the files that `extracted` couldn't take, or that have no table with a row."""
    none = ~F.exists("tables", lambda t: (F.size(t) > 0) & (F.size(F.get(t, F.lit(0))) > 0))
    return documents.where(F.col("error").isNotNull() | none).select("batch_id", F.coalesce("error", F.lit("no tables")).alias("error"))


def cells(documents: DataFrame) -> DataFrame:
    """Cells of extracted tables (batch_id, tables ARRAY<ARRAY<ARRAY<STRING>>>); tables without a first row are left out and the rest renumbered."""
    kept = F.filter("tables", lambda t: (F.size(t) > 0) & (F.size(F.get(t, F.lit(0))) > 0))
    rows = documents.select("batch_id", F.posexplode(kept).alias("tbl", "rows")).select("batch_id", "tbl", F.posexplode("rows").alias("r", "row"))
    return rows.select("batch_id", "tbl", "r", F.posexplode("row").alias("c", "text"))


def has_text_layer(pages: DataFrame, most: int = 3) -> DataFrame:
    """Per batch whether one of the first pages (batch_id, page_no from 1, text) has text."""
    seen = F.bool_or((F.col("page_no") <= most) & (F.length(strip(F.coalesce("text", F.lit("")))) > 0))
    return pages.groupBy("batch_id").agg(F.coalesce(seen, F.lit(False)).alias("has_text"))


def layouts(rows: DataFrame) -> DataFrame:
    """vertical if the top left cell of the first table has both 序號 and 姓名, else horizontal."""
    top = F.max(F.when((F.col("tbl") == 0) & (F.col("r") == 0) & (F.col("c") == 0), F.coalesce("text", F.lit(""))))
    first = rows.groupBy("batch_id").agg(top.alias("top"))
    return first.select("batch_id", F.when(F.contains("top", F.lit("序號")) & F.contains("top", F.lit("姓名")), "vertical").otherwise("horizontal").alias("layout"))


def layout_label(layout: Column) -> Column:
    """A layout as shown."""
    out = layout
    for kind, text in rules.LAYOUT_LABELS.items():
        out = F.when(layout == kind, text).otherwise(out)
    return out


def _alias(label: Column) -> Column:
    out = F.lit(None).cast("string")
    for text, field in rules.FIELD_ALIASES.items():
        out = F.when(label == text, field).otherwise(out)
    return out


def _finished(people: DataFrame) -> DataFrame:
    """Sums the two parts of tutor's pay; missing measures are 0, other amounts null."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    return people.select("batch_id", "row_ord", "seq", "name", "title", *[zero(c).alias(c) for c in ("pay", "prof", "mgr")], (zero("_tutor") + zero("_special")).alias("tutor"), "region", "gross", "net")


def vertical(rows: DataFrame) -> DataFrame:
    """One person per column: the head cell holds number, name and title on lines; the first column holds labels.

    A number's first head gives the person, the last amounts count. Tables whose own corner lacks 序號 are skipped.
    """
    own = rows.groupBy("batch_id", "tbl").agg(F.max(F.when((F.col("r") == 0) & (F.col("c") == 0), F.coalesce("text", F.lit("")))).alias("corner")).where(F.contains("corner", F.lit("序號")))
    rows = rows.join(own.select("batch_id", "tbl"), ["batch_id", "tbl"], "left_semi")
    parts = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), strip), lambda x: x != "")
    heads = rows.where("r = 0 and c > 0").select("batch_id", "tbl", "c", parts.alias("p")).where((F.size("p") > 0) & is_number_cell(F.get("p", F.lit(0))))
    heads = heads.select("batch_id", "tbl", "c", F.get("p", F.lit(0)).try_cast("bigint").alias("seq"), F.coalesce(F.get("p", F.lit(1)), F.lit("")).alias("name"), F.coalesce(F.get("p", F.lit(2)), F.lit("")).alias("title"))
    labels = rows.where("r > 0 and c = 0").select("batch_id", "tbl", "r", _alias(strip(F.coalesce("text", F.lit("")))).alias("field")).where("field is not null")
    amounts = rows.where("r > 0 and c > 0").select("batch_id", "tbl", "r", "c", money(F.col("text")).alias("amount")).join(labels, ["batch_id", "tbl", "r"]).join(heads.select("batch_id", "tbl", "c", "seq"), ["batch_id", "tbl", "c"])
    place = F.struct("tbl", "c", "r")
    values = amounts.groupBy("batch_id", "seq").agg(*[F.max_by("amount", F.when(F.col("field") == f, place)).alias(f) for f in FIELDS])
    at = F.struct("tbl", "c")
    people = heads.groupBy("batch_id", "seq").agg(F.min_by("name", at).alias("name"), F.min_by("title", at).alias("title"))
    return _finished(people.join(values, ["batch_id", "seq"], "left").withColumn("row_ord", F.col("seq")))


def horizontal(rows: DataFrame) -> DataFrame:
    """One person per row under the first row of a table that has a cell with 姓名; of equal columns the last counts.

    Names of one letter and rows of sums are skipped; a name's first row counts.
    """
    text = strip(F.coalesce("text", F.lit("")))
    head = rows.where(F.contains("text", F.lit("姓名"))).groupBy("batch_id", "tbl").agg(F.min("r").alias("head"))
    rows = rows.join(head, ["batch_id", "tbl"])
    role = F.when(text.contains("姓名"), "name").when(text.contains("職稱"), "title").otherwise(_alias(text))
    roles = rows.where("r = head").select("batch_id", "tbl", "c", role.alias("role")).where("role is not null").groupBy("batch_id", "tbl", "role").agg(F.max("c").alias("c"))
    body = rows.where("r > head").select("batch_id", "tbl", "r", "c", text.alias("cell"), money(F.col("text")).alias("amount")).join(roles, ["batch_id", "tbl", "c"])
    value = lambda f: F.max(F.when(F.col("role") == f, F.col("amount"))).alias(f)
    people = body.groupBy("batch_id", "tbl", "r").agg(F.max(F.when(F.col("role") == "name", F.col("cell"))).alias("name"), F.coalesce(F.max(F.when(F.col("role") == "title", F.col("cell"))), F.lit("")).alias("title"), *[value(f) for f in FIELDS])
    people = people.where((F.length("name") >= 2) & ~has_any(F.col("name"), rules.SKIP_NAMES))
    first = F.row_number().over(W.partitionBy("batch_id", "name").orderBy("tbl", "r"))
    people = people.withColumn("__k", first).where("__k = 1").withColumn("row_ord", F.col("tbl").cast("bigint") * 1_000_000 + F.col("r")).withColumn("seq", F.lit(None).cast("bigint"))
    return _finished(people)


def parse(rows: DataFrame) -> DataFrame:
    """People of all batches, each by its own layout.

    The cells are read once, with their layout, and kept; both layouts' parts read what is kept.
    """
    rows = checkpointed(rows.select("batch_id", "tbl", "r", "c", "text").join(layouts(rows), "batch_id"))
    of = lambda kind: rows.where(F.col("layout") == kind).drop("layout")
    return vertical(of("vertical")).withColumn("layout", F.lit("vertical")).unionByName(horizontal(of("horizontal")).withColumn("layout", F.lit("horizontal")))
