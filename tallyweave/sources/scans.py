"""Results of scans as they arrive: JSON messages to rows for `operators.validate`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import rules

#: Keys of the messages and the columns that they become; amounts come as numbers or texts.
KEYS = {"姓名": "name", "職稱": "title", "身分證": "person_id", "薪俸": "pay", "專業加給": "prof", "主管加給": "mgr", "導師特教": "tutor", "應發金額": "gross"}
PERSON = ", ".join(f"`{k}` string" for k in KEYS) + ", `身分證有效` boolean, `最低信心` double, `欄位信心` map<string,double>"
MESSAGE = f"job_id string, error string, people array<struct<{', '.join(f.replace(' ', ':', 1) for f in PERSON.split(', '))}>>"


def least_confidence(fields: Column, given: Column) -> Column:
    """A row's confidence: as given, else the least of its fields'."""
    return F.coalesce(given, F.array_min(F.map_values(fields)))


def messages(raw: DataFrame, value: str = "value", brief: bool = False) -> DataFrame:
    """(job_id, status, error) of each message: failed with its error, cut to 300 characters (`brief`: to 200, as in notices), else done."""
    m = raw.select(F.from_json(value, MESSAGE).alias("m"))
    return m.select("m.job_id", F.when(F.col("m.error").isNotNull(), "failed").otherwise("done").alias("status"), F.left("m.error", F.lit(200 if brief else 300)).alias("error"))


def people(raw: DataFrame, value: str = "value") -> DataFrame:
    """Scanned rows (batch_id, row_ord, name, title, person_id, id_valid, measures, gross, confidence) of all messages; a job is a batch."""
    m = raw.select(F.from_json(value, MESSAGE).alias("m")).select(F.col("m.job_id").alias("batch_id"), F.posexplode("m.people").alias("row_ord", "p"))
    p = lambda k: F.col("p").getField(k)
    return m.select("batch_id", F.col("row_ord").cast("bigint"), *[p(k).alias(c) for k, c in KEYS.items()], F.coalesce(p("身分證有效"), F.lit(False)).alias("id_valid"), least_confidence(p("欄位信心"), p("最低信心")).alias("confidence"))


def scan_summary(rows: DataFrame) -> DataFrame:
    """Per batch the rows and how many of them add up."""
    total = sum((F.coalesce(F.col(m).try_cast("bigint"), F.lit(0)) for m in rules.MEASURES), F.lit(0))
    return rows.groupBy("batch_id").agg(F.count("*").alias("n"), F.count_if((F.col("gross").try_cast("bigint") != 0) & (total == F.col("gross").try_cast("bigint"))).alias("n_ok"))


def inbox(spark, path: str, most_bytes: int = 16 << 20) -> DataFrame:
    """A stream of files dropped into a folder (path, content in base64, error); a file over `most_bytes` is refused: its content is null and its error says so."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return posted(files.load(path), most_bytes)


def posted(files: DataFrame, most_bytes: int = 16 << 20) -> DataFrame:
    """(path, content, error) of files (path, length, content)."""
    large = F.col("length") > most_bytes
    return files.select("path", F.when(~large, F.base64("content")).alias("content"), F.when(large, F.lit(f"larger than {most_bytes} bytes")).alias("error"))


def received(messages_: DataFrame) -> DataFrame:
    """The files' bytes again (path, content)."""
    return messages_.where("content is not null").select("path", F.unbase64("content").alias("content"))


def job_id() -> Column:
    """Twelve random hexadecimal digits."""
    return F.left(F.replace(F.uuid(), F.lit("-"), F.lit("")), F.lit(12))
