"""State tables: settings, title statistics, counters; missing ones are empty."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweave.functions.lineage import shared_folder

SCHEMAS = {
    "settings": "tenant string, titles array<string>, names array<string>, use_default boolean",
    "observations": "batch_id string, title string, total long, in_af long",
    "title_stats": "title string, total long, in_af long, files long",
    "events": "key string, n long",
    "schools": "sn1 string, sn2 string, school string, row_ord long",
}


def base(spark: SparkSession) -> str:
    """The folder of the state: the setting tallyweave.state, else the warehouse, else the checkpoint folder."""
    for found in (spark.conf.get("tallyweave.state", None), spark.conf.get("spark.sql.warehouse.dir", None)):
        if found and found.strip():
            return found.strip().rstrip("/")
    return shared_folder(spark)


def location(spark: SparkSession, name: str) -> str:
    return f"{base(spark)}/{name}"


def diagnosis(spark: SparkSession) -> DataFrame:
    """One row (setting, folder, on_volume): where the state goes, and whether that lies under the setting."""
    given = (spark.conf.get("tallyweave.state", None) or "").strip()
    return spark.createDataFrame([(given, base(spark))], "setting string, folder string").select("setting", "folder", ((F.col("setting") != "") & F.startswith("folder", "setting")).alias("on_volume"))


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table with its schema; an empty one where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def load(spark: SparkSession, name: str) -> DataFrame:
    """A state table with its schema; an empty one where there is none yet. Files that can't be read are passed over, and told by `unreadable`."""
    schema = SCHEMAS[name]
    try:
        return spark.read.schema(schema).option("ignoreCorruptFiles", True).parquet(location(spark, name))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def unreadable(spark: SparkSession, name: str) -> DataFrame:
    """(path, error) of the files of a state table that can't be read; state files are small, and each is opened in a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import parquet

        for batch in batches:
            out = []
            for path, content in zip(batch.path, batch.content, strict=True):
                try:
                    parquet.read_table(io.BytesIO(content))
                except Exception as e:
                    out.append((path, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(out, columns=["path", "error"])

    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(location(spark, name))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, error string")
    return files.select("path", "content").mapInPandas(run, "path string, error string")


def append(df: DataFrame, name: str) -> None:
    """Adds rows. Readers sum or take the latest, so that nothing is read and overwritten at once."""
    df.write.mode("append").parquet(location(df.sparkSession, name))


def upserted(old: DataFrame, updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """`old` after `updates` of the same columns: of a key's updates the last by `order` takes the old row's place."""
    last = updates.withColumn("__k", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).where("__k = 1").select(*old.columns)
    return old.join(last.select(*keys), keys, "left_anti").select(*old.columns).unionByName(last)


def save(df: DataFrame, name: str) -> None:
    """Writes a whole state table as its next version. The version's number is written when its rows are, in one file, so readers see the version before until the
    new one is whole, and a table may be read to make its own next version. A version that a failure left without a number is written over. One writer at a time."""
    spark = df.sparkSession
    number = _version(spark, name) + 1
    df.write.mode("overwrite").parquet(f"{location(spark, name)}/version={number}")
    spark.range(1).select(F.lit(number).alias("number")).coalesce(1).write.mode("append").parquet(_numbers(spark, name))


def upsert(updates: DataFrame, name: str, keys: list[str], order: str) -> None:
    """Puts keyed updates into a state table; as `foreachBatch` of a stream or for a frame."""
    save(upserted(current(updates.sparkSession, name), updates, keys, order), name)


def _numbers(spark: SparkSession, name: str) -> str:
    return f"{location(spark, name)}-versions"


def _version(spark: SparkSession, name: str) -> int:
    """The newest version that is whole; 0 for none."""
    return read_if_there(spark, _numbers(spark, name), "number int").agg(F.max("number")).first()[0] or 0


def current(spark: SparkSession, name: str) -> DataFrame:
    """The newest version of a saved state table; an empty one where there is none yet."""
    version = _version(spark, name)
    if not version:
        return spark.createDataFrame([], SCHEMAS[name])
    return spark.read.schema(SCHEMAS[name]).parquet(f"{location(spark, name)}/version={version}")


def keep_result(results: DataFrame, folder: str) -> None:
    """Keeps results by batch, for later downloads; a batch's new result takes the place of its old one, other batches stay."""
    results.write.partitionBy("batch_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)


def kept_records(spark: SparkSession, folder: str, order: str, columns: list[str] | None = None) -> DataFrame:
    """(batch_id, records): each batch's kept result as a JSON array of its rows in order, null as ''; a batch is one file."""
    rows = spark.read.parquet(folder)
    columns = columns or [c for c in rows.columns if c not in ("batch_id", order)]
    record = F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]))
    placed = F.array_sort(F.collect_list(F.struct(order, record.alias("text"))))
    return rows.groupBy("batch_id").agg(F.concat(F.lit("["), F.array_join(F.transform(placed, lambda x: x["text"]), ","), F.lit("]")).alias("records"))


def counters(events: DataFrame) -> DataFrame:
    """Totals by key."""
    return events.groupBy("key").agg(F.sum("n").alias("n"))
