"""Learning which titles to set aside, batch by batch, in a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from tallyweave.operators import exclude
from tallyweave.sources import state

#: What is remembered of each batch: its tenant and place, and of each of its titles the counts. A row of null title says that there was a batch.
SEEN = "batch_id string, tenant string, batch_ord long, title string, total long, in_af long"


def remembered(spark: SparkSession, folder: str) -> DataFrame:
    """All observations so far; a batch is a folder of its own, written anew as a whole."""
    return state.read_if_there(spark, f"{folder}/seen", SEEN)


def marked(spark: SparkSession, folder: str) -> DataFrame:
    """The people of all batches so far, as they were marked when their batch came."""
    rows = spark.read.parquet(f"{folder}/marked")
    # A batch's id is a text, also where all of them look like numbers.
    fields = [f if f.name != "batch_id" else T.StructField("batch_id", T.StringType()) for f in rows.schema]
    return spark.read.schema(T.StructType(fields)).parquet(f"{folder}/marked")


def step(people: DataFrame, known: DataFrame, folder: str, settings: DataFrame | None = None) -> None:
    """One part of the stream: `people` (batch_id, tenant, batch_ord, title, name, ...) of whole batches.

    They are observed against the register's names `known` (batch_id, name), the observations take the place of what the
    same batches had before, and the people are marked by what all observations up to their batch teach. Both tables are
    written by batch, so that a part that is run again, after a failure at any point, leaves what one run leaves. Titles
    that a later batch teaches don't change the batches before.
    """
    spark = people.sparkSession
    batches = people.select("batch_id", "tenant", "batch_ord").distinct()
    seen = exclude.observe(people, known).join(batches, "batch_id")
    rows = seen.select("batch_id", "tenant", "batch_ord", "title", "total", "in_af").unionByName(batches.select("batch_id", "tenant", "batch_ord"), allowMissingColumns=True)
    state.keep_result(rows, f"{folder}/seen")
    # Read again: the batches of this part as written, and all others.
    every = remembered(spark, folder)
    done = exclude.mark_as_of(people, every.where("title IS NOT NULL"), every.select("batch_id", "tenant", "batch_ord").distinct(), settings)
    state.keep_result(done, f"{folder}/marked")


def learn_and_mark(people: DataFrame, known: DataFrame, folder: str, progress: str, settings: DataFrame | None = None) -> StreamingQuery:
    """Runs `step` for each part of a stream of people; a file's rows are one batch and come in one part."""

    def each(part: DataFrame, _: int) -> None:
        part = part.persist()
        try:
            if not part.isEmpty():
                step(part, known, folder, settings)
        finally:
            part.unpersist()

    return people.writeStream.foreachBatch(each).option("checkpointLocation", progress).trigger(availableNow=True).start()
