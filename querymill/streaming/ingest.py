"""Items that keep arriving: the same stateless plans on a stream, appended to metric tables batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from querymill import sinks
from querymill.operators import normalize
from querymill.operators.audit import audit

ITEM = "id string, db_id string, question string, sql string"


def read_items(spark: SparkSession, folder: str, schema: str = ITEM, files_per_trigger: int = 1000) -> DataFrame:
    """JSON lines files of a folder, as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def audit_stream(items: DataFrame, out: str, checkpoint: str, dataset: str = "stream", once: bool = False) -> StreamingQuery:
    """Audits each batch and appends it to metrics_query_audit. A batch that is tried again replaces itself:
    its rows go to a folder of their own, named by the batch."""

    def write(batch: DataFrame, number: int) -> None:
        done = audit(batch).withColumn("status", F.when(F.col("parseable"), "ok").otherwise("failed"))
        sinks.envelope(done.drop("ts", "name"), "query_audit", "query_analysis", dataset).write.mode("overwrite").parquet(f"{out}/metrics_query_audit/dataset_id={dataset}/batch={number}")

    writer = items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def numbered_stream(items: DataFrame, out: str, checkpoint: str, order: list[str], start: int = 1, once: bool = False) -> StreamingQuery:
    """Items without id numbered in `order` from start, batch after batch, below out/batch=N.

    A batch begins after the numbers that earlier batches gave, which are read from what they wrote: one
    that is tried again gives the same numbers and replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        given = 0
        if number:
            given = spark.read.option("mergeSchema", False).parquet(out).where((F.col("batch") < number) & F.col("assigned")).count()
        marked = batch.withColumn("assigned", F.col("id").isNull() | (F.trim("id") == ""))
        normalize.incremental_ids(marked, order, start + given).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def with_health(items: DataFrame, health: DataFrame) -> DataFrame:
    """Items of a stream with the health of their database, from a table at rest (db_id, health); unknown where it has none.

    Spark reads the table anew for each batch and broadcasts it where it is small enough.
    """
    known = health.groupBy("db_id").agg(F.min("health").alias("health"))
    return items.join(known, "db_id", "left").withColumn("health", F.coalesce("health", F.lit("unknown")))


def first_seen(items: DataFrame, key: str = "db_id", event_time: str | None = None, horizon: str = "7 days") -> DataFrame:
    """The first row of each key, for work done once a database; with an event time, state older than horizon is dropped."""
    if event_time:
        return items.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark([key])
    return items.dropDuplicates([key])


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Beyond the batch reports: events by window and kind, late ones up to `late` included."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), kind, "events", "value")


def session_counts(events: DataFrame, time: str = "ts", user: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by session of a user."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), user).agg(F.count(F.lit(1)).alias("events")).select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), user, "events")
