"""Structured Streaming forms of the session and token operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.streaming.ordered import run
from colloquy.tables import shared_dir


def closed_sessions(activity: DataFrame, key: str, gap: str = "180 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions by key that a watermark has closed: (key, start, last, n). Open ones are withheld until it passes them."""
    of = F.session_window("ts", gap)
    found = activity.withWatermark("ts", late).groupBy(key, of).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return found.select(key, F.col("session_window.start").alias("start"), "last", "n")


def windowed_counts(activity: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return activity.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def first_submissions(utterances: DataFrame, key: str = "utterance_id", late: str = "10 minutes") -> DataFrame:
    """One row for each utterance, however often it is submitted within the watermark."""
    return utterances.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def upsert_latest(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The last value by key so far, for update mode and a sink that merges by key."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def upserts(stream: DataFrame, path: str, checkpoint: str, key: str, order: str, value: str) -> None:
    """All of a stream's input that is there, merged by key into the table at path; `upserted` reads it.

    A micro-batch writes its last value by key to a folder of its own, named by its number, in place of what a failed or repeated run of the
    same batch left there: a batch that runs again changes nothing, and a stream that was killed goes on to the same table.
    """

    def merge(batch: DataFrame, number: int) -> None:
        upsert_latest(batch, key, order, value).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upserted(spark: SparkSession, path: str, key: str, order: str, value: str) -> DataFrame:
    """The last value by key of what `upserts` has merged; of equal orders the latest batch's."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    last = F.struct(order, "batch")
    return rows.groupBy(key).agg(F.max_by(value, last).alias(value), F.max(order).alias(order))


def compacted(spark: SparkSession, path: str, to: str, key: str, order: str, value: str) -> DataFrame:
    """The table written whole to another folder, as its batch 0, for streams that have run long."""
    upserted(spark, path, key, order, value).write.mode("overwrite").parquet(f"{to}/batch=0")
    return upserted(spark, to, key, order, value)


def replay(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All of a stream's input that is there, run through it to an in-memory table: for tests and examples."""
    checkpoint = f"{shared_dir(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def written(stream: DataFrame, name: str) -> DataFrame:
    """All of a stream's input that is there, run through it to Parquet in the shared folder, where its checkpoint is too."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    run(stream, path, f"{path}-checkpoint")
    return spark.read.schema(stream.schema).parquet(path)


def event_stream(spark: SparkSession, folder: str, glob: str = "events.parquet") -> DataFrame:
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
