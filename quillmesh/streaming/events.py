"""Structured Streaming forms of the event-log reports (extensions: the batch model has no event time)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def event_stream(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """The events table as a file stream, its time as a timestamp."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """[T06] Events an hour and type, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("hour"), "event_type", "n", "value")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """[T05] The first event of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def breaker(events: DataFrame, most: int = 3) -> DataFrame:
    """[T03, T10] The failure streak of each key, and whether its breaker is open (streak of at least ``most``).

    events: key, ts, failed. State is the streak; a key's events of a batch are taken in time order.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("ts")
        out = []
        for ts, failed in zip(rows["ts"], rows["failed"], strict=True):
            streak = streak + 1 if failed else 0
            out.append((key[0], ts, streak, streak >= most))
        state.update((streak,))
        yield pd.DataFrame(out, columns=["key", "ts", "streak", "open"])

    return events.groupBy("key").applyInPandasWithState(step, "key string, ts timestamp, streak long, open boolean", "streak long", "append", GroupStateTimeout.NoTimeout)


def run_available(df: DataFrame, batch, checkpoint: str, mode: str = "append"):
    """[T01, T07] Run a stream over what is there, handing each micro-batch to ``batch``, with resumable state."""
    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
    query.awaitTermination()
    return query


def running_means(spark: SparkSession, path: str):
    """[T08, W11] A batch function that merges counts and sums by key into a snapshot table."""
    from quillmesh.operators.mutations import Snapshots

    table = Snapshots(spark, path)

    def merge(df: DataFrame, epoch: int) -> None:
        new = df.groupBy("key").agg(F.count("*").alias("n"), F.sum("value").alias("s"))
        if table.version():
            new = table.read().select("key", "n", "s").unionByName(new).groupBy("key").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        table.write(new.withColumn("mean", F.col("s") / F.col("n")))

    return merge
