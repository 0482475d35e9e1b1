"""Offsets: how far the table has come, and what is left to read."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recovered(logs: DataFrame, topic: str) -> DataFrame:
    """``partition``, ``max_offset`` of a topic in the table."""
    rows = logs.where(F.col("_kafka_topic") == topic)
    return rows.groupBy(F.col("_kafka_partition").alias("partition")).agg(F.max("_kafka_offset").alias("max_offset"))


def recovered_of(logs: DataFrame, topic: str, partition: int) -> DataFrame:
    """``max_offset`` of one partition; -1 if the table has none of it."""
    rows = logs.where((F.col("_kafka_topic") == topic) & (F.col("_kafka_partition") == partition))
    return rows.agg(F.coalesce(F.max("_kafka_offset"), F.lit(-1).cast("bigint")).alias("max_offset"))


def resumed(queue: DataFrame, done: DataFrame) -> DataFrame:
    """The rows of the queue beyond what the table holds.

    ``done`` has a row for each partition; Spark sends it to all tasks if it is as small as that.
    """
    rows = queue.join(done.withColumnRenamed("partition", "__p"), F.col("partition") == F.col("__p"), "left")
    return rows.where(F.col("offset") > F.coalesce("max_offset", F.lit(-1))).drop("__p", "max_offset")


def starting_offsets(done: DataFrame, topic: str) -> str:
    """The Kafka source's ``startingOffsets`` for the offset behind the last one of each partition."""
    return json.dumps({topic: {str(r.partition): r.max_offset + 1 for r in done.collect()}})


def pending(batch: DataFrame) -> DataFrame:
    """``partition``, ``max_offset`` of what a batch of the queue holds."""
    return batch.groupBy("partition").agg(F.max("offset").alias("max_offset"))
