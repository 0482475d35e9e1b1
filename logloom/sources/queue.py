"""The queue: Kafka where its connector is at hand, else a folder of files with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.config import AppenderConfig, ReceiverConfig
from logloom.schema import QUEUE


def writer_options(config: ReceiverConfig) -> dict[str, str]:
    """Options of Kafka's sink: no key, all replicas, in order and once."""
    acks = "all" if config.acks == -1 else str(config.acks)
    return {
        "kafka.bootstrap.servers": config.brokers,
        "topic": config.topic,
        "kafka.acks": acks,
        "kafka.enable.idempotence": str(acks == "all").lower(),
        "kafka.compression.type": config.compression,
        "kafka.linger.ms": "10",
        "kafka.retry.backoff.ms": "100",
        "kafka.buffer.memory": str(1 << 30),
    }


def reader_options(config: AppenderConfig, starting_offsets: str = "earliest") -> dict[str, str]:
    """Options of Kafka's source; the checkpoint takes the place of committed group offsets.

    A batch starts as soon as there is enough to flush, or after the flush time.
    """
    return {
        "kafka.bootstrap.servers": config.brokers,
        "subscribe": config.topic,
        "kafka.group.id": config.group,
        "startingOffsets": starting_offsets,
        "failOnDataLoss": "true",
        "minOffsetsPerTrigger": "1000",
        "maxTriggerDelay": f"{config.flush_seconds}s",
    }


def from_kafka(spark: SparkSession, config: AppenderConfig, starting_offsets: str = "earliest") -> DataFrame:
    rows = spark.readStream.format("kafka").options(**reader_options(config, starting_offsets)).load()
    return rows.select([F.col(f.name).cast(f.dataType) for f in QUEUE.fields])


def to_kafka(envelopes: DataFrame, config: ReceiverConfig) -> None:
    envelopes.select("value").write.format("kafka").options(**writer_options(config)).save()


def from_files(spark: SparkSession, folder: str, files_per_batch: int | None = None, bytes_per_batch: str | None = None) -> DataFrame:
    """A stream over the queue's files; a batch takes so many files, or so many bytes."""
    reader = spark.readStream.schema(QUEUE)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    return reader.parquet(folder)


def to_files(rows: DataFrame, folder: str) -> None:
    rows.select(*QUEUE.names).write.mode("append").parquet(folder)
