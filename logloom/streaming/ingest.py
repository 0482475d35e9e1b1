"""The stream from the queue to the log table.

Each batch is decoded and flattened without a shuffle and written to a folder that its
number names, replacing what an earlier try of the same batch has left there.  The
checkpoint makes a batch that is run again read the same offsets.  Together each message
is in the table once, whatever fails in between; messages that can't be decoded are in
the dead letters, once too.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logloom.functions.scalars import delay, record_size
from logloom.operators.decode import decode
from logloom.operators.flatten import dead_letters, logs


def retried(write: Callable[[], None], attempts: int = 5, base_ms: int = 100, most_ms: int = 5000) -> None:
    """Tries ``attempts`` times, waiting longer each time; then the failure stands and nothing is dropped."""
    for attempt in range(1, attempts + 1):
        try:
            return write()
        except Exception:
            if attempt == attempts:
                raise
            time.sleep(delay(attempt, base_ms, most_ms))


def writer(table: str, letters: str | None = None, hex_ids: bool = False, attempts: int = 5, stats: Stats | None = None) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` calls: writes a batch's rows and dead letters into folders of their own.

    ``stats`` learns how many rows and estimated bytes went by, as they pass.
    """

    def run(batch: DataFrame, number: int) -> None:
        decoded = decode(batch, hex_ids).persist()
        try:
            rows = logs(decoded).sortWithinPartitions("_kafka_partition", "_kafka_offset")

            def write() -> None:
                seen = Observation()
                counts = F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(record_size()), F.lit(0)).alias("size")
                rows.observe(seen, *counts).write.mode("overwrite").parquet(f"{table}/batch_id={number}")
                if stats:
                    stats.add(number, **seen.get)

            retried(write, attempts)
            if letters:
                retried(lambda: dead_letters(decoded).write.mode("overwrite").parquet(f"{letters}/batch_id={number}"), attempts)
        finally:
            decoded.unpersist()

    return run


def unseen(rows: DataFrame, batch: DataFrame, there: DataFrame) -> DataFrame:
    """Those of ``rows``, made from ``batch``, whose messages are not in the table ``there``.

    A batch has a range of offsets for each partition: one row each, gathered here so that
    they reach the table's files as values to skip by.
    """
    ranges = batch.groupBy("topic", "partition").agg(F.min("offset").alias("low"), F.max("offset").alias("high")).collect()
    within = F.lit(False)
    for r in ranges:
        within = within | ((F.col("_kafka_topic") == r.topic) & (F.col("_kafka_partition") == r.partition) & F.col("_kafka_offset").between(r.low, r.high))
    keys = ["_kafka_topic", "_kafka_partition", "_kafka_offset"]
    return rows.join(there.where(within).select(*keys).distinct(), keys, "left_anti").select(*rows.columns)


def iceberg_writer(table: str, hex_ids: bool = False, attempts: int = 5) -> Callable[[DataFrame, int], None]:
    """The same for a catalog table: rows of the batch's messages that are there already are left out."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = logs(decode(batch, hex_ids))
        retried(lambda: unseen(rows, batch, spark.table(table)).writeTo(table).append(), attempts)

    return run


def start(queue: DataFrame, table: str, checkpoint: str, letters: str | None = None, seconds: int | None = None, hex_ids: bool = False, stats: Stats | None = None) -> StreamingQuery:
    """Starts the stream: every ``seconds``, or through all there is now and then stops."""
    stream = queue.writeStream.foreachBatch(writer(table, letters, hex_ids, stats=stats)).option("checkpointLocation", checkpoint).queryName("logs")
    stream = stream.trigger(processingTime=f"{seconds} seconds") if seconds else stream.trigger(availableNow=True)
    return stream.start()


def flush(query: StreamingQuery) -> None:
    """Returns when all that was on the queue is in the table."""
    query.processAllAvailable()


def health(query: StreamingQuery) -> dict:
    """State of the stream for probes: whether it runs, and what it does."""
    failed = query.exception()
    return {"is_running": query.isActive, "ready": query.isActive and not failed, "message": query.status["message"], "error": str(failed) if failed else ""}


def end_offsets(query: StreamingQuery) -> list:
    """Where the sources of the last batch ended."""
    progress = query.lastProgress
    return [s["endOffset"] for s in json.loads(progress.json)["sources"]] if progress else []


class Stats:
    """Rows and estimated bytes of the batches written so far; a batch that is written again counts once."""

    def __init__(self):
        self.total_buffer_records = self.total_buffer_size_bytes = 0
        self.last, self.is_running = -1, False

    def add(self, number: int, records: int, size: int) -> None:
        if number > self.last:
            self.last = number
            self.total_buffer_records += records
            self.total_buffer_size_bytes += size

    def as_json(self) -> str:
        return json.dumps({"total_buffer_size_bytes": self.total_buffer_size_bytes, "total_buffer_records": self.total_buffer_records, "is_running": self.is_running})


def to_console(queue: DataFrame, checkpoint: str) -> StreamingQuery:
    """Shows sizes of messages where there is no table to write to."""
    rows = queue.select("topic", "partition", "offset", F.octet_length("value").alias("bytes"))
    return rows.writeStream.format("console").option("checkpointLocation", checkpoint).start()


def late_counts(logs_stream: DataFrame, watermark: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """Rows by minute, service and severity by event time; what comes later than the watermark is left out."""
    stamped = logs_stream.withColumn("event_time", F.to_timestamp(F.col("timestamp").cast("string")))
    return stamped.withWatermark("event_time", watermark).groupBy(F.window("event_time", window), "service_name", "severity").agg(F.count("*").alias("n"))
