"""Buffers: sizes, counts, and where they are flushed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.scalars import record_size

MIB = 1 << 20
#: Offsets of a partition that are numbered in one task.
STRETCH = 1 << 20


def buffer_stats(logs: DataFrame) -> DataFrame:
    """``partition``, ``buffer_records``, ``buffer_bytes``."""
    return logs.groupBy(F.col("_kafka_partition").alias("partition")).agg(F.count("*").alias("buffer_records"), F.sum(record_size()).alias("buffer_bytes"))


def totals(stats: DataFrame) -> DataFrame:
    return stats.agg(F.coalesce(F.sum("buffer_records"), F.lit(0)).alias("total_buffer_records"), F.coalesce(F.sum("buffer_bytes"), F.lit(0)).alias("total_buffer_size_bytes"))


def message_sizes(logs: DataFrame) -> DataFrame:
    """``partition``, ``offset``, ``records``, ``bytes`` of each message."""
    return logs.groupBy(F.col("_kafka_partition").alias("partition"), F.col("_kafka_offset").alias("offset")).agg(F.count("*").alias("records"), F.sum(record_size()).alias("bytes"))


def _in_order(rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """A stretch in the order of its offsets, and the bytes up to each of its messages."""
    rows = rows.sort_by([(c, "ascending") for c in ("offset", "bytes", "records")])
    return rows, np.cumsum(rows["bytes"].to_numpy())


def _next_flush(upto: np.ndarray, start: int, held: int, limit: int) -> int:
    """Which message fills a batch that has ``held`` bytes before message ``start``; their number if none does."""
    before = int(upto[start - 1]) if start else 0
    return max(start, int(np.searchsorted(upto, before + limit - held)))


def _outcomes(rows: pa.Table, limit: int) -> pa.Table:
    """For each message of a stretch that may be its first to flush: the bytes up to it, the flushes from it on, and the bytes then left."""
    rows, upto = _in_order(rows)
    n = len(upto)
    ends = np.maximum(np.arange(n), np.searchsorted(upto, np.concatenate([[0], upto[:-1]]) + limit)).tolist()
    flushes, left = [0] * (n + 1), [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        if ends[i] == n:
            left[i] = int(upto[-1] - upto[i - 1]) if i else int(upto[-1])
        else:
            flushes[i], left[i] = flushes[ends[i] + 1] + 1, left[ends[i] + 1]
    first = range(min(ends[0] + 1, n))
    own = rows.select(["partition", "stretch"]).slice(0, len(first))
    columns = [first, upto[: len(first)], [flushes[j + 1] + 1 for j in first], [left[j + 1] for j in first], [int(upto[-1])] * len(first)]
    return pa.table([*own.columns, *[pa.array(c, pa.int64()) for c in columns]], names=[*own.column_names, "place", "upto", "flushes", "left", "total"])


def _begun(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """From the outcomes in order the number of the batch and the bytes that each stretch begins with."""
    now, batch, held, rest = (None, None), 0, 0, 0
    for rows in batches:
        out = []
        for partition, stretch, upto, flushes, left, total in zip(*[rows.column(c).to_pylist() for c in ("partition", "stretch", "upto", "flushes", "left", "total")]):
            if (partition, stretch) != now:
                # ``rest`` is what the stretch before adds if none of its messages has flushed.
                batch, held = (batch, held + rest) if partition == now[0] else (0, 0)
                now, rest, flushed = (partition, stretch), total, False
                out.append((partition, stretch, batch, held))
            if not flushed and held + upto >= limit:
                batch, held, rest, flushed = batch + flushes, left, 0, True
        yield pa.RecordBatch.from_pylist([dict(zip(("of", "from", "batch", "held"), x)) for x in out], pa.schema([("of", pa.int32()), ("from", pa.int64()), ("batch", pa.int64()), ("held", pa.int64())]))


def _numbered(rows: pa.Table, begun: pa.Table, limit: int) -> pa.Table:
    """The messages of a stretch with their batches."""
    rows, upto = _in_order(rows)
    batch, held, start = begun["batch"][0].as_py(), begun["held"][0].as_py(), 0
    numbers = np.empty(len(upto), np.int64)
    while start < len(upto):
        end = _next_flush(upto, start, held, limit)
        numbers[start : end + 1] = batch
        batch, held, start = batch + 1, 0, end + 1
    return rows.drop_columns(["stretch"]).append_column("batch", pa.array(numbers))


def flush_batches(messages: DataFrame, limit: int, stretch: int = STRETCH) -> DataFrame:
    """Adds ``batch``: messages of a partition in order fill a batch until it has ``limit`` bytes.

    The count starts again at each flush, so a batch depends on all before it.  Yet what a
    stretch of ``stretch`` offsets does depends only on which of its messages flushes
    first, and that is one within its first ``limit`` bytes.  So stretches are solved apart
    for each of these; one pass over the outcomes in order tells what each stretch begins
    with; then they are numbered, apart again, from the same shuffle.
    """
    rows = messages.select("partition", "offset", "records", "bytes", F.floor(F.col("offset") / stretch).alias("stretch"))
    stretches = rows.groupBy("partition", "stretch")
    outcomes = stretches.applyInArrow(lambda own: _outcomes(own, limit), "partition int, stretch bigint, place bigint, upto bigint, flushes bigint, left bigint, total bigint")
    outcomes = outcomes.repartition("partition").sortWithinPartitions("partition", "stretch", "place")
    begun = outcomes.mapInArrow(lambda batches: _begun(batches, limit), "of int, from bigint, batch bigint, held bigint")
    both = stretches.cogroup(begun.groupBy("of", "from"))
    return both.applyInArrow(lambda own, first: _numbered(own, first, limit), "partition int, offset bigint, records bigint, bytes bigint, batch bigint")


class BufferPolicy:
    """When a buffer is due, by bytes or by seconds since the last flush."""

    def __init__(self, limit_bytes: int, limit_seconds: float, now: float = 0.0):
        self.limit_bytes, self.limit_seconds = limit_bytes, limit_seconds
        self.reset(now)

    def reset(self, now: float) -> None:
        self.bytes, self.since = 0, now

    def add(self, size: int) -> bool:
        self.bytes += size
        return self.bytes >= self.limit_bytes

    def late(self, now: float) -> bool:
        return now - self.since >= self.limit_seconds
