"""Requests, messages and a queue made from the ``events`` table, for queries and measurements."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import otlp
from logloom.functions.scalars import nanos_of
from logloom.operators.decode import envelope
from logloom.schema import TOPIC

PER_MESSAGE, PARTITIONS = 5, 3


def _text(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), F.struct(value.cast("string").alias("stringValue"), _none("intValue"), _none("doubleValue", "double")).alias("value"))


def _none(name: str, kind: str = "string") -> Column:
    return F.lit(None).cast(kind).alias(name)


def _resource(event: Column) -> Column:
    """An event as a resource with one scope and one record."""
    number = F.when(event["event_type"] == "error", 17).when(event["event_type"] == "view", 5)
    digest = F.md5(event["event_id"].cast("string").cast("binary"))
    ids = lambda text: F.base64(F.unhex(text))
    attributes = F.array(
        _text("event.type", event["event_type"]),
        F.struct(F.lit("event.value").alias("key"), F.struct(_none("stringValue"), _none("intValue"), event["value"].alias("doubleValue")).alias("value")),
        F.struct(F.lit("user.id").alias("key"), F.struct(_none("stringValue"), event["user_id"].cast("string").alias("intValue"), _none("doubleValue", "double")).alias("value")),
        _text("shared", F.lit("record")),
    )
    record = F.struct(
        nanos_of(event["ts"]).cast("string").alias("timeUnixNano"),
        number.cast("int").alias("severityNumber"),
        F.when(event["event_type"] == "purchase", "INFO").alias("severityText"),
        F.struct(event["props"].alias("stringValue")).alias("body"),
        attributes.alias("attributes"),
        ids(digest).alias("traceId"),
        ids(F.substring(digest, 1, 16)).alias("spanId"),
    )
    user = event["user_id"]
    resource = F.struct(
        F.array(
            _text("service.name", F.concat(F.lit("svc-"), user % 10)),
            _text("host.name", F.concat(F.lit("host-"), user % 50)),
            _text("deployment.environment", F.when(user % 2 == 0, "prod").otherwise("staging")),
            _text("shared", F.lit("resource")),
        ).alias("attributes")
    )
    return F.struct(resource.alias("resource"), F.array(F.struct(F.array(record).alias("logRecords"))).alias("scopeLogs"))


def messages(events: DataFrame) -> DataFrame:
    """``topic``, ``partition``, ``offset``, ``payload``: up to five events a message, as JSON."""
    key = (F.col("user_id") % PARTITIONS).cast("int").alias("partition"), F.expr(f"event_id div {PER_MESSAGE}").alias("offset")
    # The events themselves are grouped, which are much smaller than the resources made of them.
    grouped = events.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("event_id", "ts", "user_id", "event_type", "value", "props"))).alias("rows"))
    payload = F.to_json(F.struct(F.transform("rows", _resource).alias("resourceLogs")))
    return grouped.select(F.lit(TOPIC).alias("topic"), "partition", "offset", payload.alias("payload"))


def queue(events: DataFrame) -> DataFrame:
    """The messages in their envelopes."""
    return messages(events).select("topic", "partition", "offset", envelope(F.lit("application/json"), F.col("payload").cast("binary")).alias("value"))


def as_protobuf(rows: DataFrame) -> DataFrame:
    """Messages with JSON payloads as a queue with protobuf payloads."""

    @F.arrow_udf("binary")
    def encode(payloads: pa.Array) -> pa.Array:
        return pa.array([otlp.encoded(p.encode()) for p in payloads.to_pylist()], pa.binary())

    return rows.select("topic", "partition", "offset", envelope(F.lit("application/x-protobuf"), encode("payload")).alias("value"))


def protobuf_queue(events: DataFrame) -> DataFrame:
    """The same messages with protobuf payloads."""
    return as_protobuf(messages(events))


def messages_of_all_values(events: DataFrame) -> DataFrame:
    """A message for each event: values of all kinds, quotes and backslashes, times that are missing, requests without records.

    The body's kind follows from the id by seven, its time by five, and each tenth request
    is empty in one of four ways.
    """
    i, as_text = F.col("event_id"), F.col("event_id").cast("string")
    text = lambda s: F.struct(s.alias("stringValue"))
    values = {
        "stringValue": F.concat(F.lit("it's \\ '"), as_text),
        "boolValue": i % 2 == 0,
        "intValue": (-i).cast("string"),
        "doubleValue": F.col("value"),
        "bytesValue": F.base64(as_text.cast("binary")),
        "arrayValue": F.struct(F.array(text(F.lit("a,b")), text(as_text)).alias("values")),
        "kvlistValue": F.struct(F.array(F.struct(F.lit("z").alias("key"), text(as_text).alias("value")), F.struct(F.lit("a").alias("key"), text(F.lit("x")).alias("value"))).alias("values")),
    }
    value = F.struct(*[F.when(i % 7 == n, v).alias(name) for n, (name, v) in enumerate(values.items())])
    nanos = nanos_of(F.col("ts")).cast("string")
    attributes = F.array(F.struct(F.lit("q'k\\").alias("key"), value.alias("value")))
    record = F.struct(F.when(i % 5 < 3, nanos).alias("timeUnixNano"), F.when(i % 5 == 3, nanos).alias("observedTimeUnixNano"), value.alias("body"), attributes.alias("attributes"))
    full = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.array(record).alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs")))
    empty = F.element_at(F.array(*map(F.lit, ("{}", '{"resourceLogs":[]}', '{"resourceLogs":[{}]}', '{"resourceLogs":[{"scopeLogs":[{},{"logRecords":[]}]}]}'))), (i / 10 % 4 + 1).cast("int"))
    return events.select(F.lit(TOPIC).alias("topic"), (i % PARTITIONS).cast("int").alias("partition"), i.alias("offset"), F.when(i % 10 == 0, empty).otherwise(full).alias("payload"))
