"""Types of the log table, the queue and a decoded request."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT = T.StringType()
_PAIRS = T.ArrayType(T.StructType([T.StructField("key", _TEXT), T.StructField("value", _TEXT)]))

#: The log table; no column is ever null.
LOGS = T.StructType([
    T.StructField("_kafka_topic", _TEXT),
    T.StructField("_kafka_partition", T.IntegerType()),
    T.StructField("_kafka_offset", T.LongType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("severity", _TEXT),
    T.StructField("body", _TEXT),
    T.StructField("trace_id", _TEXT),
    T.StructField("span_id", _TEXT),
    T.StructField("service_name", _TEXT),
    T.StructField("deployment_environment", _TEXT),
    T.StructField("host_name", _TEXT),
    T.StructField("attributes", T.MapType(_TEXT, _TEXT)),
])

#: What the receiver puts on the queue.
ENVELOPE = T.StructType([
    T.StructField("content_type", _TEXT),
    T.StructField("telemetry_type", T.IntegerType()),
    T.StructField("payload", T.BinaryType()),
])

#: A row of the queue, shaped like one of Kafka's.
QUEUE = T.StructType([
    T.StructField("topic", _TEXT),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("value", T.BinaryType()),
])

#: A request as it arrives over HTTP.
REQUEST = T.StructType([
    T.StructField("method", _TEXT),
    T.StructField("path", _TEXT),
    T.StructField("content_type", _TEXT),
    T.StructField("content_encoding", _TEXT),
    T.StructField("body", T.BinaryType()),
])

_RECORD = T.StructType([
    T.StructField("time", T.LongType()),
    T.StructField("observed", T.LongType()),
    T.StructField("severity_number", T.IntegerType()),
    T.StructField("severity_text", _TEXT),
    T.StructField("body", _TEXT),
    T.StructField("trace_id", T.BinaryType()),
    T.StructField("span_id", T.BinaryType()),
    T.StructField("attributes", _PAIRS),
])

#: Resources of a request, each with its scopes, each with its records; values are text already.
RESOURCES = T.ArrayType(T.StructType([
    T.StructField("attributes", _PAIRS),
    T.StructField("scopes", T.ArrayType(T.StructType([T.StructField("records", T.ArrayType(_RECORD))]))),
]))

DECODED = T.StructType([T.StructField("resources", RESOURCES), T.StructField("error", _TEXT)])

#: Attributes of a resource that have a column of their own.
PROMOTED = {"service.name": "service_name", "deployment.environment": "deployment_environment", "host.name": "host_name"}

JSON_TYPES = ("application/json", "text/json")
PROTOBUF_TYPES = ("application/x-protobuf", "application/protobuf")
TOPIC = "otel-logs"
OTEL_LOGS = 1
