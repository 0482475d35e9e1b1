import base64
import json

import pytest
from pyspark.sql import functions as F

from logloom.functions import otlp
from logloom.operators.decode import decode, envelope, opened
from logloom.operators.flatten import dead_letters, logs
from logloom.schema import QUEUE

NANOS = 1672531200000000000


def request(record=None, resource=(), **more):
    return {"resourceLogs": [{"resource": {"attributes": list(resource)}, "scopeLogs": [{"logRecords": [{"timeUnixNano": str(NANOS), **(record or {})}]}]}], **more}


def attribute(key, **value):
    return {"key": key, "value": value}


def rows_of(spark, *messages, kind="application/json", **options):
    """Rows of the log table from payloads: dicts as JSON, bytes as they are."""
    wrap = otlp.messages()["RawTelemetryMessage"]
    values = [(("t", 0, i, wrap(content_type=kind, telemetry_type=1, payload=m if isinstance(m, bytes) else json.dumps(m).encode()).SerializeToString())) for i, m in enumerate(messages)]
    decoded = decode(spark.createDataFrame(values, QUEUE), **options)
    return logs(decoded).orderBy("_kafka_offset").collect(), dead_letters(decoded).collect()


def test_record(spark):
    resource = [attribute("service.name", stringValue="first"), attribute("service.name", stringValue="svc"), attribute("host.name", stringValue="h"), attribute("deployment.environment", stringValue="prod"), attribute("a", stringValue="resource"), attribute("b", intValue="1")]
    record = {"severityNumber": 17, "body": {"stringValue": "it's \\ a 'test' é"}, "attributes": [attribute("a", stringValue="x"), attribute("a", stringValue="record"), attribute("service.name", stringValue="kept")], "traceId": base64.b64encode(bytes(range(1, 17))).decode(), "spanId": base64.b64encode(bytes(range(1, 9))).decode()}
    (row,), letters = rows_of(spark, request(record, resource))
    assert not letters
    assert row.asDict() == {
        "_kafka_topic": "t", "_kafka_partition": 0, "_kafka_offset": 0, "timestamp": row.timestamp, "severity": "ERROR", "body": "it's \\ a 'test' é",
        "trace_id": "0102030405060708090a0b0c0d0e0f10", "span_id": "0102030405060708", "service_name": "svc", "deployment_environment": "prod", "host_name": "h",
        "attributes": {"a": "record", "b": "1", "service.name": "kept"},
    }
    assert str(row.timestamp) == "2023-01-01 00:00:00"


def test_keys_are_stored_in_byte_order(spark):
    """Read by map_keys: a collected map has gone through a hash map, which has an order of its own."""
    record = {"attributes": [attribute(k, stringValue=k) for k in ("service.name", "b", "a", "é", "Z", "a")]}
    value = otlp.messages()["RawTelemetryMessage"](content_type="application/json", telemetry_type=1, payload=json.dumps(request(record)).encode()).SerializeToString()
    row = logs(decode(spark.createDataFrame([("t", 0, 0, value)], QUEUE))).select(F.map_keys("attributes").alias("keys")).first()
    assert row.keys == ["Z", "a", "b", "service.name", "é"]


@pytest.mark.parametrize("value, text", [
    ({"stringValue": "x"}, "x"), ({"boolValue": True}, "true"), ({"intValue": "-9223372036854775808"}, "-9223372036854775808"), ({"intValue": 7}, "7"), ({"doubleValue": 0.0000005}, "0.000000"),
    ({"doubleValue": 0.1234565}, "0.123456"), ({"doubleValue": 1}, "1.000000"), ({"doubleValue": "Infinity"}, "inf"), ({"doubleValue": "NaN"}, "nan"), ({"bytesValue": "/+8="}, "ffef"), ({"bytesValue": "_-8"}, "ffef"),
    ({"arrayValue": {"values": [{"stringValue": "a,b"}, {"intValue": "2"}, {"arrayValue": {"values": [{"boolValue": False}]}}]}}, "a,b,2,false"),
    ({"kvlistValue": {"values": [attribute("z", stringValue="1"), attribute("a", kvlistValue={"values": [attribute("n", intValue="3")]}), {"key": "e"}]}}, "z=1,a=n=3,e="),
    ({}, ""), ({"arrayValue": {}}, ""),
])
def test_values_in_both_encodings(spark, value, text):
    message = request({"body": value, "attributes": [{"key": "k", "value": value}]})
    for payload, kind in ((message, "application/json"), (otlp.parse("application/json", json.dumps(message).encode()).SerializeToString(), "application/x-protobuf")):
        (row,), _ = rows_of(spark, payload, kind=kind)
        assert (row.body, row.attributes["k"]) == (text, text)


@pytest.mark.parametrize("message", [
    {"unknown": 1}, request({"surprise": 1}), request({"timeUnixNano": "-5"}), request({"body": {"stringValue": "a", "intValue": "1"}}), request({"timeUnixNano": str(2**63)}), b"{ invalid json }", b"[]", request({"body": {"intValue": "1.5"}}), request({"traceId": "%%%"}),
])
def test_what_cannot_be_decoded_becomes_a_dead_letter(spark, message):
    rows, letters = rows_of(spark, message, request({"body": {"stringValue": "fine"}}))
    assert [r.body for r in rows] == ["fine"] and [x.offset for x in letters] == [0] and letters[0].error_reason


def test_snake_case_nulls_numbers_and_names(spark):
    message = {"resource_logs": [{"scope_logs": [{"log_records": [{"time_unix_nano": NANOS, "severity_number": "SEVERITY_NUMBER_WARN", "severityText": None, "body": None}]}]}]}
    (row,), _ = rows_of(spark, message)
    assert (row.severity, row.body, row.service_name, row.attributes, row.trace_id) == ("WARN", "", "", {}, "")


def test_ids_as_hex(spark):
    ids = {"traceId": "0af7651916cd43dd8448eb211c80319c", "spanId": "b7ad6b7169203331"}
    assert rows_of(spark, request(ids), hex_ids=True)[0][0].trace_id == ids["traceId"]
    assert rows_of(spark, request(ids), hex_ids=True)[0][0].span_id == ids["spanId"]
    assert rows_of(spark, request(ids))[0][0].trace_id == base64.b64decode(ids["traceId"]).hex()


def test_times(spark):
    rows, _ = rows_of(spark, request({"timeUnixNano": "0", "observedTimeUnixNano": str(NANOS)}), request({"timeUnixNano": "0"}))
    assert str(rows[0].timestamp) == "2023-01-01 00:00:00" and rows[1].timestamp.year > 2023


def test_requests_without_records(spark):
    rows, letters = rows_of(spark, {}, {"resourceLogs": []}, {"resourceLogs": [{}]}, {"resourceLogs": [{"scopeLogs": [{}, {"logRecords": []}]}]})
    assert not rows and not letters
    assert rows_of(spark, b"", kind="application/x-protobuf") == ([], [])
    assert len(rows_of(spark, b"garbage", kind="application/x-protobuf")[1]) == 1
    assert len(rows_of(spark, b"x", kind="text/plain")[1]) == 1


@pytest.mark.parametrize("size", [0, 1, 127, 128, 129, 16383, 16384, 16385, 70_000])
def test_envelope(spark, size):
    payload = bytes(size)
    row = spark.createDataFrame([("application/json", payload)], "k string, p binary").select(envelope(F.col("k"), F.col("p")).alias("v")).select("v", opened(F.col("v")).alias("o")).first()
    assert bytes(row.v) == otlp.messages()["RawTelemetryMessage"](content_type="application/json", telemetry_type=1, payload=payload).SerializeToString()
    assert (row.o.content_type, bytes(row.o.payload)) == ("application/json", payload)


def test_other_envelopes_stay_closed(spark):
    values = [(b"",), (b"\x0a",), (b"\x0a\x03abc",), (b"\x1a\x01x",), (bytes(range(60)),)]
    assert {r.o for r in spark.createDataFrame(values, "v binary").select(opened(F.col("v")).alias("o")).collect()} == {None}
