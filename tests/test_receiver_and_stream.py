import gzip
import http.client
import json
import random

import pytest
from pyspark.sql import functions as F

from logloom.functions.scalars import record_size
from logloom.operators import flush, offsets
from logloom.operators.decode import decode
from logloom.operators.flatten import logs
from logloom.plans import queries as plans
from logloom.plans import synthetic
from logloom.schema import QUEUE, REQUEST
from logloom.sources import catalog, queue
from logloom.sources.receiver import Landing, serve
from logloom.sources.requests import answered
from logloom.streaming import control, ingest

BODY = json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": [{"timeUnixNano": "1", "body": {"stringValue": "hi"}}]}]}]}).encode()
CASES = [
    ("application/x-protobuf", "", b"", 200), ("application/protobuf", "", b"\x0a\x00", 200), ("application/json", "gzip", gzip.compress(BODY), 200), ("text/json", "", BODY, 200),
    ("application/x-protobuf; charset=utf-8", "", b"", 200), ("text/plain", "", b"x", 415), ("", "", b"x", 415), ("application/json", "", b"{ invalid json }", 200), ("application/x-protobuf", "", b"not protobuf", 200),
    ("application/json", "gzip", b"not gzip", 400), ("application/json", "gzip", gzip.compress(BODY)[:-4], 400), ("application/json", "gzip", b"", 200), ("APPLICATION/X-PROTOBUF", "GZIP", gzip.compress(b""), 200), ("application/json", "br", BODY, 200),
    ("application/json", "gzip", gzip.compress(BODY) + gzip.compress(b"more"), 200),
]


def test_statuses_of_a_table_of_requests(spark):
    rows = [("POST", "/v1/logs", k or None, e, b) for k, e, b, _ in CASES] + [("GET", "/health", None, None, None), ("GET", "/v1/logs", None, None, None)]
    found = answered(spark.createDataFrame(rows, REQUEST)).collect()
    assert [r.status for r in found] == [s for *_, s in CASES] + [200, 404]
    assert all((r.value is not None) == (r.status == 200 and r.method == "POST") for r in found)
    assert {r.status for r in answered(spark.createDataFrame(rows[:1], REQUEST), at_capacity=True).collect()} == {429}


def test_receiver(spark, tmp_path):
    server = serve(Landing(str(tmp_path / "queue")), port=0)
    try:
        for kind, encoding, body, status in CASES:
            connection = http.client.HTTPConnection(*server.server_address, timeout=10)
            connection.request("POST", "/v1/logs", body, {"Content-Type": kind, "Content-Encoding": encoding})
            answer = connection.getresponse()
            assert answer.status == status
            if status == 200:
                assert answer.getheader("Content-Type") == "application/x-protobuf"
            connection.close()
        connection = http.client.HTTPConnection(*server.server_address, timeout=10)
        connection.request("GET", "/ready")
        assert connection.getresponse().status == 200
    finally:
        server.shutdown()
        server.server_close()
    landed = spark.read.parquet(str(tmp_path / "queue"))
    assert landed.count() == sum(s == 200 for *_, s in CASES)
    assert landed.groupBy("partition", "offset").count().where("count > 1").count() == 0
    assert Landing(str(tmp_path / "queue")).next == [r.n for r in landed.groupBy("partition").agg((F.max("offset") + 1).alias("n")).orderBy("partition").collect()]


@pytest.fixture
def events(spark):
    rows = [(i, i % 7, ["view", "purchase", "error"][i % 3], i / 4, '{"k": 1}') for i in range(200)]
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, value double, props string")
    return df.withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, event_id, 0.5)"))


def test_stream_holds_each_message_once_through_restarts(spark, events, tmp_path):
    source, table, letters, checkpoint = (f"{tmp_path}/{x}" for x in ("queue", "logs", "letters", "checkpoint"))
    messages = synthetic.queue(events)
    bad = spark.createDataFrame([("otel-logs", 0, 10**6, b"\xff\xff")], QUEUE)
    queue.to_files(messages.where("offset % 2 = 0").unionByName(bad).repartition(4), source)
    rows = queue.from_files(spark, source, files_per_batch=1)
    first = ingest.start(rows, table, checkpoint, letters)
    first.awaitTermination()
    once = catalog.logs_of(spark, table).count()
    assert once == 100 and spark.read.parquet(letters).count() == 1
    assert not ingest.health(first)["is_running"] and ingest.end_offsets(first)
    # A batch that is written again replaces itself.
    batch = spark.read.schema(QUEUE).parquet(source).where("offset < 10")
    number = 10**6
    for _ in range(2):
        ingest.writer(f"{tmp_path}/again", None)(batch, number)
    again = catalog.logs_of(spark, f"{tmp_path}/again")
    assert again.count() == again.select("trace_id").distinct().count() > 0
    queue.to_files(messages.where("offset % 2 = 1"), source)
    ingest.start(queue.from_files(spark, source), table, checkpoint, letters).awaitTermination()
    ingest.start(queue.from_files(spark, source), table, checkpoint, letters).awaitTermination()
    stored = catalog.logs_of(spark, table)
    assert stored.count() == 200 and stored.select("trace_id").distinct().count() == 200
    assert spark.read.parquet(letters).count() == 1
    # Without the checkpoint the table itself says where to go on.
    done = offsets.recovered(stored, "otel-logs")
    assert offsets.resumed(messages, done).count() == 0
    assert json.loads(offsets.starting_offsets(done, "otel-logs"))["otel-logs"]["0"] == done.where("partition = 0").first().max_offset + 1
    catalog.compact(spark, table, f"{tmp_path}/compact")
    assert spark.read.parquet(f"{tmp_path}/compact").count() == 200
    plan = stored.where("service_name = 'svc-1'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(service_name,svc-1)" in plan


def asked(server, method, path, body=None):
    connection = http.client.HTTPConnection(*server.server_address, timeout=120)
    connection.request(method, path, body)
    answer = connection.getresponse()
    text = answer.read().decode()
    connection.close()
    return answer.status, text


def test_running_stream_flushes_and_reports(spark, events, tmp_path):
    source, stats = f"{tmp_path}/queue", ingest.Stats()
    queue.to_files(synthetic.queue(events).limit(20), source)
    query = ingest.start(queue.from_files(spark, source), f"{tmp_path}/logs", f"{tmp_path}/c", seconds=1, stats=stats)
    server = control.serve(query, stats, port=0)
    try:
        assert asked(server, "POST", "/flush") == (200, control.FLUSHED.decode())
        rows = catalog.logs_of(spark, f"{tmp_path}/logs")
        assert ingest.health(query)["ready"] and rows.count() > 0
        assert asked(server, "GET", "/ready")[0] == asked(server, "GET", "/health")[0] == 200
        status, text = asked(server, "GET", "/stats")
        sizes = rows.agg(F.count("*").alias("n"), F.sum(record_size()).alias("b")).first()
        assert status == 200 and json.loads(text) == {"total_buffer_records": sizes.n, "total_buffer_size_bytes": sizes.b, "is_running": True}
        assert asked(server, "GET", "/flush")[0] == asked(server, "POST", "/stats")[0] == 404
        query.stop()
        assert asked(server, "GET", "/ready")[0] == 503 and asked(server, "POST", "/flush")[0] == 500
        assert not json.loads(asked(server, "GET", "/stats")[1])["is_running"]
    finally:
        query.stop()
        server.shutdown()
        server.server_close()
    assert not query.isActive


def test_receiver_is_ready_while_it_can_write(tmp_path):
    server = serve(Landing(str(tmp_path / "queue")), port=0, most_bytes=100)
    try:
        assert asked(server, "GET", "/ready") == (200, "OK")
        assert asked(server, "POST", "/v1/logs", b"x" * 101)[0] == 413
        (tmp_path / "queue").rmdir()
        assert asked(server, "GET", "/ready") == (503, "Queue producer not ready") and asked(server, "GET", "/health")[0] == 200
    finally:
        server.shutdown()
        server.server_close()


def test_messages_in_the_table_are_not_written_again(spark, events):
    """What the writer for a catalog leaves out, against a table of another format."""
    queued = synthetic.queue(events)
    rows = logs(decode(queued))
    there = rows.where("_kafka_offset % 3 = 0 or _kafka_partition = 1")
    left = ingest.unseen(rows, queued, there)
    assert left.columns == rows.columns
    assert left.count() == rows.where("_kafka_offset % 3 <> 0 and _kafka_partition <> 1").count() > 0
    assert ingest.unseen(rows, queued, rows).count() == 0
    assert ingest.unseen(rows, queued, rows.limit(0)).count() == rows.count()


def test_retries():
    calls = []

    def fails():
        calls.append(1)
        raise OSError("conflict")

    with pytest.raises(OSError):
        ingest.retried(fails, attempts=3, base_ms=1, most_ms=2)
    assert len(calls) == 3


def test_batches_start_again_at_each_flush(spark):
    rows = [(p, i, 1, s) for p in (0, 1) for i, s in enumerate([5, 5, 1, 20, 3, 3, 3, 3])]
    found = flush.flush_batches(spark.createDataFrame(rows, "partition int, offset bigint, records bigint, bytes bigint"), 10).orderBy("partition", "offset").collect()
    assert [r.batch for r in found] == [0, 0, 1, 1, 2, 2, 2, 2] * 2


@pytest.mark.parametrize("limit", [1, 40, 900, 100_000])
def test_batches_are_those_of_one_pass_however_partitions_are_cut(spark, limit):
    """Batches within a stretch, over many of them, offsets that lack, and messages without bytes."""
    r = random.Random(limit)
    rows = [(p, i, 1, r.choice([0, 1, 7, 30, 95])) for p in range(3) for i in range(60 * p, 400) if r.random() < 0.8 or p == 2]
    want, now = {}, None
    for p, i, _, size in rows:
        if p != now:
            now, batch, held = p, 0, 0
        want[p, i], held = batch, held + size
        if held >= limit:
            batch, held = batch + 1, 0
    r.shuffle(rows)
    messages = spark.createDataFrame(rows, "partition int, offset bigint, records bigint, bytes bigint")
    for stretch in (1, 16, 1000):
        assert {(x.partition, x.offset): x.batch for x in flush.flush_batches(messages, limit, stretch).collect()} == want
    assert flush.flush_batches(messages.limit(0), limit).count() == 0


def test_every_query_has_sql_or_needs_none():
    without = set(plans.queries()) - set(plans.oracle_sql())
    assert without == set()
