"""Queries over the ``events`` table as requests, and the same in DuckDB's SQL."""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import scalars
from logloom.operators import analytics, flush, offsets
from logloom.operators.decode import decode, opened
from logloom.operators.flatten import dead_letters, logs
from logloom.plans import synthetic
from logloom.schema import TOPIC
from logloom.sources import catalog
from logloom.sources.requests import answered

LIMIT = 20_000
ZIPPED = b'{"resourceLogs":[{"scopeLogs":[{"logRecords":[{"timeUnixNano":"1"}]}]}]}'


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs(decode(synthetic.queue(_events(spark, sf_dir))))


def _flat(rows: DataFrame) -> DataFrame:
    """The map as text, so that engines can be compared."""
    return rows.withColumn("attributes", scalars.map_text(F.col("attributes")))


def otlp_json_to_logs(spark, sf_dir):
    return _flat(_logs(spark, sf_dir))


def otlp_proto_to_logs(spark, sf_dir):
    return _flat(logs(decode(synthetic.protobuf_queue(_events(spark, sf_dir)))))


def queue_envelopes(spark, sf_dir):
    rows = synthetic.queue(_events(spark, sf_dir)).select("partition", "offset", opened(F.col("value")).alias("o"), F.octet_length("value").cast("bigint").alias("n_bytes"))
    return rows.select("partition", "offset", "o.content_type", F.octet_length("o.payload").cast("bigint").alias("payload_bytes"), (F.col("n_bytes") > F.octet_length("o.payload")).alias("wrapped"))


def _any_values(queue):
    """Values as text, in the body and as a map's literal, and where the time comes from: the record, who observed it, or now."""
    rows = logs(decode(queue))
    source = F.when(F.col("timestamp") > F.expr("timestamp_ntz'2025-01-01 00:00:00'"), "now").otherwise(scalars.timestamp_text(F.col("timestamp")))
    return rows.select("_kafka_offset", "body", scalars.map_literal(F.col("attributes")).alias("literal"), source.alias("time"))


def any_values(spark, sf_dir):
    rows = synthetic.messages_of_all_values(_events(spark, sf_dir))
    return _any_values(rows.select("topic", "partition", "offset", synthetic.envelope(F.lit("application/json"), F.col("payload").cast("binary")).alias("value")))


def any_values_proto(spark, sf_dir):
    return _any_values(synthetic.as_protobuf(synthetic.messages_of_all_values(_events(spark, sf_dir))))


def severity_from_number(spark, sf_dir):
    n = (F.col("event_id") % 27).cast("int")
    text = F.when(F.col("event_id") % 10 == 0, "Custom").otherwise("")
    return _events(spark, sf_dir).select("event_id", scalars.severity(text, n).alias("severity"))


def time_fallback(spark, sf_dir):
    """The record's time, else the observed one; rows with neither are now and stay out here."""
    nanos = scalars.nanos_of(F.col("ts"))
    time = F.when(F.col("event_id") % 3 == 0, 0).otherwise(nanos)
    observed = F.when(F.col("event_id") % 9 == 0, 0).otherwise(nanos + 1_000_000_000)
    rows = _events(spark, sf_dir).select("event_id", scalars.nanos(time, observed).alias("n"))
    return rows.where("n is not null").select("event_id", scalars.wall_clock(F.col("n")).alias("timestamp"), scalars.timestamp_text(scalars.wall_clock(F.col("n"))).alias("timestamp_text"))


def attribute_merge(spark, sf_dir):
    return _logs(spark, sf_dir).select("trace_id", scalars.map_text(F.col("attributes")).alias("attributes"), scalars.map_literal(F.col("attributes")).alias("literal"))


def trace_hex(spark, sf_dir):
    return _logs(spark, sf_dir).select("trace_id", "span_id")


def recover_offsets(spark, sf_dir):
    return offsets.recovered(_logs(spark, sf_dir), TOPIC)


def recover_offset_scalar(spark, sf_dir):
    rows = _logs(spark, sf_dir)
    found = offsets.recovered_of(rows, TOPIC, 1).withColumn("partition", F.lit(1))
    return found.unionByName(offsets.recovered_of(rows, TOPIC, 99).withColumn("partition", F.lit(99)))


def resume_filter(spark, sf_dir):
    """What is left of the queue if the table holds the first half of each partition but the last."""
    queue = synthetic.messages(_events(spark, sf_dir))
    half = queue.agg((F.max("offset") / 2).alias("half"))
    done = queue.join(F.broadcast(half)).where((F.col("partition") < 2) & (F.col("offset") <= F.col("half"))).groupBy("partition").agg(F.max("offset").alias("max_offset"))
    return offsets.resumed(queue.select("topic", "partition", "offset"), done)


def record_size_estimate(spark, sf_dir):
    return _logs(spark, sf_dir).select("trace_id", scalars.record_size().alias("bytes"))


def buffer_stats(spark, sf_dir):
    return flush.buffer_stats(_logs(spark, sf_dir))


def buffer_totals(spark, sf_dir):
    return flush.totals(flush.buffer_stats(_logs(spark, sf_dir)))


def flush_batches(spark, sf_dir):
    rows = flush.flush_batches(flush.message_sizes(_logs(spark, sf_dir)), LIMIT)
    return rows.groupBy("partition", "batch").agg(F.count("*").alias("messages"), F.sum("bytes").alias("bytes"), F.max("offset").alias("last_offset"))


def backoff_schedule(spark, sf_dir):
    return spark.range(1, 9).select(F.col("id").alias("attempt"), scalars.backoff(F.col("id")).alias("wait_ms"))


def _requests(spark, sf_dir):
    """Requests of all kinds, one for each event."""
    i = F.col("event_id")
    kinds = F.array(*map(F.lit, ("application/json", "application/x-protobuf; charset=utf-8", "TEXT/JSON", "text/plain", " application/protobuf ", "")))
    plain = F.when(i % 4 == 1, F.lit("not gzip")).when(i % 4 == 3, F.lit("")).otherwise(F.col("props"))
    body = F.when(i % 8 == 7, F.lit(gzip.compress(ZIPPED, mtime=0))).otherwise(plain.cast("binary"))
    return _events(spark, sf_dir).select(
        "event_id",
        F.when(i % 11 == 0, "GET").otherwise("POST").alias("method"),
        F.when(i % 22 == 0, "/health").when(i % 13 == 0, "/v2/logs").otherwise("/v1/logs").alias("path"),
        F.element_at(kinds, (i % 6 + 1).cast("int")).alias("content_type"),
        F.when(i % 4 == 1, "GZIP").when(i % 4 == 3, "gzip").otherwise("").alias("content_encoding"),
        body.alias("body"),
    )


def http_status(spark, sf_dir):
    """Status and message of each request, and the bytes that went on the queue: those within, where it was zipped."""
    rows = answered(_requests(spark, sf_dir))
    return rows.select("event_id", "status", "message", F.col("value").isNotNull().alias("queued"), F.octet_length(opened(F.col("value"))["payload"]).cast("bigint").alias("payload_bytes"))


def _damaged(spark, sf_dir):
    """Messages, some cut short, some with a field that nobody knows."""
    rows = synthetic.messages(_events(spark, sf_dir))
    text = F.when(F.col("offset") % 10 == 3, F.lit("{ invalid json }")).when(F.col("offset") % 10 == 7, F.lit('{"resourceLogs":[],"unknown":1}')).otherwise(F.col("payload"))
    return rows.select("topic", "partition", "offset", synthetic.envelope(F.lit("application/json"), text.cast("binary")).alias("value"))


def dead_letter_queue(spark, sf_dir):
    return dead_letters(decode(_damaged(spark, sf_dir))).select("topic", "partition", "offset")


def logs_without_damaged(spark, sf_dir):
    return logs(decode(_damaged(spark, sf_dir))).groupBy("_kafka_partition").agg(F.count("*").alias("n"))


def sink_and_scan(spark, sf_dir):
    """The rows written as a table and read back by name, by the documented statements."""
    folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/logs-{uuid.uuid4().hex}"
    _logs(spark, sf_dir).write.parquet(f"{folder}/batch_id=0")
    catalog.register(spark, folder, "logloom_logs")
    return spark.sql("SELECT count(*) AS n, count(DISTINCT trace_id) AS traces, max(timestamp) AS last_ts FROM logloom_logs WHERE service_name = 'svc-1'")


_STORED: dict[tuple[str, str], str] = {}


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log table as the stream leaves it, written once for each application.

    Rows of a service lie near one another, so that conditions skip parts of files.
    """
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _STORED:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/logs-{uuid.uuid4().hex}"
        _logs(spark, sf_dir).sortWithinPartitions("service_name", "timestamp").write.parquet(folder)
        _STORED[key] = folder
    return catalog.logs_of(spark, _STORED[key])


_ASKED: set[tuple[str, str]] = set()


def _analytics(f: Callable[..., DataFrame], spark, sf_dir):
    """An application's first question takes the rows as they are decoded, and computes only the columns it needs; the table is stored when there is a second one."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _ASKED:
        _ASKED.add(key)
        return f(_logs(spark, sf_dir))
    return f(_stored(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (otlp_json_to_logs, otlp_proto_to_logs, queue_envelopes, any_values, any_values_proto, severity_from_number, time_fallback, attribute_merge, trace_hex, recover_offsets, recover_offset_scalar, resume_filter, record_size_estimate, buffer_stats, buffer_totals, flush_batches, backoff_schedule, http_status, dead_letter_queue, logs_without_damaged, sink_and_scan)
    asked = {
        "logs_by_service_severity": analytics.by_service_and_severity,
        "error_rate_by_hour": analytics.error_rate,
        "top_services": analytics.top_services,
        "log_sessions": analytics.sessions,
        "latest_log_per_host": analytics.latest_by_host,
        "logs_of_service": partial(analytics.of_service, service="svc-3"),
        "environment_rollup": analytics.rollup,
        "trace_summary": analytics.traces,
        "first_logs_per_service": analytics.ranked,
    }
    return {f.__name__: f for f in own} | {name: partial(_analytics, f) for name, f in asked.items()}


_LOGS = f"""
WITH logs AS (
  SELECT '{TOPIC}' AS _kafka_topic, (user_id % 3)::INTEGER AS _kafka_partition, event_id // 5 AS _kafka_offset,
    date_trunc('millisecond', ts) AS timestamp,
    CASE event_type WHEN 'purchase' THEN 'INFO' WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'DEBUG' ELSE 'UNSPECIFIED' END AS severity,
    props AS body, md5(event_id::VARCHAR) AS trace_id, substr(md5(event_id::VARCHAR), 1, 16) AS span_id,
    'svc-' || (user_id % 10) AS service_name, CASE WHEN user_id % 2 = 0 THEN 'prod' ELSE 'staging' END AS deployment_environment,
    'host-' || (user_id % 50) AS host_name,
    'event.type=' || event_type || ',event.value=' || printf('%.6f', value) || ',shared=record,user.id=' || user_id AS attributes,
    event_type, value, user_id, event_id
  FROM events)
"""
_COLUMNS = "_kafka_topic, _kafka_partition, _kafka_offset, timestamp, severity, body, trace_id, span_id, service_name, deployment_environment, host_name, attributes"
# The keys' own bytes are 39, and the record's fixed part 112.
_SIZE = "(strlen(_kafka_topic) + strlen(body) + strlen(severity) + strlen(service_name) + strlen(deployment_environment) + strlen(host_name) + strlen(trace_id) + strlen(span_id) + strlen(event_type) + strlen(printf('%.6f', value)) + strlen('record') + strlen(user_id::VARCHAR) + strlen('event.typeevent.valueshareduser.id') + 112)::BIGINT"


#: Values as text: the kinds follow from the id by seven; quotes and backslashes are doubled in a map's literal.
_VALUES = r"""
SELECT event_id AS _kafka_offset, v AS body, 'MAP([' || chr(39) || 'q' || chr(39) || chr(39) || 'k\\' || chr(39) || '], [' || chr(39) || replace(replace(v, '\', '\\'), chr(39), chr(39) || chr(39)) || chr(39) || '])' AS literal,
  CASE WHEN event_id % 5 = 4 THEN 'now' ELSE strftime(date_trunc('millisecond', ts), '%Y-%m-%d %H:%M:%S.%g') END AS time
FROM (SELECT event_id, ts, CASE event_id % 7 WHEN 0 THEN 'it' || chr(39) || 's \ ' || chr(39) || event_id WHEN 1 THEN (event_id % 2 = 0)::VARCHAR WHEN 2 THEN (-event_id)::VARCHAR WHEN 3 THEN printf('%.6f', value)
  WHEN 4 THEN lower(hex(event_id::VARCHAR::BLOB)) WHEN 5 THEN 'a,b,' || event_id ELSE 'z=' || event_id || ',a=x' END AS v FROM events WHERE event_id % 10 <> 0)
"""
#: An event as its part of a JSON request; ids are base64 of sixteen and of eight bytes.
_TEXT_OF_EVENT = r"""
'{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"svc-' || (user_id % 10) || '"}},{"key":"host.name","value":{"stringValue":"host-' || (user_id % 50)
  || '"}},{"key":"deployment.environment","value":{"stringValue":"' || CASE WHEN user_id % 2 = 0 THEN 'prod' ELSE 'staging' END || '"}},{"key":"shared","value":{"stringValue":"resource"}}]},'
  || '"scopeLogs":[{"logRecords":[{"timeUnixNano":"' || (epoch_us(ts)::HUGEINT * 1000) || '"' || CASE event_type WHEN 'error' THEN ',"severityNumber":17' WHEN 'view' THEN ',"severityNumber":5' WHEN 'purchase' THEN ',"severityText":"INFO"' ELSE '' END
  || ',"body":{"stringValue":"' || replace(props, '"', '\"') || '"},"attributes":[{"key":"event.type","value":{"stringValue":"' || event_type || '"}},{"key":"event.value","value":{"doubleValue":' || value
  || '}},{"key":"user.id","value":{"intValue":"' || user_id || '"}},{"key":"shared","value":{"stringValue":"record"}}],"traceId":"' || repeat('x', 24) || '","spanId":"' || repeat('x', 12) || '"}]}]}'
"""


def oracle_sql() -> dict[str, str]:
    sizes = f"{_LOGS}, sizes AS (SELECT _kafka_partition AS partition, _kafka_offset AS \"offset\", count(*) AS records, sum({_SIZE})::BIGINT AS bytes FROM logs GROUP BY ALL)"
    messages = "(SELECT DISTINCT (user_id % 3)::INTEGER AS partition, event_id // 5 AS \"offset\" FROM events)"
    return {
        "any_values": _VALUES,
        "any_values_proto": _VALUES,
        "queue_envelopes": f"""SELECT (user_id % 3)::INTEGER AS partition, event_id // 5 AS "offset", 'application/json' AS content_type,
            ({len('{"resourceLogs":[]}')} + sum(strlen({_TEXT_OF_EVENT})) + count(*) - 1)::BIGINT AS payload_bytes, true AS wrapped FROM events GROUP BY 1, 2""",
        "otlp_json_to_logs": f"{_LOGS} SELECT {_COLUMNS} FROM logs",
        "otlp_proto_to_logs": f"{_LOGS} SELECT {_COLUMNS} FROM logs",
        "severity_from_number": """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'Custom' WHEN event_id % 27 BETWEEN 1 AND 4 THEN 'TRACE' WHEN event_id % 27 BETWEEN 5 AND 8 THEN 'DEBUG'
            WHEN event_id % 27 BETWEEN 9 AND 12 THEN 'INFO' WHEN event_id % 27 BETWEEN 13 AND 16 THEN 'WARN' WHEN event_id % 27 BETWEEN 17 AND 20 THEN 'ERROR'
            WHEN event_id % 27 BETWEEN 21 AND 24 THEN 'FATAL' ELSE 'UNSPECIFIED' END AS severity FROM events""",
        "time_fallback": """SELECT event_id, t AS timestamp, strftime(t, '%Y-%m-%d %H:%M:%S.%g') AS timestamp_text FROM (
            SELECT event_id, date_trunc('millisecond', CASE WHEN event_id % 3 <> 0 THEN ts ELSE ts + INTERVAL 1 SECOND END) AS t FROM events WHERE event_id % 9 <> 0)""",
        "attribute_merge": f"""{_LOGS} SELECT trace_id, attributes, 'MAP([''event.type'', ''event.value'', ''shared'', ''user.id''], [''' || event_type || ''', ''' || printf('%.6f', value) || ''', ''record'', ''' || user_id || '''])' AS literal FROM logs""",
        "trace_hex": f"{_LOGS} SELECT trace_id, span_id FROM logs",
        "recover_offsets": f"{_LOGS} SELECT _kafka_partition AS partition, max(_kafka_offset) AS max_offset FROM logs GROUP BY 1",
        "recover_offset_scalar": f"{_LOGS} SELECT p AS partition, coalesce((SELECT max(_kafka_offset) FROM logs WHERE _kafka_partition = p), -1) AS max_offset FROM (VALUES (1), (99)) t(p)",
        "resume_filter": f"""WITH q AS {messages}, done AS (SELECT partition, max("offset") AS m FROM q WHERE partition < 2 AND "offset" <= (SELECT max("offset") / 2 FROM q) GROUP BY 1)
            SELECT '{TOPIC}' AS topic, q.partition, q."offset" FROM q LEFT JOIN done USING (partition) WHERE q."offset" > coalesce(m, -1)""",
        "record_size_estimate": f"{_LOGS} SELECT trace_id, {_SIZE} AS bytes FROM logs",
        "buffer_stats": f"{_LOGS} SELECT _kafka_partition AS partition, count(*) AS buffer_records, sum({_SIZE})::BIGINT AS buffer_bytes FROM logs GROUP BY 1",
        "buffer_totals": f"{_LOGS} SELECT count(*) AS total_buffer_records, sum({_SIZE})::BIGINT AS total_buffer_size_bytes FROM logs",
        "flush_batches": f"""WITH RECURSIVE {sizes.strip()[5:]}, s AS (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY "offset") AS i FROM sizes),
            fold AS (SELECT partition, i, "offset", bytes, 0::BIGINT AS batch, bytes AS held FROM s WHERE i = 1
              UNION ALL SELECT s.partition, s.i, s."offset", s.bytes, CASE WHEN fold.held >= {LIMIT} THEN fold.batch + 1 ELSE fold.batch END, CASE WHEN fold.held >= {LIMIT} THEN s.bytes ELSE fold.held + s.bytes END
              FROM fold JOIN s ON s.partition = fold.partition AND s.i = fold.i + 1)
            SELECT partition, batch, count(*) AS messages, sum(bytes)::BIGINT AS bytes, max("offset") AS last_offset FROM fold GROUP BY 1, 2""",
        "backoff_schedule": "SELECT n AS attempt, least(100 * pow(2, n), 5000)::BIGINT AS wait_ms FROM range(1, 9) t(n)",
        "http_status": """SELECT event_id, status, CASE status WHEN 400 THEN 'Failed to decompress gzip payload' WHEN 415 THEN 'Unsupported media type' ELSE '' END AS message,
            status = 200 AND method = 'POST' AND path = '/v1/logs' AS queued,
            CASE WHEN status = 200 AND method = 'POST' AND path = '/v1/logs' THEN CASE WHEN event_id % 8 = 7 THEN """ + str(len(ZIPPED)) + """ WHEN event_id % 4 = 3 THEN 0 ELSE strlen(props) END END::BIGINT AS payload_bytes FROM (
            SELECT event_id, props, method, path, CASE WHEN method = 'GET' AND path = '/health' THEN 200 WHEN method <> 'POST' OR path <> '/v1/logs' THEN 404 WHEN event_id % 6 IN (3, 5) THEN 415 WHEN event_id % 4 = 1 THEN 400 ELSE 200 END AS status
            FROM (SELECT event_id, props, CASE WHEN event_id % 11 = 0 THEN 'GET' ELSE 'POST' END AS method, CASE WHEN event_id % 22 = 0 THEN '/health' WHEN event_id % 13 = 0 THEN '/v2/logs' ELSE '/v1/logs' END AS path FROM events))""",
        "dead_letter_queue": f"SELECT '{TOPIC}' AS topic, partition, \"offset\" FROM {messages} WHERE \"offset\" % 10 IN (3, 7)",
        "logs_without_damaged": f"{_LOGS} SELECT _kafka_partition, count(*) AS n FROM logs WHERE _kafka_offset % 10 NOT IN (3, 7) GROUP BY 1",
        "sink_and_scan": f"{_LOGS} SELECT count(*) AS n, count(DISTINCT trace_id) AS traces, max(timestamp) AS last_ts FROM logs WHERE service_name = 'svc-1'",
        "logs_by_service_severity": f"{_LOGS} SELECT service_name, severity, count(*) AS n, min(timestamp) AS first_ts, max(timestamp) AS last_ts FROM logs GROUP BY 1, 2",
        "error_rate_by_hour": f"{_LOGS} SELECT date_trunc('hour', timestamp) AS window_start, service_name, count(*) AS n, count(*) FILTER (WHERE severity = 'ERROR') AS errors, count(*) FILTER (WHERE severity = 'ERROR') / count(*) AS error_rate FROM logs GROUP BY 1, 2",
        "top_services": f"{_LOGS} SELECT service_name, count(*) AS n FROM logs GROUP BY 1 ORDER BY n DESC, service_name LIMIT 5",
        "log_sessions": f"""{_LOGS}, marked AS (SELECT *, CASE WHEN timestamp - lag(timestamp) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM logs WINDOW w AS (PARTITION BY host_name ORDER BY timestamp, trace_id)),
            numbered AS (SELECT *, sum(new) OVER (PARTITION BY host_name ORDER BY timestamp, trace_id) AS s FROM marked)
            SELECT host_name, min(timestamp) AS session_start, max(timestamp) AS session_end, count(*) AS n FROM numbered GROUP BY host_name, s""",
        "latest_log_per_host": f"{_LOGS} SELECT host_name, timestamp, severity, body, trace_id FROM logs QUALIFY row_number() OVER (PARTITION BY host_name ORDER BY timestamp DESC, trace_id DESC) = 1",
        "logs_of_service": f"{_LOGS} SELECT timestamp, severity, body, host_name, trace_id FROM logs WHERE service_name = 'svc-3'",
        "environment_rollup": f"{_LOGS} SELECT deployment_environment, service_name, count(*) AS n, grouping(deployment_environment, service_name)::BIGINT AS level FROM logs GROUP BY ROLLUP (deployment_environment, service_name)",
        "trace_summary": f"{_LOGS} SELECT trace_id, count(*) AS n, count(DISTINCT service_name) AS services, max(CASE WHEN severity = 'ERROR' THEN 1 ELSE 0 END)::INTEGER AS failed FROM logs GROUP BY 1",
        "first_logs_per_service": f"{_LOGS} SELECT * FROM (SELECT service_name, timestamp, trace_id, row_number() OVER (PARTITION BY service_name ORDER BY timestamp, trace_id)::INTEGER AS rn FROM logs) WHERE rn <= 3",
    }
