import datetime as dt

import pytest
from pyspark.sql import functions as F

from logloom.config import AppenderConfig, ReceiverConfig
from logloom.functions import scalars
from logloom.operators.flush import BufferPolicy
from logloom.plans.queries import LIMIT  # noqa: F401
from logloom.schema import LOGS
from logloom.sources import catalog, queue


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("text, number, want", [("", 17, "ERROR"), ("Warning", 17, "Warning"), ("", 0, "UNSPECIFIED"), ("", 25, "UNSPECIFIED"), (None, None, "UNSPECIFIED"), *[("", n, w) for n, w in ((1, "TRACE"), (4, "TRACE"), (5, "DEBUG"), (12, "INFO"), (13, "WARN"), (20, "ERROR"), (21, "FATAL"), (24, "FATAL"), (-1, "UNSPECIFIED"))]])
def test_severity(spark, text, number, want):
    assert one(spark, scalars.severity(F.lit(text).cast("string"), F.lit(number).cast("int"))) == want


@pytest.mark.parametrize("header, want", [("application/json; charset=utf-8", "application/json"), (" TEXT/JSON ", "text/json"), (None, ""), (";x", "")])
def test_media_type(spark, header, want):
    assert one(spark, scalars.media_type(F.lit(header).cast("string"))) == want


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        n = F.lit(1672531200123999999).cast("bigint")
        assert one(spark, scalars.wall_clock(n)) == dt.datetime(2023, 1, 1, 0, 0, 0, 123000)
        assert one(spark, scalars.timestamp_text(scalars.wall_clock(n))) == "2023-01-01 00:00:00.123"
        assert one(spark, scalars.nanos_of(scalars.wall_clock(n))) == 1672531200123000000
        assert one(spark, scalars.nanos(F.lit(0), F.lit(5))) == 5 and one(spark, scalars.nanos(F.lit(0), F.lit(0))) is None
        assert one(spark, scalars.wall_clock(F.lit(2**63 - 1).cast("bigint"))) == dt.datetime(2262, 4, 11, 23, 47, 16, 854000)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_texts(spark):
    assert one(spark, scalars.escape(F.lit("it's a\\b"))) == "it''s a\\\\b"
    pairs = F.create_map(F.lit("b"), F.lit("x'y"), F.lit("a"), F.lit("1"))
    assert one(spark, scalars.map_literal(pairs)) == "MAP(['a', 'b'], ['1', 'x''y'])"
    assert one(spark, scalars.map_literal(F.expr("cast(map() as map<string,string>)"))) == "MAP([], [])"
    assert one(spark, scalars.map_text(pairs)) == "a=1,b=x'y"
    assert one(spark, scalars.hex_text(F.lit(bytes(range(1, 17))))) == "0102030405060708090a0b0c0d0e0f10"


def test_record_size(spark):
    row = ("t", 0, 1, None, "INFO", "é", "ab", "c", "s", "e", "h", {"k": "vé"})
    size = spark.createDataFrame([row], LOGS).select(scalars.record_size().alias("x")).first().x
    assert size == 1 + 4 + 2 + 2 + 1 + 1 + 1 + 1 + (1 + 3) + 112


def test_backoff():
    for attempt, base in ((1, 200), (2, 400), (3, 800), (9, 5000)):
        assert base / 1000 <= scalars.delay(attempt) <= base * 1.5 / 1000


def test_names_and_options():
    assert scalars.table_name("logs") == "iceberg_catalog.default.logs"
    assert scalars.table_name("a-b") == "iceberg_catalog.default.`a-b`"
    assert "map<string,string>" in catalog.ddl("logs")[1]
    env = {"KAFKA_BROKERS": "k:9", "ICEBERG_CATALOG_URI": "u", "S3_ENDPOINT": "e", "S3_ACCESS_KEY": "a", "S3_SECRET_KEY": "s", "S3_BUCKET": "b"}
    config = AppenderConfig.from_env(env)
    assert (config.flush_mb, config.flush_seconds, config.topic, config.table) == (50, 60, "otel-logs", "logs")
    assert queue.reader_options(config)["maxTriggerDelay"] == "60s"
    assert catalog.session_options(config)["spark.sql.catalog.iceberg_catalog.uri"] == "u"
    assert queue.writer_options(ReceiverConfig.from_env(env))["kafka.acks"] == "all"
    with pytest.raises(ValueError):
        AppenderConfig.from_env(env | {"S3_BUCKET": ""})
    with pytest.raises(ValueError):
        ReceiverConfig.from_env(env | {"MAX_IN_FLIGHT": "many"})


def test_buffer_policy():
    policy = BufferPolicy(1024, 1)
    assert [policy.add(100) for _ in range(11)] == [False] * 10 + [True]
    assert not policy.late(0.9) and policy.late(1.1)
    policy.reset(2)
    assert not policy.add(500) and not policy.late(2.5)
