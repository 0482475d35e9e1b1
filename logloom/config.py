"""Settings from environment variables.

A required variable that is unset or empty raises; so does a number that isn't one.
"""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import MISSING, dataclass, field, fields

from logloom.schema import TOPIC


def _env(name: str, default=MISSING):
    return field(default=default, metadata={"env": name})


class _FromEnv:
    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ):
        given = {}
        for f in fields(cls):
            value = env.get(f.metadata["env"], "")
            if value:
                given[f.name] = int(value) if f.type == "int" else value
            elif f.default is MISSING:
                raise ValueError(f"{f.metadata['env']} must be set")
        return cls(**given)


@dataclass(frozen=True)
class ReceiverConfig(_FromEnv):
    brokers: str = _env("KAFKA_BROKERS")
    topic: str = _env("KAFKA_TOPIC", TOPIC)
    max_in_flight: int = _env("MAX_IN_FLIGHT", 1000)
    acks: int = _env("PRODUCER_ACKS", -1)
    compression: str = _env("PRODUCER_COMPRESSION", "snappy")


@dataclass(frozen=True)
class AppenderConfig(_FromEnv):
    brokers: str = _env("KAFKA_BROKERS")
    catalog_uri: str = _env("ICEBERG_CATALOG_URI")
    s3_endpoint: str = _env("S3_ENDPOINT")
    s3_access_key: str = _env("S3_ACCESS_KEY")
    s3_secret_key: str = _env("S3_SECRET_KEY")
    s3_bucket: str = _env("S3_BUCKET")
    topic: str = _env("KAFKA_TOPIC", TOPIC)
    group: str = _env("KAFKA_CONSUMER_GROUP", "otel-appender")
    table: str = _env("ICEBERG_TABLE_NAME", "logs")
    flush_mb: int = _env("PARTITION_BUFFER_SIZE_MB", 50)
    flush_seconds: int = _env("PARTITION_BUFFER_TIME_SECONDS", 60)
    commit_attempts: int = _env("ICEBERG_COMMIT_RETRIES", 5)
    backoff_base_ms: int = _env("ICEBERG_RETRY_BASE_DELAY_MS", 100)
    backoff_max_ms: int = _env("ICEBERG_RETRY_MAX_DELAY_MS", 5000)
    stop_seconds: int = _env("REBALANCE_TIMEOUT_SECONDS", 30)
    health_port: int = _env("HEALTH_PORT", 8080)
    dead_letters: str = _env("DLQ_PATH", "")
