"""Scalar functions of the log table as column expressions."""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def media_type(header: Column) -> Column:
    """A content type without parameters, lowered, without blanks around."""
    return F.trim(F.lower(F.substring_index(F.coalesce(header, F.lit("")), ";", 1)))


def hex_text(binary: Column) -> Column:
    return F.coalesce(F.lower(F.hex(binary)), F.lit(""))


def severity(text: Column, number: Column) -> Column:
    """The text if there is one, else the name of the number's range of four."""
    names = F.array(*map(F.lit, ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")))
    named = F.when(number.between(1, 24), F.element_at(names, F.floor((number - 1) / 4).cast("int") + 1)).otherwise("UNSPECIFIED")
    return F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(F.coalesce(named, F.lit("UNSPECIFIED")))


def nanos(time: Column, observed: Column) -> Column:
    """The record's time, else the time it was observed, else null."""
    return F.coalesce(F.nullif(time, F.lit(0)), F.nullif(observed, F.lit(0)))


def wall_clock(nanoseconds: Column) -> Column:
    """Nanoseconds since 1970 as a time without zone, cut to milliseconds; in any session time zone."""
    seconds = (F.call_function("div", nanoseconds, F.lit(1_000_000)) / F.lit(1000).cast("decimal(4,0)")).cast("decimal(18,6)")
    return F.expr(_EPOCH) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def nanos_of(time: Column) -> Column:
    """Nanoseconds from 1970 to a time without zone."""
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), time) * 1000


def timestamp_text(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss.SSS")


def escape(text: Column) -> Column:
    """Quotes and backslashes doubled; for texts that compare with the older form only."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''"))


def map_literal(attributes: Column) -> Column:
    """A map as the SQL literal MAP([keys], [values]), by key."""
    entries = F.sort_array(F.map_entries(attributes))
    quoted = lambda name: F.array_join(F.transform(entries, lambda e: F.concat(F.lit("'"), escape(e[name]), F.lit("'"))), ", ")
    return F.concat(F.lit("MAP(["), quoted("key"), F.lit("], ["), quoted("value"), F.lit("])"))


def map_text(attributes: Column) -> Column:
    """A map as k=v, joined by commas, by key."""
    return F.array_join(F.transform(F.sort_array(F.map_entries(attributes)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


_SIZED = ("_kafka_topic", "body", "severity", "service_name", "deployment_environment", "host_name", "trace_id", "span_id")


def record_size() -> Column:
    """Estimated bytes of a row of the log table: its texts, 12 for partition and offset, 100 for the rest."""
    texts = sum((F.octet_length(c) for c in _SIZED[1:]), F.octet_length(_SIZED[0]))
    pairs = F.aggregate(F.map_entries("attributes"), F.lit(0), lambda n, e: n + F.octet_length(e["key"]) + F.octet_length(e["value"]))
    return (texts + pairs + 112).cast("bigint")


def backoff(attempt: Column, base: int = 100, most: int = 5000) -> Column:
    """Milliseconds to wait after an attempt, without the random part."""
    return F.least(F.lit(base) * F.pow(F.lit(2), attempt), F.lit(most)).cast("bigint")


def delay(attempt: int, base: int = 100, most: int = 5000) -> float:
    """Seconds to wait on the driver after an attempt: doubled each time, and up to half as much again."""
    whole = min(base * 2**attempt, most)
    return (whole + random.randint(0, whole // 2)) / 1000


def table_name(name: str, catalog: str = "iceberg_catalog", namespace: str = "default") -> str:
    return ".".join(part if part.isidentifier() else "`" + part.replace("`", "``") + "`" for part in (catalog, namespace, name))
