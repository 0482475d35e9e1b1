"""Questions that users ask of the log table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_service_and_severity(logs: DataFrame) -> DataFrame:
    return logs.groupBy("service_name", "severity").agg(F.count("*").alias("n"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))


def error_rate(logs: DataFrame, minutes: int = 60) -> DataFrame:
    """Share of errors in windows that follow one another."""
    rows = logs.groupBy(F.window("timestamp", f"{minutes} minutes").alias("w"), "service_name")
    rows = rows.agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "ERROR").alias("errors"))
    return rows.select(F.col("w.start").alias("window_start"), "service_name", "n", "errors", (F.col("errors") / F.col("n")).alias("error_rate"))


def top_services(logs: DataFrame, k: int = 5) -> DataFrame:
    """The services with the most rows; a limit because it is a report of the top."""
    return logs.groupBy("service_name").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "service_name").limit(k)


def sessions(logs: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Spans of a host's rows with less than ``gap`` between one and the next."""
    rows = logs.groupBy(F.session_window("timestamp", gap).alias("w"), "host_name").agg(F.count("*").alias("n"), F.min("timestamp").alias("session_start"), F.max("timestamp").alias("session_end"))
    return rows.select("host_name", "session_start", "session_end", "n")


def latest_by_host(logs: DataFrame) -> DataFrame:
    """Each host's last row: a maximum by group, so nothing is sorted."""
    last = F.max_by(F.struct("severity", "body", "trace_id"), F.struct("timestamp", "trace_id")).alias("last")
    rows = logs.groupBy("host_name").agg(F.max("timestamp").alias("timestamp"), last)
    return rows.select("host_name", "timestamp", "last.severity", "last.body", "last.trace_id")


def of_service(logs: DataFrame, service: str) -> DataFrame:
    """Rows of one service; the condition reaches the files."""
    return logs.where(F.col("service_name") == service).select("timestamp", "severity", "body", "host_name", "trace_id")


def rollup(logs: DataFrame) -> DataFrame:
    rows = logs.rollup("deployment_environment", "service_name").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
    return rows.select("deployment_environment", "service_name", "n", "level")


def traces(logs: DataFrame) -> DataFrame:
    """Traces with how many rows and services they touch.

    Rows meet by trace once, and both groupings are made there; a count of distinct services
    would send a row for each trace and service, and then again one for each trace.
    """
    failed = F.when(F.col("severity") == "ERROR", 1).otherwise(0).alias("failed")
    rows = logs.where("trace_id <> ''").select("trace_id", "service_name", failed).repartition("trace_id")
    of_service = rows.groupBy("trace_id", "service_name").agg(F.count("*").alias("n"), F.max("failed").alias("failed"))
    return of_service.groupBy("trace_id").agg(F.sum("n").alias("n"), F.count("service_name").alias("services"), F.max("failed").alias("failed"))


def ranked(logs: DataFrame, k: int = 3) -> DataFrame:
    """The first k rows of each service by time; the limit is the report's."""
    order = Window.partitionBy("service_name").orderBy("timestamp", "trace_id")
    return logs.select("service_name", "timestamp", "trace_id", F.row_number().over(order).alias("rn")).where(F.col("rn") <= k)
