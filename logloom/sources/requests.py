"""Requests as they arrive over HTTP: their status, and the envelopes of those accepted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.scalars import media_type
from logloom.operators.decode import envelope, gunzip
from logloom.schema import JSON_TYPES, PROTOBUF_TYPES

PATH = "/v1/logs"
BAD_GZIP = "Failed to decompress gzip payload"


def answered(requests: DataFrame, at_capacity: bool = False) -> DataFrame:
    """Adds ``status``, ``message`` and ``value`` (the envelope, of accepted requests only).

    Payloads aren't decoded here: what is wrong in them shows later, as a dead letter.
    """
    kind = media_type(F.col("content_type"))
    known = kind.isin(*JSON_TYPES, *PROTOBUF_TYPES)
    zipped = F.trim(F.lower(F.coalesce("content_encoding", F.lit("")))) == "gzip"
    rows = requests.withColumn("__kind", kind).withColumn("__zipped", zipped & known)
    rows = rows.withColumn("__plain", F.coalesce(F.when(~F.col("__zipped"), F.coalesce("body", F.unhex(F.lit("")))), gunzip(F.when(F.col("__zipped"), F.coalesce("body", F.unhex(F.lit("")))))))
    probe = F.col("path").isin("/health", "/ready")
    status = (
        F.when((F.col("method") == "GET") & probe, 200)
        .when((F.col("path") != PATH) | (F.col("method") != "POST"), 404)
        .when(~F.col("__kind").isin(*JSON_TYPES, *PROTOBUF_TYPES), 415)
        .when(F.col("__plain").isNull(), 400)
        .when(F.lit(at_capacity), 429)
        .otherwise(200)
    )
    rows = rows.withColumn("status", status)
    accepted = (F.col("status") == 200) & (F.col("path") == PATH)
    message = F.when(F.col("status") == 400, BAD_GZIP).when(F.col("status") == 415, "Unsupported media type").otherwise("")
    value = F.when(accepted, envelope(F.col("__kind"), F.col("__plain")))
    return rows.withColumn("message", message).withColumn("value", value).drop("__kind", "__zipped", "__plain")
