"""Decoded requests to rows of the log table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import scalars
from logloom.schema import LOGS, PROMOTED, RESOURCES

_ENTRIES = "array<struct<key:string,value:string>>"


def _last(attributes: Column, key: str) -> Column:
    """The value of a key, of several the last; empty if there is none."""
    backwards = F.reverse(attributes)
    return F.coalesce(F.get(backwards["value"], F.array_position(backwards["key"], key).cast("int") - 1), F.lit(""))


def records(decoded: DataFrame) -> DataFrame:
    """A row for each record, with the attributes of its resource beside it and its place in the request.

    Resources and scopes without records give none; so do messages that could not be decoded.
    """
    # Of a bare column Spark infers a filter (size > 0) and pushes it down to the source, where it decodes every message once more.
    resources = F.coalesce("decoded.resources", F.array().cast(RESOURCES))
    rows = decoded.select("topic", "partition", "offset", F.posexplode(resources).alias("__r", "resource"))
    rows = rows.select("topic", "partition", "offset", "__r", F.col("resource.attributes").alias("of_resource"), F.posexplode("resource.scopes").alias("__s", "scope"))
    return rows.select("topic", "partition", "offset", "of_resource", "__r", "__s", F.posexplode("scope.records").alias("__i", "record"))


def attributes(of_resource: Column, of_record: Column) -> Column:
    """Entries of both, by key; the record's replace the resource's and later ones earlier ones.

    Keys with a column of their own are left out of the resource's only.
    """
    rest = F.filter(F.coalesce(of_resource, F.expr(f"cast(array() as {_ENTRIES})")), lambda e: ~e["key"].isin(*PROMOTED))
    numbered = F.transform(F.concat(rest, F.coalesce(of_record, F.expr(f"cast(array() as {_ENTRIES})"))), lambda e, i: F.struct(e["key"].alias("key"), (-i).alias("back"), e["value"].alias("value")))
    return F.sort_array(numbered)


def _first_of_key(entries: Column) -> Column:
    return F.filter(entries, lambda e, i: (i == 0) | (F.try_element_at(entries, i)["key"] != e["key"]))


def logs(decoded: DataFrame, with_place: bool = False) -> DataFrame:
    """The log table's rows; ``with_place`` adds ``_ordinal``, the record's place in its message."""
    record = F.col("record")
    rows = records(decoded).withColumn("__entries", attributes(F.col("of_resource"), F.col("record.attributes"))).withColumn("__entries", _first_of_key(F.col("__entries")))
    time = scalars.wall_clock(scalars.nanos(record["time"], record["observed"]))
    columns = {
        "_kafka_topic": F.col("topic"),
        "_kafka_partition": F.col("partition"),
        "_kafka_offset": F.col("offset"),
        # Without any time it is now, one time for the whole batch.
        "timestamp": F.coalesce(time, F.date_trunc("millisecond", F.localtimestamp())),
        "severity": scalars.severity(record["severity_text"], record["severity_number"]),
        "body": F.coalesce(record["body"], F.lit("")),
        "trace_id": scalars.hex_text(record["trace_id"]),
        "span_id": scalars.hex_text(record["span_id"]),
        **{column: _last(F.col("of_resource"), key) for key, column in PROMOTED.items()},
        "attributes": F.map_from_arrays(F.col("__entries.key"), F.col("__entries.value")),
    }
    out = [columns[f.name].cast(f.dataType).alias(f.name) for f in LOGS.fields]
    if with_place:
        out.append(F.concat_ws(".", "__r", "__s", "__i").alias("_ordinal"))
    return rows.select(*out)


def dead_letters(decoded: DataFrame) -> DataFrame:
    """The messages that could not be decoded, with the reason."""
    return decoded.where("decoded.error is not null").select(
        F.localtimestamp().alias("ts"), F.col("decoded.error").alias("error_reason"), F.col("value").alias("raw"), "topic", "partition", "offset"
    )
