"""Envelopes and payloads: from bytes to the nested rows of a request.

Payloads are recursive and have strict rules, so they are decoded in one Arrow function
that sees the queue's bytes only; what it returns has a fixed nested type, and all that
follows is expressions on it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions import otlp
from logloom.schema import DECODED, OTEL_LOGS

def gunzip(body: Column) -> Column:
    """The first gzip member of each body, or null if it is broken."""

    @F.arrow_udf(T.BinaryType())
    def run(bodies: pa.Array) -> pa.Array:
        return pa.array([None if b is None else otlp.gunzip(b) for b in bodies.to_pylist()], pa.binary())

    return run(body)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _varint(n: Column) -> Column:
    """A length below 2 ** 35 in protobuf's form, read as one number and its hex."""

    def of_size(k: int) -> Column:
        digit = lambda i: F.shiftright(n, 7 * i).bitwiseAND(127) + F.lit(128 if i < k - 1 else 0)
        return F.lpad(F.hex(sum((F.shiftleft(digit(i), 8 * (k - 1 - i)) for i in range(1, k)), F.shiftleft(digit(0), 8 * (k - 1)))), 2 * k, "0")

    out = of_size(5)
    for k in range(4, 0, -1):
        out = F.when(n < 1 << 7 * k, of_size(k)).otherwise(out)
    return F.unhex(out)


def _nothing() -> Column:
    return F.unhex(F.lit(""))


def envelope(content_type: Column, payload: Column, telemetry_type: int = OTEL_LOGS) -> Column:
    """The envelope's bytes; fields at their default are left out."""
    middle = F.unhex(F.lit(f"10{telemetry_type:02X}" if telemetry_type else ""))

    def field(tag: str, data: Column) -> Column:
        full = lambda d: F.when(F.octet_length(d) > 0, F.concat(F.unhex(F.lit(tag)), _varint(F.octet_length(d).cast("bigint")), d)).otherwise(_nothing())
        return _let(data, full)

    return F.concat(field("0A", content_type.cast("binary")), middle, field("1A", F.coalesce(payload, _nothing())))


def opened(value: Column) -> Column:
    """Content type and payload of an envelope that was written as :func:`envelope` does; else null.

    The length of a payload isn't parsed: it follows from that of the whole, and writing
    the parts again must give the same bytes.
    """

    def size(rest: Column) -> Column:
        """Of ``rest`` bytes one is a tag, and one in front of each seven bits of the payload's length is the length."""
        fits = [F.when((rest - 1 - i >= (1 << 7 * (i - 1) if i > 1 else 1)) & (rest - 1 - i < 1 << 7 * i), rest - 1 - i) for i in range(1, 5)]
        return F.coalesce(*fits, F.lit(0))

    def parts(n: Column) -> Column:
        kind = F.substr(value, F.lit(3), n)
        payload = _let(_let(F.octet_length(value) - n - 4, size), lambda m: F.when(m > 0, F.substr(value, F.octet_length(value) - m + 1, m)).otherwise(_nothing()))
        printable = F.hex(kind).rlike("^([2-7][0-9A-F])+$")
        return F.when((n < 128) & printable, F.struct(F.decode(kind, "utf-8").alias("content_type"), payload.alias("payload")))

    same = lambda x: F.when(envelope(x["content_type"], x["payload"]) == value, x)
    found = _let(_let(F.conv(F.hex(F.substring(value, 2, 1)), 16, 10).cast("int"), parts), same)
    return F.when(F.substring(value, 1, 1) == F.unhex(F.lit("0A")), found)


def decode(queue: DataFrame, hex_ids: bool = False) -> DataFrame:
    """Adds ``decoded`` (``schema.DECODED``) to rows of the queue.

    ``hex_ids`` accepts ids in JSON as hex; by default they are base64, as for all bytes.
    """

    @F.arrow_udf(DECODED)
    def run(values: pa.Array) -> pa.Array:
        return otlp.decoded_all(values.to_pylist(), hex_ids)

    return queue.withColumn("decoded", run(F.coalesce("value", _nothing())))
