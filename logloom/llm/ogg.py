"""Ogg containers in a media column.

``store`` writes a payload as a container of two logical streams whose pages alternate:
eight-bit samples in packets, and a note for each packet.  ``pages_of`` walks the pages and
verifies each page's checksum; ``packets_of`` joins lacing values to packets, also over
pages, for each stream by itself; times follow from granule positions and the rate in the
stream's first packet.

Rows stay where they are: no shuffle, and a task holds one slice of the texts.

Defined results: a null text is an empty one and its payload 64 zero bytes; repeated rows
give repeated results; an empty table gives an empty result; further columns are not read;
a damaged page raises, naming its place.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import slices

RATE, PACKET, PAGE_PACKETS = 8000, 4000, 12
HEAD = struct.Struct("<4sBBqIIIB")
FIRST, LAST, CONTINUED = 2, 4, 1
#: Each byte with its bits in reverse.
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(data: bytes) -> int:
    """The CRC of Ogg pages (polynomial 04C11DB7, most significant bit first, from 0).

    It is the mirror image of zlib's, which takes bits in the other order.
    """
    mirrored = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{mirrored:032b}"[::-1], 2)


class _Stream:
    """Packs packets of one logical stream into pages."""

    def __init__(self, serial: int):
        self.serial, self.number = serial, 0

    def pages(self, packets: list[tuple[bytes, int]], last: bool) -> Iterator[bytes]:
        """Pages for (packet, granule position after it); a page is full at 255 lacing values."""
        lacing: list[int] = []
        body: list[bytes] = []
        granule, carried = -1, False
        for i, (packet, position) in enumerate(packets):
            values = [255] * (len(packet) // 255) + [len(packet) % 255]
            at = 0
            while values:
                room = 255 - len(lacing)
                now, values = values[:room], values[room:]
                n = sum(now)
                lacing += now
                body.append(packet[at : at + n])
                at += n
                if not values:
                    granule = position
                if len(lacing) == 255:
                    end = last and not values and i == len(packets) - 1
                    yield self._page(lacing, body, granule, carried, end)
                    lacing, body, granule, carried = [], [], -1, bool(values)
        if lacing:
            yield self._page(lacing, body, granule, carried, last)

    def _page(self, lacing: list[int], body: list[bytes], granule: int, carried: bool, last: bool) -> bytes:
        flags = CONTINUED * carried | FIRST * (self.number == 0) | LAST * last
        parts = [HEAD.pack(b"OggS", 0, flags, granule, self.serial, self.number, 0, len(lacing)), bytes(lacing), *body]
        self.number += 1
        page = bytearray(b"".join(parts))
        struct.pack_into("<I", page, 22, checksum(bytes(page)))
        return bytes(page)


def store(payload: bytes) -> bytes:
    """The payload as an Ogg container; equal payloads give equal bytes."""
    seed = zlib.crc32(payload)
    samples, notes = _Stream(seed & 0xFFFFFFFE), _Stream(seed | 1)
    out = [*samples.pages([(b"samples\0" + struct.pack("<IQ", RATE, len(payload)), 0)], False)]
    out += notes.pages([(b"notes\0\0\0" + struct.pack("<I", RATE), 0)], False)
    cuts = list(range(0, len(payload), PACKET))
    for first in range(0, len(cuts), PAGE_PACKETS):
        group = [(payload[at : at + PACKET], min(at + PACKET, len(payload))) for at in cuts[first : first + PAGE_PACKETS]]
        last = first + PAGE_PACKETS >= len(cuts)
        out += samples.pages(group, last)
        out += notes.pages([(struct.pack("<II", len(p), zlib.crc32(p)), end) for p, end in group], last)
    return b"".join(out)


def pages_of(media: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """(serial, number, flags, granule position, lacing values, body) of each page; bad ones raise."""
    at = 0
    while at < len(media):
        if media[at : at + 4] != b"OggS" or len(media) - at < HEAD.size:
            raise ValueError(f"no page at {at}")
        _, _, flags, granule, serial, number, crc, n = HEAD.unpack_from(media, at)
        lacing = media[at + HEAD.size : at + HEAD.size + n]
        begin = at + HEAD.size + n
        end = begin + sum(lacing)
        if checksum(media[at : at + 22] + bytes(4) + media[at + 26 : end]) != crc or end > len(media):
            raise ValueError(f"damaged page at {at}")
        yield serial, number, flags, granule, lacing, media[begin:end]
        at = end


def packets_of(media: bytes) -> dict[int, list[tuple[bytes, int, int]]]:
    """For each logical stream (packet, granule position of its page, page number) in order."""
    out: dict[int, list] = {}
    parts: dict[int, list[bytes]] = {}
    due: dict[int, int] = {}
    ended: dict[int, bool] = {}
    for serial, number, flags, granule, lacing, body in pages_of(media):
        if number != due.get(serial, 0) or bool(flags & FIRST) != (number == 0) or bool(flags & CONTINUED) != bool(parts.get(serial)):
            raise ValueError(f"stream {serial} is broken at page {number}")
        due[serial] = number + 1
        held, own = parts.setdefault(serial, []), out.setdefault(serial, [])
        # A packet ends at each lacing value under 255.
        ends = np.cumsum(np.frombuffer(lacing, np.uint8), dtype=np.int64)
        at = 0
        for end in ends[np.frombuffer(lacing, np.uint8) < 255].tolist():
            own.append((b"".join([*held, body[at:end]]), granule, number))
            held.clear()
            at = end
        if lacing and lacing[-1] == 255:
            held.append(body[at:])
        ended[serial] = bool(flags & LAST)
    if any(parts.values()) or not all(ended.values()):
        raise ValueError("a stream has no end")
    return out


def features(media: bytes) -> dict:
    """What the stored bytes hold: the payload and numbers from its container."""
    streams = packets_of(media)
    payload, note = b"", {}
    for packets in streams.values():
        if packets[0][0].startswith(b"samples\0"):
            rate, size = struct.unpack("<IQ", packets[0][0][8:])
            payload = b"".join(p for p, _, _ in packets[1:])
            if len(payload) != size:
                raise ValueError("samples are missing")
            # Only the last packet that ends on a page has the page's granule position.
            times = sorted({g / rate for _, g, _ in packets[1:] if g >= 0})
            pages, n = packets[-1][2] + 1, len(packets) - 1
        else:
            note = {i: struct.unpack("<II", p) for i, (p, _, _) in enumerate(packets[1:])}
    if sum(size for size, _ in note.values()) != len(payload):
        raise ValueError("the notes don't fit the samples")
    samples = np.frombuffer(payload, np.uint8)
    mean = float(samples.mean())
    return {
        "payload": payload,
        "feature": f"streams={len(streams)};pages={pages};packets={n};rate={rate};seconds={times[-1]:.6f};first={times[0]:.6f};mean={mean:.4f};rms={float(np.sqrt(np.square(samples, dtype=np.float64).mean())):.4f}",
    }


def stored(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes`` of the text and ``media``, the container of its padded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text"):
                texts = batch.column(1).to_pylist()
                media = [store(t.ljust(max(64, -(-len(t) // 64) * 64), b"\0")) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    base = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("__text"))
    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, media binary")


def described(media: DataFrame) -> DataFrame:
    """Reads ``media`` back: digests of the payload and of the container, and its features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "media"):
                stored_bytes = batch.column(2).to_pylist()
                found = [features(m) for m in stored_bytes]
                columns = [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(f["payload"]) for f in found], pa.int64()),
                    pa.array([hashlib.sha256(f["payload"]).hexdigest() for f in found], pa.string()),
                    pa.array([zlib.crc32(f["payload"][-64:]) for f in found], pa.int64()),
                    pa.array([len(m) for m in stored_bytes], pa.int64()),
                    pa.array([hashlib.sha256(m).hexdigest() for m in stored_bytes], pa.string()),
                    pa.array([f["feature"] for f in found], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
