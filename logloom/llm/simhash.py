"""Near duplicates by SimHash fingerprints and covering locality-sensitive hashing.

Two fingerprints of 64 bits link if at most ``radius`` bits differ.  Each bit
position gets a non-zero vector of ``radius + 1`` bits; for each non-zero ``v``
of as many bits, a table keeps the positions whose vector has an odd product with
``v``.  The vectors of ``radius`` positions never span the whole space, so some
``v`` has an even product with all of them: its table ignores every position in
which a pair differs, and the pair collides there.  No pair is missed.

Only distinct fingerprints go into the tables.  Buckets of up to ``block``
fingerprints are solved in one task each; larger ones in pairs of blocks, so no
task holds more than two blocks.  Either gives the edges of a spanning forest, not
all pairs.  Components follow from alternating large-star and small-star steps.

Defined results: null and empty texts and texts without words have fingerprint 0
and link like any other; repeated rows come back as often as they came; an empty
table gives an empty result; null ids stay null and lose to any other id as the
smallest of a component; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import drop_table, forget_kept, named, scratch, sent_once, slices, table

SHINGLE, SEED, RADIUS, BLOCK = 3, 42, 3, 4096


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the shingles of ``text``, whose A-Z are lowered; unsigned."""
    words = text.lower().split()  # on bytes both know ASCII only
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = ends - sizes
    k = min(shingle, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in spans], np.uint64)
    counts = np.zeros(64, np.int64)
    for first in range(0, len(hashes), 1 << 16):
        part = hashes[first : first + (1 << 16)]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *keep: Column, with_text: bool = False) -> DataFrame:
    """``keep`` (by default ``doc_id``) and ``fp``, the fingerprint of ``text`` as a signed long.

    ``with_text`` adds the text that was read, ``__text``.
    """
    base = docs.select(*(keep or [F.col("doc_id")]), F.col("text").cast("string").alias("__text"))
    names = base.columns if with_text else base.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        for whole in batches:
            for batch in slices(whole, "__text"):
                texts = batch.column("__text").cast(pa.binary())
                found = np.array([fingerprint(t or b"") for t in texts.to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(found.view(np.int64))], names=[*names, "fp"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[: len(names)]]
    return base.mapInArrow(run, ", ".join([*kinds, "fp bigint"]))


def masks(radius: int = RADIUS) -> list[int]:
    """Bit masks of the tables, as signed longs; there are 2 ** (radius + 1) - 1."""
    full = (1 << (radius + 1)) - 1
    vectors = [1 + (i * 7) % full for i in range(64)]
    out = []
    for v in range(1, full + 1):
        mask = sum(1 << i for i in range(64) if bin(vectors[i] & v).count("1") % 2)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Edges that span what links within ``left`` (right: None), or within both together."""
    points = left if right is None else np.concatenate([left, right])
    edges, rest = [], np.arange(len(points))
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            near = np.full(len(rest), -1)
            for a in front:
                close = np.bitwise_count(points[rest] ^ points[a]) <= radius
                near[close & (near < 0)] = a
            hit = near >= 0
            edges += zip(near[hit].tolist(), rest[hit].tolist())
            front, rest = rest[hit], rest[~hit]
    return [(int(points[a]), int(points[b])) for a, b in edges]


def _solve(buckets: DataFrame, radius: int) -> DataFrame:
    """Edges from rows with an array ``fps``, and perhaps a second one, ``more``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        for batch in batches:
            edges = []
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for row in zip(*columns):
                sides = [np.array(x, np.int64).view(np.uint64) for x in row if x is not None]
                edges += forest(sides[0], sides[1] if len(sides) > 1 else None, radius)
            pairs = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs.min(1)), pa.array(pairs.max(1))], names=["a", "b"])

    return buckets.mapInArrow(run, "a bigint, b bigint")


def links(points: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """``a``, ``b``: edges between distinct fingerprints (column ``fp``) that connect all that link."""
    tables = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks(radius))])
    keyed = points.select("fp", F.explode(tables).alias("key"))
    counts = keyed.groupBy("key").count().where("count > 1")
    counts = table(counts, "buckets")
    small = keyed.join(counts.where(F.col("count") <= block), "key", "left_semi")
    found = _solve(small.groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps"), radius)
    large = counts.where(F.col("count") > block)
    if not large.isEmpty():
        n = F.ceil(F.col("count") / F.lit(block))
        own = F.pmod(F.xxhash64("fp", F.lit("block")), n)
        # Each fingerprint goes to the pairs of blocks that its own block is in.
        dealt = keyed.join(large, "key").select("key", "fp", own.alias("own"), n.alias("n"))
        dealt = dealt.select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
        dealt = dealt.groupBy("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")).agg(F.collect_list("fp").alias("fps"))
        found = found.unionByName(_solve(dealt.select("fps"), radius))
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root``: the smallest node that each node of the edges ``a``, ``b`` reaches."""
    edges, before = table(edges.select("a", "b"), "edges"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: neighbours above a node move to the smallest that it sees.
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        up = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: a node and its neighbours below move to the smallest of these.
        least = up.groupBy("a").agg(F.min("b").alias("m"))
        down = up.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        step = table(down.select("e.*").where("a <> b").distinct(), "edges")
        now = step.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_table(edges)
        edges = step
        if now == before or not now[0]:
            break
        before = now
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))


def _rooted(prints: DataFrame, radius: int, block: int) -> DataFrame:
    """``fp``, ``least`` (its smallest id) and ``root`` for each distinct fingerprint of ``prints``."""
    with scratch(prints.sparkSession) as keep:
        points = table(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
        found = components(links(points, radius, block))
        rooted = points.join(found, points.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        return keep(table(rooted, "roots"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` for each row of ``docs``."""
    prints = table(fingerprints(docs), "fingerprints")
    rooted = _rooted(prints, radius, block)
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """One row of ``docs`` for each component: the one with the smallest id (null is the last),
    then the smallest digest of the text, then the smallest digest of the further columns.

    The component is that of the row's own text, so neither null nor repeated ids mix rows
    up; each row has a number of its own, by which the survivors are found again.
    """
    further = [c for c in docs.columns if c not in ("doc_id", "text")]
    digest = F.coalesce(F.md5(F.col("text").cast("string").cast("binary")), F.lit(""))
    others = F.md5(F.to_json(F.struct(*map(named, further))).cast("binary")) if further else F.lit("")
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), digest.alias("digest"), others.alias("others"))
    once = sent_once(docs)
    place_of = {c: "__text" if once and c == "text" else f"__{i}" for i, c in enumerate(docs.columns)}
    columns = [named(c).alias(at) for c, at in place_of.items() if at != "__text"]
    rows = table(fingerprints(docs, F.monotonically_increasing_id().alias("__row"), place.alias("__place"), *columns, with_text=once), "rows")
    prints = table(rows.select(F.col("__place.doc_id").alias("doc_id"), "fp", F.struct("__place", "__row").alias("first")), "fingerprints")
    rooted = _rooted(prints, radius, block).select("fp", "root")
    # Rows of one fingerprint first, so that a large component is small before it is dealt out.
    firsts = prints.groupBy("fp").agg(F.min("first").alias("first")).join(rooted, "fp").groupBy("root").agg(F.min("first").alias("first"))
    kept = rows.join(firsts.select(F.col("first.__row").alias("__row")), "__row", "left_semi")
    return kept.select(*[F.col(at).alias(c) for c, at in place_of.items()])
