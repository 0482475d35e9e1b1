"""Mixing sources to target weights by Sainte-Lague apportionment.

The words of all sources are houses of equal-token blocks.  Each source gets the seats
that the highest quotients target / (2 j - 1) give it.  Its documents stand in a line in
seeded order, cut into blocks, and the line into shards of whole blocks: a shard takes the
seats whose quotients fall into its part, so it has an integer quota of each source.  Then
each shard by itself selects blocks of its own: with a quota of q and n blocks every block
q div n times, and q mod n blocks once more, those that an even step with a start seeded
for source and shard hits.

Blocks have ``BLOCK_WORDS`` words.  A source whose target is less than a hundred of these
has blocks half, a quarter, ... as long and is seated with its like, so a small source
comes near its target too and changes nothing for the others.

Everything is DataFrame expressions.  Only sums by source, and by source and
1/4096 of the hash range, are gathered; a source that holds a third of all rows
is spread over 4096 window groups.  One row a source is ordered in one task.

Defined results: a null source is a source of its own, the last; a null text has
size 0 and nothing is taken of it; sources without words have target 0; a row's place
follows from its id and text, so rows with null or repeated ids are rows like others and
equal rows stand in the line one after another; an empty table gives an empty result;
further columns may have any name and are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import WORD, named, table

SEED, BLOCK_WORDS, MOST_REPEATS, SHARDS = 17, 128, 3, 64


def _digest(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def sizes(docs: DataFrame, seed: int = SEED, *keep: Column) -> DataFrame:
    """``doc_id``, ``source``, ``size`` in words, ``place`` in the seeded order, its ``slot`` of 4096, and ``keep``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    place = _digest(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), _digest(text)))
    size = F.regexp_count(text, F.lit(WORD)).cast("bigint")
    return docs.select("doc_id", "source", size.alias("size"), place.alias("place"), *keep).withColumn("slot", F.substring("place", 1, 3))


def targets(by_source: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_REPEATS) -> DataFrame:
    """Adds ``target`` to one row for each source with ``source_size``.

    Targets share all words by weight; a target stops at ``most`` times its source's size
    and the excess goes to the others by weight.  With sources in ascending order of cap
    over weight, those up to some place are capped; the rest share what is left.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    rows = by_source.withColumn("weight", nth.cast("bigint")).withColumn("cap", F.lit(most) * F.col("source_size"))
    rising = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    rows = rows.withColumns({
        "capped": F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "open": F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)),
        "total": F.sum("source_size").over(everything),
    })
    # The level at which the sources from here on share what the ones before leave.
    level = (F.col("total") - F.col("capped")) / F.col("open")
    rows = rows.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level))
    # The first source that is below its cap sets the level of all after it.
    rows = rows.withColumn("level", F.max("level").over(everything))
    share = F.col("level") * F.col("weight")
    target = F.when(F.col("level").isNull() | (share > F.col("cap")), F.col("cap").cast("double")).otherwise(share)
    return rows.select("source", "source_size", "total", target.alias("target"))


def seats(shares: DataFrame, block_words: int = BLOCK_WORDS, most: int = MOST_REPEATS) -> DataFrame:
    """Adds ``block``, ``blocks`` and ``seats`` to one row for each source with a target.

    Sources with blocks of one length share a house.  A divisor a little too large gives
    every source fewer seats than it is due, by rounding; what is missing then goes to the
    highest quotients that are left.  No source has more than ``most`` seats a block: what
    it would have beyond goes to the others' quotients.
    """
    fine = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(F.col("target") / 100, F.lit(1.0)))))
    rows = shares.withColumn("block", F.least(F.lit(block_words), fine).cast("bigint"))
    house = Window.partitionBy("block")
    rows = rows.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("bigint"))
    rows = rows.withColumns({
        "wanted": F.sum("target").over(house),
        "house": F.floor(F.sum("target").over(house) / F.col("block") + 0.5).cast("bigint"),
        "sources": F.count("*").over(house),
    })
    divisor = F.col("wanted") / F.greatest(F.col("house") - F.col("sources"), F.lit(1))
    base = F.when(F.col("target") > 0, F.floor(F.col("target") / divisor + 0.5)).otherwise(0).cast("bigint")
    rows = rows.withColumn("base", F.least(base, most * F.col("blocks")))
    rows = rows.withColumn("left", F.greatest(F.lit(0), F.col("house") - F.sum("base").over(house)))
    # Some of a source's next quotients: its part of what is left, twice over, and two more.
    more = F.ceil(2 * F.col("left") * F.col("target") / F.col("wanted")) + 2
    more = F.least(F.col("left"), more, most * F.col("blocks") - F.col("base"))
    bids = rows.where(F.col("target") > 0).withColumn("more", more).where("more > 0")
    bids = bids.select("source", "block", "target", "left", F.explode(F.sequence(F.col("base") + 1, F.col("base") + F.col("more"))).alias("nth"))
    best = Window.partitionBy("block").orderBy((F.col("target") / (2 * F.col("nth") - 1)).desc(), F.col("source").asc_nulls_last(), "nth")
    won = bids.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= F.col("left"))
    won = won.groupBy(F.col("source").alias("winner")).agg(F.count("*").alias("won"))
    rows = rows.join(won, F.col("source").eqNullSafe(F.col("winner")), "left")
    return rows.select("source", "source_size", "target", "block", "blocks", (F.col("base") + F.coalesce("won", F.lit(0))).alias("seats"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _part(i: Column, part: Column, whole: Column, more: Column) -> Column:
    """(i * part + more) div whole where the product may be too large for a long."""
    return _div(i.cast("decimal(19,0)") * part.cast("decimal(18,0)") + more.cast("decimal(19,0)"), whole.cast("decimal(19,0)")).cast("bigint")


def shard_of(i: Column, blocks: Column, shards: int) -> Column:
    """The shard of block ``i`` of a line."""
    return _div(2 * shards * i + (shards - 1), 2 * blocks)


def _shard(k: Column, blocks: Column, all_seats: Column, shards: int) -> Column:
    """A shard's first block and how many it has, the seats before it and its quota.

    Seat j of q stands at (j - 1/2) / q of the line, and highest quotients come first.
    """
    begin = lambda k: _div(2 * k * blocks + shards, F.lit(2 * shards))
    before = lambda first: _part(2 * first, all_seats, 2 * blocks, blocks)
    edges = F.struct(begin(k).alias("first"), begin(k + 1).alias("next"))
    return _let(edges, lambda e: F.struct(e["first"].alias("first"), (e["next"] - e["first"]).alias("blocks"), before(e["first"]).alias("before"), (before(e["next"]) - before(e["first"])).alias("quota")))


def shard_quotas(plan: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``source``, ``shard``, its ``first`` block of the source's line and its ``blocks``, and the ``quota`` of seats in it."""
    rows = plan.where("blocks > 0").select("source", "blocks", "seats", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))).alias("shard"))
    return rows.select("source", "shard", _shard(F.col("shard"), F.col("blocks"), F.col("seats"), shards).alias("s")).select("source", "shard", "s.first", "s.blocks", "s.quota")


def _taken_before(i: Column, blocks: Column, all_seats: Column, name: Column, shards: int) -> Column:
    """How many seats the blocks before block ``i`` fill: those of the shards before, and of its own as selected there."""

    def within(s: Column, k: Column) -> Column:
        n = F.greatest(s["blocks"], F.lit(1))
        start = F.pmod(F.conv(F.substring(_digest(F.concat(name, F.lit(":"), k.cast("string"))), 1, 8), 16, 10).cast("bigint"), n)
        at, rest = i - s["first"], s["quota"] % n
        hits = _let(start, lambda a: _part(a + at, rest, n, F.lit(0)) - _part(a, rest, n, F.lit(0)))
        return s["before"] + _div(s["quota"], n) * at + hits

    return _let(shard_of(i, blocks, shards), lambda k: _let(_shard(k, blocks, all_seats, shards), lambda s: within(s, k)))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), block_words: int = BLOCK_WORDS, most: int = MOST_REPEATS, seed: int = SEED, shards: int = SHARDS, keep: tuple[Column, ...] = ()) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken``, ``shard`` for each document, and ``keep``.

    ``taken`` counts the words that the mix takes of the document, repeats included;
    ``shard`` is that of its first block, null without words.
    """
    # Rows that travel along are not written first: their words are counted twice instead.
    narrow = sizes(docs, seed) if keep else table(sizes(docs, seed), "sizes")
    sized = sizes(docs, seed, *keep) if keep else narrow
    further = [c for c in sized.columns if c not in narrow.columns]
    by_slot = table(narrow.groupBy("source", "slot").agg(F.sum("size").alias("words")), "slots")
    plan = seats(targets(by_slot.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most), block_words, most)
    # Where each slot of each source's line begins.
    before = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    begins = by_slot.select("source", "slot", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("begins"))
    begins = begins.join(plan.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    # One key for the window and the join, so that rows are shuffled once.
    group = F.concat(F.col("slot"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")))
    begins = begins.withColumn("group", group).drop("source", "slot")
    inside = Window.partitionBy("group").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    lined = sized.withColumn("group", group).withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = lined.join(begins, "group")
    b, start = F.col("block"), F.col("begins") + F.col("within")
    rows = rows.withColumns({"start": start, "end": start + F.col("size")})
    rows = rows.withColumns({"first": _div(F.col("start"), b), "last": _div(F.col("end") - 1, b)})
    name = F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))
    upto = F.transform(F.array(F.col("first"), F.col("first") + 1, F.col("last"), F.col("last") + 1), lambda i: _taken_before(i, F.col("blocks"), F.col("seats"), name, shards))

    def taken(h: Column) -> Column:
        """Of the first and the last block what the document holds of them, of those between everything."""
        ends = (h[1] - h[0]) * (b * (F.col("first") + 1) - F.col("start")) + (h[3] - h[2]) * (F.col("end") - b * F.col("last"))
        return F.when(F.col("first") == F.col("last"), (h[1] - h[0]) * F.col("size")).otherwise(ends + b * (h[2] - h[1]))

    full = F.col("size") > 0
    out = F.when(full, _let(upto, taken)).otherwise(0)
    shard = F.when(full, shard_of(F.col("first"), F.col("blocks"), shards))
    return rows.select("doc_id", "source", "size", "source_size", "target", out.cast("bigint").alias("taken"), shard.cast("bigint").alias("shard"), *further)


def expand(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """Each row of ``docs`` as often as the mix takes its words, in whole documents.

    A part of a document becomes a whole one with that part as its probability, by a hash
    of its id and text.  Documents without words stay.  The row travels with its size
    through the one shuffle that the line needs.
    """
    whole = F.struct(*map(named, docs.columns)).alias("__row")
    rows = mix(docs, seed=seed, keep=(whole,), **options)
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("__row.text").cast("string")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + u)).otherwise(1).cast("int")
    rows = rows.withColumn("__copies", copies).where("__copies > 0")
    return rows.select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("__row.*")
