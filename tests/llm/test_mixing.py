import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from logloom.llm import mixing


def plain_targets(sizes: dict, weights=(1, 2, 3), most=3) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        rest = sum(weight[s] for s in order if s not in capped)
        target = {s: most * sizes[s] if s in capped else left * weight[s] / rest for s in order}
        over = {s for s in order if target[s] > most * sizes[s] + 1e-9}
        if not over:
            return target
        capped |= over


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_query_of_mixing(docs, no_docs, rows):
    found = mixing.mix(docs).collect()
    sizes = defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += size(text)
    targets = plain_targets(sizes)
    assert Counter((r.doc_id, r["size"], r.source_size) for r in found) == Counter((i, size(t), sizes[s]) for i, t, _, s in rows)
    taken = Counter()
    for r in found:
        assert r.target == pytest.approx(targets[r.source])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for source, target in targets.items():
        assert abs(taken[source] - target) <= max(0.02 * target, 3)
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, found))
    assert mixing.mix(no_docs).count() == 0


def shares_of(spark, rows):
    return spark.createDataFrame([(s, n, float(t)) for s, n, t in rows], "source string, source_size bigint, target double")


def test_seats_go_to_the_highest_quotients(spark):
    shares = shares_of(spark, [("a", 10_000, 5300), ("b", 10_000, 3700), ("c", 10_000, 1000)])
    plan = {r.source: r for r in mixing.seats(shares, block_words=10).collect()}
    house = 1000
    quotients = sorted(((n / (2 * j + 1), s) for s, n in (("a", 5300), ("b", 3700), ("c", 1000)) for j in range(house)), reverse=True)[:house]
    # c has less than a hundred blocks and shorter ones of its own.
    assert (plan["a"].block, plan["c"].block, plan["c"].seats) == (10, 8, 125)
    quotients = sorted(((n / (2 * j + 1), s) for s, n in (("a", 5300), ("b", 3700)) for j in range(house)), reverse=True)[:900]
    assert {s: plan[s].seats for s in "ab"} == Counter(s for _, s in quotients)


def test_a_tiny_source_changes_nothing_for_the_others(spark):
    rows = [("a", 100_000, 250_000), ("b", 400_000, 300_000), ("c", 300_000, 250_000)]
    plan = {r.source: r for r in mixing.seats(shares_of(spark, rows)).collect()}
    more = {r.source: r for r in mixing.seats(shares_of(spark, [*rows, ("t", 5, 15)])).collect()}
    assert {s: more[s] for s in "abc"} == plan and (more["t"].block, more["t"].seats) == (1, 15)


def test_no_source_has_more_seats_than_it_can_fill(spark):
    """What a source cannot fill goes to the others' quotients, and the house stays full."""
    rows = [(f"s{i}", 1000 + i, 3 * (1000 + i) if i % 2 else 900 + 7 * i) for i in range(41)]
    plan = mixing.seats(shares_of(spark, rows), block_words=8).collect()
    assert all(p.seats <= 3 * p.blocks for p in plan)
    for block in {p.block for p in plan}:
        own = [p for p in plan if p.block == block]
        assert sum(p.seats for p in own) == int(sum(p.target for p in own) / block + 0.5)


def plain_blocks(source, blocks, quotas, seed):
    """How often each block is taken, shard by shard: exactly the quota, by an even step from a seeded start."""
    counts = [0] * blocks
    for shard, first, n, quota in quotas:
        if not n:
            assert not quota
            continue
        start = int(hashlib.md5(f"{seed}:{source or ''}:{shard}".encode()).hexdigest()[:8], 16) % n
        for t in range(n):
            counts[first + t] = quota // n + (start + t + 1) * (quota % n) // n - (start + t) * (quota % n) // n
        assert sum(counts[first : first + n]) == quota
    return counts


@pytest.mark.parametrize("shards", [1, 7, 64])
def test_shards_take_their_quotas_exactly(spark, docs, rows, shards):
    """Each document's words counted block by block in plain Python."""
    found = mixing.mix(docs, shards=shards, block_words=16)
    of_source = found.groupBy("source").agg(F.sum("size").alias("source_size"), F.first("target").alias("target"))
    plan = {r.source: r for r in mixing.seats(of_source, block_words=16).collect()}
    quotas = defaultdict(list)
    for r in mixing.shard_quotas(mixing.seats(of_source, block_words=16), shards).orderBy("shard").collect():
        quotas[r.source].append((r.shard, r.first, r["blocks"], r.quota))
    want = Counter()
    for source, p in plan.items():
        own = quotas[source]
        assert sum(q for *_, q in own) == p.seats and max(q for *_, q in own) - min(q for *_, q in own) <= 2 * 3 + 1
        counts = plain_blocks(source, p.blocks, own, 17)
        lined = sorted((hashlib.md5(f"17:{'' if i is None else i}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest(), -1 if i is None else i, size(t)) for i, t, _, s in rows if s == source)
        at = 0
        for _, i, n in lined:
            shard = next((k for k, first, m, _ in own if first <= at // p.block < first + m), None) if n else None
            want[i, n, sum(counts[w // p.block] for w in range(at, at + n)), shard] += 1
            at += n
    assert Counter((-1 if r.doc_id is None else r.doc_id, r["size"], r.taken, r.shard) for r in found.collect()) == want


def test_rows_of_one_id_are_spread(spark):
    docs = spark.createDataFrame([(None if i % 2 else 5, f"text number {i}", "a") for i in range(2000)], "doc_id bigint, text string, source string")
    assert mixing.sizes(docs).groupBy("source", "slot").count().agg(F.max("count")).first()[0] < 20


def test_expand_repeats_whole_rows(docs, rows):
    out = mixing.expand(docs)
    assert out.columns == docs.columns
    copies = Counter((r.doc_id, r.text) for r in out.collect())
    assert copies == Counter((r.doc_id, r.text) for r in mixing.expand(docs.repartition(5)).collect())
    want = defaultdict(list)
    for r in mixing.mix(docs, keep=(F.col("text").alias("__text"),)).collect():
        want[r.doc_id, r["__text"]].append(r.taken / r["size"] if r["size"] else 1)
    for key, taken in want.items():
        assert abs(copies[key] - sum(taken)) < len(taken) + 1e-9


def test_expand_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", "x", 1), (2, None, None, "y", 2)], "doc_id bigint, text string, source string, `a.b` string, taken int")
    out = mixing.expand(docs)
    assert out.columns == docs.columns and (2, None, None, "y", 2) in {tuple(r) for r in out.collect()}
