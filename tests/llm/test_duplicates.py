import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.llm import simhash


def plain_fingerprint(text: str | None) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(prints: list[int], radius: int) -> list[int]:
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 63), max_size=3))
def test_every_pair_within_the_radius_collides(bits):
    a = 0x123456789ABCDEF0
    b = a
    for i in bits:
        b ^= 1 << i
    assert any((a & m & (2**64 - 1)) == (b & m & (2**64 - 1)) for m in simhash.masks())


def test_tables_keep_about_half_of_the_bits():
    kept = [(m & (2**64 - 1)).bit_count() for m in simhash.masks()]
    assert len(kept) == 15 and all(28 <= k <= 40 for k in kept)


def test_query_of_simhash(docs, no_docs, rows):
    found = simhash.near_duplicates(docs).collect()
    prints = [plain_fingerprint(t) for _, t, _, _ in rows]
    roots = plain_components(prints, 3)
    least = {}
    for (doc_id, *_), root in zip(rows, roots):
        if doc_id is not None:
            least[root] = min(least.get(root, doc_id), doc_id)
    want = sorted((str(r[0]), f"{p:016x}", str(least.get(root))) for r, p, root in zip(rows, prints, roots))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found) == want
    assert simhash.near_duplicates(no_docs).count() == 0


def test_large_buckets_lose_no_link(spark):
    """With blocks of four all buckets go through the pairs of blocks."""
    r = np.random.default_rng(1)
    base = int(r.integers(0, 2**63))
    points = {base}
    for _ in range(300):
        x = list(points)[int(r.integers(len(points)))]
        for b in r.choice(64, int(r.integers(1, 6)), replace=False):
            x ^= 1 << int(b)
        points.add(x)
    points = sorted(points)
    signed = [p - 2**64 if p >> 63 else p for p in points]
    df = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    found = {r.node: r.root for r in simhash.components(simhash.links(df, block=4)).collect()}
    roots = plain_components(points, 3)
    groups = {}
    for p, root in zip(signed, roots):
        groups.setdefault(root, []).append(p)
    for members in groups.values():
        assert {found.get(p, p) for p in members} == {min(members)}


def test_chain_becomes_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)], "a bigint, b bigint")
    assert {r.root for r in simhash.components(edges).collect()} == {0}
    assert simhash.components(edges.limit(0)).count() == 0


def test_first_of_each(docs, rows):
    kept = simhash.first_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 10 in ids and not set(range(200, 240)) & set(ids)


def test_first_of_each_keeps_one_row_of_each_component(spark):
    """Null ids and an id with two texts: each component of texts keeps one row, the same one again on a rerun."""
    a, b, c, d = ("red sun over the old mill", "nine grey geese fly south today", "copper kettles sing in winter", "my only line without an id")
    rows = [(3, a, "x"), (5, b, "x"), (5, a, "x"), (6, b, "y"), (None, c, "x"), (None, c, "y"), (None, d, "x"), (None, a, "x"), (9, None, "x"), (None, "", "x")]
    rows += [(3, a, "x"), (7, "second text of seven is this", "x"), (7, "and a third one for the same id", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    kept = [tuple(r) for r in simhash.first_of_each(docs).collect()]
    assert sorted(r[:2] for r in kept if r[0] is not None) == [(3, a), (5, b), (7, "and a third one for the same id"), (7, "second text of seven is this")] + [(9, None)]
    assert sorted(r[1] for r in kept if r[0] is None) == [c, d]
    again = [tuple(r) for r in simhash.first_of_each(docs.orderBy(docs.text.desc(), docs.source.desc()).repartition(5)).collect()]
    assert sorted(again, key=str) == sorted(kept, key=str)
