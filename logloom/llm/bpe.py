"""Byte-level BPE encoding and decoding in numpy.

Distinct pre-tokens go by length into padded matrices of token ids.  In each
round every row merges its leftmost pair of the lowest rank, found through a
hash table of pairs; the matrix then loses one column, and rows that have no pair
left leave it.  Spark deals out the texts; a task holds one slice of them.

Defined results: a null or empty text has no ids; repeated rows give repeated
results; extra columns are not read; an empty table gives an empty result; very
long pre-tokens are encoded whole, and rows over ``WIDE`` bytes find the same pairs in the
same order by a heap (see ``_one_row``), as a matrix would take the square of their length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.chunks import Vocabulary
from logloom.llm.common import kept, slices

NONE = np.int32(2**31 - 1)
#: Rows over so many bytes are merged one at a time.
WIDE = 192
#: Cells of a matrix.
CELLS = 1 << 20


def load_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Ranks of a file in tiktoken's form, read on the driver; the size is that of the vocabulary."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Pairs:
    """A hash table from two neighbouring ids to the rank of what they merge into."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        self.parts = left, right, rank
        keys = self._key(np.array(left, np.int64), np.array(right, np.int64))
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self.ranks = np.full(1 << bits, NONE, np.int32)
        at, todo = self._slot(keys), np.arange(len(keys))
        values = np.array(rank, np.int32)
        while len(todo):
            free = self.keys[at[todo]] == np.iinfo(np.uint64).max
            self.keys[at[todo[free]]] = keys[todo[free]]
            won = self.keys[at[todo]] == keys[todo]
            self.ranks[at[todo[won]]] = values[todo[won]]
            todo = todo[~won]
            at[todo] = (at[todo] + 1) & self.mask

    @staticmethod
    def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; ``NONE`` where they don't merge or one of them is padding (-1)."""
        keys = self._key(a, b)
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.ranks[at], NONE)
        todo = np.flatnonzero((found != keys) & (found != np.iinfo(np.uint64).max))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[~hit & (found != np.iinfo(np.uint64).max)]
        return np.where((a < 0) | (b < 0), NONE, out)


class Bpe:
    """Encoder and decoder for one vocabulary and one pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.pairs = Pairs(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.tokens = {r: t for t, r in ranks.items()}
        self.one_by_one: dict[tuple[int, int], int] = {}

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; each match of the pattern is encoded by itself."""
        found = [self.pattern.findall(t) for t in texts]
        words = list(set().union(*found))
        coded = dict(zip(words, self.encode_words([w.encode("utf-8", "replace") for w in words])))
        return [coded[f[0]] if len(f) == 1 else np.concatenate([coded[w] for w in f]) if f else np.empty(0, np.int32) for f in found]

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        widths = np.where(sizes <= 16, sizes, np.where(sizes <= WIDE, (sizes + 15) // 16 * 16, 0))
        for width in np.unique(widths):
            rows = np.flatnonzero(widths == width)
            if width == 0:
                for i in rows:
                    out[i] = self._one_row(self.byte_ids[np.frombuffer(words[i], np.uint8)]) if words[i] else np.empty(0, np.int32)
                continue
            for first in range(0, len(rows), step := max(1, CELLS // int(width))):
                part = rows[first : first + step]
                codes = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in part), np.uint8).reshape(len(part), width)
                ids = np.where(np.arange(width) < sizes[part, None], self.byte_ids[codes], np.int32(-1))
                self._matrix(ids, part, out)
        return out

    def _matrix(self, ids: np.ndarray, rows: np.ndarray, out: list) -> None:
        """One merge for every row in each round, until no row has a pair that merges."""
        ranks = self.pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while len(rows):
            if ranks.shape[1]:
                at = ranks.argmin(1)  # the leftmost of equals
                low = ranks[np.arange(len(rows)), at]
            else:
                low = np.full(len(rows), NONE)
            done = low == NONE
            if done.any():
                kept = ids[done]
                for i, row, n in zip(rows[done], kept, (kept >= 0).sum(1)):
                    out[i] = row[:n].copy()
                if done.all():
                    return
                ids, ranks, rows, at, low = ids[~done], ranks[~done], rows[~done], at[~done], low[~done]
            n, each = len(rows), np.arange(len(rows))
            ids[each, at] = low
            stay = np.ones(ids.shape, bool)
            stay[each, at + 1] = False
            ids = ids[stay].reshape(n, -1)
            stay = np.ones(ranks.shape, bool)
            stay[each, at] = False
            ranks = ranks[stay].reshape(n, -1)
            has = each[at < ranks.shape[1]]
            ranks[has, at[has]] = self.pairs(ids[has, at[has]], ids[has, at[has] + 1])
            has = each[at > 0]
            ranks[has, at[has] - 1] = self.pairs(ids[has, at[has] - 1], ids[has, at[has]])

    def _one_row(self, ids: np.ndarray) -> np.ndarray:
        """A row of its own: the leftmost pair of the lowest rank comes from a heap, neighbours from links."""
        if not self.one_by_one:
            left, right, rank = self.pairs.parts
            self.one_by_one = dict(zip(zip(left, right), rank))
        rank_of = self.one_by_one.get
        own, n = ids.tolist(), len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        low = self.pairs(ids[:-1], ids[1:]).tolist() + [int(NONE)]  # of each place and the next
        heap = [(r, i) for i, r in enumerate(low) if r != NONE]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            if low[i] != r:  # merged in the meantime
                continue
            gone = after[i]
            own[i], low[gone] = r, -1
            after[i] = j = after[gone]
            low[i] = NONE
            if j < n:
                before[j] = i
                low[i] = rank_of((r, own[j]), NONE)
                if low[i] != NONE:
                    heappush(heap, (low[i], i))
            own[gone] = -1
            if (k := before[i]) >= 0:
                low[k] = rank_of((own[k], r), NONE)
                if low[k] != NONE:
                    heappush(heap, (low[k], k))
        return np.array([x for x in own if x >= 0], np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, with_ids: bool = False, keep: list[str] = ()) -> DataFrame:
    """``doc_id``, ``n_tokens``, digests of the ids and of the bytes decoded from them.

    ``with_ids`` adds ``token_ids``; ``keep`` names further columns to carry along.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((ranks, pattern))  # of the vocabulary's size
    carried = ["doc_id", *keep]
    base = docs.select(*carried, F.col("text").cast("string").alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-1]]
    fields += ["n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"] + ["token_ids array<int>"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make() -> tuple:
            bpe = Bpe(*shared.value)
            return bpe, Vocabulary(bpe.encode_all)

        bpe, words = kept(shared.value, make)
        for whole in batches:
            for batch in slices(whole, "__text"):
                ids, counts = words.encode_column(batch.column("__text"))
                ends = np.cumsum(counts)
                digests, back = [], []
                for a, b in zip(ends - counts, ends):
                    own = ids[a:b].tolist()
                    digests.append(hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest())
                    back.append(hashlib.sha256(b"".join(map(bpe.tokens.__getitem__, own))).hexdigest())
                columns = [batch.column(c) for c in carried] + [pa.array(counts), pa.array(digests, pa.string()), pa.array(back, pa.string())]
                names = [*carried, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return base.mapInArrow(run, ", ".join(fields))
