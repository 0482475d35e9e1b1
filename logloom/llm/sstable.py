"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of their identifier.  Its parts, in order:

- data blocks: entries (bytes of the key shared with the entry before, further bytes,
  bytes of the value, the key's rest, the value), compressed, with a crc32 behind;
- index: for each block its last key, offset, length and first entry's number;
- Bloom filter over the keys;
- footer of fixed length: places of index and filter, counts of entries and ids, magic.

A lookup asks the filter, then searches the index and one block by halving.

Spark sorts the documents into ranges of identifiers, as many as their number and bytes ask
for; rows that share an identifier may be in several.  A task writes the shard of its range
to a file of its attempt and returns the file's path, so readers only know files that are
whole; those of other attempts are removed.  File systems are those of pyarrow's URIs.  Keys are a byte that is 0 for null, then the identifier as
eight bytes in an order-preserving form.

Defined results: null and empty texts have only the end id; a null identifier sorts
first; repeated identifiers are kept, in the order of a hash of their texts; an empty table gives
shards without entries; further columns are not read.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.chunks import Vocabulary, gather
from logloom.llm.common import kept, new_folder, slices, table

MAGIC = b"LLSST001"
FOOTER = struct.Struct("<QQQQQQQI8s")
BLOCK_BYTES, BITS_PER_KEY, PROBES = 256 << 10, 10, 7
#: Bytes of texts, and documents, to a shard.
SHARD_BYTES, SHARD_DOCS = 128 << 20, 1 << 20
SIGN = 1 << 63


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", doc_id + SIGN)


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - SIGN if key[0] else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def _bits(hashes: np.ndarray, size: int) -> np.ndarray:
    """The places of keys with these hashes in a Bloom filter of ``size`` bits, one row for each key."""
    h = hashes
    step = (h >> np.uint64(32)) | np.uint64(1)
    return (h[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(size)


class Writer:
    """Writes one shard to a stream; entries come in ascending order of their keys."""

    def __init__(self, out, wide: bool):
        self.out, self.wide, self.at = out, wide, 0
        self.hashes, self.n_keys = array("Q"), 0
        self.index: list[tuple[bytes, int, int, int]] = []
        self.ids = self.first = 0
        self.squeeze = zstandard.ZstdCompressor(level=1)
        self._begin()

    def _begin(self) -> None:
        self.block, self.held, self.last, self.first = [], 0, b"", self.n_keys

    def add(self, key: bytes, ids: np.ndarray) -> None:
        value = ids.astype("<u4" if self.wide else "<u2").tobytes()
        shared = len(os.path.commonprefix([self.last, key]))
        self.block += [varint(shared), varint(len(key) - shared), varint(len(value)), key[shared:], value]
        self.held += len(value) + 12
        self.last = key
        if not self.n_keys or key != self.previous:
            self.hashes.append(xxhash.xxh64_intdigest(key))
        self.previous = key
        self.n_keys += 1
        self.ids += len(ids)
        if self.held >= BLOCK_BYTES:
            self._end()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _end(self) -> None:
        if self.block:
            data = self.squeeze.compress(b"".join(self.block))
            self.index.append((self.last, self.at, len(data) + 4, self.first))
            self._put(data + struct.pack("<I", zlib.crc32(data)))
        self._begin()

    def close(self) -> None:
        self._end()
        index_at = self.at
        self._put(b"".join(struct.pack("<H", len(k)) + k + struct.pack("<QQQ", *rest) for k, *rest in self.index))
        bloom_at, size = self.at, max(64, (len(self.hashes) * BITS_PER_KEY + 7) // 8 * 8)
        bloom, hashes = np.zeros(size, np.uint8), np.frombuffer(self.hashes, np.uint64)
        for first in range(0, len(hashes), 1 << 16):
            bloom[_bits(hashes[first : first + (1 << 16)], size)] = 1
        self._put(np.packbits(bloom, bitorder="little").tobytes())
        self._put(FOOTER.pack(index_at, bloom_at - index_at, bloom_at, size, self.n_keys, self.ids, len(self.index), self.wide, MAGIC))


class Reader:
    """Reads a shard from a file that can be read at places (``read_at(n, offset)``)."""

    def __init__(self, file):
        self.file = file
        foot = file.read_at(FOOTER.size, file.size() - FOOTER.size)
        self.index_at, self.index_n, self.bloom_at, self.bloom_bits, self.n_keys, self.n_ids, self.n_blocks, wide, magic = FOOTER.unpack(foot)
        if magic != MAGIC:
            raise ValueError("not a shard, or one that was not finished")
        self.type = "<u4" if wide else "<u2"
        self.index, data, at = [], file.read_at(self.index_n, self.index_at), 0
        for _ in range(self.n_blocks):
            n = struct.unpack_from("<H", data, at)[0]
            self.index.append((data[at + 2 : at + 2 + n], *struct.unpack_from("<QQQ", data, at + 2 + n)))
            at += n + 26
        self.bloom = None

    def block(self, i: int) -> list[tuple[bytes, np.ndarray]]:
        _, at, n, _ = self.index[i]
        raw = self.file.read_at(n, at)
        data, crc = raw[:-4], struct.unpack("<I", raw[-4:])[0]
        if zlib.crc32(data) != crc:
            raise ValueError(f"block {i} is damaged")
        data = zstandard.ZstdDecompressor().decompress(data)
        out, at, last = [], 0, b""
        while at < len(data):
            shared, at = read_varint(data, at)
            rest, at = read_varint(data, at)
            n, at = read_varint(data, at)
            last = last[:shared] + data[at : at + rest]
            at += rest
            out.append((last, np.frombuffer(data, self.type, n // int(self.type[2]), at)))
            at += n
        return out

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(self.n_blocks):
            yield from self.block(i)

    def may_hold(self, key: bytes) -> bool:
        if self.bloom is None:
            raw = np.frombuffer(self.file.read_at((self.bloom_bits + 7) // 8, self.bloom_at), np.uint8)
            self.bloom = np.unpackbits(raw, bitorder="little")
        return bool(self.bloom[_bits(np.array([xxhash.xxh64_intdigest(key)], np.uint64), self.bloom_bits)].all())

    def get(self, key: bytes) -> list[np.ndarray]:
        """The values of a key: none, one, or several in order."""
        if not self.n_blocks or not self.may_hold(key):
            return []
        low, high = 0, self.n_blocks
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.index[mid][0] < key else (low, mid)
        out = []
        while low < self.n_blocks:
            entries = self.block(low)
            a, b = 0, len(entries)
            while a < b:
                mid = (a + b) // 2
                a, b = (mid + 1, b) if entries[mid][0] < key else (a, mid)
            while a < len(entries) and entries[a][0] == key:
                out.append(entries[a][1])
                a += 1
            if a < len(entries):
                break
            low += 1
        return out


def filesystem(uri: str):
    """A file system of pyarrow for a folder that driver and executors share, and the path in it; raises where it knows none."""
    from pyarrow import fs

    try:
        return fs.FileSystem.from_uri(uri)
    except pa.ArrowInvalid as e:
        raise ValueError(f"shards need a folder that pyarrow can write to (file, s3, gs, abfs, hdfs with its library), not {uri}") from e


def reads_as_gpt2(tokenizer) -> bool:
    """Whether texts as they are are cut by the pattern of GPT-2 and nothing else."""
    from tokenizers.pre_tokenizers import ByteLevel

    cut = tokenizer.pre_tokenizer
    return isinstance(cut, ByteLevel) and cut.use_regex and not cut.add_prefix_space and tokenizer.normalizer is None


def encoder(data: bytes):
    """``encode_all`` for a file of the tokenizers library, and its tokenizer.

    Chunks go to the library joined to longer texts, which it reads much faster; as none of
    them touches its neighbours, the ids fall to the chunks by the bytes they stand for.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_buffer(data)
    joins = " \n" if reads_as_gpt2(tokenizer) else " "
    vocabulary = tokenizer.get_vocab(with_added_tokens=False)
    bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for token, number in vocabulary.items():
        bytes_of[number] = len(token)  # a character for each byte

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum())), sizes

    def encode_all(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain, rest = [], []
        for i, t in enumerate(texts):
            (plain if len(t) > 1 and t[0] in joins and not t[1].isspace() and not t[-1].isspace() else rest).append(i)
        sizes, flat = np.zeros(len(texts), np.int64), []
        for first in range(0, len(plain), step := 20_000):
            at = plain[first : first + step]
            part = [texts[i] for i in at]
            ids, _ = encode(["".join(part[i : i + 400]) for i in range(0, len(part), 400)])
            ends = np.cumsum(np.fromiter((len(t) if t.isascii() else len(t.encode()) for t in part), np.int64, len(part)))
            sizes[at] = np.diff(np.searchsorted(np.cumsum(bytes_of[ids]), ends) + 1, prepend=0)
            flat.append(ids)
        if rest:
            ids, sizes[rest] = encode([texts[i] for i in rest])
            flat.append(ids)
        # In the order of the texts again.
        order = np.array(plain + rest, np.int64)
        starts = np.empty(len(texts), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return gather(np.concatenate([np.empty(0, np.int32), *flat]), starts, sizes), sizes

    return encode_all, tokenizer


def write(docs: DataFrame, tokenizer_path: str, end_id: int, shards: int | None = None, folder: str | None = None) -> DataFrame:
    """Writes the shards; a row for each: ``shard``, ``path``, ``n_docs``, ``n_ids``.

    ``shards`` is the number of ranges; by default that of shuffle partitions, and more for
    more than ``SHARD_BYTES`` of texts or ``SHARD_DOCS`` documents each.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "sst")
    with open(tokenizer_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())  # of the vocabulary's size
    files, root = filesystem(folder)  # fails here rather than in a task
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    if not shards:
        size = base.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("__text").cast("bigint")), F.lit(0)).alias("bytes")).first()
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size.bytes // SHARD_BYTES), -(-size.n // SHARD_DOCS))
    # An identifier that many rows share has several ranges: by its texts, and equal rows by where they stand.
    order = [F.col("doc_id").asc_nulls_first(), F.col("__hash").asc()]
    base = base.withColumns({"__hash": F.xxhash64("__text"), "__nth": F.monotonically_increasing_id()})
    ranged = base.repartitionByRange(shards, *order, "__nth").sortWithinPartitions(*order, "__text").drop("__hash", "__nth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make() -> tuple:
            encode, tokenizer = encoder(shared.value)
            return encode, tokenizer, Vocabulary(encode, most=500_000, fine=reads_as_gpt2(tokenizer))

        encode, tokenizer, words = kept(shared.value, make)
        # Strings of special tokens cut a text before its words are found; such texts go in whole.
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        shard, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        files, root = filesystem(folder)
        files.create_dir(root, recursive=True)
        name = f"shard-{shard:06d}-{attempt}.sst"
        with files.open_output_stream(f"{root}/{name}", compression=None) as stream:
            out = Writer(stream, tokenizer.get_vocab_size() > 1 << 16)
            for whole in batches:
                for batch in slices(whole, "__text", 4 << 20):
                    texts = batch.column("__text")
                    cut = np.zeros(len(texts), bool)
                    for mark in special:
                        cut |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
                    ids, counts = words.encode_column(pc.if_else(pa.array(cut), "", texts) if cut.any() else texts)
                    ends = np.cumsum(counts)
                    for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                        own = encode([texts[i].as_py()])[0] if cut[i] else ids[ends[i] - counts[i] : ends[i]]
                        out.add(key_of(doc_id), np.append(own, end_id))
            out.close()
        row = {"shard": [shard], "path": [f"{folder}/{name}"], "n_docs": [out.n_keys], "n_ids": [out.ids]}
        yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    listed = table(ranged.mapInArrow(run, "shard int, path string, n_docs bigint, n_ids bigint"), "sst-list")
    from pyarrow import fs

    whole = {r.path.rpartition("/")[2] for r in listed.select("path").collect()}  # a row for each shard
    for info in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if info.base_name.startswith("shard-") and info.base_name not in whole:
            files.delete_file(info.path)
    return listed


def read(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """From the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and, if asked for, ``token_ids``."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    placed = shards.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    n = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                files, path = filesystem(uri)
                with files.open_input_file(path) as file:
                    reader = Reader(file)
                    for i in range(reader.n_blocks):
                        rows = reader.block(i)
                        sizes = np.array([len(v) for _, v in rows], np.int64)
                        starts = start + np.cumsum(sizes) - sizes
                        start += int(sizes.sum())
                        crcs = [zlib.crc32(v.astype("<u4").tobytes()) for _, v in rows]
                        columns = [pa.array([id_of(k) for k, _ in rows], pa.int64()), pa.array(starts), pa.array(sizes), pa.array(crcs, pa.int64())]
                        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                        if with_ids:
                            columns.append(pa.array([v.tolist() for _, v in rows], pa.list_(pa.int32())))
                            names.append("token_ids")
                        yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", token_ids array<int>" * with_ids
    return placed.repartition(n, "path").mapInArrow(run, schema)


def lookup(shards: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """``doc_id`` and ``token_ids`` of the rows of ``doc_ids``: each goes to the shards whose range may hold it."""
    ranged = table(shards.select("path").repartition(1).mapInArrow(_bounds, "path string, low bigint, high bigint"), "sst-ranges")
    wanted = doc_ids.select("doc_id").where("doc_id is not null").distinct()
    pairs = wanted.join(F.broadcast(ranged), (F.col("doc_id") >= F.col("low")) & (F.col("doc_id") <= F.col("high")))  # a row for each shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader = None, None
        for batch in batches:
            for uri, doc_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if uri != name:
                    files, path = filesystem(uri)
                    name, reader = uri, Reader(files.open_input_file(path))
                found = reader.get(key_of(doc_id))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(found)), pa.array([v.tolist() for v in found], pa.list_(pa.int32()))], names=["doc_id", "token_ids"])

    return pairs.select("path", "doc_id").repartition("path").sortWithinPartitions("path", "doc_id").mapInArrow(run, "doc_id bigint, token_ids array<int>")


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for uri in batch.column(0).to_pylist():
            files, path = filesystem(uri)
            with files.open_input_file(path) as file:
                reader = Reader(file)
                if reader.n_blocks:
                    ids = [x for x in (id_of(reader.block(0)[0][0]), id_of(reader.index[-1][0])) if x is not None]
                    rows.append((uri, ids[0] if len(ids) == 2 else -SIGN, ids[-1] if ids else -SIGN))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "low", "high"])
