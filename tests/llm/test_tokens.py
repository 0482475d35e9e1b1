import base64
import hashlib
import os
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.llm import bpe, chunks, sstable

os.environ["TOKENIZERS_PARALLELISM"] = "false"
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
KNOWN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OWN = bpe.Bpe(RANKS, P.PATTERN)


def digest(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'aetsé 日1!"), st.characters(exclude_categories=["Cs"]))), max_size=4))
def test_texts_encode_as_the_library_does(texts):
    words = chunks.Vocabulary(OWN.encode_all, most=3)
    column = pa.array(["x y", *texts, None], pa.string()).slice(1)
    for ids, counts in (words.encode(texts), words.encode_column(column), words.encode_column(column[:-1]), words.encode(texts)):
        ends = np.cumsum(counts)
        for text, a, b in zip(texts, ends - counts, ends):
            assert ids[a:b].tolist() == KNOWN.encode_ordinary(text)
            assert OWN.decode(ids[a:b]) == text.encode()


def test_white_space_is_the_same_in_arrow():
    signs = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for form in ("{}x", "x{}", "{}"):
        values = [form.format(s) for s in signs]
        assert chunks._ragged_of(pa.array(values)).tolist() == [chunks._ragged(v) for v in values]


LIBRARY, _ = sstable.encoder(open(P.path("byte_bpe_50k.json"), "rb").read())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'aetsé 日1!"), st.characters(exclude_categories=["Cs"]))), max_size=6))
def test_columns_encode_as_the_tokenizers_library_does(texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    words = chunks.Vocabulary(LIBRARY, most=5)
    for _ in range(2):
        ids, counts = words.encode_column(pa.array(texts, pa.string()))
        ends = np.cumsum(counts)
        for text, a, b in zip(texts, ends - counts, ends):
            assert ids[a:b].tolist() == whole.encode(text, add_special_tokens=False).ids


FINE = st.text(alphabet=st.one_of(st.sampled_from(" \n\t'.,!_-(1aetsßéª×\xb5\xad\u0301\u3000日\r"), st.characters(exclude_categories=["Cs"])))


@settings(max_examples=300, deadline=None)
@given(st.lists(FINE, max_size=6))
def test_finer_chunks_encode_as_the_libraries_do(texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for encode, want in ((LIBRARY, lambda t: whole.encode(t, add_special_tokens=False).ids), (OWN.encode_all, KNOWN.encode_ordinary)):
        words = chunks.Vocabulary(encode, most=5, fine=True)
        for column in (texts, texts, [f"{a}b.\nC{a}d,\n'{a}s e" for a in texts]):
            ids, counts = words.encode_column(pa.array(column, pa.string()))
            ends = np.cumsum(counts)
            for text, a, b in zip(column, ends - counts, ends):
                assert ids[a:b].tolist() == want(text)


def test_a_word_before_signs_and_lines_is_encoded_once():
    from tokenizers import Tokenizer

    file = open(P.path("byte_bpe_50k.json"), "rb").read()
    encode, tokenizer = sstable.encoder(file)
    asked = []
    words = chunks.Vocabulary(lambda texts: (asked.extend(texts), encode(texts))[1], fine=sstable.reads_as_gpt2(tokenizer))
    r = random.Random(5)
    known = ["".join(r.choice("abcdefgh") for _ in range(12)) for _ in range(2000)]
    texts = ["We " + " ".join(f"{w}{end}" for w in known) + " end" for end in ("", ".", ",", ";", "!", "...", ".\nThen", "\nNow")]
    ids, counts = words.encode_column(pa.array(texts))
    assert len(set(asked)) == len(asked) < 2020
    assert ids.tolist() == [i for e in Tokenizer.from_buffer(file).encode_batch(texts, add_special_tokens=False) for i in e.ids]
    # Without the pattern of GPT-2 nothing is cut finer.
    other = Tokenizer.from_buffer(file)
    assert sstable.reads_as_gpt2(other)
    from tokenizers import pre_tokenizers

    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    assert not sstable.reads_as_gpt2(other)


def test_what_is_kept_is_bounded_by_ids_too():
    words = chunks.Vocabulary(OWN.encode_all, most=4)
    texts = [f"a {c * 500} b" for c in "qxz"]
    ids, counts = words.encode_column(pa.array(texts))
    assert ids.tolist() == [i for t in texts for i in KNOWN.encode_ordinary(t)]
    assert len(words.flat) <= 4 * words.IDS and len(words.index) == len(words.ends) - 1


@pytest.mark.parametrize("word", ["a" * 5000, "ab" * 3000, "abcab" * 900, "the" * 1500, "".join(chr(97 + i * i % 26) for i in range(4000)), "é" * 700])
def test_long_words_encode_as_the_library_does(word):
    assert OWN.encode_all([word])[0].tolist() == KNOWN.encode_ordinary(word)


def test_a_very_long_word_takes_time_in_proportion():
    r = random.Random(2)
    word = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000))
    began = time.perf_counter()
    ids = OWN.encode_all([word])[0]
    assert time.perf_counter() - began < 20 and OWN.decode(ids) == word.encode() and ids.tolist() == KNOWN.encode_ordinary(word)


def test_a_shared_id_is_spread_over_shards(spark):
    docs = spark.createDataFrame([(None if i < 600 else 5, f"text {i % 300}") for i in range(1200)], "doc_id bigint, text string")
    shards = sstable.write(docs, P.path("byte_bpe_50k.json"), 2, shards=8)
    assert max(r.n_docs for r in shards.collect()) < 400 and sstable.read(shards).count() == 1200
    found = sstable.lookup(shards, spark.createDataFrame([(5,)], "doc_id bigint")).collect()
    assert len(found) == 600


def test_query_of_bpe(spark, docs, no_docs, rows):
    found = bpe.encoded(docs, RANKS, P.PATTERN, with_ids=True, keep=["source"]).collect()
    want = sorted((i if i is not None else -1, len(ids := KNOWN.encode_ordinary(t or "")), digest(" ".join(map(str, ids)).encode()), digest((t or "").encode())) for i, t, _, _ in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == want
    assert all(len(r.token_ids) == r.n_tokens for r in found)
    assert bpe.encoded(no_docs, RANKS, P.PATTERN).count() == 0


def test_shards(spark, docs, no_docs, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    shards = sstable.write(docs, P.path("byte_bpe_50k.json"), 2, shards=5)
    found = sorted(sstable.read(shards, with_ids=True).collect(), key=lambda r: r.start)
    start = 0
    for row, (doc_id, text, _, _) in zip(found, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, np.uint64(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)).astype(np.int64)))):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32, row.token_ids) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        start += len(ids)
    assert len(found) == len(rows)
    asked = spark.createDataFrame([(7,), (600,), (12345,), (-3,), (None,)], "doc_id bigint")
    got = {(r.doc_id, len(r.token_ids)) for r in sstable.lookup(shards, asked).collect()}
    assert got == {(r.doc_id, r.n_tokens) for r in found if r.doc_id in (7, 600)}
    assert sstable.read(sstable.write(no_docs, P.path("byte_bpe_50k.json"), 2, shards=2)).count() == 0


def test_shard_format(tmp_path):
    import pyarrow as pa

    keys = sorted({sstable.key_of(i * 37 - 5000) for i in range(3000)} | {sstable.key_of(None)})
    with open(tmp_path / "x.sst", "wb") as f:
        out = sstable.Writer(f, wide=False)
        for n, k in enumerate(keys):
            out.add(k, np.arange(n % 300))
        out.close()
    reader = sstable.Reader(pa.OSFile(str(tmp_path / "x.sst")))
    assert [k for k, _ in reader] == keys and reader.n_blocks > 1
    assert all([v.tolist() for v in reader.get(k)] == [list(range(n % 300))] for n, k in enumerate(keys))
    absent = [sstable.key_of(i) for i in range(10**6, 10**6 + 2000)]
    assert not any(reader.get(k) for k in absent)
    assert sum(reader.may_hold(k) for k in absent) < 100
    data = bytearray((tmp_path / "x.sst").read_bytes())
    data[100] ^= 1
    (tmp_path / "y.sst").write_bytes(data)
    with pytest.raises(ValueError):
        list(sstable.Reader(pa.OSFile(str(tmp_path / "y.sst"))))
