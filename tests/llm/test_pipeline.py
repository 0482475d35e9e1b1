import hashlib
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_duplicates import plain_components, plain_fingerprint
from test_mixing import plain_targets, size
from test_pii import FORMS, luhn, plain
from test_tokens import KNOWN

from logloom.llm import common, langid, mixing, simhash

#: Texts of the fixture in no language that it teaches may go or stay.
DOUBTFUL = ("日", "aaa", "abab", "é", "İ")


def plain_redaction(text):
    """Spans of the fixed forms, those that overlap as one, replaced in plain Python."""
    spans = sorted((int(a), int(b), list(FORMS).index(k)) for k, a, b in (s.split(":") for s in plain(text)))
    out, at = "", 0
    for a, b, kind in spans:
        if a >= at:
            out += (text or "")[at:a] + f"<{list(FORMS)[kind].upper()}>"
        at = max(at, b)
    return text if not spans else out + text[at:]


@pytest.fixture(scope="module")
def more_docs(spark, docs):
    """The fixture with personal data, rows without ids and ids with several texts."""
    assert luhn("4111111111111111")
    texts = [(700, "the of and that write to some.one@mail.example.com or +1 (017) 555-7713 with erthing onstion"), (701, "the reand thion of 4111 1111 1111 1111 and 10.1.2.3 that hathe ster"), (701, "another text of the same id with erthing whened"), (None, "no id here but of and that with the onstion whened ster"), (None, "no id there either and that with reand thion hathe ster")]
    rows = [(i, t, "en", "src1", len(t), 1, "k", "f", "y", 2, b"b") for i, t in texts]
    return docs.unionByName(spark.createDataFrame(rows, docs.schema))


def test_stages(spark, more_docs, tmp_path):
    """Each stage against plain Python, on what the one before has kept."""
    now = more_docs
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "mixture", "tokens"]
    for name, stage in corpus_pipeline.STAGES:
        before = now.collect()
        out = stage(spark, now, "unused")
        if name != "tokens":
            assert out.columns == more_docs.columns
        path = f"file://{tmp_path}/{name}"
        out.write.parquet(path)
        now = spark.read.parquet(path)
        after = now.collect()
        if name == "language":
            lost = Counter(r.text for r in before) - Counter(r.text for r in after)
            assert all(t is None or not any(c.isalpha() for c in t) or t.startswith(DOUBTFUL) or len(t) < 30 for t in lost)
            assert not any(r.text is None or not any(c.isalpha() for c in r.text) for r in after)
            assert all(r.lang for r in after)
        elif name == "near_duplicates":
            roots = plain_components([plain_fingerprint(r.text) for r in before], 3)
            groups = defaultdict(list)
            for r, root in zip(before, roots):
                groups[root].append(r)
            want = Counter()
            for own in groups.values():
                first = min(own, key=lambda r: (r.doc_id is None, r.doc_id or 0, hashlib.md5(r.text.encode()).hexdigest()))
                want[first.doc_id, first.text] += 1
            assert Counter((r.doc_id, r.text) for r in after) == want
        elif name == "personal_data":
            assert Counter((r.doc_id, r.text, r.n_chars) for r in after) == Counter((r.doc_id, t := plain_redaction(r.text), len(t)) for r in before)
            assert any("<CARD>" in r.text and "<IP>" in r.text for r in after) and any("<EMAIL>" in r.text and "<PHONE>" in r.text for r in after)
        elif name == "mixture":
            taken = defaultdict(list)
            for r in mixing.mix(spark.createDataFrame(before, more_docs.schema), keep=(F.col("text").alias("__text"),)).collect():
                taken[r.doc_id, r["__text"]].append(r.taken / r["size"])
            copies = Counter((r.doc_id, r.text) for r in after)
            assert set(copies) <= set(taken) and all(abs(copies[key] - sum(own)) < len(own) + 1e-9 and copies[key] <= 3 * len(own) for key, own in taken.items())
            sizes, got = Counter(), Counter()
            for r in before:
                sizes[r.source] += size(r.text)
            for r in after:
                got[r.source] += size(r.text)
            # Whole documents come near the targets as far as their own sizes let them.
            longest = defaultdict(int)
            for r in before:
                longest[r.source] = max(longest[r.source], size(r.text))
            assert all(abs(got[s] - t) <= 4 * longest[s] for s, t in plain_targets(sizes).items())
        else:
            texts = Counter((r.doc_id, r.source, r.text) for r in before)
            want = Counter({(i, s, tuple(KNOWN.encode_ordinary(t))): n for (i, s, t), n in texts.items()})
            assert Counter((r.doc_id, r.source, tuple(r.token_ids)) for r in after) == want and all(len(r.token_ids) == r.n_tokens for r in after)


def test_a_text_is_sent_once_and_nothing_of_other_stages_stays(spark, docs, monkeypatch):
    """Python workers live on between stages: what one keeps there must not add to the memory of the next."""
    sent, plain_map = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *a, **k: sent.append((self, f)) or plain_map(self, f, *a, **k))
    some = docs.where("doc_id < 30")
    fitted = langid.fit(docs.where(~langid.held_out()), sample=60)
    owner = object()
    for stage, frees in ((lambda: simhash.first_of_each(some), True), (lambda: langid.accepted(some, fitted), False), (lambda: langid.count_grams(some), True)):
        sent.clear()
        stage()
        rows, run = sent[0]
        batch = rows.toArrow().combine_chunks().to_batches()[0]
        texts = sorted(r.text for r in some.collect())
        assert sum(sorted(map(str, c.to_pylist())) == texts for c in batch.columns) == 1
        common.kept(owner, lambda: "of another stage")
        assert list(run(iter([batch])))
        assert (common._KEPT == []) == frees and owner not in common._KEPT
    common.kept(object(), lambda: common._KEPT.copy() == [] or pytest.fail("the last one is still held"))
    common.forget_kept()


def test_texts_of_other_types_travel_as_they_are(spark, docs):
    some = docs.where("doc_id < 30").withColumn("text", F.col("text").cast("binary"))
    fitted = langid.fit(docs.where(~langid.held_out()), sample=60)
    for out in (langid.accepted(some, fitted), simhash.first_of_each(some)):
        assert out.dtypes == some.dtypes and {bytes(r.text) for r in out.collect()} <= {bytes(r.text) for r in some.collect()}


def test_run_applies_the_stages_to_documents(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/sf"
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"]
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, folder).write.parquet(f"{folder}/stage-{n}")
        now = spark.read.parquet(f"{folder}/stage-{n}")
    assert Counter((r.doc_id, r.source, r.ids_sha256) for r in out.collect()) == Counter((r.doc_id, r.source, r.ids_sha256) for r in now.collect())


def test_empty_table(spark, no_docs):
    now = no_docs
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "unused")
        assert now.count() == 0
