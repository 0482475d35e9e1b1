import zlib

import numpy as np
import pyarrow as pa
import pytest

from logloom.llm import langid, quality


def test_language_models_are_interpolated_kneser_ney(spark):
    """Probabilities as the formula gives them, and they sum to one over all letters."""
    texts = ["abab ab abc", "ba ba cab"]
    sample = spark.createDataFrame([(t, "xx") for t in texts] + [("zz zy", "yy")], "text string, lang string")
    models = langid.Models(langid.count_grams(sample, 2).toPandas(), 2)
    grams = {}
    for t in texts:
        for w in t.split():
            for a, b in zip("\2" + w, w + "\3"):
                grams[a, b] = grams.get((a, b), 0) + 1
    d, letters = 0.75, 6  # a b c z y and the end, and one for the unseen
    after = {b: len({x for x, y in grams if y == b}) for _, b in grams}
    total = sum(after.values())

    def p(a, b):
        one = max(after.get(b, 0) - d, 0) / total + d * len(after) / total / (letters + 1)
        n = sum(v for (x, _), v in grams.items() if x == a)
        kinds = len([1 for x, _ in grams if x == a])
        return one if not n else max(grams.get((a, b), 0) - d, 0) / n + d * kinds / n * one

    column = models.langs.index("xx")
    for word in ("ab", "cb", "ba", "q"):
        want = -sum(np.log2(p(a, b)) for a, b in zip("\2" + word, word + "\3"))
        assert models.bits([word])[0][column] == pytest.approx(want, rel=1e-4)


def test_costs_are_the_sums_of_the_words(spark, rows):
    """Whatever was scored before, and however words repeat, a text costs what its runs of letters cost."""
    texts = [text for _, text, *_ in rows if text is None or len(text) < 2000] + ["don't", "The THE the", "x1y²z", "\u0345a İx"]
    sample = spark.createDataFrame([(t, "xx") for t in texts[:60]] + [("zz zy", "yy")], "text string, lang string")
    models = langid.Models(langid.count_grams(sample).toPandas())
    score = langid.Scorer(models)
    found = np.concatenate([score(pa.array(texts[first : first + 50], pa.string())) for first in range(0, len(texts), 50)])
    for text, own in zip(texts, found):
        words = [r for w in (text or "").split() for r in langid.letters(w)]
        want = models.bits(words).sum(0, dtype=float) if words else np.zeros(3)
        assert own == pytest.approx(want, rel=1e-5)


def test_query_of_languages(docs, no_docs, rows):
    fitted = langid.fit(docs.where(~langid.held_out()), sample=60)
    found = langid.predict(docs, fitted).collect()
    assert len(found) == len(rows)
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, set()).add((r.lang_pred, r.score, r.rejected))
    right = [by_id[i] == {(lang, next(iter(by_id[i]))[1], False)} for i, _, lang, _ in rows if i is not None and i < 120 and i != 7]
    assert np.mean(right) > 0.97
    for i, text, *_ in rows:
        assert all(0 <= s <= 1 for _, s, _ in by_id[i])
        if i is not None and (text is None or not any(c.isalpha() for c in text)):
            assert by_id[i] == {("und", 0.0, True)}
    assert {i for i in by_id if i is not None and zlib.crc32(str(i).encode()) % 4 == 2} == {r.doc_id for r in docs.where(langid.held_out()).collect()}
    assert langid.predict(no_docs, fitted).count() == 0
    none = langid.predict(docs, langid.fit(no_docs))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    kept = langid.accepted(docs, fitted)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not r.rejected for r in found)


def test_unseen_languages_go_and_learned_ones_stay(spark):
    """A few odd documents under a language's label do not open it."""
    r = np.random.default_rng(5)
    words = {"en": "the of and that with from this house river stone people garden after water under while".split(), "de": "der die und nicht mit das haus fluss stein leute garten nach wasser unter eine auch".split()}
    text = lambda lang, n: " ".join(r.choice(words[lang], n))
    rows = [(i, text(lang, int(r.choice([3, 30, 300]))), lang) for i, lang in enumerate(["en", "de"] * 600)]
    rows += [(5000 + i, odd, "en") for i, odd in enumerate(["qqxzj vkqpw zzxqy", "xkcd qwrtz pfgh", "жшщ ъыэ юяё"])]
    fitted = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), sample=2000)
    polish = "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem"
    finnish = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto"
    seen = [(i, text(lang, n), lang) for i, (lang, n) in enumerate([(lang, n) for lang in words for n in (3, 12, 60, 900)])]
    unseen = [(100, polish, None), (101, finnish, None), (102, "все люди рождаются свободными и равными в своем достоинстве и правах", None), (103, "xq zvk jjw", None)]
    docs = spark.createDataFrame(seen + unseen, "doc_id bigint, text string, lang string")
    found = {r.doc_id: r for r in langid.predict(docs, fitted).collect()}
    assert all(not found[i].rejected and found[i].lang_pred == lang for i, _, lang in seen)
    assert {i for i, *_ in unseen if not found[i].rejected} == set(), fitted[2]
    assert sorted(r.doc_id for r in langid.accepted(docs, fitted).collect()) == [i for i, *_ in seen]
    assert langid.accepted(docs, langid.fit(docs.limit(0))).count() == len(seen + unseen)  # nothing learned, nothing lost


def test_quality(spark, no_docs):
    r = np.random.default_rng(0)
    good = ["the house of stone and river", "a long walk over green hills"]
    rows = [(i, " ".join(r.permutation(good[i // 2 % 2].split())) if i % 3 else " ".join(w.upper() + "!!" for w in r.permutation(good[i // 2 % 2].split())), "x", 1) for i in range(600)]
    rows += [(900, None, "x", 1), (901, "", "x", 1), (None, "the house", "x", 1), (5, rows[5][1], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, quality string, score int")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(0, 600, 2)] + [(None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    found = quality.score(docs, labels).collect()
    assert len(found) == len(rows) and all(0 <= f.score <= 1 and f.predicted == int(f.score >= 0.5) for f in found)
    assert all(f.held_out == (f.doc_id is not None and zlib.crc32(str(f.doc_id).encode()) % 3 == 1) for f in found)
    held = [f for f in found if f.held_out and f.doc_id < 600]
    assert np.mean([f.predicted == int(f.doc_id % 3 != 0) for f in held]) > 0.97
    assert quality.score(no_docs, labels).count() == 0
    assert {f.score for f in quality.score(docs, labels.limit(0)).collect()} == {0.5}


def test_context_sums_are_those_of_a_plain_count(spark):
    texts = ["a b c a b", "b", None, "", "c c a"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    vectors, want = quality.index_vectors(), {}
    for t in texts:
        words = (t or "").split()
        rows = []
        for w in words:
            rows.append(quality.Units()([w])[0][0].tolist())
        for i, own in enumerate(rows):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(rows):
                    for row in own:
                        want[row] = want.get(row, 0) + sum(vectors[x].astype(int) for x in rows[j])
    found = {r.row: np.array(r[1:]) for r in quality.context_sums(docs).collect()}
    for row, v in want.items():
        assert np.array_equal(found.get(row, np.zeros(quality.WIDTH, int)), v)
