"""Language identification by interpolated Kneser-Ney character models.

One model for each language, over the letters of words with their boundaries, so a
text's log-probability is the sum over its words.  All models stand in one set of
sorted arrays of n-gram hashes, one array for each order, with a column for each
language; a task looks each distinct word up once.  The language with the lowest
cross-entropy by letter wins.  A softmax whose temperature held-out documents of the
sample set gives the score; a text is rejected if its cross-entropy is beyond a high
quantile of those documents of the language and a margin.  Short texts vary more and
have bounds of their own, for which the first words of each document count too.

The models come from a bounded sample: about ``SAMPLE`` documents of each language,
chosen by a hash of the id, whole; Spark counts their n-grams.

Defined results: a null or empty text, or one without letters, is ``und`` with score
0 and is rejected; rows with null ids are predicted like others; repeated rows give
repeated results; ties go to the language that sorts first; with no labelled rows
everything is ``und`` and nothing is rejected; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import crc_of_id, forget_kept, kept, named, scratch, sent_once, slices, table

ORDER, SAMPLE, DISCOUNT, MOST_WORDS = 4, 1000, 0.75, 400_000
#: A text is rejected beyond this quantile of what its language's documents of like length
#: show (at most ``SPREAD`` times as far above the median as nine tenths lie, for a few odd
#: documents among few), and a margin.  For each class of length: letters below which it
#: holds, first words of a document that stand for it, margin in bits a letter.
QUANTILE, SPREAD, LENGTHS = 0.99, 4, ((20, 2, 2.0), (80, 8, 1.5), (float("inf"), 0, 1.0))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def letters(word: str) -> list[str]:
    """The runs of letters in a word, lowered."""
    word = word.lower()
    return [word] if word.isalpha() else "".join(c if c.isalpha() else " " for c in word).split()


def grams(words: list[str], order: int) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each letter or end mark of ``words``, by order from 0 to ``order``.

    A word stands between marks; n-grams that would reach before its first mark repeat it.
    """
    flat = np.frombuffer("".join(w + "\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.arange(len(flat)) - starts
    out = [np.zeros(len(flat), np.uint64)]
    for back in range(order):
        # Mixed from the last letter to the first, so a context is not a prefix of the hash; orders never meet.
        letter = np.where(place >= back, flat[np.maximum(np.arange(len(flat)) - back, 0)], np.uint64(2))
        mixed = (out[-1] ^ (letter + np.uint64(back << 32) + np.uint64(1))) * _MULTIPLIER
        out.append(mixed ^ (mixed >> np.uint64(29)))
    return out


def contexts(words: list[str], order: int) -> list[np.ndarray]:
    """Hashes of the ``k`` letters before each place, for k from 0 to ``order`` - 1."""
    flat = np.frombuffer("".join(w + "\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = [np.zeros(len(flat), np.uint64)]
    for back in range(1, order):
        letter = np.where(place >= back, flat[np.maximum(np.arange(len(flat)) - back, 0)], np.uint64(2))
        mixed = (out[-1] ^ (letter + np.uint64(back << 40) + np.uint64(1))) * _MULTIPLIER
        out.append(mixed ^ (mixed >> np.uint64(29)))
    return out


def count_grams(sample: DataFrame, order: int = ORDER) -> DataFrame:
    """``lang``, ``k`` (order), ``gram``, ``shorter`` (the n-gram without its first letter), ``context``, ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        for whole in batches:
            for batch in slices(whole, "__text"):
                langs = np.array(batch.column(0).to_pylist(), object)
                for lang in sorted(set(langs)):
                    texts = batch.column(1).filter(pa.array(langs == lang)).to_pylist()
                    words = [w for t in texts for token in t.split() for w in letters(token)]
                    if not words:
                        continue
                    seen, held = grams(words, order), contexts(words, order)
                    for k in range(1, order + 1):
                        gram, at, n = np.unique(seen[k], return_index=True, return_counts=True)
                        columns = [pa.array([lang] * len(gram)), pa.array(np.full(len(gram), k, np.int32)), pa.array(gram.view(np.int64)), pa.array(seen[k - 1][at].view(np.int64)), pa.array(held[k - 1][at].view(np.int64)), pa.array(n)]
                        yield pa.RecordBatch.from_arrays(columns, names=["lang", "k", "gram", "shorter", "context", "n"])

    counts = sample.select("lang", F.col("text").cast("string").alias("__text")).where("lang is not null and __text is not null")
    counts = counts.mapInArrow(run, "lang string, k int, gram bigint, shorter bigint, context bigint, n bigint")
    return counts.groupBy("lang", "k", "gram", "shorter", "context").agg(F.sum("n").alias("n"))


class Models:
    """Sorted n-gram hashes with what each language adds (alpha), and sorted contexts with what it passes on (gamma)."""

    def __init__(self, counts, order: int = ORDER, discount: float = DISCOUNT):
        self.order, self.langs = order, sorted(set(counts["lang"]))
        lang = np.searchsorted(self.langs, counts["lang"].to_numpy().astype(str)) if len(counts) else np.empty(0, int)
        k, n = counts["k"].to_numpy(), counts["n"].to_numpy().astype(float)
        gram, shorter, context = (counts[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("gram", "shorter", "context"))
        self.grams, self.alpha, self.held, self.gamma = [], [], [], []
        letters = len(np.unique(gram[k == 1])) + 1
        self.uniform = 1.0 / max(letters, 2)
        for order_k in range(1, order + 1):
            own = k == order_k
            names, column = np.unique(gram[own], return_inverse=True)
            weight = np.zeros((len(names), len(self.langs)))
            if order_k == order:
                weight[column, lang[own]] = n[own]
            else:  # below the highest order what counts is how many letters go before
                longer = k == order_k + 1
                at = np.searchsorted(names, shorter[longer])
                np.add.at(weight, (at, lang[longer]), 1.0)
            holders = np.empty(len(names), np.uint64)
            holders[column] = context[own]
            held, of = np.unique(holders, return_inverse=True)
            total, kinds = np.zeros((2, len(held), len(self.langs)))
            np.add.at(total, of, weight)
            np.add.at(kinds, of, weight > 0)
            total = np.maximum(total, 1e-9)
            self.grams.append(names)
            none, all_of = np.zeros((1, len(self.langs))), np.ones((1, len(self.langs)))
            self.alpha.append(np.concatenate([np.maximum(weight - discount, 0) / total[of], none]).astype(np.float32))
            self.held.append(held)
            self.gamma.append(np.concatenate([np.where(kinds > 0, discount * kinds / total, 1.0), all_of]).astype(np.float32))

    def bits(self, words: list[str]) -> np.ndarray:
        """For each word the bits that each language's model needs, and in the last column its letters and end."""
        seen, before = grams(words, self.order), contexts(words, self.order)
        p = np.full((len(seen[0]), len(self.langs)), self.uniform, np.float32)
        for k in range(self.order):
            # The last row stands for what is not there.
            p *= self.gamma[k].take(self._find(self.held[k], before[k]), axis=0)
            p += self.alpha[k].take(self._find(self.grams[k], seen[k + 1]), axis=0)
        sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        np.log2(np.maximum(p, 1e-12, out=p), out=p)
        cost = -np.add.reduceat(p, np.cumsum(sizes) - sizes, axis=0)
        return np.column_stack([cost, sizes]).astype(np.float32)

    @staticmethod
    def _find(names: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Where each of ``wanted`` stands in the sorted ``names``; their number if it does not."""
        if not len(names):
            return np.zeros(len(wanted), np.int64)
        at = np.searchsorted(names, wanted)
        at[at == len(names)] = 0
        at[names[at] != wanted] = len(names)
        return at


class Scorer:
    """Costs of texts; each distinct word, and each one in small letters, is scored once until there are ``MOST_WORDS``."""

    def __init__(self, models: Models):
        self.models = models
        self.index: dict[str, int] = {}
        self.costs = np.zeros((0, len(models.langs) + 1), np.float32)
        self.runs: dict[str, int] = {}
        self.of_runs = self.costs

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """A row for each text: bits by language, then letters."""
        if len(self.index) > MOST_WORDS:
            self.__init__(self.models)
        # Only distinct runs of letters become Python strings.
        spaced = pc.replace_substring_regex(texts.cast(pa.large_string()).fill_null(""), pattern=r"\PL+", replacement=" ")
        words = pc.utf8_split_whitespace(spaced)
        flat = words.flatten().dictionary_encode()
        distinct = flat.dictionary.to_pylist()
        new = [w for w in distinct if w not in self.index]
        if new:
            self.costs = np.concatenate([self.costs, self._added([letters(w) for w in new])])
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
        row = np.fromiter(map(self.index.__getitem__, distinct), np.int64, len(distinct))
        at, ends = flat.indices.to_numpy(), words.value_lengths().to_numpy().cumsum()
        out, begin = np.zeros((len(texts), self.costs.shape[1])), 0
        for i, end in enumerate(ends.tolist()):
            for first in range(begin, end, 1 << 16):
                out[i] += self.costs.take(row[at[first : min(first + (1 << 16), end)]], axis=0).sum(0, dtype=float)
            begin = end
        return out

    def _added(self, words: list[list[str]]) -> np.ndarray:
        """The costs of words, each given by its runs of letters."""
        flat = [r for own in words for r in own]
        if new := list(set(flat) - self.runs.keys()):
            parts = [self.models.bits(new[first : first + 20_000]) for first in range(0, len(new), 20_000)]
            self.of_runs = np.concatenate([self.of_runs, *parts])
            self.runs.update(zip(new, range(len(self.runs), len(self.runs) + len(new))))
        out = np.zeros((len(words), self.costs.shape[1]), np.float32)
        of = np.repeat(np.arange(len(words)), [len(own) for own in words])
        np.add.at(out, of, self.of_runs[np.fromiter(map(self.runs.__getitem__, flat), np.int64, len(flat))])
        return out


def costs(docs: DataFrame, models: Models, keep: list[Column], with_text: bool = False) -> DataFrame:
    """``keep`` and ``bits`` (an array by language), ``letters`` for each row; ``with_text`` adds the text that was read, ``__text``."""
    shared = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the sample
    base = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    names = base.columns if with_text else base.columns[:-1]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[: len(names)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = kept(shared.value, lambda: Scorer(shared.value))
        for whole in batches:
            for batch in slices(whole, "__text"):
                found = score(batch.column("__text"))
                bits = pa.array([row.tolist() for row in found[:, :-1]], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [bits, pa.array(found[:, -1])], names=[*names, "bits", "letters"])

    return base.mapInArrow(run, ", ".join([*fields, "bits array<double>", "letters double"]))


def fit(labelled: DataFrame, sample: int = SAMPLE, order: int = ORDER) -> tuple[Models, float, list[list[float]]]:
    """Models, temperature and for each of ``LENGTHS`` the highest cross-entropy that each language accepts.

    ``labelled`` has ``doc_id``, ``text``, ``lang``.  About ``sample`` documents of each
    language are used, by a hash of the id; a fifth of them calibrates.
    """
    rows = labelled.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row for each language
    part = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        part = F.when(F.col("lang") == lang, F.lit(min(1.0, sample / n))).otherwise(part)
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    with scratch(labelled.sparkSession):
        return _fitted(table(rows.where(draw < part), "langid-sample"), order)


def _fitted(chosen: DataFrame, order: int) -> tuple[Models, float, list[list[float]]]:
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(5))
    models = Models(count_grams(chosen.where(fold != 0), order).toPandas(), order)
    if not models.langs:
        return models, 1.0, []
    # Bounded: a fifth of the sample, one short row for each document and for each of its beginnings.
    calibrating = chosen.where(fold == 0).select("lang", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("of"), F.lit(0).alias("first"))
    begun = [calibrating.select("lang", F.regexp_extract("text", rf"^\s*+\S++(?:\s++\S++){{0,{words - 1}}}", 0).alias("text"), "of", F.lit(words).alias("first")) for _, words, _ in LENGTHS if words]
    for part in begun:
        calibrating = calibrating.unionByName(part)
    every = costs(calibrating, models, [F.col("lang"), F.col("of"), F.col("first")]).where("letters > 0").toPandas()
    every = every[every["lang"].isin(models.langs)]
    seen = every[every["first"] == 0]
    if not len(seen):
        return models, 1.0, [[float("inf")] * len(models.langs) for _ in LENGTHS]
    bits, n = np.stack(seen["bits"]), seen["letters"].to_numpy()
    truth = np.searchsorted(models.langs, seen["lang"].to_numpy().astype(str))
    loss = lambda t: -np.log(np.maximum(posterior(bits, n, t)[np.arange(len(n)), truth], 1e-12)).mean()
    best = min((2.0**k for k in range(-4, 9)), key=loss)
    return models, best, bounds(every, models.langs)


def bounds(seen, langs: list[str]) -> list[list[float]]:
    """For each of ``LENGTHS`` and each language the highest cross-entropy that is accepted.

    A class of length that a language shows no text of has the bound of the next one
    that it shows, with its own margin; a language without any accepts everything.
    """
    # A document stands once in a class of length, so a short odd one has no more weight.
    seen = seen.assign(kind=np.searchsorted([below for below, _, _ in LENGTHS], seen["letters"].to_numpy(), side="right"))
    seen = seen.sort_values("first", kind="stable").drop_duplicates(["lang", "of", "kind"])
    n, kind = seen["letters"].to_numpy(), seen["kind"].to_numpy()
    truth = np.searchsorted(langs, seen["lang"].to_numpy().astype(str))
    entropy = np.stack(seen["bits"])[np.arange(len(n)), truth] / n
    out = [[float("inf")] * len(langs) for _ in LENGTHS]
    for i in range(len(langs)):
        for j, (_, _, margin) in enumerate(LENGTHS):
            for other in sorted(range(len(LENGTHS)), key=lambda k: abs(k - j)):
                if (own := (truth == i) & (kind == other)).any():
                    middle, most, high = np.quantile(entropy[own], (0.5, 0.9, QUANTILE))
                    out[j][i] = float(min(high, middle + SPREAD * (most - middle))) + margin
                    break
    return out


def _bound(most: list[list[float]], at: Column) -> Column:
    """The bound of the language with number ``at`` for a text of ``letters``."""
    *short, longest = [F.element_at(F.array(*map(F.lit, of)), at) for of in most]
    out = longest
    for (below, _, _), bound in reversed(list(zip(LENGTHS, short))):
        out = F.when(F.col("letters") < below, bound).otherwise(out)
    return out


def posterior(bits: np.ndarray, n: np.ndarray, temperature: float) -> np.ndarray:
    """Probabilities of the languages; evidence grows with the square root of the length."""
    z = -bits / np.sqrt(np.maximum(n, 1))[:, None] / temperature
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def predict(docs: DataFrame, fitted: tuple[Models, float, list[list[float]]]) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score``, ``rejected`` for each row."""
    models, temperature, most = fitted
    names = F.array(*map(F.lit, models.langs)) if models.langs else F.array(F.lit("und"))
    rows = costs(docs, models, [F.col("doc_id")])
    if not models.langs:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("rejected"))
    best = F.array_min("bits")
    at = F.array_position("bits", best).cast("int")
    weights = F.transform("bits", lambda b: F.exp((best - b) / F.sqrt(F.greatest(F.col("letters"), F.lit(1.0))) / temperature))
    none = F.col("letters") == 0
    beyond = best / F.col("letters") > _bound(most, at)
    return rows.select(
        "doc_id",
        F.when(none, "und").otherwise(F.element_at(names, at)).alias("lang_pred"),
        F.when(none, 0.0).otherwise(1 / F.aggregate(weights, F.lit(0.0), lambda a, b: a + b)).alias("score"),
        F.when(none, True).otherwise(beyond).alias("rejected"),
    )


def held_out() -> Column:
    return crc_of_id() % 4 == 2


def accepted(docs: DataFrame, fitted: tuple[Models, float, list[list[float]]]) -> DataFrame:
    """The rows of ``docs`` that are not rejected, those without a ``lang`` with the one found; all as they are if no language was learned."""
    models, _, most = fitted
    if not models.langs:
        return docs
    # The row travels along with its text, so nothing has to be joined again.
    once = sent_once(docs)
    place_of = {c: "__text" if once and c == "text" else f"__{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[named(c).alias(at) for c, at in place_of.items() if at != "__text"], "text")
    scored = costs(rows, models, [F.col(at) for at in place_of.values() if at != "__text"], with_text=once)
    best = F.array_min("bits")
    at = F.array_position("bits", best).cast("int")
    kept = scored.where((F.col("letters") > 0) & (best / F.col("letters") <= _bound(most, at)))
    found = F.element_at(F.array(*map(F.lit, models.langs)), at)
    own = lambda c: F.coalesce(F.col(place_of[c]), found) if c == "lang" and docs.schema[c].dataType.typeName() == "string" else F.col(place_of[c])
    return kept.select(*[own(c).alias(c) for c in docs.columns])
