"""A quality classifier on random-indexing word vectors.

Each token has two units, itself and its shape, both hashed into a fixed number of rows.
Each row has a sparse random index vector; a row's word vector sums the index vectors of
all tokens up to two places from its own, over all documents: tasks sum what they read
and Spark adds these sums up by row.  A document's features are the means of its tokens'
vectors.  A network of two layers is fitted with numpy on a bounded sample of labelled
documents, and a temperature on the part of it that the fit has not seen.

Bounds: ``ROWS`` + ``SHAPES`` vectors of ``WIDTH`` numbers; ``SAMPLE`` labelled documents,
by a hash of the id.  Counts cover all documents.

Defined results: null and empty texts have zero features and a score like any other; null
ids are scored and taken as not held out; ids may be numbers or texts; repeated rows give
repeated results, and of a labelled id with several texts the smallest is learned from;
without labels every score is 0.5; an empty table gives an empty result; further columns are not
read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import crc_of_id, kept, slices

ROWS, SHAPES, WIDTH, NONZERO, SAMPLE, HIDDEN, MOST_TOKENS, TEXTS = 1 << 13, 1 << 10, 64, 6, 12_000, 32, 400_000, 128

#: A shape is a token with runs of capitals as X, of other letters as x, of digits as 9, of equal signs as one.
_SAME = re.compile(r"(.)\1+", re.S)


def index_vectors() -> np.ndarray:
    """A sparse vector of ones and minus ones for each row."""
    random = np.random.default_rng(5)
    out = np.zeros((ROWS + SHAPES, WIDTH), np.int8)
    for row in out:
        row[random.choice(WIDTH, NONZERO, replace=False)] = random.choice([-1, 1], NONZERO)
    return out


class Units:
    """Rows of tokens; a distinct token is hashed once, and kept while there are fewer than ``MOST_TOKENS``."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.rows = np.empty((0, 2), np.int32)

    def __call__(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows of the distinct tokens, the tokens of all texts as numbers of these, and how many each text has."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        parts = pc.utf8_split_whitespace(texts.fill_null(""))
        coded = parts.flatten().dictionary_encode()
        owner = np.repeat(np.arange(len(texts)), parts.value_lengths().to_numpy())
        # White space at an end of a text gives an empty part.
        full = pc.binary_length(coded.dictionary).to_numpy() > 0
        number, at = np.cumsum(full) - 1, coded.indices.to_numpy()
        some = full[at]
        counts = np.bincount(owner[some], minlength=len(texts))
        tokens = coded.dictionary.filter(pa.array(full)).to_pylist()
        place = np.fromiter(map(self.index.get, tokens, repeat(-1)), np.int64, len(tokens))
        unseen = np.flatnonzero(place < 0)
        if len(unseen):
            new = [tokens[i] for i in unseen]
            digest = xxhash.xxh32_intdigest
            own = np.fromiter(map(digest, new), np.int64, len(new)) % ROWS
            rows = np.column_stack([own, _shape_rows(new)]).astype(np.int32)
            place[unseen] = len(self.rows) + np.arange(len(new))
            every = np.concatenate([self.rows, rows])
            room = max(0, MOST_TOKENS - len(self.index))
            self.index.update(zip(new[:room], range(len(self.rows), len(self.rows) + room)))
            self.rows = every[: len(self.index)]
        else:
            every = self.rows
        return every[place], number[at[some]], counts


def _shape_rows(tokens: list[str]) -> np.ndarray:
    """The rows of the tokens' shapes; few shapes are left once letters and digits are alike."""
    marked = pa.array(tokens, pa.string())
    for pattern, sign in ((r"[A-ZÀ-ÖØ-Þ]+", "\0"), (r"\p{L}+", "x"), (r"\p{Nd}+", "9")):
        marked = pc.replace_substring_regex(marked, pattern, sign)
    coded = marked.dictionary_encode()
    rows = [ROWS + xxhash.xxh32_intdigest(_SAME.sub(r"\1", m.replace("\0", "X"))) % SHAPES for m in coded.dictionary.to_pylist()]
    return np.array(rows, np.int64)[coded.indices.to_numpy()]


def _sums(values: np.ndarray, by: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` by number, all of 1 to ``n`` - 1 of which occur."""
    counts = np.bincount(by, minlength=n)
    return np.add.reduceat(values[np.argsort(by, kind="stable")], np.cumsum(counts) - counts, axis=0, dtype=np.int32)


def context_sums(docs: DataFrame) -> DataFrame:
    """``row`` and ``c0`` ...: for each row the sum of the index vectors around its tokens, over all documents."""
    names = [f"c{i}" for i in range(WIDTH)]
    shared = docs.sparkSession.sparkContext.broadcast(index_vectors())  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = shared.value
        units = kept(vectors, Units)
        total = np.zeros((ROWS + SHAPES, WIDTH), np.int64)
        for whole in batches:
            for batch in slices(whole, "__text", 1 << 20):
                rows, tokens, counts = units(batch.column(0))
                if not len(tokens):
                    continue
                # Two places of nothing around each text, so that no window reaches over.
                line = np.zeros(len(tokens) + 2 * len(counts) + 2, np.int64)  # 0 is nothing
                line[np.arange(len(tokens)) + 2 * np.repeat(np.arange(1, len(counts) + 1), counts)] = tokens + 1
                own = np.concatenate([np.zeros((1, WIDTH), np.int8), vectors[rows[:, 0]] + vectors[rows[:, 1]]])[line]
                around = own[:-4] + own[1:-3]
                around += own[3:-1]
                around += own[4:]
                sums = _sums(around, line[2:-2], len(rows) + 1)[1:]
                for side in (0, 1):
                    found, of = np.unique(rows[:, side], return_inverse=True)
                    total[found] += _sums(sums, of, len(found))
        used = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *[pa.array(total[used, i]) for i in range(WIDTH)]], names=["row", *names])

    sums = docs.select(F.col("text").cast("string").alias("__text")).mapInArrow(run, ", ".join(["row int", *[f"{c} bigint" for c in names]]))
    return sums.groupBy("row").agg(*[F.sum(c).alias(c) for c in names])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of all rows, from the contexts and a little of the own index vector; of fixed size."""
    own = index_vectors().astype(np.float64)
    context = np.zeros_like(own)
    found = context_sums(docs).toPandas()  # ROWS + SHAPES rows at most
    if len(found):
        context[found["row"].to_numpy()] = found.drop(columns="row").to_numpy()
        context -= context.mean(0)
    unit = lambda m: m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-9)
    return (unit(context) + unit(own)).astype(np.float32)


def pooled(docs: DataFrame, vectors: np.ndarray, keep: list[Column], finish=None, schema: str = "features array<float>") -> DataFrame:
    """``keep`` and the features of each row, or what ``finish`` makes of their matrix (a list of arrays)."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    base = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    names = base.columns[:-1]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-1]]
    made = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        units = kept(v, Units)
        for whole in batches:
            for batch in slices(whole, "__text", 1 << 20):
                rows, tokens, counts = units(batch.column("__text"))
                features = np.zeros((len(counts), 2 * WIDTH + 1), np.float32)
                # Counts of the rows that occur, for a few texts at a time, and one product.
                for side, first in ((0, 0), (1, WIDTH)):
                    of_token = rows[tokens, side]
                    last = np.cumsum(counts)
                    for low in range(0, len(counts), TEXTS):
                        high = min(low + TEXTS, len(counts))
                        begin, end = last[low] - counts[low], last[high - 1]
                        seen, local = np.unique(of_token[begin:end], return_inverse=True)
                        if len(seen):
                            owner = np.repeat(np.arange(high - low), counts[low:high])
                            table = np.bincount(owner * len(seen) + local, minlength=(high - low) * len(seen)).reshape(high - low, len(seen))
                            features[low:high, first : first + WIDTH] = (table.astype(np.float32) @ v[seen]) / np.maximum(counts[low:high, None], 1)
                features[:, -1] = np.log1p(counts) / 8
                columns = finish(features) if finish else [pa.array(list(features), pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *columns], names=[*names, *made])

    return base.mapInArrow(run, ", ".join([*fields, schema]))


class Network:
    """Two layers, features scaled to mean 0 and deviation 1, logits divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, check: np.ndarray, seed: int = 3, steps: int = 3000, rate: float = 3e-3, decay: float = 1e-4):
        random = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        self.w1, self.b1 = random.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN)
        self.w2, self.b2 = random.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)
        self.temperature = 1.0
        learn = ~check if (~check).any() else np.ones(len(y), bool)
        own, truth = self._scaled(x[learn]), y[learn]
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.w1, self.b1, self.w2, self.b2)]
        turn = 0
        while turn < steps:
            for at in np.array_split(random.permutation(len(truth)), max(1, len(truth) // 128)):
                turn += 1
                z = np.maximum(own[at] @ self.w1 + self.b1, 0)
                error = (_sigmoid(z @ self.w2 + self.b2) - truth[at]) / len(at)
                back = np.outer(error, self.w2) * (z > 0)
                slopes = (own[at].T @ back + decay * self.w1, back.sum(0), z.T @ error + decay * self.w2, error.sum(keepdims=True))
                for p, g, m in zip((self.w1, self.b1, self.w2, self.b2), slopes, moments):
                    m[0][:] = 0.9 * m[0] + 0.1 * g
                    m[1][:] = 0.999 * m[1] + 0.001 * g * g
                    p -= rate * (m[0] / (1 - 0.9**turn)) / (np.sqrt(m[1] / (1 - 0.999**turn)) + 1e-8)
        if check.any():
            logits, truth = self.logits(x[check]), y[check]
            loss = lambda t: -np.log(np.clip(np.where(truth == 1, _sigmoid(logits / t), 1 - _sigmoid(logits / t)), 1e-9, 1)).mean()
            self.temperature = min((2.0 ** (k / 4) for k in range(-8, 21)), key=loss)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(self._scaled(x) @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def held_out() -> Column:
    return crc_of_id() % 3 == 1


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (that the quality is 1) and ``predicted`` for each row of ``docs``."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    n = known.count()
    draw = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = known.where(draw < min(1.0, sample / max(n, 1))).groupBy(F.col("doc_id").alias("__id")).agg(F.max("quality").alias("quality"))
    vectors = word_vectors(docs)
    # About SAMPLE ids of a few bytes.
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    # However often an id is repeated, its smallest text stands for it.
    rows = rows.groupBy("__id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"))
    fold = F.pmod(F.xxhash64(F.lit("check"), F.col("__id").cast("string")), F.lit(5))
    drawn = pooled(rows, vectors, [F.col("__id").cast("string").alias("id"), F.col("quality"), fold.alias("fold")]).toPandas().sort_values("id")
    model = None
    if len(drawn):
        x = np.stack(drawn["features"]).astype(np.float64)
        check = drawn["fold"].to_numpy() == 0
        model = Network(x, drawn["quality"].to_numpy().astype(float), check)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def finish(features: np.ndarray) -> list[pa.Array]:
        net = shared.value
        return [pa.array(net.probability(features.astype(np.float64)) if net else np.full(len(features), 0.5), pa.float64())]

    scored = pooled(docs, vectors, [F.col("doc_id")], finish, "score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
