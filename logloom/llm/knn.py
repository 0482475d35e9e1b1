"""Exact top-k by inner product: a Voronoi kNN join.

Pivots, as many as the root of the number of vectors up to ``MOST_PIVOTS`` and far from
one another, cut the space into cells.  A pass over the vectors gives each its cell and each query what it scores with
the pivots, which are candidates themselves: its k-th best of these is a score that its k
best surely reach.  Summaries of the cells (how many vectors, how far from the pivot) give
another such score; the higher one is the cell's threshold.  A vector goes to a cell's
queries only if the upper bound of its scores with all of them reaches the threshold.

Cells near one another share a group up to ``GROUP_QUERIES`` queries; a cell with more has
groups of its own.  A first round counts the vectors that each group needs and a second
one sends them, in as many chunks as their number asks for, so a task holds a chunk and
the queries of a group, and queries are repeated no more often than the vectors need.  The
best of all chunks meet in a window over k rows a chunk.

Scores are exact integers.  Defined results: vectors that are null, empty or hold null or
non-finite components, and rows with a null id, take no part; shorter vectors count as
filled up with zeros; rows with the query's own id aren't its candidates; repeated query
rows are each answered; ties go to the smaller id; an empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import scratch, table

K, SCALE, LEAST_PIVOTS, MOST_PIVOTS, DRAWN, GROUP_QUERIES, CHUNK = 10, 1024, 32, 4096, 3, 1024, 25_000
#: Components of a matrix in a task, and of the vectors of a chunk.
CELLS, CHUNK_CELLS = 1 << 18, 1 << 22
_SLACK = 1e-6


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix of ``width`` columns, filled up with zeros or cut."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    row, place = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    own = place < width
    out = np.zeros((len(column), width), np.int64)
    out[row[own], place[own]] = flat[own]
    return out


def _parts(column: pa.Array, cells: int = CELLS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a list column in parts, and their matrix: short ones first, so a long vector widens its own part only."""
    sizes = np.diff(column.offsets.to_numpy())
    order, first = np.argsort(sizes, kind="stable"), 0
    while first < len(order):
        last = first + max(1, cells // max(int(sizes[order[first]]), 1))
        last = first + max(1, min(last - first, cells // max(int(sizes[order[min(last, len(order)) - 1]]), 1)))
        rows = order[first:last]
        yield rows, _matrix(column.take(pa.array(rows)), int(sizes[rows[-1]]))
        first = last


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``uid`` (of the row), ``vec_id`` and ``v``, the vector's components as integers."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where((F.size("embedding") > 0) & whole & F.col("vec_id").isNotNull())
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    return table(rows.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")), "vectors")


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products as exact longs; beyond what doubles hold exactly, by long arithmetic, which may wrap only beyond a long."""
    width = min(a.shape[1], b.shape[1])  # beyond it one side is zero
    a, b = a[:, :width], b[:, :width]
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * width
    if top < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _bounds(v: np.ndarray, p: np.ndarray) -> np.ndarray:
    width = min(v.shape[1], p.shape[1])
    return v[:, :width].astype(np.float64) @ p[:, :width].T.astype(np.float64)


def _norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v.astype(np.float64) ** 2).sum(1))


def _assign(rows: DataFrame, pivots: np.ndarray, ids: np.ndarray, every: int, k: int) -> DataFrame:
    """Adds ``cell``, ``reach`` (the distance to its pivot) and, for queries, ``floor``: the k-th best score with pivots."""
    shared = rows.sparkSession.sparkContext.broadcast((pivots, ids))  # MOST_PIVOTS rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, ids = shared.value
        of_pivot = (p.astype(np.float64) ** 2).sum(1)
        for batch in batches:
            vec_id = batch.column(1).to_numpy()
            cell, reach, low = np.empty(len(vec_id), np.int32), np.empty(len(vec_id)), np.full(len(vec_id), -np.inf)
            for at, v in _parts(batch.column(2)):
                far = (v.astype(np.float64) ** 2).sum(1)[:, None] - 2 * _bounds(v, p) + of_pivot
                cell[at] = own = far.argmin(1)
                reach[at] = np.sqrt(np.maximum(far[np.arange(len(at)), own], 0))
                ask = np.flatnonzero(vec_id[at] % every == 0)
                if len(ask) and len(ids) > k:
                    scores = _products(v[ask], p).astype(np.float64)
                    scores[vec_id[at[ask]][:, None] == ids] = -np.inf
                    low[at[ask]] = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(reach), pa.array(low)], names=["uid", "vec_id", "v", "cell", "reach", "floor"])

    return rows.mapInArrow(run, "uid bigint, vec_id bigint, v array<bigint>, cell int, reach double, floor double")


def thresholds(pivots: np.ndarray, data: dict[int, tuple[int, float]], asked: dict[int, float], k: int) -> dict[int, float]:
    """For each query cell a score that k candidates of each of its queries reach, from the summaries."""
    out, norms = {}, _norms(pivots)
    cells = np.array(sorted(data))
    counts, reach = np.array([data[c][0] for c in cells]), np.array([data[c][1] for c in cells])
    for cell, radius in asked.items():
        middle = _bounds(pivots[cell : cell + 1], pivots[cells])[0]
        low = middle - radius * norms[cells] - reach * norms[cell] - radius * reach
        order = np.argsort(-low)
        enough = np.flatnonzero(np.cumsum(counts[order]) > k)  # one may be the query itself
        out[cell] = float(low[order[enough[0]]]) if len(enough) else -np.inf
    return out


@dataclass
class Plan:
    """What the tasks know: a row for each cell that holds queries."""

    cells: np.ndarray  # their numbers
    pivots: np.ndarray
    radius: np.ndarray  # how far from the pivot their queries reach
    floor: np.ndarray  # what the k best of each of their queries reach
    group: np.ndarray  # their first group
    parts: np.ndarray  # and how many they have

    def needed(self, v: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each group the rows of ``v`` that it needs."""
        bound = _bounds(v, self.pivots)
        norm = _norms(v)[:, None]
        bound += norm * self.radius
        need = bound + _SLACK * (np.abs(bound) + norm) >= self.floor
        order = np.argsort(self.group, kind="stable")
        starts = np.flatnonzero(np.diff(self.group[order], prepend=-1))
        for first, last in zip(starts, [*starts[1:], len(order)]):
            own = order[first:last]
            hit = np.flatnonzero(need[:, own].any(1))
            for part in range(int(self.parts[own[0]])):
                yield int(self.group[own[0]]) + part, hit


def _grouped(pivots: np.ndarray, queries: dict[int, int], most: int) -> tuple[dict[int, int], dict[int, int]]:
    """The first group of each query cell and how many groups it has; cells near one another come one after another."""
    cells = np.array(sorted(queries))
    n = max(1, math.ceil(sum(queries.values()) / most))
    middle = pivots[cells[np.linspace(0, len(cells) - 1, min(n, len(cells))).astype(int)]].astype(np.float64)
    own = pivots[cells].astype(np.float64)
    near = ((own**2).sum(1)[:, None] - 2 * own @ middle.T + (middle**2).sum(1)).argmin(1)
    group, parts, groups, held = {}, {}, 0, most + 1
    for cell in cells[np.argsort(near, kind="stable")].tolist():
        parts[cell] = math.ceil(queries[cell] / most)
        if parts[cell] > 1 or held + queries[cell] > most:
            group[cell], groups, held = groups, groups + parts[cell], queries[cell] if parts[cell] == 1 else most
        else:
            group[cell], held = groups - 1, held + queries[cell]
    return group, parts


def _spread(drawn: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` rows, each the farthest from those before, so that no part of the space is without a pivot."""
    x = drawn.astype(np.float64)
    square = (x * x).sum(1)
    out, far = [0] if len(x) else [], np.full(len(x), np.inf)
    while 0 < len(out) < min(n, len(x)):
        far = np.minimum(far, square - 2 * x @ x[out[-1]] + square[out[-1]])
        far[out] = 0
        if far.max() <= 0:  # what is left repeats rows that were chosen
            break
        out.append(int(far.argmax()))
    return np.array(out, np.int64)


def prepared(vectors: DataFrame, every: int = 100, k: int = K, scale: int = SCALE, pivots: int | None = None, group_queries: int = GROUP_QUERIES) -> tuple[DataFrame, Plan | None]:
    """The vectors with their cells, and the plan of the join; no plan if there are no queries."""
    with scratch(vectors.sparkSession) as keep:
        return _prepared(integers(vectors, scale), every, k, pivots, group_queries, keep)


def _prepared(rows: DataFrame, every: int, k: int, pivots: int | None, group_queries: int, keep) -> tuple[DataFrame, Plan | None]:
    n = rows.count()
    pivots = pivots or min(MOST_PIVOTS, max(LEAST_PIVOTS, math.isqrt(n)))
    drawn = rows.orderBy(F.xxhash64("vec_id"), "uid").limit(DRAWN * pivots).select("vec_id", "v").collect()  # DRAWN * MOST_PIVOTS rows at most
    width = max((len(r.v) for r in drawn), default=1)
    middle = _matrix(pa.array([r.v for r in drawn], pa.list_(pa.int64())), width)
    chosen = _spread(middle, pivots)
    middle = middle[chosen]
    placed = keep(table(_assign(rows, middle, np.array([drawn[i].vec_id for i in chosen], np.int64), every, k), "cells"))
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    summary = placed.groupBy("cell").agg(
        F.count("*").alias("n"), F.max("reach").alias("reach"), F.count_if(is_query).alias("queries"), F.max(F.when(is_query, F.col("reach"))).alias("asked"), F.min(F.when(is_query, F.col("floor"))).alias("floor")
    ).collect()  # MOST_PIVOTS rows at most
    asked = {r.cell: r.asked * (1 + _SLACK) for r in summary if r.queries}
    if not asked:
        return placed, None
    sure = thresholds(middle, {r.cell: (r.n, r.reach * (1 + _SLACK)) for r in summary}, asked, k)
    low = {r.cell: max(r.floor, sure[r.cell]) for r in summary if r.queries}
    group, parts = _grouped(middle, {r.cell: r.queries for r in summary if r.queries}, group_queries)
    cells = np.array(sorted(asked))
    column = lambda of, kind: np.array([of[c] for c in cells.tolist()], kind)
    return placed, Plan(cells, middle[cells], column(asked, float), column(low, float), column(group, np.int64), column(parts, np.int64))


def sent(placed: DataFrame, plan: Plan) -> DataFrame:
    """``group`` and ``n``, the vectors that the group needs: a row for each group."""
    shared = placed.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        for batch in batches:
            for _, v in _parts(batch.column(0)):
                for group, hit in shared.value.needed(v):
                    counts[group] = counts.get(group, 0) + len(hit)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["group", "n"])

    return placed.select("v").mapInArrow(run, "group int, n bigint").groupBy("group").agg(F.sum("n").alias("n"))


def join(vectors: DataFrame, every: int = 100, k: int = K, scale: int = SCALE, pivots: int | None = None, group_queries: int = GROUP_QUERIES, chunk: int = CHUNK) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k best of all other vectors for each id divisible by ``every``."""
    spark = vectors.sparkSession
    schema = "query_uid bigint, query_id bigint, vec_id bigint, score bigint"
    placed, plan = prepared(vectors, every, k, scale, pivots, group_queries)
    if plan is None:
        return spark.createDataFrame([], schema).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    mean = placed.agg(F.avg(F.size("v"))).first()[0]
    chunk = max(1, min(chunk, CHUNK_CELLS // math.ceil(mean)))
    chunks = {r.group: max(1, math.ceil(r.n / chunk)) for r in sent(placed, plan).collect()}  # a row for each group
    shared = spark.sparkContext.broadcast((plan, chunks))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector to the groups that need it, to one of their chunks; each query to all chunks of its group."""
        plan, chunks = shared.value
        of_cell = dict(zip(plan.cells.tolist(), zip(plan.group.tolist(), plan.parts.tolist())))
        for batch in batches:
            uid, vec_id, cell = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_numpy()
            for rows, v in _parts(batch.column(2)):
                at, group, salt, query = [], [], [], []
                for g, hit in plan.needed(v):
                    at.append(rows[hit]), group.append(np.full(len(hit), g)), salt.append(uid[rows[hit]] % chunks[g]), query.append(np.zeros(len(hit), bool))
                for i in rows[vec_id[rows] % every == 0].tolist():
                    g, parts = of_cell[int(cell[i])]
                    g += int(uid[i]) % parts
                    at.append(np.full(chunks[g], i)), group.append(np.full(chunks[g], g)), salt.append(np.arange(chunks[g])), query.append(np.ones(chunks[g], bool))
                if at:
                    taken = batch.select([0, 1, 2]).take(pa.array(np.concatenate(at)))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.concatenate(group).astype(np.int32)), pa.array(np.concatenate(salt).astype(np.int32)), pa.array(np.concatenate(query))], names=["uid", "vec_id", "v", "group", "chunk", "query"])

    def solve(both: pa.Table) -> pa.Table:
        asks = both.filter(both["query"]).combine_chunks()
        have = both.filter(pc.invert(both["query"])).combine_chunks()
        best = [np.empty((0,), np.int64)] * 4
        if asks.num_rows and have.num_rows:
            lists = lambda t: t["v"].combine_chunks() if isinstance(t["v"], pa.ChunkedArray) else t["v"]
            ids, uids, names = have["vec_id"].to_numpy(), asks["uid"].to_numpy(), asks["vec_id"].to_numpy()
            wide = list(_parts(lists(have)))
            for at, q in _parts(lists(asks), CELLS // 16):
                found = []
                for rows, x in wide:
                    scores, own = _products(q, x), ids[rows]
                    # Rows with the query's own id don't count, so as many more are near.
                    left = min(len(own), k + int((own[:, None] == names[at]).sum(0).max()))
                    low = np.partition(scores, len(own) - left, axis=1)[:, len(own) - left]
                    of, near = np.nonzero((scores >= low[:, None]) & (own != names[at][:, None]))
                    found.append((at[of], own[near], scores[of, near]))
                of, own, score = (np.concatenate(c) for c in zip(*found))
                order = np.lexsort((own, -score, of))
                of, own, score = of[order], own[order], score[order]
                first = np.flatnonzero(np.diff(of, prepend=-1))
                place = np.arange(len(of)) - np.repeat(first, np.diff([*first, len(of)]))
                keep = place < k
                best = [np.concatenate([a, b]) for a, b in zip(best, (uids[of[keep]], names[of[keep]], own[keep], score[keep]))]
        return pa.table([pa.array(c, pa.int64()) for c in best], names=["query_uid", "query_id", "vec_id", "score"])

    spread = placed.select("uid", "vec_id", "v", "cell").mapInArrow(dealt, "uid bigint, vec_id bigint, v array<bigint>, group int, chunk int, query boolean")
    best = spread.groupBy("group", "chunk").applyInArrow(solve, schema)
    order = Window.partitionBy("query_uid").orderBy(F.col("score").desc(), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
