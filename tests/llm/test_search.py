import numpy as np

from logloom.llm import knn


def plain(rows, every, k):
    out = set()
    whole = []
    for n, (i, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v):
            whole.append((n, i, [int(np.floor(1024 * float(x))) for x in v]))
    for n, q, v in whole:
        if q is None or q % every:
            continue
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for _, i, w in whole if i is not None and i != q)[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def found(df, **more):
    return {tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()}


SCHEMA = "vec_id bigint, embedding array<float>, label int, uid string, cell int, rank int"


def test_search(spark):
    r = np.random.default_rng(2)
    centres = r.normal(0, 1, (6, 8))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] + r.normal(0, 0.1, 8)]) for i in range(500)]
    rows += [(600 + i, rows[0][1]) for i in range(30)]  # ties
    rows += [(700, None), (800, []), (900, [1.0, float("nan")]), (1000, [float("inf")] * 8), (1100, [None] * 8), (None, rows[3][1]), (1200, [0.0] * 8), (1300, [0.5])]
    df = spark.createDataFrame([(i, v, 0, "u", 1, 2) for i, v in rows], SCHEMA)
    want = plain(rows, 100, 10)
    assert found(knn.join(df)) == want
    # Many cells, small groups and chunks take the other ways.
    assert found(knn.join(df, pivots=7, group_queries=1, chunk=40)) == want
    assert found(knn.join(df, every=3, k=4, pivots=5, group_queries=8, chunk=100)) == plain(rows, 3, 4)
    assert knn.join(df.limit(0)).count() == 0
    assert knn.join(df.where("vec_id % 100 <> 0")).count() == 0
    large = [(2**53 + 100 * i + j, [float(i), float(j)]) for i in range(3) for j in range(4)] + [(None, [5.0]), (2**53 + 12 + 88, [1.0] * 3000)]
    ids = spark.createDataFrame([(i, v, 0, "u", 1, 2) for i, v in large], SCHEMA)
    assert found(knn.join(ids, every=4)) == plain(large, 4, 10)  # ids stay longs beside null; a long vector
    few = df.where("vec_id in (0, 1, 2)")
    assert found(knn.join(few)) == plain([x for x in rows if x[0] in (0, 1, 2)], 100, 10)


def test_cells_that_cannot_matter_are_left_out():
    pivots = np.array([[1000, 0], [-1000, 0]])
    least = knn.thresholds(pivots, {0: (50, 10.0), 1: (50, 10.0)}, {0: 5.0}, 10)
    low = 1e6 - 5 * 1000 - 10 * 1000 - 50
    assert least[0] == low
    assert -1e6 + 5 * 1000 + 10 * 1000 + 50 < low  # the best of the other cell


def clustered(spark, n=20_000, clusters=60, width=64, spread=0.02):
    r = np.random.default_rng(3)
    centres = r.normal(0, 1, (clusters, width))
    centres /= np.sqrt((centres**2).sum(1, keepdims=True))
    return [(i, [float(np.float32(x)) for x in centres[r.integers(clusters)] + r.normal(0, spread / 8, width)]) for i in range(n)]


def test_groups_get_what_they_need_only(spark):
    """On clustered vectors most never leave for most groups, and the answers stay exact."""
    rows = clustered(spark)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    placed, plan = knn.prepared(df, group_queries=8)
    groups = int((plan.group + plan.parts).max())
    got = {r.group: r.n for r in knn.sent(placed, plan).collect()}
    assert groups > 10 and sum(got.values()) < 0.15 * groups * len(rows)
    x = np.floor(1024 * np.array([v for _, v in rows])).astype(np.int64)
    scores = x[::100] @ x.T
    answers = {}
    for r in knn.join(df, group_queries=8).collect():
        answers.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for row, own in zip(range(0, len(rows), 100), scores):
        order = [j for j in np.lexsort((np.arange(len(own)), -own)) if j != row][:10]
        assert sorted(answers[row]) == [(n + 1, j, own[j]) for n, j in enumerate(order)]


def test_pivots_are_rows_of_their_own():
    assert knn._spread(np.array([[3, 4]] * 50 + [[0, 1]] * 5), 32).tolist() == [0, 50]
    assert knn._spread(np.zeros((0, 2), np.int64), 4).tolist() == []
