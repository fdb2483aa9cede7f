import math

import numpy as np
import pytest

from docloom.llm import topk

SCHEMA = "vec_id long, embedding array<double>, id string, x string, part string, score string"


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x", "x", "x") for i, v in rows], SCHEMA).repartition(3)


def brute(rows, k, every):
    valid = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            valid[i] = min(valid.get(i, v), v)
    ints = {i: [math.floor(64 * x) for x in v] for i, v in valid.items()}
    out = []
    for q in (i for i in ints if i % every == 0):
        near = sorted((-sum(a * b for a, b in zip(ints[q], x, strict=True)), i) for i, x in ints.items() if i != q and len(x) == len(ints[q]))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(near[:k], 1)]
    return sorted(out)


def _check(spark, rows, k=5, every=10, **more):
    found = topk.search(_frame(spark, rows), f"id % {every} = 0", k, **more)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, found.collect())) == brute(rows, k, every)


@pytest.mark.parametrize("parts", [1, 2, 3])
def test_equals_brute_force(spark, parts):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 8)) / 3)]
    _check(spark, rows, parts=parts)


def test_clusters_ties_and_a_frequent_vector(spark, monkeypatch):
    """A third of all rows are one vector; more are near copies of another; cutoffs are joined by shuffle."""
    monkeypatch.setattr(topk, "BROADCAST_QUERIES", 0)
    monkeypatch.setattr(topk, "SLICE_SCORES", 50)
    rng = np.random.default_rng(8)
    rows = [(i, [0.5, 0.25, -0.5, 0.125]) for i in range(100)]
    rows += [(100 + i, [float(x) for x in np.array([0.5, -0.25, 0.5, 0.1]) + 0.01 * rng.integers(0, 3, 4)]) for i in range(100)]
    rows += [(200 + i, [-1.0 * x for x in v]) for i, v in enumerate(rng.integers(-2, 3, (100, 4)).tolist())]
    _check(spark, rows, k=7)


def test_odd_vectors(spark):
    """Null, empty, zero, non-finite, of other lengths, huge; null and repeated ids; all scores negative."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, None), (10, []), (11, []), (20, [0.0, 0.0]), (30, [nan, 1.0]), (40, [inf, 1.0]), (50, [None, 1.0]), (60, [1.0]), (61, [-1.0]), (62, [0.01])]
    rows += [(70, [1.0, 2.0]), (70, [0.5, 2.0]), (70, [0.5, 2.0]), (None, [1.0, 2.0]), (71, [-1.0, -1.0]), (72, [-2.0, -0.001]), (80, [1.0, 2.0, 3.0]), (-10, [1e7, -1e7]), (81, [1e7, 1e7]), (90, [-1.0, -2.0])]
    _check(spark, rows, k=3)
    _check(spark, rows, k=30)


def test_empty_and_alone(spark):
    _check(spark, [])
    _check(spark, [(10, [1.0, 2.0])])
    _check(spark, [(11, [1.0, 2.0]), (12, [1.0, 2.0])])


def test_scores_beyond_the_bound_count_as_it(spark):
    rows = [(10, [1e30, 0.0]), (11, [1e30, 0.0]), (12, [-1e30, 0.0])]
    found = sorted(map(tuple, topk.search(_frame(spark, rows), "id = 10", 2).collect()))
    assert found == [(10, 1, 11, topk.MOST), (10, 2, 12, -topk.MOST)]


def test_most_pairs_are_never_sent(spark):
    """Of the pairs' parts, the second phase sends a few."""
    rng = np.random.default_rng(9)
    v = rng.normal(size=(3000, 16))
    rows = [(i, [float(x) for x in u]) for i, u in enumerate(v / np.linalg.norm(v, axis=1, keepdims=True))]
    sent = []
    write = topk.Scratch.write

    def counted(self, df, name):
        out = write(self, df, name)
        sent.append((name, out.count()))
        return out

    topk.Scratch.write = counted
    try:
        _check(spark, rows, k=5, every=100)
    finally:
        topk.Scratch.write = write
    assert dict(sent)["seen"] < 0.2 * 30 * 3000
