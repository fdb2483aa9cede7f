import numpy as np
import pytest

from docloom.operators import pivots, retrieval


def _frame(spark, rows, name):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], f"{name} long, vector array<double>").repartition(3)


def brute(units, questions, k):
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1.0)
    out = []
    for q, v in questions:
        if v is not None:
            near = sorted((-round(float(unit(v) @ unit(w)), 6) + 0.0, i) for i, w in units if w is not None)[:k]
            out += [(q, i, r) for r, (_, i) in enumerate(near, 1)]
    return sorted(out)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(retrieval, "UNIT_BLOCK", 60)
    monkeypatch.setattr(retrieval, "QUESTION_BLOCK", 20)
    monkeypatch.setattr(pivots, "UNITS_OF_A_CELL", 25)


def _check(spark, units, questions, k):
    visits = {}
    found = retrieval.dense_top_k(_frame(spark, questions, "qid"), _frame(spark, units, "id"), k, visits=visits)
    assert sorted((r.qid, r.id, r.rank) for r in found.collect()) == brute(units, questions, k)
    return visits


def test_random_vectors(spark, small):
    rng = np.random.default_rng(1)
    units = list(enumerate(rng.normal(size=(600, 12))))
    visits = _check(spark, units, [(i, rng.normal(size=12)) for i in range(30)], 5)
    assert 0 < visits["visited"] <= visits["pairs"]


def test_clustered_vectors_visit_few_cells(spark, small):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(24, 12))
    units = [(i, centres[i % 24] + 0.02 * rng.normal(size=12)) for i in range(1200)]
    visits = _check(spark, units, [(i, centres[i % 24] + 0.02 * rng.normal(size=12)) for i in range(48)], 5)
    assert visits["visited"] < 0.25 * visits["pairs"]


def test_odd_vectors_and_ties(spark, small):
    """Zero and null vectors on both sides, one vector that is a third of all, cells larger than a block, more asked than there is."""
    rng = np.random.default_rng(3)
    units = [(i, [1.0, 2.0, 0.0] if i % 3 == 0 else [0.0] * 3 if i % 50 == 1 else None if i % 50 == 2 else rng.integers(-2, 3, 3)) for i in range(300)]
    questions = [(0, [1.0, 2.0, 0.1]), (1, [0.0, 0.0, 0.0]), (2, None), (3, [-1.0, -2.0, 0.0]), (4, [0.0, 0.0, 5.0])]
    for k in (3, 40, 1000):
        _check(spark, units, questions, k)


def test_only_zero_vectors(spark, small):
    _check(spark, [(i, [0.0, 0.0]) for i in range(100)], [(0, [1.0, 1.0])], 3)


def test_no_bound_is_under_a_cosine():
    rng = np.random.default_rng(4)
    rows = pivots.rows_of(__import__("pyarrow").array([list(map(float, v)) for v in rng.normal(size=(500, 6))]))
    p = rows[:9]
    at = pivots.angles(rows, p)
    cell = at.argmin(axis=1)
    own = [at[cell == i, i] for i in range(9)]
    cells = pivots.Cells(p, np.array([*map(len, own), 0]), np.array([*(x.min() for x in own), 0]), np.array([*(x.max() for x in own), 0]))
    asked = rng.normal(size=(50, 6))
    asked /= np.linalg.norm(asked, axis=1, keepdims=True)
    bounds = cells.bounds(asked)
    assert all((asked @ rows[cell == i].T).max(axis=1)[j] <= bounds[j, i] + 1e-9 for i in range(9) for j in range(50))


def test_a_block_keeps_ties_by_id_and_what_is_no_number_last():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    vectors = rng.integers(-1, 2, (500, 3)).astype(float)
    vectors[::50] = np.nan
    table = lambda name, rows: pa.table({name: pa.array(np.arange(len(rows))[::-1]), "vector": pa.array(rows.tolist(), pa.list_(pa.float64()))})
    units, questions = vectors[::-1], vectors[1:300]
    for k in (1, 7, 495, 600):
        found = retrieval._block_top_k(k)(table("id", units), table("qid", questions)).to_pydict()
        rows = list(zip(found["qid"], found["id"], strict=True))
        assert len(rows) == len(set(rows)) == len(questions) * min(k, 500)
        near = np.round(pivots.rows_of(table("q", questions)["vector"]) @ pivots.rows_of(table("u", vectors)["vector"]).T, retrieval.DECIMALS)
        for n in (0, 5, 298):
            want = np.argsort(-near[n], kind="stable")[:k]
            assert [i for q, i in rows if q == len(questions) - 1 - n] == want.tolist()
