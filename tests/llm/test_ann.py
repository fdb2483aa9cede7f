import numpy as np

from docloom.llm import ann


def test_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 16))
    x = (centres[rng.integers(0, 6, 1500)] + 0.4 * rng.normal(size=(1500, 16))).astype(np.float32)
    x[200:260] = x[200]  # copies
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    odd = [(5000, None, "x"), (5050, [0.0] * 16, "x"), (5100, [float("nan")] + [1.0] * 15, "x"), (5150, [1.0, 2.0], "x"), (5200, [None] + [1.0] * 15, "x"), (None, [1.0] * 16, "x"), (5250, [], "x"), (100, x[100].tolist(), "x")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, cell string").repartition(4)
    found = ann.search(df, "id % 50 = 0").collect()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    by_query: dict = {}
    for r in found:
        by_query.setdefault(r.query_id, []).append(r)
    assert by_query.keys() == set(range(0, 1500, 50))
    hit = 0
    for q, own in by_query.items():
        own.sort(key=lambda r: r.rank)
        assert [r.rank for r in own] == [1, 2, 3, 4, 5]
        cos = unit @ unit[q]
        assert all(abs(cos[r.vec_id] - r.score) < 1e-12 and r.vec_id != q for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        cos[q] = -2
        hit += len({r.vec_id for r in own} & set(np.lexsort((np.arange(1500), -cos.round(12)))[:5].tolist()))
    assert hit / (5 * len(by_query)) >= 0.9
    assert [r.vec_id for r in by_query[200]] == [201, 202, 203, 204, 205] and [r.vec_id for r in by_query[250]] == [200, 201, 202, 203, 204]


def test_groups_and_batches_of_few(spark, monkeypatch):
    """Cells cut over several groups and queries in several batches find the same."""
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(3000, 8)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = []
    for size, batch in ((20_000, "10000"), (40, "7")):
        monkeypatch.setattr(ann, "GROUP_VECTORS", size)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got.append(sorted(map(tuple, ann.search(df, "id % 10 = 0").collect())))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[0] == got[1] and len(got[0]) == 1500


def test_few_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.search(spark.createDataFrame([], schema), "id % 50 = 0").count() == 0
    assert ann.search(spark.createDataFrame([(0, [1.0, 0.0])], schema), "id % 50 = 0").count() == 0
    rows = ann.search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [2.0, 2.0])], schema), "id % 50 = 0").collect()
    assert sorted((r["rank"], r.vec_id) for r in rows) == [(1, 1), (2, 2)]


def test_traversal_goes_by_summed_distance():
    rng = np.random.default_rng(5)
    books = ann.Codebooks(rng.normal(size=(7, 3)), rng.normal(size=(5, 3)))
    sizes = rng.integers(0, 4, 35)
    unit = rng.normal(size=6)
    sums = (ann.distances(unit[None, :3], books.first)[0][:, None] + ann.distances(unit[None, 3:], books.second)[0]).ravel()
    want = [int(c) for c in sums.argsort() if sizes[c]]
    assert books.traverse(unit, sizes, 10**9) == want
    short = books.traverse(unit, sizes, 9)
    assert short == want[: len(short)] and sizes[short].sum() >= 9 > sizes[short[:-1]].sum()
