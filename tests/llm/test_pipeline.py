"""The pipeline against the plain versions of its stages."""

import random
from pathlib import Path

import pytest

import corpus_pipeline
from docloom.llm import pii, quality, toxicity
from docloom.llm.registry import oracle_sql, queries

from .test_near_dedup import brute_force

SF = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(str(SF / "documents.parquet"))
    labels = spark.read.parquet(str(SF / "labels.parquet"))
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(SF))
        out.write.parquet(str(tmp_path / name))
        seen[name] = (docs, docs := spark.read.parquet(str(tmp_path / name)))
        if name != "packing":
            assert docs.columns == columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = seen["toxicity"]
    assert ids(after) == ids(toxicity.toxicity(before, labels).where("predicted = 0"))
    before, after = seen["quality"]
    assert ids(after) == {r.doc_id for r in quality.quality(before).collect() if r.kept}
    before, after = seen["near_dedup"]
    classes, _ = brute_force([(r.doc_id, r.text) for r in before.collect()], 5, 80, 100)
    assert ids(after) == set(classes.values())
    before, after = seen["pii"]
    old, new = ({r.doc_id: r for r in df.collect()} for df in (before, after))
    assert old.keys() == new.keys()
    for i, r in new.items():
        assert r.n_chars == len(r.text) and not [s for s in pii.base_spans(r.text)]
        if not pii.base_spans(old[i].text):
            assert r.text == old[i].text
    before, after = seen["packing"]
    assert ids(after) == ids(before)


def test_registered():
    assert sorted(q.split("_")[0] for q in queries()) == sorted(f"op{i}" for i in range(1, 14))
    assert oracle_sql().keys() < queries().keys()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "pii", "packing"]


def test_whole_run_over_odd_rows(spark, odd_texts, tmp_path):
    """run() over nulls, empty and very long texts, repeated rows, shared ids and columns whose names operators use."""
    rng = random.Random(4)
    words = [f"word{i}" for i in range(400)] + ["the", "of", "and"] * 30
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    good = {i: prose(120) for i in range(100, 130)}
    good[131] = good[100] + " end"
    rows = [*odd_texts, *good.items(), (132, good[101]), (132, prose(130)), (None, prose(110)), (140, prose(60) + " mail ann@x.org " + prose(60))]
    rows = [(i, t, "en", "web", len(t or ""), "x", "x", "x", "x") for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, terms string, kept string, n int".replace("n int", "n string")).repartition(4)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(100, 130)], "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.dtypes == df.dtypes
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    left = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(((r.doc_id, r.start) for r in pieces if r.start == 0), key=repr) == sorted(((i, 0) for i, _ in left), key=repr)
    ids = [i for i, _ in left]
    assert set(range(100, 130)) <= set(ids) and 131 not in ids and ids.count(132) == 2 and ids.count(None) == 1 and 140 in ids
    assert "[EMAIL]" in dict(left)[140] and all(r.n_chars == len(r.text) for r in docs.collect())
    # A table without rows goes through, too.
    none = tmp_path / "none"
    df.limit(0).write.parquet(str(none / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(str(none / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(none)).count() == 0
