import json
import random
import time

import pytest
from pyspark.sql import functions as F

from docloom.sources import documents, json_folder
from docloom.sources.kept import kept, releasing, shared_dir


def test_a_folder_of_documents_and_back(spark, tmp_path):
    """One indented object per file, read in parts; odd files of the folder are no documents."""
    rows = [(f"d{i}.json" if i % 2 else f"d{i}", "m", None, f"# É {i}\n<table>") for i in range(40)]
    docs = spark.createDataFrame(rows, json_folder.SCHEMA).repartition(5)
    folder = str(tmp_path / "out")
    (tmp_path / "out").mkdir()
    json_folder.write_folder(docs, folder)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(f"d{i}.json" for i in range(40))
    text = (tmp_path / "out/d1.json").read_text(encoding="utf-8")
    assert text == json.dumps(dict(zip(json_folder.FIELDS, rows[1], strict=True)), indent=2, ensure_ascii=False)
    (tmp_path / "out/bare.json").write_text('{"content": "x"}')
    (tmp_path / "out/other.txt").write_text("no")
    (tmp_path / "out/below").mkdir()
    found = json_folder.read_folder(spark, folder, 7)
    assert found.rdd.getNumPartitions() == 6
    assert sorted(map(tuple, found.collect())) == sorted([*rows, ("bare.json", None, None, "x")])
    assert {r.doc_name: r.content for r in documents.read_json(spark, folder).collect()} == {r.doc_name: r.content for r in found.collect()}


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    (tmp_path / "out").mkdir()
    docs = spark.range(20, numPartitions=4).select(F.when(F.col("id") != 13, F.concat(F.lit("d"), "id")).alias("doc_name"), F.lit("x").alias("content"))
    with pytest.raises(Exception, match="not a file name"):
        json_folder.write_folder(docs, str(tmp_path / "out"))
    assert list((tmp_path / "out").iterdir()) == []
    json_folder.write_folder(docs.where("doc_name is not null"), str(tmp_path / "out"))
    before = {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()}
    assert len(before) == 19
    for rows in (docs.where("id = 3"), docs.where("id = 4").union(docs.where("id = 4")), spark.createDataFrame([("new", "y"), ("new.json", "z")], "doc_name string, content string").repartition(2)):
        with pytest.raises(Exception, match="name"):
            json_folder.write_folder(rows.select("doc_name", "content"), str(tmp_path / "out"))
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == before
    json_folder.write_folder(docs.where("id < 2"), str(tmp_path / "out"), overwrite=True)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["d0.json", "d1.json"]


def _brute(words, boxes):
    inside = lambda w, b: w[:2] == b[:2] and b[2] <= w[3] and w[4] <= b[4] and b[3] <= w[5] and w[6] <= b[5]
    return sorted(w for w in words if not any(inside(w, b) for b in boxes))


def test_words_outside_of_boxes(spark):
    """Boxes of all sizes, one over another, empty and without height; words on borders and beyond the boxes' extent."""
    rng = random.Random(6)
    boxes = []
    for page in (0, 1, 2):
        for _ in range((40, 3, 1)[page]):
            x, y, w, h = rng.randint(-20, 90), rng.randint(0, 90), rng.choice([0, 1, 5, 30, 100]), rng.choice([0, 2, 10, 80])
            boxes.append(("d", page, float(x), float(y), float(x + w), float(y + h)))
    words = []
    for i in range(900):
        x, y = rng.randint(-40, 130), rng.randint(-10, 130)
        words.append(("d", i % 4, f"w{i}", float(x), float(x + rng.randint(0, 4)), float(y), float(y + rng.randint(0, 3))))
    w = spark.createDataFrame(words, documents.WORDS)
    b = spark.createDataFrame([(*x, [["a"]]) for x in boxes], documents.TABLES)
    assert sorted(map(tuple, documents.outside_boxes(w, b).select(*documents.WORDS.replace(" string", "").replace(" int", "").replace(" double", "").split(", ")).collect())) == _brute(words, boxes)
    assert documents.outside_boxes(w, b.limit(0)).count() == len(words)


def test_a_full_page(spark):
    """100,000 words and 10,000 boxes on one page."""
    boxes = spark.range(10_000).selectExpr("'d' doc_name", "0 page", "cast(id % 100 * 10 as double) x0", "cast(id div 100 * 10 as double) y0", "cast(id % 100 * 10 + 8 as double) x1", "cast(id div 100 * 10 + 8 as double) y1", "array(array('a')) rows")
    words = spark.range(100_000).selectExpr("'d' doc_name", "0 page", "'w' text", "cast(id % 1000 as double) x0", "cast(id % 1000 + 1 as double) x1", "cast(id div 1000 * 10 as double) top", "cast(id div 1000 * 10 + 1 as double) bottom")
    began = time.time()
    # A box takes places 0 to 7 of ten.
    assert documents.outside_boxes(words, boxes).count() == 20_000
    assert time.time() - began < 30


def test_what_is_kept_goes_with_its_scope(spark):
    from pathlib import Path

    files = lambda: set(Path(shared_dir(spark).removeprefix("file:")).glob("docloom/**/*.parquet"))
    outer = kept(spark.range(3))
    before = files()
    with releasing(spark):
        one = kept(spark.range(4))
        with releasing(spark):
            assert kept(spark.range(5)).count() == 5
        assert one.count() == 4 and len(files()) > len(before)
    assert files() == before and outer.count() == 3
    with pytest.raises(ValueError), releasing(spark):
        kept(spark.range(2))
        raise ValueError
    assert files() == before
