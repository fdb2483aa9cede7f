import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import chunking

BLOCKS = "doc_ord long, doc_name string, pos int, content string"


def brute(docs, window, overlap):
    step, out = max(1, window - overlap), []
    for name, text in docs:
        words = text.split()
        out += [(name, " ".join(words[a : a + window])) for a in range(0, len(words), step)]
    return [(i, *x) for i, x in enumerate(out)]


def _found(df):
    return sorted((r.parent_id, r.doc_name, r.rows[0]) for r in df.collect())


@pytest.mark.parametrize(("window", "overlap"), [(5, 2), (4, 0), (3, 5), (7, 6)])
def test_pieces_give_the_windows_of_the_whole(spark, window, overlap):
    rng = random.Random(window)
    docs, rows, tables = [], [], []
    for d in range(12):
        pieces = [" ".join(f"{d}.{i}.{j}" for j in range(rng.choice([0, 0, 1, 2, 3, 11, 40]))) for i in range(rng.randint(0, 9))]
        docs.append((f"d{d}", "\n".join(pieces)))
        tables.append((3 * d, f"d{d}", "\n".join(pieces)))
        rows += [(3 * d, f"d{d}", 2 * i, p) for i, p in enumerate(pieces)]
    want = brute(docs, window, overlap)
    assert _found(chunking.windows_of(spark.createDataFrame(rows, BLOCKS).repartition(4), window, overlap)) == want
    assert _found(chunking.windows_of(spark.createDataFrame(tables, "doc_ord long, doc_name string, content string"), window, overlap)) == want


def test_no_pieces(spark):
    for rows in ([], [(1, "d", 0, ""), (1, "d", 1, " \n")]):
        assert chunking.windows_of(spark.createDataFrame(rows, BLOCKS)).count() == 0


def test_a_document_of_fifty_million_words(spark):
    """In a thousand pieces: no row of the result or between has more than a piece's words, and every word is in its windows."""
    n, each = 1000, 50_000
    blocks = spark.range(n, numPartitions=16).select(F.lit(7).cast("long").alias("doc_ord"), F.lit("d").alias("doc_name"), F.col("id").cast("int").alias("pos"), F.repeat(F.concat(F.hex("id"), F.lit(" ")), each).alias("content"))
    found = chunking.windows_of(blocks).select("parent_id", F.size(F.split(F.col("rows")[0], " ")).alias("n"), F.split(F.col("rows")[0], " ")[0].alias("first"))
    total = -(-n * each // 120)
    seen = found.agg(F.count("*"), F.count_distinct("parent_id"), F.max("parent_id"), F.sum("n"), F.max("n"), F.sum((F.col("first") == F.hex(F.floor(F.col("parent_id") * 120 / each))).cast("int"))).first()
    assert tuple(seen[:3]) == (total, total, total - 1) and seen[4] == 150 and seen[5] == total
    assert seen[3] == sum(min(150, n * each - a) for a in range(0, n * each, 120))


def test_words_of_a_text_are_cut_once(spark):
    """No condition on the words makes the optimizer cut them again, before a shuffle or behind it."""
    from docloom.operators import chunking

    docs = spark.createDataFrame([(0, "d", "a b c"), (1, "e", " \n"), (2, "f", None)], "doc_ord long, doc_name string, content string")
    found = chunking.windows_of(docs.repartition(2))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert [(r.doc_ord, r.parent_id, r.rows) for r in found.collect()] == [(0, 0, ["a b c"])]
