import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import chunking, ordering
from docloom.operators.blocks import parse_blocks, parse_pieces

PIECES = "doc_ord long, doc_name string, part int, content string, segments string"
LINES = ["# Head", "##", "", " \t", "words", "more words ", "#no space", "<table>", "</table>", "<TABLE border=1><tr><th>A</th></tr>", "<tr><td>1</td></tr>", "<tr><td>2</td><td>3</td></tr></table>",
         "before <table><tr><td>x</td></tr></table> behind", "<table><tr><td>y</td></tr></table><table><tr><td>z</td></tr>", "</table> text </table> <table>", "<tr>", "a\x02b", "</Table>"]


def _blocks(df):
    rows = sorted(df.collect(), key=lambda r: (r.doc_ord, r.pos))
    return [(r.doc_ord, r.doc_name, r.type, r.text, None if r.rows is None else [[(c.k, c.v) for c in cells] for cells in r.rows]) for r in rows]


@pytest.mark.parametrize("most", [1, 2, 5])
def test_a_document_may_be_cut_at_any_line(spark, most):
    rng = random.Random(most)
    docs, pieces = [], []
    for d in range(300):
        lines = [rng.choice(LINES[:8] if d % 5 == 0 else LINES) + rng.choice(["\n", "\n", "\r\n", " "]) for _ in range(rng.randint(0, 14))]
        if lines and rng.random() < 0.3:
            lines[-1] = lines[-1].rstrip("\r\n ")
        docs.append((d, f"d{d}", "".join(lines)))
        at, part = 0, 0
        while at < len(lines):
            n = rng.randint(1, most)
            pieces.append((d, f"d{d}", part, "".join(lines[at : at + n]), "x"))
            at, part = at + n, part + rng.randint(1, 3)
            if rng.random() < 0.1:
                pieces.append((d, f"d{d}", part, rng.choice([None, ""]), "x"))
                part += 1
    want = _blocks(parse_blocks(spark.createDataFrame(docs, "doc_ord long, doc_name string, content string")))
    assert {w[2] for w in want} == {"heading", "text", "table"}
    assert _blocks(parse_pieces(spark.createDataFrame(pieces, PIECES).repartition(7))) == want


def test_pieces_of_nothing(spark):
    for rows in ([], [(1, "d", 0, None, "")], [(1, "d", 0, "\n", ""), (1, "d", 1, " \n", "")]):
        assert parse_pieces(spark.createDataFrame(rows, PIECES)).count() == 0


def test_strategies_take_blocks_of_pieces(spark):
    text = "Intro\n# One\nbefore\n<table>\n<tr><th>A</th></tr>\n<tr><td>1</td></tr>\n<tr><td>2</td></tr>\n</table>\nbehind\n# Two\nwords\n\nof it\n"
    lines = [(d, f"d{d}", i, x, "") for d in range(3) for i, x in enumerate(text.splitlines(keepends=True))]
    whole = parse_blocks(spark.createDataFrame([(d, f"d{d}", text) for d in range(3)], "doc_ord long, doc_name string, content string"))
    cut = parse_pieces(spark.createDataFrame(lines, PIECES))
    for strategy in chunking.STRATEGIES.values():
        want, found = ([r.asDict(True) for r in strategy.parents(b).orderBy("parent_id").collect()] for b in (whole, cut))
        assert want and found == want


def test_one_document_of_a_million_lines(spark):
    """One table, one heading and one text for each thousand lines, in pieces of 40 lines: every row, cell and line is there."""
    n = 1_000_000
    i = F.col("id") % 1000
    line = F.when(i == 0, "# H").when(i == 1, "<table><tr><th>A</th></tr>").when(i == 400, "</table>").when(i < 400, F.format_string("<tr><td>%d</td></tr>", "id")).otherwise(F.format_string("w%d", "id"))
    lines = spark.range(n, numPartitions=8).select("id", line.alias("line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]), "\n")
    cut = lines.groupBy(F.floor(F.col("id") / 40).alias("part")).agg(joined.alias("content")).select(F.lit(5).cast("long").alias("doc_ord"), F.lit("d").alias("doc_name"), "part", "content")
    found = parse_pieces(cut)
    found = found.groupBy("type").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.size("rows"), F.lit(0))).alias("cells"), F.sum(F.size(F.split("text", "\n"))).alias("lines")).collect()
    assert {r.type: (r.n, r.cells, r.lines) for r in found} == {"heading": (1000, 0, 1000), "table": (1000, 398_000, None), "text": (1000, 0, 599_000)}


def test_carried(spark):
    rng = random.Random(3)
    rows = [(g, o, rng.choice([None, None, o]), rng.choice([None, "a", "b"])) for g in (1, 2, 2**40) for o in range(rng.choice([1, 30, 400]))]
    want, last = {}, {}
    for g, o, a, b in rows:
        want[g, o] = (last.get((g, "a")), last.get((g, "b")))
        last |= {(g, n): v for n, v in (("a", a), ("b", b)) if v is not None}
    df = spark.createDataFrame(rows, "g long, o int, a int, b string").repartition(5)
    assert {(r.g, r.o): (r.x, r.y) for r in ordering.carried(df, "g", "o", {"x": "a", "y": "b"}).collect()} == want
