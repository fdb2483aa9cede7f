"""Edge cases of the scalar rules."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import layout, replies, text, vectors
from docloom.functions.html import table_rows


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x"))).first()[0]


def cells(html, **options):
    return [[(c["k"], c["v"]) for c in row] for row in table_rows(html, **options)]


def test_spans_fill_the_grid():
    html = '<table><tr><th>A</th><th>B</th><th>C</th></tr><tr><td rowspan="9">x</td><td colspan="2">y</td></tr><tr><td>p</td><td>q</td></tr></table>'
    assert cells(html) == [[("A", "x"), ("B", "y"), ("C", "y")], [("A", "x"), ("B", "p"), ("C", "q")]]


def test_repeated_headers_keep_place_and_last_value():
    html = "<table><tr><th>A</th><th></th><th>B</th><th></th></tr><tr><td>1</td><td>2</td><td></td><td>4</td></tr></table>"
    assert cells(html) == [[("A", "1"), ("", "4")]]
    assert cells(html, keep_repeated_headers=True) == [[("A", "1"), ("", "2"), ("", "4")]]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<table></table>", []),
        ("<table><tr></tr></table>", []),
        ('<table><tr><td colspan="x">a</td></tr></table>', [[("Col0", "a")]]),
        ("<table><tr><td>a<br>b</td><td>&amp;</td></tr></table>", [[("Col0", "a \n b"), ("Col1", "&")]]),
        ("<table><tr><th>H</th></tr></table>", []),
    ],
)
def test_odd_tables(html, want):
    assert cells(html) == want


def test_null_table():
    assert table_rows(None) is None


@pytest.mark.parametrize(
    ("line", "want"),
    [("CCY: chf \nx", "CHF"), ("no colon\na: b", None), ("CCY:", None), (":  ", None), ("a: b: c", "B: C"), (None, None), ("", None)],
)
def test_scope(spark, line, want):
    assert one(spark, line, text.scope) == want


def test_codes(spark):
    assert one(spark, "UBSWCHZH80A deutdeff DEUTDEFF, DEUTDEFFX éABCDEF12", text.codes) == ["UBSWCHZH80A", "DEUTDEFF"]
    assert one(spark, None, text.codes) is None


@pytest.mark.parametrize(("question", "want"), [("small totals", True), ("which one", False), ("Download it", True), (None, None)])
def test_broad(spark, question, want):
    assert one(spark, question, text.is_broad) is want


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        ('{"answer": "a"}', "a"),
        ('```json\n{"answer": "a"}\n```', "a"),
        ('see {"answer": "a"} there', "a"),
        ('{"answer": {"k": "v", "l": "w"}}', "k: v\nl: w"),
        ('{"answer": null}', '{"answer": null}'),
        ('{"other": 1}', '{"other": 1}'),
        ("[1, 2]", "[1, 2]"),
        ("5", "5"),
        ("  words ", "words"),
        ("", ""),
        (None, None),
    ],
)
def test_answers(spark, reply, want):
    assert one(spark, reply, replies.answer) == want


def test_cells_and_headers(spark):
    assert one(spark, "a  S W I F T\n x", layout.clean_cell) == "a SWIF T x"
    assert one(spark, None, layout.clean_cell) == ""
    rows = [[["NAME", "Account No"], ["", None], ["x", "1"]]]
    assert one(spark, rows[0], layout.table_html, "array<array<string>>") == "<table><tr><th>NAME</th><th>Account No</th></tr><tr><td>x</td><td>1</td></tr></table>"
    assert one(spark, [[None, ""], ["A", "B"]], layout.table_html, "array<array<string>>") == "<table><tr><td>A</td><td>B</td></tr></table>"
    assert one(spark, [], layout.table_html, "array<array<string>>") == ""


def test_vectors(spark):
    assert one(spark, [3.0, 4.0], vectors.normalise, "array<float>") == [0.6, 0.8]
    assert one(spark, [0.0, 0.0], vectors.normalise, "array<float>") == [0.0, 0.0]


def test_strip_looks_at_the_ends_only(spark):
    """Every white-space character goes at both ends, none in between; a long run of them inside is no work of its square."""
    import time

    white = [chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
    rows = [(f"{w}{white[i - 1]}a{w}b{w}\n{w}", f"a{w}b") for i, w in enumerate(white)] + [("".join(white), ""), ("​x﻿", "​x﻿"), (None, None)]
    found = spark.createDataFrame(rows, "x string, want string").select(text.strip(F.col("x")).alias("x"), "want").collect()
    assert all(r.x == r.want for r in found)
    started = time.monotonic()
    assert spark.range(1).select(F.length(text.strip(F.concat(F.lit("a"), F.repeat(F.lit(" "), F.lit(400_000)), F.lit("b"))))).first()[0] == 400_002
    assert time.monotonic() - started < 20
