"""Rules for text and tables that were read off pages."""

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Single capitals that were spaced out, which are joined.
SPACED = [(r"\b([A-Z]) ([A-Z]) ([A-Z]) ([A-Z])\b", "$1$2$3$4"), (r"\b([A-Z]) ([A-Z]) ([A-Z])\b", "$1$2$3")]


def clean_cell(cell: Column) -> Column:
    """White space collapsed; four, then three single capitals that were spaced out are joined; null is empty."""
    text = F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), r"\s+", " "))
    for spaced, joined in SPACED:
        text = F.regexp_replace(text, spaced, joined)
    return text


def is_header_like(cell: Column) -> Column:
    """Upper case, or title case: every run of letters starts with a capital and goes on in lower case."""
    cased = cell.rlike(r"\p{L}")
    upper = cased & (F.upper(cell) == cell)
    title = cased & ~cell.rlike(r"(?<!\p{L})\p{Ll}|\p{L}\p{Lu}")
    return upper | title


def is_header_row(cells: Column) -> Column:
    """At least three in five of the cells with content are header-like; none with content: no."""
    held = F.filter(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")
    return (F.size(held) > 0) & (F.size(F.filter(held, is_header_like)) >= 0.6 * F.size(held))


def has_content(cells: Column) -> Column:
    return F.exists(cells, lambda c: F.coalesce(c, F.lit("")) != "")


def table_html(rows: Column) -> Column:
    """A table of array<array<string>>: blank rows are left out, a header-like first row gets header cells. Text isn't escaped."""
    clean = F.transform(rows, lambda r: F.transform(r, clean_cell))

    def line(tag: str):
        return lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))

    lines = F.transform(clean, lambda r, i: F.when(~has_content(r), F.lit("")).when((i == 0) & is_header_row(r), line("th")(r)).otherwise(line("td")(r)))
    return F.when(F.size(rows) > 0, F.concat(F.lit("<table>"), F.array_join(lines, ""), F.lit("</table>"))).otherwise(F.lit(""))


#: Fixed patterns of heading lines: marked, all capitals, numbered.
HEADINGS = [r"^(#+)\s+(.+)$", r"^([A-Z][A-Z\s&/\-]+[A-Z])\s*$", r"^(\d+\.\s+.+)$"]


def line_class(line: Column) -> Column:
    """blank, heading or text."""
    text = F.trim(line)
    heading = F.lit(False)
    for pattern in HEADINGS:
        heading = heading | text.rlike(pattern)
    return F.when(text == "", F.lit("blank")).when(heading, F.lit("heading")).otherwise(F.lit("text"))
