"""HTML tables to rows of (header, value) cells, with row and column spans laid out on a grid."""

from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

CELLS = "array<array<struct<k:string,v:string>>>"


class _Cells(HTMLParser):
    """Rows as lists of (tag, attributes, text nodes)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[tuple[str, dict, list[str]]]] = []
        self.inside = False

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
            self.inside = False
        elif tag in ("td", "th"):
            if not self.rows:
                return
            self.rows[-1].append((tag, dict(attrs), []))
            self.inside = True
        elif tag == "br" and self.inside:
            self.rows[-1][-1][2].append("\n")

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.rows[-1][-1][2].append(data)


def _span(value: str | None) -> int:
    try:
        return int(value or 1)
    except ValueError:
        return 1


def table_rows(html: str | None, keep_repeated_headers: bool = False) -> list[list[dict]] | None:
    """Rows of {k, v}. A first row of header cells alone names the columns, else they are Col0, Col1, ...; empty cells and
    rows without cells are left out. A header that repeats keeps its first place and its last value, or, if asked for, all.

    A span that isn't a number counts as 1; a row span beyond the last row is cut.
    """
    if html is None:
        return None
    parser = _Cells()
    parser.feed(html)
    parser.close()
    grid: list[dict[int, str]] = [{} for _ in parser.rows]
    for y, cells in enumerate(parser.rows):
        x = 0
        for _, attrs, nodes in cells:
            while x in grid[y]:
                x += 1
            width, height = _span(attrs.get("colspan")), _span(attrs.get("rowspan"))
            for column in range(x, x + width):
                for row in range(y, max(y + 1, min(y + height, len(grid)))):
                    grid[row][column] = " ".join(nodes).strip()
            x += max(0, width)
    names = {}
    titled = bool(parser.rows and parser.rows[0]) and all(tag == "th" for tag, _, _ in parser.rows[0])
    if titled:
        names, grid = grid[0], grid[1:]
    out = []
    for row in grid:
        cells = [(names.get(x, f"Col{x}"), row[x]) for x in sorted(row) if row[x]]
        if not keep_repeated_headers:
            cells = list(dict(cells).items())
        if cells:
            out.append([{"k": k, "v": v} for k, v in cells])
    return out


def html_rows(html: Column, keep_repeated_headers: bool = False) -> Column:
    return F.udf(lambda t: table_rows(t, keep_repeated_headers), CELLS, useArrow=True)(html)
