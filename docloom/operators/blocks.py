"""Documents to blocks: headings, texts and tables in reading order."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import CELLS, html_rows
from ..functions.text import strip
from ..sources.kept import kept
from .ordering import carried

_LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
#: Control characters that mark cuts inside a row; they are taken out of the content first.
_CUT, _HEADING, _PIECE = "\x01", "\x02", "\x03"
_OPEN, _CLOSE = "<table", "</table>"


def _held(docs: DataFrame) -> DataFrame:
    content = F.coalesce("content", F.lit(""))
    has = F.contains(content, F.lit(_CUT)) | F.contains(content, F.lit(_HEADING)) | F.contains(content, F.lit(_PIECE))
    return docs.withColumn("content", F.when(has, F.regexp_replace(content, f"[{_CUT}{_HEADING}{_PIECE}]", " ")).otherwise(content))


def _may_open(content: Column) -> Column:
    """Few texts have a table; the others aren't searched for where one ends."""
    return F.contains(content, F.lit(_OPEN[0])) & F.contains(F.lower(content), F.lit(_OPEN))


def _segments(content: Column) -> Column:
    """Texts and closed tables in turn; texts may be empty."""
    cut = F.split(F.regexp_replace(content, f"(?is)({_OPEN}.*?{_CLOSE})", f"{_CUT}$1{_CUT}"), _CUT)
    return F.when(_may_open(content), cut).otherwise(F.array(content))


def _pieces(text: Column) -> Column:
    """Runs of lines and headings, which start with a mark, in turn; empty where nothing stands before, between or behind them."""
    marked = F.transform(
        F.transform(F.split(text, _LINE_ENDS), strip),
        lambda x: F.when(x == "", F.lit(_PIECE)).when(x.startswith("#"), F.concat(F.lit(_PIECE + _HEADING), strip(F.regexp_replace(x, "^#+", "")), F.lit(_PIECE))).otherwise(x),
    )
    return F.transform(F.split(F.array_join(marked, "\n"), _PIECE), lambda p: F.btrim(p, F.lit("\n")))


def parse_blocks(docs: DataFrame, keep_repeated_headers: bool = False) -> DataFrame:
    """(doc_ord, doc_name, pos, type, text, rows) from (doc_ord, doc_name, content). pos orders a document's blocks.

    A table is cut out from its tag to the first closing tag; one that is never closed is text. A line that starts with #
    is a heading, a blank line ends a text block. Tables without rows and null content give no blocks. Cuts are made inside
    the row, so nothing is shuffled; only tables go to Python, and only documents that have any are looked at for them.
    """
    held = _held(docs)
    is_table = F.lower("part").startswith("<table")
    none = F.lit(None).cast(CELLS)

    def parts(rows: DataFrame) -> DataFrame:
        return rows.select("doc_ord", "doc_name", F.posexplode(_segments(F.col("content"))).alias("seg", "part")).withColumn("part", strip(F.col("part"))).where("part <> ''")

    pieces = F.filter(_pieces(F.col("part")), lambda p: p != "")
    texts = parts(held).where(~is_table).select("doc_ord", "doc_name", "seg", F.posexplode_outer(pieces).alias("sub", "p")).where("p is not null")
    heads = F.col("p").startswith(_HEADING)
    texts = texts.select(
        "doc_ord", "doc_name", "seg", "sub", F.when(heads, "heading").otherwise("text").alias("type"), F.when(heads, F.substring("p", 2, 1 << 30)).otherwise(F.col("p")).alias("text"), none.alias("rows")
    )
    tables = parts(held.where(_may_open(F.col("content")))).where(is_table).select("doc_ord", "doc_name", "seg", F.lit(0).alias("sub"), F.lit("table").alias("type"), F.lit(None).cast("string").alias("text"), html_rows(F.col("part"), keep_repeated_headers).alias("rows"))
    found = texts.unionByName(tables.where(F.size("rows") > 0))
    return found.select("doc_ord", "doc_name", (F.col("seg").cast("long") * (1 << 32) + F.col("sub")).alias("pos"), "type", "text", "rows")


def _table_states(held: DataFrame) -> DataFrame:
    """For each piece (doc_ord, part): closes, whether it holds a closing tag; opened and left, whether a table is open where it
    starts and where it ends; behind, the last piece before it that closes one, or -1; last, the document's last such piece, or
    -1; tail, whether what follows there is a table that is never closed.

    A piece is a function of the state at its start: one with a closing tag ends in a state of its own, one without leaves an
    open table open. So the composition of all pieces before another is the last one that closes and whether one since opens.
    """
    closing = F.regexp_replace("content", f"(?is)^.*{_CLOSE}", "")
    closes = F.col("content").rlike(f"(?i){_CLOSE}")
    # Whether the last closing tag closes nothing, should a table be open at the start or not.
    stray = lambda content: closes & F.element_at(_segments(content), -1).rlike(f"(?i){_CLOSE}")
    facts = held.select("doc_ord", "part", closes.alias("closes"), closing.rlike(f"(?i){_OPEN}").alias("opens"), F.lower(F.substring(strip(closing), 1, len(_OPEN))).alias("begins"),
                        stray(F.col("content")).alias("stray"), stray(F.concat(F.lit(_OPEN), "content")).alias("stray_open"))
    facts = kept(facts)
    lasts = kept(facts.groupBy("doc_ord").agg(F.coalesce(F.max(F.when(F.col("closes"), F.col("part"))), F.lit(-1)).alias("last")))
    # What opens behind the last closing tag is text.
    facts = kept(facts.join(lasts, "doc_ord").withColumn("opens", F.col("opens") & (F.col("part") < F.col("last"))))
    marks = facts.select("doc_ord", "part", F.when(F.col("closes"), F.col("part")).alias("c"), F.when(F.col("opens"), F.col("part")).alias("o"))
    facts = facts.join(kept(carried(marks, "doc_ord", "part", {"behind": "c", "since": "o"})), ["doc_ord", "part"]).withColumn("behind", F.coalesce("behind", F.lit(-1)))
    facts = facts.withColumn("opened", F.coalesce(F.col("since") >= F.col("behind"), F.lit(False)))
    closed = F.max((F.col("part") == F.col("last")) & F.when(F.col("opened"), F.col("stray_open")).otherwise(F.col("stray")))
    begins = F.min_by("begins", F.when((F.col("begins") != "") & (F.col("part") >= F.col("last")), F.col("part")))
    tails = kept(facts.groupBy("doc_ord").agg((~closed & F.coalesce(begins == _OPEN, F.lit(False))).alias("tail")))
    left = F.col("opens") | (F.col("opened") & ~F.col("closes"))
    return facts.join(tails, "doc_ord").select("doc_ord", "part", "closes", "opened", left.alias("left"), "behind", "last", "tail")


def parse_pieces(pieces: DataFrame, keep_repeated_headers: bool = False) -> DataFrame:
    """The blocks of parse_blocks from documents in pieces (doc_ord, doc_name, part, content), which end a line each, wherever they
    are cut: no row but a block's own holds more than a piece. pos is a struct (part, seg, sub).

    part is at least 0, orders the pieces of a document and doesn't repeat there. Null and empty pieces count as none. What
    is known of a piece's start follows from small rows of the pieces before it; each piece is then parsed where it is. Only
    tables and texts that reach over a cut meet their other parts.
    """
    held = _held(pieces.where("content <> ''").select("doc_ord", "doc_name", F.col("part").cast("long").alias("part"), "content"))
    held = held.withColumn("content", F.when(F.col("content").rlike(f"(?:{_LINE_ENDS})\\z"), F.col("content")).otherwise(F.concat("content", F.lit("\n"))))
    states = kept(_table_states(held))
    # A table that is open at the start or the end gets the missing tag, which is cut off again behind.
    tag = lambda when, t: F.when(F.col(when), F.lit(t)).otherwise(F.lit(""))
    rows = held.join(states, ["doc_ord", "part"]).withColumn("segments", _segments(F.concat(tag("opened", _OPEN), "content", tag("left", _CLOSE))))
    rows = rows.select("doc_ord", "doc_name", *states.columns[1:], F.size("segments").alias("n"), F.posexplode("segments").alias("seg", "s"))
    ends = F.col("seg") == F.col("n") - 1
    unclosed = F.col("tail") & ((F.col("part") > F.col("last")) | ((F.col("part") == F.col("last")) & ends))
    first, final = F.col("opened") & (F.col("seg") == 1), F.col("left") & (F.col("seg") == F.col("n") - 2)
    cut = F.when(first, F.substring("s", len(_OPEN) + 1, 1 << 30)).otherwise(F.col("s"))
    cut = F.when(final, F.substring(cut, F.lit(1), F.length(cut) - len(_CLOSE))).otherwise(cut)
    is_table = ((F.col("seg") % 2 == 1) | unclosed).alias("is_table")
    #: One table at most is open between two pieces that close one, so the first of these names it.
    name = F.when(unclosed, F.col("last")).when(first, F.col("behind")).when(final, F.when(F.col("closes"), F.col("part")).otherwise(F.col("behind"))).alias("name")
    parsed = F.when(is_table, F.array(cut)).otherwise(_pieces(F.regexp_replace("s", f"(?:{_LINE_ENDS})\\z", "")))
    rows = rows.select("doc_ord", "doc_name", "part", "seg", ends.alias("ends"), is_table, name, parsed.alias("parsed"))
    rows = rows.select("*", F.posexplode("parsed").alias("sub", "p")).where("p <> ''")
    starts, stays = F.lit(False) == F.col("is_table"), F.col("ends") & (F.col("sub") == F.size("parsed") - 1)
    rows = rows.select(
        "doc_ord", "doc_name", F.struct("part", "seg", "sub").alias("pos"), "part", "is_table", "name", "p",
        (starts & (F.col("seg") == 0) & (F.col("sub") == 0)).alias("starts"), (starts & stays).alias("stays"),
    )
    rows = kept(rows)

    # A run of lines goes through a piece that is nothing else; any other piece is where runs end or begin.
    through = rows.where("starts and stays").select("doc_ord", "part", F.lit(True).alias("through"))
    marks = kept(states.select("doc_ord", "part").join(through, ["doc_ord", "part"], "left").select("doc_ord", "part", F.when(F.col("through").isNull(), F.col("part")).alias("b")))
    runs = rows.where("starts or stays").join(kept(carried(marks, "doc_ord", "part", {"behind": "b"})), ["doc_ord", "part"])
    runs = runs.withColumn("name", F.when(F.col("starts"), F.coalesce("behind", F.lit(-1))).otherwise(F.col("part")))

    def met(parts: DataFrame, by: str) -> DataFrame:
        listed = F.array_sort(F.collect_list(F.struct("pos", "p")))
        joined = parts.groupBy("doc_ord", "name").agg(F.first("doc_name").alias("doc_name"), F.min("pos").alias("pos"), listed.alias("l"))
        return joined.select("doc_ord", "doc_name", "pos", F.array_join(F.transform("l", lambda x: x["p"]), by).alias("p"))

    columns = ["doc_ord", "doc_name", "pos", "p"]
    texts = rows.where("not (is_table or starts or stays)").select(*columns).unionByName(met(runs, "\n"))
    heads = F.col("p").startswith(_HEADING)
    texts = texts.select("doc_ord", "doc_name", "pos", F.when(heads, "heading").otherwise("text").alias("type"), F.when(heads, F.substring("p", 2, 1 << 30)).otherwise(F.col("p")).alias("text"), F.lit(None).cast(CELLS).alias("rows"))
    tables = rows.where("is_table")
    tables = tables.where("name is null").select(*columns).unionByName(met(tables.where("name is not null"), ""))
    tables = tables.select("doc_ord", "doc_name", "pos", F.lit("table").alias("type"), F.lit(None).cast("string").alias("text"), html_rows(strip(F.col("p")), keep_repeated_headers).alias("rows"))
    return texts.unionByName(tables.where(F.size("rows") > 0))
