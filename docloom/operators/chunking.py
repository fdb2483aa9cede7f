"""Blocks to parents (sections, tables) and children (retrieval units), by a strategy.

parents: doc_ord, doc_name, parent_id, type, heading, preamble, rows array<string>, notes array<string>, first_child (the
  child_idx of its first child)
children: child_idx, parent_id, doc_ord, doc_name, row_text, embed_text
Ids are dense over the corpus in document order, unlike ids that restart or skip.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.kept import kept
from .ordering import running_offsets

WINDOW_WORDS, OVERLAP_WORDS = 150, 30
_KEYS = ["doc_ord", "section", "table_no"]


def _listed(order: str, value: Column | str, when: Column | None = None) -> Column:
    """Values of a group in order, as an array."""
    one = F.struct(F.col(order).alias("o"), (F.col(value) if isinstance(value, str) else value).alias("v"))
    return F.transform(F.array_sort(F.collect_list(one if when is None else F.when(when, one))), lambda x: x["v"])


def sections(blocks: DataFrame) -> DataFrame:
    """Blocks that aren't headings, with section, heading, table_no (tables so far) and first_section (the document's first
    section that has a block). A heading with nothing under it vanishes; before any heading the heading is empty."""
    so_far = Window.partitionBy("doc_ord").orderBy("pos")
    named = blocks.withColumn("section", F.sum((F.col("type") == "heading").cast("int")).over(so_far))
    named = named.withColumn("heading", F.coalesce(F.last(F.when(F.col("type") == "heading", F.col("text")), True).over(so_far), F.lit("")))
    named = named.where("type <> 'heading'")
    named = named.withColumn("first_section", F.min("section").over(Window.partitionBy("doc_ord")))
    return named.withColumn("table_no", F.sum((F.col("type") == "table").cast("int")).over(Window.partitionBy("doc_ord", "section").orderBy("pos")))


_PARENT = ["doc_ord", "doc_name", "parent_id", "type", "heading", "preamble", "rows", "notes", "first_child"]


def _child_rows() -> Column:
    """One child per row of a table parent, one per other parent."""
    return F.when(F.col("type") == "narrative", F.slice("rows", 1, 1)).otherwise(F.col("rows"))


def _numbered(parents: DataFrame, order: str) -> DataFrame:
    """parent_id and first_child from the order within each document and the counts of the documents before it."""
    so_far = Window.partitionBy("doc_ord").orderBy(order)
    parents = parents.withColumn("_n", F.size(_child_rows())).withColumn("_place", F.row_number().over(so_far) - 1).withColumn("_first", F.sum("_n").over(so_far) - F.col("_n"))
    parents = kept(parents.drop(order))
    sizes = parents.groupBy("doc_ord").agg(F.count("*").alias("_parents"), F.sum("_n").alias("_children"))
    offsets = running_offsets(sizes, "doc_ord", {"_p": "_parents", "_c": "_children"})
    return parents.join(offsets, "doc_ord").withColumn("parent_id", F.col("_p") + F.col("_place")).withColumn("first_child", F.col("_c") + F.col("_first")).select(*_PARENT)


def build_parents(blocks: DataFrame, merge: bool = True) -> DataFrame:
    """One parent per table, with the texts before the section's first table as preamble and those behind it as notes, and
    one per section without a table. The first section's text, if it has no table, also leads every table's preamble.
    Neighbouring tables under one heading become one."""
    named = sections(blocks)
    is_text, is_table = F.col("type") == "text", F.col("type") == "table"
    grouped = named.groupBy(*_KEYS).agg(
        F.first("doc_name").alias("doc_name"),
        F.first("heading").alias("heading"),
        F.first("first_section").alias("first_section"),
        F.min("pos").alias("pos"),
        F.max(is_table.cast("int")).alias("own_table"),
        F.transform(F.flatten(_listed("pos", F.coalesce("rows", F.expr("cast(array() as array<array<struct<k:string,v:string>>>)")), is_table)), T.flatten_row).alias("rows"),
        _listed("pos", "text", is_text).alias("texts"),
    )
    section = Window.partitionBy("doc_ord", "section")
    grouped = grouped.withColumn("has_table", F.max("own_table").over(section)).withColumn("texts_before", F.max(F.when(F.col("table_no") == 0, F.array_join("texts", "\n"))).over(section))
    lead = F.max(F.when((F.col("section") == F.col("first_section")) & (F.col("has_table") == 0), F.array_join("texts", "\n"))).over(Window.partitionBy("doc_ord"))
    grouped = grouped.withColumn("lead", lead)
    full = F.array_join(F.filter(F.array("lead", "texts_before"), lambda x: x != ""), "\n")
    narrative = F.col("has_table") == 0
    body = F.array_join("texts", "\n")
    parents = grouped.where((F.col("table_no") > 0) | (narrative & (T.strip(body) != ""))).select(
        "doc_ord",
        "doc_name",
        "pos",
        F.when(narrative, "narrative").otherwise("table").alias("type"),
        "heading",
        F.when(narrative, "").otherwise(full).alias("preamble"),
        F.when(narrative, F.array(body)).otherwise(F.col("rows")).alias("rows"),
        F.when(narrative, F.expr("cast(array() as array<string>)")).otherwise(F.col("texts")).alias("notes"),
    )
    return _numbered(merge_tables(parents) if merge else parents, "pos")


def merge_tables(parents: DataFrame) -> DataFrame:
    """Runs of table parents of one document under one heading become their first, with the rows and notes of all."""
    order = Window.partitionBy("doc_ord").orderBy("pos")
    same = (F.col("type") == "table") & (F.lag("type").over(order) == "table") & (F.lag("heading").over(order) == F.col("heading"))
    marked = parents.withColumn("island", F.sum((~F.coalesce(same, F.lit(False))).cast("int")).over(order))
    first = lambda c: F.min_by(c, "pos").alias(c)
    merged = marked.groupBy("doc_ord", "island").agg(*(first(c) for c in ("doc_name", "type", "heading", "preamble")), F.flatten(_listed("pos", "rows")).alias("rows"), F.flatten(_listed("pos", "notes")).alias("notes"), F.min("pos").alias("pos"))
    return merged.drop("island")


def build_children(parents: DataFrame) -> DataFrame:
    """One child per row of a table parent, one per other parent. Nothing is shuffled: parents know their first child."""
    out = parents.select("first_child", "parent_id", "doc_ord", "doc_name", "heading", F.posexplode(_child_rows()).alias("row_pos", "row_text"))
    return out.select(
        (F.col("first_child") + F.col("row_pos")).alias("child_idx"), "parent_id", "doc_ord", "doc_name", "row_text", F.concat(T.prefix(F.col("doc_name"), F.col("heading")), "row_text").alias("embed_text")
    )


def section_table(blocks: DataFrame) -> DataFrame:
    return build_parents(blocks)


def sliding_window(blocks: DataFrame, window: int = WINDOW_WORDS, overlap: int = OVERLAP_WORDS) -> DataFrame:
    """Windows of so many words, each starting window - overlap words behind the last; the last may be all overlap. Rows of a
    table are 'header: value' joined by bars; headings are words like others."""
    cells = lambda r: F.array_join(F.transform(F.filter(r, lambda c: T.strip(c["v"]) != ""), lambda c: F.concat_ws(": ", c["k"], T.strip(c["v"]))), " | ")
    flat = F.when(F.col("type") == "table", F.array_join(F.transform("rows", cells), "\n")).otherwise(F.col("text"))
    return windows_of(blocks.select("doc_ord", "doc_name", "pos", flat.alias("content")), window, overlap)


def _with_words(pieces: DataFrame) -> DataFrame:
    """Those of which more than white space is left. A condition on the words themselves would cut each text twice."""
    return pieces.where(T.strip(F.col("content")) != "")


def _places(pieces: DataFrame, step: int) -> DataFrame:
    """(doc_ord, pos, at, total, first): where a piece's words start in its document, how many that has, and the number of its
    first window. Only counts are shuffled and summed."""
    n = F.size(T.words(F.col("content"))).cast("long")
    windows = F.ceil(F.col("total") / step).alias("_n")
    if "pos" not in pieces.columns:
        counts = kept(_with_words(pieces).select("doc_ord", n.alias("total")))
        return counts.join(running_offsets(counts.select("doc_ord", windows), "doc_ord", {"first": "_n"}, written=True), "doc_ord").withColumn("at", F.lit(0).cast("long"))
    counts = kept(_with_words(pieces).select(F.struct("doc_ord", "pos").alias("place"), n.alias("n")))
    starts = kept(running_offsets(counts, "place", {"start": "n"}, written=True).join(counts, "place").select("place.*", "start", "n"))
    docs = kept(starts.groupBy("doc_ord").agg(F.min("start").alias("begin"), F.sum("n").alias("total")))
    docs = docs.join(running_offsets(docs.select("doc_ord", windows), "doc_ord", {"first": "_n"}, written=True), "doc_ord")
    return starts.join(docs, "doc_ord").select("doc_ord", "pos", (F.col("start") - F.col("begin")).alias("at"), "total", "first")


def windows_of(pieces: DataFrame, window: int = WINDOW_WORDS, overlap: int = OVERLAP_WORDS) -> DataFrame:
    """The same from (doc_ord, doc_name, content), or from a document's text in pieces (doc_ord, doc_name, pos, content), which end
    a word each.

    A piece knows where its words start, so which windows it has words of follows by arithmetic. Windows that lie in one piece
    are cut where that is; of the others the parts meet, which are a window's words at most. So no row holds a document.
    """
    step, keys = max(1, window - overlap), [c for c in ("doc_ord", "pos") if c in pieces.columns]
    # What is known of the pieces is written, so it is joined by broadcast where it is small, and no text is shuffled.
    known = kept(_places(pieces, step))
    words = _with_words(pieces).select(*keys, "doc_name", T.words(F.col("content")).alias("w")).join(known, keys)
    end = F.col("at") + F.size("w")
    lowest = F.greatest(F.floor((F.col("at") - window) / step) + 1, F.lit(0))
    start = lambda k: F.greatest(k * step, F.col("at"))
    part = lambda k: F.struct(k.alias("k"), F.array_join(F.slice("w", (start(k) - F.col("at") + 1).cast("int"), (F.least(k * step + window, end) - start(k)).cast("int")), " ").alias("piece"))
    cut = words.where(lowest <= F.floor((end - 1) / step)).select("doc_ord", "doc_name", "first", "at", "total", end.alias("end"), F.inline_outer(F.transform(F.sequence(lowest, F.floor((end - 1) / step)), part)))
    if "pos" in keys:
        whole = (F.col("k") * step >= F.col("at")) & (F.least(F.col("k") * step + window, F.col("total")) <= F.col("end"))
        parts = cut.where(~whole).groupBy("doc_ord", "k").agg(F.first("doc_name").alias("doc_name"), F.first("first").alias("first"), F.array_join(_listed("at", "piece"), " ").alias("piece"))
        columns = ["doc_ord", "doc_name", "first", "k", "piece"]
        cut = cut.where(whole).select(*columns).unionByName(parts.select(*columns))
    number, empty = F.col("first") + F.col("k"), F.expr("cast(array() as array<string>)")
    return cut.select(
        "doc_ord", "doc_name", number.alias("parent_id"), F.lit("narrative").alias("type"), F.lit("").alias("heading"), F.lit("").alias("preamble"), F.array("piece").alias("rows"), empty.alias("notes"), number.alias("first_child")
    )


def paragraph(blocks: DataFrame) -> DataFrame:
    """One parent per table and per paragraph of a text or heading block; none keeps a heading above it."""
    named = blocks.withColumn("heading", F.lit(""))
    pieces = F.filter(F.transform(F.split("text", "\n\n"), T.strip), lambda p: p != "")
    empty = F.expr("cast(array() as array<string>)")
    texts = named.where("type <> 'table'").select("doc_ord", "doc_name", "pos", "heading", F.posexplode_outer(pieces).alias("sub", "piece")).where("piece is not null")
    texts = texts.select("doc_ord", "doc_name", F.struct("pos", "sub").alias("at"), F.lit("narrative").alias("type"), "heading", F.array("piece").alias("rows"))
    tables = named.where("type = 'table'").select("doc_ord", "doc_name", F.struct("pos", F.lit(0).alias("sub")).alias("at"), F.lit("table").alias("type"), "heading", F.transform("rows", T.flatten_row).alias("rows"))
    return _numbered(texts.unionByName(tables).withColumn("preamble", F.lit("")).withColumn("notes", empty), "at")


@dataclass(frozen=True)
class Strategy:
    name: str
    parents: Callable[[DataFrame], DataFrame]

    def build(self, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
        parents = self.parents(blocks)
        return parents, build_children(parents)


STRATEGIES = {f.__name__: Strategy(f.__name__, f) for f in (section_table, sliding_window, paragraph)}


def get_strategy(name: str) -> Strategy:
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}; known: {', '.join(STRATEGIES)}")
    return STRATEGIES[name]
