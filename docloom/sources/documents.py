"""Documents from JSON files, from a table, or from laid-out pages; and back to JSON."""

import argparse
import json
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.layout import table_html
from ..operators.ordering import running_offsets

SCHEMA = "doc_name string, model_id string, api_version string, content string"
WORDS = "doc_name string, page int, text string, x0 double, x1 double, top double, bottom double"
TABLES = "doc_name string, page int, x0 double, y0 double, x1 double, y1 double, rows array<array<string>>"
MODEL_ID, API_VERSION = "prebuilt-document", "2023-07-31"


def read_json(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_ord, doc_name, content): one object per *.json file of the folder, not of those below it, in path order. A missing
    name is the file's own, a missing content empty."""
    files = spark.read.schema(SCHEMA).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    named = files.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("_file"))
    order = running_offsets(named.select("_path").distinct().withColumn("_one", F.lit(1)), "_path", {"doc_ord": "_one"})
    out = named.join(order, "_path")
    return out.select("doc_ord", F.coalesce("doc_name", "_file").alias("doc_name"), F.coalesce("content", F.lit("")).alias("content"))


def from_table(rows: DataFrame, order: str, content: str, name: str | None = None) -> DataFrame:
    """(doc_ord, doc_name, content) from columns of a table; order has to be a distinct integer."""
    label = F.col(name).cast("string") if name else F.concat(F.lit("doc_"), F.col(order).cast("string"))
    return rows.select(F.col(order).cast("long").alias("doc_ord"), label.alias("doc_name"), F.coalesce(F.col(content), F.lit("")).alias("content"))


def write_json(docs: DataFrame, path: str) -> None:
    """One JSON object per line, with the fields that read_json() reads; json_folder writes a file for each document."""
    docs.select("doc_name", F.lit(MODEL_ID).alias("model_id"), F.lit(API_VERSION).alias("api_version"), "content").write.json(path)


#: Cells of a page's grid on each side at most, and how many cells a box may lie in on average.
MOST_CELLS, CELLS_OF_A_BOX = 256, 8


def outside_boxes(words: DataFrame, boxes: DataFrame) -> DataFrame:
    """The words (doc_name, page, x0, x1, top, bottom, ...) that lie in none of their page's boxes (doc_name, page, x0, y0, x1, y1).

    A page has a grid over the extent of its boxes, as fine as their number and size allow. A box stands in all cells that it
    touches, and a word in the one of its upper left corner, so it meets the boxes there only, and a full page is many keys.
    """
    at = ["doc_name", "page"]
    area = F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    grid = boxes.groupBy(*at).agg(F.min("x0").alias("gx"), F.min("y0").alias("gy"), (F.max("x1") - F.min("x0")).alias("gw"), (F.max("y1") - F.min("y0")).alias("gh"), F.count("*").alias("n"), area.alias("area"))
    fine = F.least(F.sqrt("n"), F.sqrt(CELLS_OF_A_BOX * F.col("n") * F.col("gw") * F.col("gh") / F.greatest("area", F.lit(1e-9))), F.lit(float(MOST_CELLS)))
    grid = grid.select(*at, "gx", "gy", "gw", "gh", F.greatest(F.floor(fine), F.lit(1)).alias("cells"))
    cell = lambda v, start, size: F.when(F.col(size) > 0, F.least(F.greatest(F.floor((F.col(v) - F.col(start)) / F.col(size) * F.col("cells")), F.lit(0)), F.col("cells") - 1)).otherwise(F.lit(0))
    across = lambda a, b, start, size: F.sequence(cell(a, start, size), cell(b, start, size))
    placed = boxes.join(grid, at).where("x0 <= x1 and y0 <= y1").withColumn("cx", F.explode(across("x0", "x1", "gx", "gw"))).withColumn("cy", F.explode(across("y0", "y1", "gy", "gh")))
    marked = words.join(grid, at, "left").withColumn("cx", cell("x0", "gx", "gw")).withColumn("cy", cell("top", "gy", "gh"))
    inside = (F.col("t.x0") <= F.col("w.x0")) & (F.col("w.x1") <= F.col("t.x1")) & (F.col("t.y0") <= F.col("w.top")) & (F.col("w.bottom") <= F.col("t.y1"))
    same = [F.col(f"w.{c}") == F.col(f"t.{c}") for c in (*at, "cx", "cy")]
    return marked.alias("w").join(placed.alias("t"), [*same, inside], "left_anti").select(*words.columns)


def page_content(words: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc_name, page, content): words outside all tables gathered to lines on a grid of 4 points, tables as HTML, both from
    top to bottom; at one height text comes first."""
    free = outside_boxes(words, tables)
    free = free.withColumn("y", (F.bround(F.col("top") / 4) * 4).cast("double"))
    in_line = F.array_sort(F.collect_list(F.struct("x0", "text")))
    lines = free.groupBy("doc_name", "page", "y").agg(F.trim(F.array_join(F.transform(in_line, lambda w: w["text"]), " ")).alias("part")).withColumn("kind", F.lit(0)).where("part <> ''")
    made = tables.select("doc_name", "page", F.col("y0").alias("y"), table_html(F.col("rows")).alias("part")).withColumn("kind", F.lit(1)).where("part <> ''")
    parts = F.array_sort(F.collect_list(F.struct("y", "kind", "part")))
    return lines.unionByName(made).groupBy("doc_name", "page").agg(F.array_join(F.transform(parts, lambda p: p["part"]), "\n").alias("content"))


def pages_to_documents(pages: DataFrame) -> DataFrame:
    """(doc_name, content): pages that aren't blank, joined by a blank line."""
    held = F.array_sort(F.collect_list(F.when(F.trim("content") != "", F.struct("page", "content"))))
    return pages.groupBy("doc_name").agg(F.array_join(F.transform(held, lambda p: p["content"]), "\n\n").alias("content"))


def _read_pdf(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import io

    import pdfplumber

    for frame in frames:
        out = []
        for path, content in zip(frame["path"], frame["content"], strict=True):
            name = path.rsplit("/", 1)[-1].rsplit(".", 1)[0] + ".json"
            with pdfplumber.open(io.BytesIO(content)) as pdf:
                for i, page in enumerate(pdf.pages):
                    words = [{k: w[k] for k in ("text", "x0", "x1", "top", "bottom")} for w in page.extract_words(keep_blank_chars=False, use_text_flow=True)]
                    tables = [dict(zip(("x0", "y0", "x1", "y1"), map(float, t.bbox), strict=True), rows=t.extract() or []) for t in page.find_tables()]
                    out.append((name, i, words, tables))
        yield pd.DataFrame(out, columns=["doc_name", "page", "words", "tables"])


def read_pdf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(words, tables) of PDF files, for page_content(). Needs pdfplumber where it runs."""
    word, table = "struct<text:string,x0:double,x1:double,top:double,bottom:double>", "struct<x0:double,y0:double,x1:double,y1:double,rows:array<array<string>>>"
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    pages = files.mapInPandas(_read_pdf, f"doc_name string, page int, words array<{word}>, tables array<{table}>")
    return pages.select("doc_name", "page", F.inline("words")), pages.select("doc_name", "page", F.inline("tables"))


def main(arguments: list[str] | None = None) -> None:
    """python -m docloom.sources.documents FILE.pdf [--out FILE.json] [--doc-name NAME]"""
    parser = argparse.ArgumentParser()
    parser.add_argument("pdf")
    parser.add_argument("--out")
    parser.add_argument("--doc-name")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    row = pages_to_documents(page_content(*read_pdf(spark, given.pdf))).first()
    out = {"doc_name": given.doc_name or (row.doc_name if row else Path(given.pdf).stem + ".json"), "model_id": MODEL_ID, "api_version": API_VERSION, "content": row.content if row else ""}
    Path(given.out or Path(given.pdf).with_suffix(".json")).write_text(json.dumps(out, indent=2, ensure_ascii=False), encoding="utf-8")


if __name__ == "__main__":
    main()
