"""Prompts, citations and questions as columns."""

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import parent_text


def _in_order(order: str, value: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"])


def context_blocks(parents: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """(qid, parent_rank, block): source line, preamble, rows and notes of each matched parent. With the matched children, a
    parent that has any shows the rows whose text is among theirs, repeats included; else all."""
    if matched is not None:
        own = matched.groupBy("qid", "parent_id").agg(F.collect_set("row_text").alias("own"))
        parents = parents.join(own, ["qid", "parent_id"], "left")
        rows = F.when(F.col("own").isNotNull(), F.filter("rows", lambda r: F.array_contains(F.col("own"), r))).otherwise(F.col("rows"))
        parents = parents.withColumn("rows", rows).drop("own")
    head = F.concat(F.lit("[Source: "), "doc_name", F.lit(" | Section: "), "heading", F.lit("]"))
    lines = F.concat(F.array_compact(F.array(head, F.when(F.col("preamble") != "", F.col("preamble")))), F.col("rows"), F.col("notes"))
    return parents.withColumn("block", F.array_join(lines, "\n"))


def rag_prompt(questions: DataFrame, parents: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """(qid, prompt): all blocks by rank, one under another, then the question; a question without parents stands alone."""
    blocks = context_blocks(parents, matched).groupBy("qid").agg(F.array_join(_in_order("parent_rank", F.col("block")), "\n").alias("blocks"))
    last = F.concat(F.lit("Question: "), F.col("question"))
    return questions.join(blocks, "qid", "left").select("qid", F.trim(F.concat_ws("\n", "blocks", last)).alias("prompt"))


def direct_prompt(question: Column, contexts: Column) -> Column:
    """All parents' texts with blank lines between, for a corpus that fits into one prompt."""
    return F.concat(F.lit("Context:\n"), F.array_join(contexts, "\n\n"), F.lit("\n\nQuestion: "), question)


def citation(parents: DataFrame) -> DataFrame:
    """(qid, citation): 'document / heading' of the matched parents, each once, by rank."""
    entry = F.concat_ws(" / ", "doc_name", "heading")
    entries = F.array_distinct(_in_order("parent_rank", entry))
    return parents.groupBy("qid").agg(F.concat(F.lit("Sources:\n"), F.array_join(F.transform(entries, lambda e: F.concat(F.lit("  - "), e)), "\n")).alias("citation"))


def contexts(parents: DataFrame) -> DataFrame:
    """(qid, context): the full text of the matched parents by rank, for grounding."""
    text = parent_text(F.col("heading"), F.col("preamble"), F.col("rows"), F.col("notes"))
    return parents.groupBy("qid").agg(F.array_join(_in_order("parent_rank", text), "\n").alias("context"))


def field_question(items: Column, scope_label: str, fields: list[str]) -> Column:
    """A question for a JSON object of items with these fields; items: array<string>. Its wording is fixed."""
    entry = "{" + ", ".join(f'"{f}": "..."' for f in fields) + "}"
    schema = F.array_join(F.transform(items, lambda i: F.concat(F.lit('"'), i, F.lit(f'": {entry}'))), ", ")
    return F.concat(
        F.lit(f"For each of the following {scope_label}(s): "),
        F.array_join(items, ", "),
        F.lit(f" — extract these fields: {', '.join(fields)}. Respond with a single valid JSON object following this exact schema:\n{{"),
        schema,
        F.lit(f'}}\nMissing field value: "N/A". {scope_label.title()} not in the context: set its field values to "not found".'),
    )


def render_custom(template: str, **values) -> str:
    """A template of one's own: with jinja2 if that is installed, else $name places; a missing value is an error."""
    try:
        import jinja2
    except ImportError:
        return string.Template(template).substitute(values)
    return jinja2.Environment(undefined=jinja2.StrictUndefined, trim_blocks=True, lstrip_blocks=True).from_string(template).render(**values)
