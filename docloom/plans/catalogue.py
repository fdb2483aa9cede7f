"""Every operator as a query over the given tables, with the same rows in DuckDB SQL.

Sections, tables and codes need documents that have them, so SYN builds some from suppliers: a document per region and desk,
a heading per nation, a table of its suppliers, a text before and behind it. The relational rows are then the oracle.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import layout as L
from ..functions import replies
from ..functions import text as T
from ..functions import vectors as V
from ..functions.html import html_rows
from ..operators import bm25, chunking, conflicts, retrieval
from ..operators.blocks import parse_blocks, parse_pieces
from ..sources.documents import from_table, page_content
from ..sources.kept import kept
from ..sources.workers import find_package, spread
from . import engine, prompts
from .domains import FIELDS, domain_fields
from .providers import EchoChat, HashedEmbedder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
K = 5


def _query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = find_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


# --- the documents made of suppliers

_SUPPLIERS = """
SELECT r_name, n_name, n_nationkey, n_regionkey, s_suppkey, s_name, desk, n_regionkey * 2 + desk AS doc_ord, concat(r_name, '_desk', desk, '.json') AS doc_name,
  CASE WHEN desk = 1 AND s_suppkey % 3 <> 0 THEN concat('DESK', chr(65 + n_nationkey), 'Y', lpad(CAST(s_suppkey * 7 % 100 AS VARCHAR(9)), 2, '0'))
    ELSE concat('SUPP', chr(65 + n_nationkey), 'X', lpad(CAST(s_suppkey % 100 AS VARCHAR(9)), 2, '0')) END AS code,
  CAST(CAST(s_acctbal AS DECIMAL(12, 2)) AS VARCHAR(20)) AS balance
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey CROSS JOIN (VALUES (0), (1)) AS v(desk)
"""
_ROW_SQL = "'Supplier: ' || s_name || chr(10) || 'Code: ' || code || chr(10) || 'Balance: ' || balance"


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (_t(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    desks = spark.range(2).select(F.col("id").cast("int").alias("desk"))
    rows = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).join(F.broadcast(desks), F.lit(True))
    made = lambda word, letter, number: F.concat(F.lit(word), F.char(65 + F.col("n_nationkey")), F.lit(letter), F.lpad((number % 100).cast("string"), 2, "0"))
    code = F.when((F.col("desk") == 1) & (F.col("s_suppkey") % 3 != 0), made("DESK", "Y", F.col("s_suppkey") * 7)).otherwise(made("SUPP", "X", F.col("s_suppkey")))
    return rows.select(
        "r_name", "n_name", "n_nationkey", "s_suppkey", "s_name", "desk", (F.col("n_regionkey") * 2 + F.col("desk")).cast("long").alias("doc_ord"),
        F.concat("r_name", F.lit("_desk"), "desk", F.lit(".json")).alias("doc_name"), code.alias("code"), F.col("s_acctbal").cast("decimal(12,2)").cast("string").alias("balance"),
    )


def _joined(order: str, value: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"]), "")


_HEAD = "<tr><th>Supplier</th><th>Code</th><th>Balance</th></tr>"


def _syn(spark: SparkSession, sf_dir: str, cut: bool = False) -> DataFrame:
    """cut: each table ends and starts anew before its second row, as at a page's end."""
    rows = _suppliers(spark, sf_dir)
    line = F.concat(F.lit("<tr><td>"), "s_name", F.lit("</td><td>"), "code", F.lit("</td><td>"), "balance", F.lit("</td></tr>"))
    if cut:
        first = F.row_number().over(Window.partitionBy("doc_ord", "n_nationkey").orderBy("s_suppkey"))
        line = F.concat(F.when(F.col("nth") == 2, F.lit(f"</table>\n<table>{_HEAD}")).otherwise(F.lit("")), line)
        rows = rows.withColumn("nth", first)
    nations = rows.groupBy("doc_ord", "doc_name", "r_name", "n_nationkey", "n_name").agg(_joined("s_suppkey", line).alias("lines"))
    part = F.concat(F.lit("# "), "n_name", F.lit("\nRows of "), "n_name", F.lit(f"\n<table>{_HEAD}"), "lines", F.lit("</table>\nNote of "), "n_name", F.lit("\n"))
    docs = nations.groupBy("doc_ord", "doc_name", "r_name").agg(_joined("n_nationkey", part).alias("parts"))
    return docs.select("doc_ord", "doc_name", F.concat(F.lit("Intro of "), "r_name", F.lit("\n\n"), "parts").alias("content"))


def _parents(spark: SparkSession, sf_dir: str, cut: bool = False) -> DataFrame:
    return chunking.build_parents(parse_blocks(_syn(spark, sf_dir, cut)))


# --- parsing

_NATIONS_SQL = f"s AS ({_SUPPLIERS}), n AS (SELECT doc_ord, doc_name, r_name, n_nationkey, n_name, count(*) AS n_rows, string_agg({_ROW_SQL}, chr(10) ORDER BY s_suppkey) AS rows_text FROM s GROUP BY ALL)"


_BLOCKS_SQL = f"""WITH {_NATIONS_SQL}, b AS (
SELECT doc_ord, doc_name, -1 AS a, 0 AS b, 'text' AS type, 'Intro of ' || r_name AS text, 0 AS n_rows FROM n GROUP BY ALL
UNION ALL SELECT doc_ord, doc_name, n_nationkey, 1, 'heading', n_name, 0 FROM n
UNION ALL SELECT doc_ord, doc_name, n_nationkey, 2, 'text', 'Rows of ' || n_name, 0 FROM n
UNION ALL SELECT doc_ord, doc_name, n_nationkey, 3, 'table', '', n_rows FROM n
UNION ALL SELECT doc_ord, doc_name, n_nationkey, 4, 'text', 'Note of ' || n_name, 0 FROM n)
SELECT doc_name, CAST(row_number() OVER (PARTITION BY doc_ord ORDER BY a, b) AS INTEGER) AS block_no, type, text, CAST(n_rows AS INTEGER) AS n_rows FROM b"""


@_query(_BLOCKS_SQL)
def parse_blocks_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks_in_order(parse_blocks(_syn(spark, sf_dir)))


@_query(_BLOCKS_SQL)
def parse_blocks_in_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of a table stands on a line of its own, and each line is a piece."""
    docs = _syn(spark, sf_dir)
    lines = F.regexp_extract_all(F.replace("content", F.lit("<tr>"), F.lit("\n<tr>")), F.lit("[^\n]*\n|[^\n]+$"), F.lit(0))
    return _blocks_in_order(parse_pieces(docs.select("doc_ord", "doc_name", F.posexplode(lines).alias("part", "content"))))


def _blocks_in_order(blocks: DataFrame) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("doc_ord").orderBy("pos"))
    return blocks.select("doc_name", number.alias("block_no"), "type", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.size("rows"), F.lit(0)).alias("n_rows"))


@_query(
    f"""WITH s AS ({_SUPPLIERS}), c AS (SELECT doc_name, n_name AS heading, CAST(row_number() OVER (PARTITION BY doc_ord, n_nationkey ORDER BY s_suppkey) - 1 AS INTEGER) AS row_no, s_name, code, balance FROM s)
SELECT doc_name, heading, row_no, 0 AS cell_no, 'Supplier' AS k, s_name AS v FROM c UNION ALL SELECT doc_name, heading, row_no, 1, 'Code', code FROM c UNION ALL SELECT doc_name, heading, row_no, 2, 'Balance', balance FROM c"""
)
def html_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = chunking.sections(parse_blocks(_syn(spark, sf_dir))).where("type = 'table'")
    rows = named.select("doc_name", "heading", F.posexplode("rows").alias("row_no", "cells"))
    return rows.select("doc_name", "heading", "row_no", F.posexplode("cells").alias("cell_no", "c")).select("doc_name", "heading", "row_no", "cell_no", "c.k", "c.v")


def _cells(made: DataFrame, keys: list[str]) -> DataFrame:
    rows = made.select(*keys, F.posexplode(html_rows(F.col("html"))).alias("row_no", "cells"))
    return rows.select(*keys, "row_no", F.posexplode("cells").alias("cell_no", "c")).select(*keys, "row_no", "cell_no", "c.k", "c.v")


@_query(
    """WITH c AS (SELECT s_nationkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INTEGER) AS row_no, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT s_nationkey, row_no, 0 AS cell_no, 'Nation' AS k, n_name AS v FROM c UNION ALL SELECT s_nationkey, row_no, 1, 'Supplier', s_name FROM c"""
)
def html_table_rowspan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _t(spark, sf_dir, "supplier").join(F.broadcast(_t(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    nth = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    n = F.count("*").over(Window.partitionBy("s_nationkey"))
    first = F.when(F.col("nth") == 1, F.concat(F.lit('<td rowspan="'), F.col("n").cast("string"), F.lit('">'), "n_name", F.lit("</td>"))).otherwise(F.lit(""))
    rows = s.withColumn("nth", nth).withColumn("n", n).withColumn("row", F.concat(F.lit("<tr>"), first, F.lit("<td>"), "s_name", F.lit("</td></tr>")))
    made = rows.groupBy("s_nationkey").agg(F.concat(F.lit("<table><tr><th>Nation</th><th>Supplier</th></tr>"), _joined("s_suppkey", F.col("row")), F.lit("</table>")).alias("html"))
    return _cells(made, ["s_nationkey"])


@_query(
    """SELECT s_suppkey, 0 AS row_no, i AS cell_no, 'Col' || i AS k, CASE WHEN i < 2 THEN s_name ELSE 'N' || s_nationkey END AS v FROM supplier CROSS JOIN (VALUES (0), (1), (2)) AS t(i)"""
)
def html_table_colspan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _t(spark, sf_dir, "supplier")
    html = F.concat(F.lit('<table><tr><td colspan="2">'), "s_name", F.lit("</td><td></td><td>N"), F.col("s_nationkey").cast("string"), F.lit("</td></tr></table>"))
    html = F.replace(html, F.lit("<td></td>"), F.lit(""))
    return _cells(s.select("s_suppkey", html.alias("html")), ["s_suppkey"])


@_query(
    """SELECT n_nationkey, CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY x) - 1 AS INTEGER) AS row_no, 0 AS cell_no, 'Col0' AS k, CASE x WHEN 0 THEN 'Nation' ELSE n_name || ' ' || chr(10) || ' of ' || r_name END AS v
FROM nation JOIN region ON n_regionkey = r_regionkey CROSS JOIN (VALUES (0), (1)) AS t(x)"""
)
def html_table_headerless(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _t(spark, sf_dir, "nation").join(F.broadcast(_t(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    html = F.concat(F.lit("<table><tr><td>Nation</td></tr><tr><td>"), "n_name", F.lit("<br>of "), "r_name", F.lit("</td></tr></table>"))
    return _cells(n.select("n_nationkey", html.alias("html")), ["n_nationkey"])


@_query("SELECT c_custkey, 'Name: ' || c_name || CASE WHEN c_acctbal >= 0 THEN chr(10) || 'Segment: ' || c_mktsegment ELSE '' END AS row_text FROM customer")
def flatten_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    segment = F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).otherwise(F.lit("  "))
    return _t(spark, sf_dir, "customer").select("c_custkey", T.flatten_row(F.array(cell("Name", F.col("c_name")), cell("Empty", F.lit("")), cell("Segment", segment))).alias("row_text"))


@_query(f"WITH {_NATIONS_SQL} SELECT doc_name, '' AS heading, 1::BIGINT AS n_blocks, 0::BIGINT AS n_tables FROM n GROUP BY doc_name UNION ALL SELECT doc_name, n_name, 3, 1 FROM n")
def section_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = chunking.sections(parse_blocks(_syn(spark, sf_dir)))
    return named.groupBy("doc_name", "section", "heading").agg(F.count("*").alias("n_blocks"), F.count(F.when(F.col("type") == "table", 1)).alias("n_tables")).drop("section")


_PARENTS_SQL = f"""{_NATIONS_SQL}, p AS (
SELECT doc_ord, doc_name, -1 AS o, 'narrative' AS type, '' AS heading, '' AS preamble, 'Intro of ' || r_name AS rows_text, 1 AS n_rows, '' AS notes FROM n GROUP BY ALL
UNION ALL SELECT doc_ord, doc_name, n_nationkey, 'table', n_name, 'Intro of ' || r_name || chr(10) || 'Rows of ' || n_name, rows_text, n_rows, 'Note of ' || n_name FROM n),
pp AS (SELECT *, CAST(row_number() OVER (ORDER BY doc_ord, o) - 1 AS BIGINT) AS parent_id FROM p)"""
_PARENT_COLUMNS = "doc_name, parent_id, type, heading, preamble, rows_text, CAST(n_rows AS INTEGER) AS n_rows, notes"


def _shown(parents: DataFrame) -> DataFrame:
    return parents.select("doc_name", "parent_id", "type", "heading", "preamble", F.array_join("rows", "\n").alias("rows_text"), F.size("rows").alias("n_rows"), F.array_join("notes", "\n").alias("notes"))


@_query(f"WITH {_PARENTS_SQL} SELECT {_PARENT_COLUMNS} FROM pp")
def build_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_parents(spark, sf_dir))


@_query(f"WITH {_PARENTS_SQL} SELECT {_PARENT_COLUMNS} FROM pp")
def merge_split_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_parents(spark, sf_dir, cut=True))


_CHILDREN_SQL = f"""{_PARENTS_SQL}, cc AS (
SELECT parent_id, 0 AS i, doc_name, heading, rows_text AS row_text FROM pp WHERE type = 'narrative'
UNION ALL SELECT pp.parent_id, s.s_suppkey, pp.doc_name, heading, {_ROW_SQL} FROM pp JOIN s ON s.doc_ord = pp.doc_ord AND s.n_nationkey = pp.o),
ch AS (SELECT CAST(row_number() OVER (ORDER BY parent_id, i) - 1 AS BIGINT) AS child_idx, parent_id, doc_name, row_text,
  '[' || replace(replace(doc_name, '.json', ''), '_', ' ') || CASE WHEN heading <> '' THEN ' | ' || heading ELSE '' END || '] ' || row_text AS embed_text FROM cc)"""


@_query(f"WITH {_CHILDREN_SQL} SELECT * FROM ch")
def build_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.build_children(_parents(spark, sf_dir)).drop("doc_ord")


@_query(f"WITH {_PARENTS_SQL} SELECT parent_id, CASE WHEN heading <> '' THEN '[Section: ' || heading || ']' || chr(10) ELSE '' END || CASE WHEN preamble <> '' THEN preamble || chr(10) ELSE '' END || rows_text || CASE WHEN notes <> '' THEN chr(10) || notes ELSE '' END AS full_text FROM pp")
def parent_full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parents(spark, sf_dir).select("parent_id", T.parent_text(F.col("heading"), F.col("preamble"), F.col("rows"), F.col("notes")).alias("full_text"))


_WORDS_SQL = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\x0b\x1c-\x1f]+'), lambda x: x <> '')"
_WINDOWS_SQL = f"""w AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
win AS (SELECT doc_id, start, array_to_string(list_slice(w, start + 1, start + 150), ' ') AS row_text FROM w, unnest(generate_series(0, len(w) - 1, 120)) AS g(start) WHERE len(w) > 0),
ch AS (SELECT CAST(row_number() OVER (ORDER BY doc_id, start) - 1 AS BIGINT) AS child_idx, doc_id, 'doc_' || doc_id AS doc_name, row_text, '[doc ' || doc_id || '] ' || row_text AS embed_text FROM win)"""


def _window_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.windows_of(from_table(_t(spark, sf_dir, "documents"), "doc_id", "text"))


@_query(f"WITH {_WINDOWS_SQL} SELECT child_idx, doc_id, row_text, embed_text FROM ch")
def sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.build_children(_window_parents(spark, sf_dir)).select("child_idx", F.col("doc_ord").alias("doc_id"), "row_text", "embed_text")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, each line a paragraph."""
    return from_table(_t(spark, sf_dir, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n"))), "doc_id", "text")


@_query(r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents), p AS (SELECT doc_id, i, trim(x) AS row_text FROM l WHERE trim(x) <> '')
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS BIGINT) AS paragraph, row_text FROM p""")
def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = chunking.paragraph(parse_blocks(_lines(spark, sf_dir)))
    own = F.row_number().over(Window.partitionBy("doc_ord").orderBy("parent_id")) - 1
    return parents.select(F.col("doc_ord").alias("doc_id"), own.cast("long").alias("paragraph"), F.col("rows")[0].alias("row_text"))


# --- codes

# DuckDB's \b knows ASCII only: other letters and digits count as x.
_FOLDED = r"regexp_replace(text, '[^\x00-\x7F\p{Z}\p{P}\p{S}]', 'x', 'g')"
_BIC_SQL = r"\b([A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?)\b"
_IBAN_SQL = r"\b([A-Z]{2}\d{2}[A-Z0-9]{10,30})\b"


@_query(f"SELECT doc_id, array_to_string(regexp_extract_all({_FOLDED}, '{_BIC_SQL}', 1), ',') AS codes FROM documents")
def extract_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.array_join(T.codes(F.col("text")), ",").alias("codes"))


@_query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) END AS scope FROM customer")
def extract_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.concat(F.lit("Name"), F.when(F.col("c_custkey") % 2 == 0, F.lit(": ")).otherwise(F.lit(" ")), "c_name", F.lit("\nSegment: "), "c_mktsegment")
    return _t(spark, sf_dir, "customer").select("c_custkey", T.scope(row).alias("scope"))


_CODES_SQL = f"s AS ({_SUPPLIERS}), m AS (SELECT upper(s_name) AS scope, doc_name, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM s GROUP BY ALL), k AS (SELECT scope FROM m GROUP BY scope HAVING count(*) >= 2 AND count(DISTINCT codes) > 1)"


@_query(f"WITH {_CODES_SQL} SELECT scope, doc_name, codes FROM m")
def scope_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts.scope_codes(_parents(spark, sf_dir)).select("scope", "doc_name", F.array_join("codes", ",").alias("codes"))


@_query(f"WITH {_CODES_SQL} SELECT scope, doc_name, codes FROM m JOIN k USING (scope)")
def conflict_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts.conflict_map(_parents(spark, sf_dir)).select("scope", "doc_name", F.array_join("codes", ",").alias("codes"))


@_query(
    f"""WITH {_CODES_SQL}, c AS (SELECT scope, string_agg(doc_name || ': ' || replace(codes, ',', ', '), '; ' ORDER BY doc_name) AS summary FROM m JOIN k USING (scope) GROUP BY scope)
SELECT s_suppkey AS qid, scope, 'Conflicting SSI found for ''' || scope || ''' across documents: ' || summary || '. Verify with the responsible desk before settling.' AS message
FROM supplier JOIN c ON contains(upper('What is the code of ' || s_name || '?'), scope)"""
)
def detect_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("qid"), F.concat(F.lit("What is the code of "), "s_name", F.lit("?")).alias("question"))
    return conflicts.detect_conflicts(questions, conflicts.conflict_map(_parents(spark, sf_dir)))


@_query(
    rf"""WITH s AS ({_SUPPLIERS}), a AS (SELECT s_suppkey, desk, code, 'GB12' || lpad(CAST(s_suppkey AS VARCHAR), 12, '0') AS iban, CASE WHEN s_suppkey % 2 = 0 THEN code ELSE 'none' END AS held FROM s)
SELECT s_suppkey, desk, CASE WHEN s_suppkey % 2 <> 0 THEN iban WHEN code < iban THEN code || ',' || iban ELSE iban || ',' || code END AS grounded, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE code END AS ungrounded, s_suppkey % 2 = 0 AS passed FROM a"""
)
def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    iban = F.concat(F.lit("GB12"), F.lpad(F.col("s_suppkey").cast("string"), 12, "0"))
    rows = _suppliers(spark, sf_dir).select("s_suppkey", "desk", F.lower(F.concat(F.lit("Pay "), "code", F.lit(" at "), iban)).alias("answer"), F.concat(F.lit("See "), iban, F.lit(" and "), F.when(F.col("s_suppkey") % 2 == 0, F.col("code")).otherwise(F.lit("none"))).alias("context"))
    return conflicts.check_grounding(rows).select("s_suppkey", "desk", F.array_join("grounded", ",").alias("grounded"), F.array_join("ungrounded", ",").alias("ungrounded"), "passed")


# --- retrieval


@_query(
    """WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings)
SELECT vec_id, CAST(unnest(generate_series(0, len(e) - 1)) AS INTEGER) AS place, round(unnest(list_transform(e, lambda x: x / l)), 6) AS value FROM n"""
)
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _t(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(V.normalise(F.col("embedding"))).alias("place", "value"))
    return v.withColumn("value", F.round("value", 6))


_DENSE_SQL = f"""e AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings),
d AS (SELECT q.vec_id AS qid, e.vec_id AS id, round(list_dot_product(q.e, e.e) / q.l / e.l, 6) AS score FROM e q, e WHERE q.vec_id % 50 = 0),
dk AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM d)"""


def _dense(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return retrieval.dense_top_k(e.where("id % 50 = 0").withColumnRenamed("id", "qid"), e, k)


@_query(f"WITH {_DENSE_SQL} SELECT qid, id, score, rank FROM dk WHERE rank <= {K}")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, K)


def _bm25_sql(units: str, id_: str, text: str, questions: str = "SELECT item_id AS qid, text AS question FROM benchmark") -> str:
    tokens = lambda c: rf"unnest(list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[\s\x0b\x1c-\x1f]+'), lambda x: x <> ''))"
    return f"""u AS (SELECT {id_} AS id, {text} AS t FROM {units}), tok AS (SELECT id, {tokens("t")} AS term FROM u),
tf AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY ALL), dl AS (SELECT id, count(*) AS dl FROM tok GROUP BY id),
tot AS (SELECT (SELECT count(*) FROM u)::DOUBLE AS n, (SELECT count(*) FROM tok)::DOUBLE / (SELECT count(*) FROM u) AS avgdl),
raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, tot GROUP BY term),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
q AS ({questions}), qt AS (SELECT qid, term, count(*) AS qn FROM (SELECT qid, {tokens("question")} AS term FROM q) GROUP BY ALL),
sc AS (SELECT qid, tf.id, round(sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN idf ON qt.term = idf.term JOIN tf ON qt.term = tf.term JOIN dl ON tf.id = dl.id, tot GROUP BY qid, tf.id),
al AS (SELECT qid, u.id, coalesce(score, 0.0) AS score FROM q CROSS JOIN u LEFT JOIN sc USING (qid, id)),
sk AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM al)"""


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("child_idx"), F.coalesce("text", F.lit("")).alias("embed_text"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


@_query(f"WITH {_bm25_sql('documents', 'doc_id', 'text')} SELECT qid, id, score FROM sc")
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.scores(bm25.index(_units(spark, sf_dir)), _items(spark, sf_dir)).withColumn("score", F.round("score", 6))


@_query(f"WITH {_bm25_sql('documents', 'doc_id', 'text')} SELECT qid, id, score, rank FROM sk WHERE rank <= {K}")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.sparse_scores(_items(spark, sf_dir), _units(spark, sf_dir), K)


@_query(f"WITH {_bm25_sql('documents', 'doc_id', 'text')} SELECT qid, id, CASE WHEN max(score) OVER (PARTITION BY qid) > 0 THEN round(score / max(score) OVER (PARTITION BY qid), 6) ELSE 0.0 END AS score, rank FROM sk WHERE rank <= {K}")
def bm25_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.normalised_sparse(retrieval.sparse_scores(_items(spark, sf_dir), _units(spark, sf_dir), K))


_HYBRID_SQL = f"""{_DENSE_SQL}, {_bm25_sql("documents", "doc_id", "text", "SELECT doc_id AS qid, text AS question FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0)")},
f AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.id, b.id) AS id, a.rank AS d, b.rank AS s FROM (SELECT * FROM dk WHERE rank <= {2 * K}) a FULL JOIN (SELECT * FROM sk WHERE rank <= {2 * K}) b ON a.qid = b.qid AND a.id = b.id),
fk AS (SELECT qid, id, coalesce(1.0::DOUBLE / (60 + d), 0) + coalesce(1.0::DOUBLE / (60 + s), 0) AS raw, d, s FROM f)"""


@_query(f"WITH {_HYBRID_SQL} SELECT qid, id, round(raw, 9) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY raw DESC, d NULLS LAST, s NULLS LAST) AS INTEGER) AS rank FROM fk QUALIFY rank <= {K}")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = _dense(spark, sf_dir, 2 * K)
    vectors = _t(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("doc_id"))
    asked = _t(spark, sf_dir, "documents").join(vectors, "doc_id").select(F.col("doc_id").alias("qid"), F.col("text").alias("question"))
    sparse = retrieval.sparse_scores(asked, _units(spark, sf_dir), 2 * K)
    return retrieval.fuse(dense, sparse, K).withColumn("score", F.round("score", 9))


_HITS_SQL = f"{_WINDOWS_SQL}, {_bm25_sql('ch', 'child_idx', 'embed_text')}, hit AS (SELECT sk.qid, sk.id, sk.score, sk.rank, doc_name, row_text FROM sk JOIN ch ON sk.id = ch.child_idx WHERE rank <= {K})"


def _hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(hits with their children, parents): windows of documents against benchmark items by BM25."""
    parents = kept(_window_parents(spark, sf_dir))
    return _matched(spark, sf_dir, parents), parents


def _matched(spark: SparkSession, sf_dir: str, parents: DataFrame) -> DataFrame:
    children = chunking.build_children(parents)
    return kept(retrieval.matched_children(retrieval.sparse_scores(_items(spark, sf_dir), children, K), children))


@_query(f"WITH {_HITS_SQL} SELECT qid, id, rank, id AS parent_id, doc_name, row_text FROM hit")
def child_parent_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched, parents = _hits(spark, sf_dir)
    return matched.join(parents.select("parent_id"), "parent_id").select("qid", "id", "rank", "parent_id", "doc_name", "row_text")


@_query(
    f"""WITH {_bm25_sql("documents", "doc_id", "text")}, h AS (SELECT qid, rank, source AS parent_id FROM sk JOIN documents ON id = doc_id WHERE rank <= {4 * K}), m AS (SELECT qid, parent_id, min(rank) AS first_rank FROM h GROUP BY ALL)
SELECT qid, parent_id, first_rank, CAST(row_number() OVER (PARTITION BY qid ORDER BY first_rank) AS INTEGER) AS parent_rank FROM m"""
)
def parent_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("parent_id"))
    hits = retrieval.sparse_scores(_items(spark, sf_dir), _units(spark, sf_dir), 4 * K).join(docs, "id")
    return retrieval.matched_parents(hits, docs.select("parent_id").distinct()).select("qid", "parent_id", "first_rank", "parent_rank")


@_query(
    f"""WITH {_DENSE_SQL}, b AS (SELECT qid, score AS best FROM dk WHERE rank = 2)
SELECT qid, best AS best_score, best < 0.45 AS blocked, CASE WHEN best < 0.45 THEN 'No sufficiently relevant settlement instructions found (best retrieval score ' || CAST(round(CAST(best AS DECIMAL(18, 6)), 3) AS DECIMAL(18, 3)) || ' < threshold 0.450). The queried instrument or currency may not be in the SSI corpus.' END AS reason FROM b"""
)
def confidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _dense(spark, sf_dir, 2).where("rank = 2").select("qid", F.col("score").alias("best_score"))
    return retrieval.gate(best, 0.45).select("qid", "best_score", "blocked", "reason")


_BROAD_SQL = "regexp_matches(lower(coalesce(text, '')), 'all|every|full|complete|entire|download')"


@_query(f"SELECT conv_id, turn, {_BROAD_SQL} AS broad FROM conversations")
def broad_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_broad(F.coalesce("text", F.lit(""))).alias("broad"))


@_query(
    f"""WITH n AS (SELECT count(*) AS n FROM documents) SELECT conv_id, turn, CASE WHEN {_BROAD_SQL} THEN n ELSE 10 END AS k, least(5 * CASE WHEN {_BROAD_SQL} THEN n ELSE 10 END, n) AS fetch_k,
CAST(CASE WHEN {_BROAD_SQL} THEN 4096 ELSE 2048 END AS BIGINT) AS max_tokens FROM conversations, n"""
)
def query_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _t(spark, sf_dir, "documents").count()
    asked = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("question"))
    return retrieval.policy(asked, n, rerank=True).select("conv_id", "turn", "k", "fetch_k", "max_tokens")


@_query(
    f"""WITH {_bm25_sql("documents", "doc_id", "text")}, h AS (SELECT sk.*, d.text AS dt, question FROM sk JOIN documents d ON id = doc_id JOIN q USING (qid) WHERE rank <= {4 * K}),
o AS (SELECT qid, id, rank, list_distinct(list_filter(regexp_split_to_array(lower(question), '\\s+'), lambda x: x <> '')) AS a, list_filter(regexp_split_to_array(lower(dt), '\\s+'), lambda x: x <> '') AS b FROM h),
r AS (SELECT qid, id, round(len(list_intersect(a, b))::DOUBLE / len(a), 4) AS rerank_score FROM o)
SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, id) AS INTEGER) AS rank FROM r QUALIFY rank <= {K}"""
)
def rerank_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    units, items = _units(spark, sf_dir), _items(spark, sf_dir)
    hits = retrieval.sparse_scores(items, units, 4 * K).join(units.withColumnRenamed("child_idx", "id"), "id").join(items, "qid")
    return retrieval.rerank(hits, retrieval.overlap_score(F.col("question"), F.col("embed_text")), K).select("qid", "id", "rerank_score", "rank")


_PARAGRAPHS_SQL = r"""l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
ch AS (SELECT CAST(row_number() OVER (ORDER BY doc_id, i) - 1 AS BIGINT) AS child_idx, 'doc_' || doc_id AS doc_name, trim(x) AS row_text, '[doc ' || doc_id || '] ' || trim(x) AS embed_text FROM l WHERE trim(x) <> '')"""


def _evaluated_sql(strategy: str, chunks: str) -> str:
    return f"""SELECT * FROM (WITH {chunks}, {_bm25_sql("ch", "child_idx", "embed_text")}, hit AS (SELECT sk.qid, sk.id, sk.score, doc_name FROM sk JOIN ch ON sk.id = ch.child_idx WHERE rank <= {K}),
e AS (SELECT qid, max(score) AS best_score, count(DISTINCT id) AS n_parents, count(*) AS n_children, count(DISTINCT doc_name) AS n_docs FROM hit GROUP BY qid)
SELECT '{strategy}' AS strategy, qid, substr(text, 1, 60) AS question, best_score, n_parents, n_children, n_docs FROM benchmark JOIN e ON item_id = qid)"""


@_query(f"{_evaluated_sql('sliding_window', _WINDOWS_SQL)} UNION ALL {_evaluated_sql('paragraph', _PARAGRAPHS_SQL)}")
def evaluate_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same questions over windows and over paragraphs."""
    windows = _hits(spark, sf_dir)[0]
    paragraphs = _matched(spark, sf_dir, kept(chunking.paragraph(parse_blocks(_lines(spark, sf_dir)))))
    one, two = (engine.evaluation(_items(spark, sf_dir), matched).withColumn("strategy", F.lit(name)) for name, matched in (("sliding_window", windows), ("paragraph", paragraphs)))
    return one.unionByName(two)


@_query(
    f"""WITH {_bm25_sql("documents", "doc_id", "text")}, h AS (SELECT sk.*, d.text AS dt, d.source, question FROM sk JOIN documents d ON id = doc_id JOIN q USING (qid) WHERE rank <= {4 * K}),
o AS (SELECT qid, id, source, list_distinct(list_filter(regexp_split_to_array(lower(question), '\\s+'), lambda x: x <> '')) AS a, list_filter(regexp_split_to_array(lower(dt), '\\s+'), lambda x: x <> '') AS b FROM h),
r AS (SELECT qid, id, source, row_number() OVER (PARTITION BY qid ORDER BY round(len(list_intersect(a, b))::DOUBLE / len(a), 4) DESC, id) AS rank FROM o),
m AS (SELECT qid, source AS parent_id, CAST(min(rank) AS INTEGER) AS first_rank FROM r WHERE rank <= {K} GROUP BY ALL)
SELECT qid, parent_id, first_rank, CAST(row_number() OVER (PARTITION BY qid ORDER BY first_rank) AS INTEGER) AS parent_rank FROM m"""
)
def reranked_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More hits than asked for are fetched and reranked, and the parents rebuilt from those that stay."""
    units, items = _units(spark, sf_dir), _items(spark, sf_dir)
    hits = retrieval.matched_children(retrieval.sparse_scores(items, units, 4 * K), units).join(items, "qid")
    best = retrieval.rerank(hits, retrieval.overlap_score(F.col("question"), F.col("embed_text")), K)
    sources = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("parent_id"))
    found = kept(best.select("qid", "id", "rank")).join(sources, "id")
    return retrieval.matched_parents(found, sources.select("parent_id").distinct()).select("qid", "parent_id", "first_rank", "parent_rank")


_SUMMED_SQL = "SELECT a.vec_id, list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda x: x[1] + x[2]) AS e FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 50 = 0 AND a.vec_id IN (SELECT doc_id FROM documents)"


@_query(
    f"""WITH qv AS ({_SUMMED_SQL}), e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)),
d AS (SELECT qv.vec_id AS qid, e.vec_id AS id, round(list_dot_product(qv.e, e.e) / sqrt(list_dot_product(qv.e, qv.e)) / sqrt(list_dot_product(e.e, e.e)), 6) AS score FROM qv, e),
dk AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM d QUALIFY rank <= {2 * K}),
{_bm25_sql("documents", "doc_id", "text", f"SELECT doc_id AS qid, coalesce(text, '') AS question FROM documents WHERE doc_id IN (SELECT vec_id FROM ({_SUMMED_SQL}))")},
f AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.id, b.id) AS id, a.rank AS d, b.rank AS s FROM dk a FULL JOIN (SELECT * FROM sk WHERE rank <= {2 * K}) b ON a.qid = b.qid AND a.id = b.id),
fk AS (SELECT qid, id, coalesce(1.0::DOUBLE / (60 + d), 0) + coalesce(1.0::DOUBLE / (60 + s), 0) AS raw, d, s FROM f),
best AS (SELECT qid, max(score) AS best_score FROM dk GROUP BY qid)
SELECT qid, id, round(raw, 9) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY raw DESC, d NULLS LAST, s NULLS LAST) AS INTEGER) AS rank, best_score, best_score < 0.75 AS blocked FROM fk JOIN best USING (qid) QUALIFY rank <= {K}"""
)
def hybrid_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused hits with the score that the gate looks at, the best cosine. A question's vector is the sum of two documents'."""
    vectors = _t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    units = _units(spark, sf_dir).join(vectors.toDF("child_idx", "vector"), "child_idx", "left")
    both = vectors.where("vec_id % 50 = 0").join(vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id")
    asked = both.select(F.col("vec_id").alias("child_idx"), F.zip_with("embedding", "next", lambda a, b: a.cast("double") + b.cast("double")).alias("vector"))
    asked = asked.join(_units(spark, sf_dir), "child_idx").select(F.col("child_idx").alias("qid"), F.col("embed_text").alias("question"), "vector")
    # Texts are indexed where they lie, not behind the join with their vectors.
    hits = retrieval.retrieve(kept(asked), units, "hybrid", K, bm25.index(_units(spark, sf_dir)))
    return retrieval.gate(hits, 0.75).select("qid", "id", F.round("score", 9).alias("score"), "rank", "best_score", "blocked")


# --- prompts


def _ranked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(questions, hits with their children, their parents by rank)"""
    matched, parents = _hits(spark, sf_dir)
    return _items(spark, sf_dir), matched, retrieval.matched_parents(matched.select("qid", "rank", "parent_id"), parents)


@_query(
    f"""WITH {_HITS_SQL} SELECT hit.qid, string_agg('[Source: ' || doc_name || ' | Section: ]' || chr(10) || row_text, chr(10) ORDER BY rank) || chr(10) || 'Question: ' || any_value(question) AS prompt FROM hit JOIN q USING (qid) GROUP BY hit.qid"""
)
def rag_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions, matched, parents = _ranked(spark, sf_dir)
    return prompts.rag_prompt(questions, parents, matched)


@_query(
    f"""WITH {_HITS_SQL}, f AS (SELECT qid, doc_name, min(rank) AS r FROM hit GROUP BY ALL) SELECT qid, 'Sources:' || chr(10) || string_agg('  - ' || doc_name || ' / ', chr(10) ORDER BY r) AS citation FROM f GROUP BY qid"""
)
def citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.citation(_ranked(spark, sf_dir)[2])


@_query(
    f"""WITH {_PARENTS_SQL}, t AS (SELECT doc_name, parent_id, CASE WHEN heading <> '' THEN '[Section: ' || heading || ']' || chr(10) ELSE '' END || CASE WHEN preamble <> '' THEN preamble || chr(10) ELSE '' END || rows_text || CASE WHEN notes <> '' THEN chr(10) || notes ELSE '' END AS t FROM pp)
SELECT doc_name, 'Context:' || chr(10) || string_agg(t, chr(10) || chr(10) ORDER BY parent_id) || chr(10) || chr(10) || 'Question: Which codes are there?' AS prompt FROM t GROUP BY doc_name"""
)
def direct_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.parent_text(F.col("heading"), F.col("preamble"), F.col("rows"), F.col("notes"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("parent_id", text.alias("t")))), lambda x: x["t"])
    return _parents(spark, sf_dir).groupBy("doc_name").agg(parts.alias("parts")).select("doc_name", prompts.direct_prompt(F.lit("Which codes are there?"), F.col("parts")).alias("prompt"))


_SECTION_QUESTIONS_SQL = "SELECT n_nationkey AS qid, '[' || r_name || ' desk1 | ' || n_name || '] Code: Balance:' AS question FROM nation JOIN region ON n_regionkey = r_regionkey"


@_query(
    f"""WITH {_CHILDREN_SQL}, {_bm25_sql("ch", "child_idx", "embed_text", _SECTION_QUESTIONS_SQL)},
h AS (SELECT sk.qid, sk.rank, ch.child_idx, ch.parent_id, ch.row_text FROM sk JOIN ch ON sk.id = ch.child_idx WHERE rank <= {3 * K}),
b AS (SELECT qid, parent_id, min(rank) AS r, string_agg(row_text, chr(10) ORDER BY child_idx) AS own FROM h GROUP BY ALL),
t AS (SELECT qid, r, '[Source: ' || doc_name || ' | Section: ' || heading || ']' || CASE WHEN preamble <> '' THEN chr(10) || preamble ELSE '' END || chr(10) || own || CASE WHEN notes <> '' THEN chr(10) || notes ELSE '' END AS block FROM b JOIN pp USING (parent_id))
SELECT t.qid, string_agg(block, chr(10) ORDER BY r) || chr(10) || 'Question: ' || any_value(question) AS prompt FROM t JOIN q USING (qid) GROUP BY t.qid"""
)
def sectioned_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several rows of one table, with its section, preamble and notes, and none of the rows that weren't found."""
    parents = kept(_parents(spark, sf_dir))
    n, r = (_t(spark, sf_dir, t) for t in ("nation", "region"))
    questions = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("qid"), F.concat(F.lit("["), "r_name", F.lit(" desk1 | "), "n_name", F.lit("] Code: Balance:")).alias("question"))
    children = chunking.build_children(parents)
    matched = kept(retrieval.matched_children(retrieval.sparse_scores(questions, children, 3 * K), children))
    return prompts.rag_prompt(questions, retrieval.matched_parents(matched.select("qid", "rank", "parent_id"), parents), matched)


@_query(
    f"""WITH {_PARENTS_SQL}, t AS (SELECT parent_id, doc_name, heading, CASE WHEN heading <> '' THEN '[Section: ' || heading || ']' || chr(10) ELSE '' END || CASE WHEN preamble <> '' THEN preamble || chr(10) ELSE '' END || rows_text || CASE WHEN notes <> '' THEN chr(10) || notes ELSE '' END AS t FROM pp),
c AS (SELECT doc_name || ' / ' || heading AS entry, min(parent_id) AS p FROM t GROUP BY ALL)
SELECT r_regionkey AS qid, 'Context:' || chr(10) || (SELECT string_agg(t, chr(10) || chr(10) ORDER BY parent_id) FROM t) || chr(10) || chr(10) || 'Question: Which codes has ' || r_name || '?' AS prompt, 'direct' AS mode, false AS blocked, 'direct-context mode' AS reason,
1.0::DOUBLE AS best_score, CAST(4096 AS BIGINT) AS max_tokens, 'Sources:' || chr(10) || (SELECT string_agg('  - ' || entry, chr(10) ORDER BY p) FROM c) AS citation FROM region"""
)
def direct_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An engine whose corpus is small enough for one prompt."""
    built = engine.Engine(spark, _syn(spark, sf_dir), EchoChat(), HashedEmbedder(), small_corpus=1 << 40).build()
    questions = _t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("qid"), F.concat(F.lit("Which codes has "), "r_name", F.lit("?")).alias("question"))
    return built.prepare(questions)[0].select("qid", "prompt", "mode", "blocked", "reason", "best_score", "max_tokens", "citation")


_FIELD_LABEL, _FIELD_NAMES = FIELDS["repo_ssi"]
_ENTRY_SQL = "{" + ", ".join(f'"{f}": "..."' for f in _FIELD_NAMES) + "}"


@_query(
    f"""WITH b AS (SELECT n_nationkey // 5 AS batch, string_agg(n_name, ', ' ORDER BY n_nationkey) AS items, string_agg('"' || n_name || '": {_ENTRY_SQL}', ', ' ORDER BY n_nationkey) AS schema FROM nation GROUP BY ALL)
SELECT CAST(batch AS BIGINT) AS qid, 'For each of the following country(s): ' || items || ' — extract these fields: {", ".join(_FIELD_NAMES)}. Respond with a single valid JSON object following this exact schema:' || chr(10) || '{{' || schema || '}}' || chr(10) || 'Missing field value: "N/A". Country not in the context: set its field values to "not found".' AS question FROM b"""
)
def field_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _t(spark, sf_dir, "nation").withColumn("qid", F.floor(F.col("n_nationkey") / 5))
    items = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"])
    return n.groupBy("qid").agg(items.alias("items")).select("qid", prompts.field_question(F.col("items"), _FIELD_LABEL, _FIELD_NAMES).alias("question"))


@_query("SELECT s_suppkey // 5 AS batch, string_agg(s_name, ',' ORDER BY s_suppkey) AS items FROM supplier GROUP BY ALL")
def item_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda x: x["s_name"])
    return _t(spark, sf_dir, "supplier").groupBy(F.floor(F.col("s_suppkey") / 5).alias("batch")).agg(F.array_join(items, ",").alias("items"))


# --- replies


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    body = F.concat(F.lit('{"answer": "'), "o_orderpriority", F.lit('", "source": "order '), F.col("o_orderkey").cast("string"), F.lit('"}'))
    kind = F.col("o_orderkey") % 6
    fields = F.concat(F.lit('{"answer": {"Status": "'), "o_orderstatus", F.lit('"}}'))
    return o.select(
        "o_orderkey", "o_orderstatus", "o_orderpriority",
        F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Here it is: "), body, F.lit(" - done")))
        .when(kind == 3, F.concat(F.lit("  plain "), "o_orderpriority")).when(kind == 4, fields).otherwise(F.lit('{"answer": null}')).alias("raw"),
    )


@_query("SELECT o_orderkey, o_orderkey % 6 <> 3 AS is_object, CASE WHEN o_orderkey % 6 < 3 THEN 'order ' || o_orderkey END AS source FROM orders")
def extract_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _replies(spark, sf_dir).withColumn("v", replies.extract_json(F.col("raw")))
    return found.select("o_orderkey", F.col("v").isNotNull().alias("is_object"), F.try_variant_get("v", "$.source", "string").alias("source"))


@_query("""SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 3 THEN o_orderpriority WHEN o_orderkey % 6 = 3 THEN 'plain ' || o_orderpriority WHEN o_orderkey % 6 = 4 THEN 'Status: ' || o_orderstatus ELSE '{"answer": null}' END AS answer FROM orders""")
def parse_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replies(spark, sf_dir).select("o_orderkey", replies.answer(F.col("raw")).alias("answer"))


@_query(
    """WITH f(field) AS (VALUES ('Name'), ('Balance')) SELECT s_suppkey, field, CASE WHEN s_suppkey % 3 = 0 THEN 'not found' WHEN field = 'Name' THEN s_name WHEN s_suppkey % 3 = 1 THEN CAST(s_nationkey AS VARCHAR) ELSE 'N/A' END AS value FROM supplier, f"""
)
def extract_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))
    balance = F.when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit(', "Balance": '), F.col("s_nationkey").cast("string"))).otherwise(F.lit(""))
    reply = F.when(F.col("s_suppkey") % 3 == 0, F.lit("{}")).otherwise(F.concat(F.lit('{"'), item, F.lit('": {"Name": "'), "s_name", F.lit('"'), balance, F.lit("}}")))
    rows = _t(spark, sf_dir, "supplier").select("s_suppkey", item.alias("item"), reply.alias("raw"), F.lit("").alias("answer"))
    return engine.extracted(rows, ["Name", "Balance"]).select("s_suppkey", "field", "value")


_FIELDS_SQL = "(VALUES " + ", ".join(f"('{name}', '{label}', {i}, '{f}')" for name, (label, fields) in FIELDS.items() for i, f in enumerate(fields)) + ") AS t(domain, scope_label, pos, field)"


@_query(f"SELECT c_custkey, domain, scope_label, pos, field FROM customer JOIN {_FIELDS_SQL} ON domain = ({list(FIELDS)!r})[c_custkey % {len(FIELDS)} + 1]")
def domain_fields_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is asked for each customer: the fields of its domain."""
    domain = F.element_at(F.array(*map(F.lit, FIELDS)), (F.col("c_custkey") % len(FIELDS) + 1).cast("int"))
    customers = _t(spark, sf_dir, "customer").select("c_custkey", domain.alias("domain"))
    return customers.join(F.broadcast(domain_fields(spark)), "domain").select("c_custkey", "domain", "scope_label", "pos", "field")


# --- pages


@_query("SELECT p_partkey, upper(split_part(p_name, ' ', 1))[1:4] || ' x ' || p_brand AS cell FROM part WHERE length(split_part(p_name, ' ', 1)) >= 4 UNION ALL SELECT p_partkey, upper(split_part(p_name, ' ', 1)) || ' x ' || p_brand FROM part WHERE length(split_part(p_name, ' ', 1)) = 3")
def pdf_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.upper(F.substring(F.split_part("p_name", F.lit(" "), F.lit(1)), 1, 4))
    spaced = F.trim(F.regexp_replace(word, "(.)", "$1 "))
    p = _t(spark, sf_dir, "part").where(F.length(F.split_part("p_name", F.lit(" "), F.lit(1))) >= 3)
    return p.select("p_partkey", L.clean_cell(F.concat(F.lit("  "), spaced, F.lit(" \n x\t"), "p_brand")).alias("cell"))


@_query("SELECT p_partkey, p_size % 2 = 0 AS is_header FROM part")
def pdf_header_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.when(F.col("p_size") % 2 == 0, F.lit("Account No")).otherwise(F.lit("account no"))
    return _t(spark, sf_dir, "part").select("p_partkey", L.is_header_row(F.array(F.upper("p_type"), F.lit(""), F.lower("p_name"), third)).alias("is_header"))


@_query("SELECT n_nationkey, '<table><tr><th>NATION</th><th>Key</th></tr><tr><td>' || lower(n_name) || '</td><td>' || n_nationkey || '</td></tr></table>' AS html FROM nation")
def pdf_table_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = lambda *c: F.array(*c)
    rows = F.array(row(F.lit("NATION"), F.lit("Key")), row(F.lit(" "), F.lit(None).cast("string")), row(F.lower("n_name"), F.col("n_nationkey").cast("string")))
    return _t(spark, sf_dir, "nation").select("n_nationkey", L.table_html(rows).alias("html"))


@_query(
    """WITH w AS (SELECT l_orderkey % 97 AS doc, l_orderkey AS page, 'w' || l_linenumber || '.' || l_partkey AS text, l_partkey % 500 AS x, l_quantity AS top FROM lineitem),
f AS (SELECT * FROM w WHERE NOT (x >= 100 AND x + 10 <= 200 AND top >= 0 AND top + 2 <= 60)),
l AS (SELECT doc, page, round_even(top / 4, 0) * 4 AS y, string_agg(text, ' ' ORDER BY x, text) AS part FROM f GROUP BY ALL),
p AS (SELECT doc, page, y, 0 AS kind, part FROM l UNION ALL SELECT doc, page, 0, 1, '<table><tr><th>HEAD</th></tr></table>' FROM w GROUP BY ALL)
SELECT 'd' || doc AS doc_name, CAST(page AS INTEGER) AS page, string_agg(part, chr(10) ORDER BY y, kind) AS content FROM p GROUP BY ALL"""
)
def pdf_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _t(spark, sf_dir, "lineitem")
    at = F.concat(F.lit("d"), (F.col("l_orderkey") % 97).cast("string")).alias("doc_name"), F.col("l_orderkey").cast("int").alias("page")
    x, top = (F.col("l_partkey") % 500).cast("double"), F.col("l_quantity")
    words = i.select(*at, F.concat(F.lit("w"), "l_linenumber", F.lit("."), "l_partkey").alias("text"), x.alias("x0"), (x + 10).alias("x1"), top.alias("top"), (top + 2).alias("bottom"))
    tables = i.select(*at).distinct().select("doc_name", "page", F.lit(100.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(200.0).alias("x1"), F.lit(60.0).alias("y1"), F.array(F.array(F.lit("HEAD"))).alias("rows"))
    return page_content(words, tables)


@_query(
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'heading' WHEN 1 THEN 'heading' WHEN 2 THEN 'heading' WHEN 3 THEN 'blank' ELSE 'text' END AS class FROM orders"""
)
def line_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("o_orderkey") % 5
    line = F.when(kind == 0, F.lit("## Order")).when(kind == 1, F.lit("ORDER STATUS")).when(kind == 2, F.lit("1. Order")).when(kind == 3, F.lit("   ")).otherwise(F.concat(F.lit("order "), "o_orderstatus"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", L.line_class(line).alias("class"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of documents, BM25 against every benchmark item, gate, prompt and citation, one row per item."""
    questions, matched, parents = _ranked(spark, sf_dir)
    best = retrieval.normalised_sparse(matched.select("qid", "id", "score", "rank")).groupBy("qid").agg(F.max("score").alias("best_score"))
    gated = retrieval.gate(best)
    return gated.join(prompts.rag_prompt(questions, parents, matched), "qid").join(prompts.citation(parents), "qid")


for _name in ("parse_blocks", "domain_fields"):
    QUERIES[_name], SQL[_name] = QUERIES.pop(f"{_name}_query"), SQL.pop(f"{_name}_query")
