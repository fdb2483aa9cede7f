"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Common words of English, French, German and Spanish, as they are written inside a sentence.
STOP_WORDS = {
    "en": "a an and are as at be by for from he in is it of on or that the this to was with not have".split(),
    "fr": "au aux avec ce dans de des du elle en est et il la le les ne on par pas pour que qui se sur un une".split(),
    "de": "als am an auf aus bei das dem den der des die ein eine er es für im in ist mit nicht sich sie und von war zu".split(),
    "es": "al como con de del el en es la las lo los no para por que se su sus un una y".split(),
}

WORD_BREAK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A measure that has to lie between two bounds, both allowed; None: no bound."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None

    def holds(self) -> Column:
        value = F.expr(self.measure)
        held = F.lit(True)
        if self.least is not None:
            held = held & (value >= self.least)
        if self.most is not None:
            held = held & (value <= self.most)
        return held


RULES = [
    Rule("word_length", "word_chars / nullif(n_words, 0)", 2.0, 16.0),
    Rule("symbol_ratio", "n_symbols / nullif(n_words, 0)", most=0.1),
    Rule("stop_word_ratio", "n_stop_words / nullif(n_words, 0)", least=0.04),
    Rule("exclamation_ratio", "n_exclamations / nullif(n_words, 0)", most=0.25),
    Rule("duplicate_line_ratio", "n_dup_lines / nullif(n_lines, 0)", most=0.6),
]


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The counts of every whole text: null counts as empty. keep: other columns of docs that stay."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(text, WORD_BREAK), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    marks = F.regexp_replace(text, f"[^!{SYMBOLS}]+", "")
    base = docs.select(*(keep if keep is not None else [id_col]), marks.alias("_m"), words.alias("_w"), lines.alias("_l"))
    stops = sorted({w for own in STOP_WORDS.values() for w in own})
    windows = F.transform("_w", lambda w, i: F.xxhash64(w, F.get(F.col("_w"), i + 1), F.get(F.col("_w"), i + 2)))
    base = base.select(
        *[c for c in base.columns if c not in ("_m", "_w", "_l")],
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.translate("_m", "!", "")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.length("_m") - F.length(F.translate("_m", "!", ""))).cast("long").alias("n_exclamations"),
        F.size(F.filter("_w", lambda w: w.isin(stops))).cast("long").alias("n_stop_words"),
        F.slice(windows, 1, F.greatest(F.size("_w") - 2, F.lit(0))).alias("_g"),
    )
    plain = [c for c in base.columns if c != "_g"]
    # Most texts repeat no window, which a hash set shows; the others sort their windows, so equal ones are neighbours.
    base = base.select(*plain, F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))).alias("_s"))
    same = lambda x, j: F.coalesce(F.get(F.col("_s"), j)["g"] == x["g"], F.lit(False))
    # A repeated window covers its own place and the next two.
    again = F.filter(F.transform("_s", lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"])), lambda i: i.isNotNull())
    covered = F.size(F.array_distinct(F.flatten(F.transform(again, lambda i: F.array(i, i + 1, i + 2)))))
    return base.select(*plain, F.when(F.col("_s").isNotNull(), covered).otherwise(0).cast("long").alias("n_repeat_words"))


def _verdict(rules: list[Rule]) -> tuple[Column, Column]:
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~failed
    for rule in rules:
        kept = kept & F.coalesce(rule.holds(), F.lit(False))
    return failed, kept


def quality(docs: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the
    method's own counts.

    Null and empty texts have no words, fail the base rule and are not kept. Null ids pass through; repeated rows are judged
    once each; other columns are not read. An empty table gives an empty result. A text's words stay in its own row, so a
    long one costs its length times the logarithm of it.
    """
    failed, kept = _verdict(rules)
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    found = measures(docs, id_col, text_col)
    return found.select(id_col, *columns, failed.alias("base_failed"), kept.alias("kept"), "n_lines", "n_exclamations", "n_stop_words")


def accepted(docs: DataFrame, rules: list[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of docs that quality() keeps, with all their columns."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(text_col))
    # A filter on computed counts would be pushed below them, with every count's whole expression in it; the row number,
    # which isn't deterministic, keeps it above.
    found = measures(packed, text_col=text_col, keep=["_row"]).withColumn("_at", F.monotonically_increasing_id())
    return found.where(_verdict(rules)[1] & (F.col("_at") >= 0)).select("_row.*")


def quality_sql(rules: list[Rule] = RULES, table: str = "documents") -> str:
    """The same rows in DuckDB."""
    stops = ", ".join(f"'{w}'" for w in sorted({w for own in STOP_WORDS.values() for w in own}))
    held = " AND ".join(f"coalesce({r.measure} {op} {bound}, false)" for r in rules for op, bound in ((">=", r.least), ("<=", r.most)) if bound is not None)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM {table}),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
u AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT r, i, x AS a, lead(x) OVER (PARTITION BY r ORDER BY i) AS b, lead(x, 2) OVER (PARTITION BY r ORDER BY i) AS c FROM u),
n AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g WHERE c IS NOT NULL),
p AS (SELECT r, count(DISTINCT i + o) AS n FROM n, (VALUES (0), (1), (2)) AS v(o) WHERE n.n > 1 GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines, CAST(length(t) - length(translate(t, '!', '')) AS BIGINT) AS n_exclamations,
  CAST(len(list_filter(w, lambda x: x IN ({stops}))) AS BIGINT) AS n_stop_words FROM w LEFT JOIN p USING (r)),
f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND {held}) AS kept, n_lines, n_exclamations, n_stop_words FROM f
"""
