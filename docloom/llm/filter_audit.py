"""Filter interaction audit: what each filter removes in every order of filters, by wide packed counters.

Which filters a document fails is a mask. For a mask, what happens at every step of every order is known beforehand, so each
mask has an integer with a field of FIELD_BITS for each of these steps. Such integers are summed per part and unpacked.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import join_counted
from .storage import Scratch

#: A field counts documents, of which a table has fewer than 2 ** 63, so no field runs over into the next.
FIELD_BITS = 64

BREAK = r"[\x20\x09-\x0D]+"


def text_filters(text: Column) -> dict[str, Column]:
    """Conditions under which a text fails, by the filter's letter. All but E, which compares texts."""
    words = F.array_remove(F.split(text, BREAK), "")
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))) > 10 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


#: Fails where the same text has a smaller id.
COPY = "E"


@dataclass(frozen=True)
class Counters:
    """The packed integers of all masks over the filters of a string of letters; bit i of a mask: its i-th filter fails."""

    letters: str

    @cached_property
    def orders(self) -> list[str]:
        return sorted("".join(p) for p in permutations(self.letters))

    @property
    def fields(self) -> int:
        return len(self.orders) * len(self.letters)

    @cached_property
    def packed(self) -> dict[int, dict[str, int]]:
        """mask -> name -> an integer with 1 in the fields of the steps where the document is kept, removed, redundant (fails a
        filter that comes after its removal) or fails that filter only. Fields lie in the order of orders, then steps."""
        out = {}
        for mask in range(1 << len(self.letters)):
            sums = dict.fromkeys(("kept", "removed", "redundant", "unique_fails"), 0)
            field = 1
            for order in self.orders:
                alive = True
                for letter in order:
                    bit = 1 << self.letters.index(letter)
                    fails = bool(mask & bit)
                    sums["removed"] += field * (alive and fails)
                    sums["redundant"] += field * (fails and not alive)
                    sums["unique_fails"] += field * (mask == bit)
                    alive = alive and not fails
                    sums["kept"] += field * alive
                    field <<= FIELD_BITS
            out[mask] = sums
        return out

    def unpack(self, packed: int) -> list[int]:
        raw = packed.to_bytes(self.fields * FIELD_BITS // 8, "little")
        return [int.from_bytes(raw[i : i + FIELD_BITS // 8], "little") for i in range(0, len(raw), FIELD_BITS // 8)]


def masked(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, good, toxic) for each row of docs. Texts are read once; what is joined are their digests."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    tests = text_filters(text)
    mask = reduce(lambda a, b: a + b, (F.when(test, 1 << i).otherwise(0) for i, test in enumerate(tests.values())))
    rows = docs.select(F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(id_col).alias("id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"), mask.alias("mask"))
    rows = scratch.write(rows, "digests")
    copies = scratch.write(rows.groupBy("sha").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1"), "copies")
    # Texts without a copy have nothing to be joined to.
    found = join_counted(rows, copies, ["sha"], rows.count(), "left").withColumn("mask", F.col("mask") + F.when(F.col("id") > F.col("first"), 1 << len(tests)).otherwise(0))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    named, others = found.where("id is not null").select("part", "id", "mask"), found.where("id is null").select("part", F.lit(0).alias("good"), F.lit(0).alias("toxic"), "mask")
    named = named.join(marks, "id", "left").select("part", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "mask")
    return named.unionByName(others).select("part", "mask", "good", "toxic")


SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def report(counters: Counters):
    """Of the counts of a part's masks, at most 2 ** letters rows, its rows for each order and step."""
    orders, letters = counters.orders, counters.letters
    steps = [(order, step) for order in orders for step in range(len(letters))]
    columns = {"filter_order": [o for o, _ in steps], "step": [s + 1 for _, s in steps]}

    def run(groups: Iterator[pd.DataFrame]) -> pd.DataFrame:
        packed = counters.packed
        weighted = {"kept": ("kept", "n"), "removed": ("removed", "n"), "redundant": ("redundant", "n"), "unique_fails": ("unique_fails", "n"), "good_lost": ("removed", "good"), "toxic_lost": ("removed", "toxic")}
        out = {"part": groups["part"].iloc[0]} | columns
        for name, (field, weight) in weighted.items():
            # Adding a mask's integer for each of its documents is multiplying it by their number.
            out[name] = counters.unpack(sum(int(w) * packed[int(m)][field] for m, w in zip(groups["mask"], groups[weight], strict=True)))
        shares = dict.fromkeys(letters, 0)
        for (order, step), n in zip(steps, out["removed"], strict=True):
            shares[order[step]] += n
        return pd.DataFrame(out | {"shapley": [shares[order[step]] for order, step in steps]})

    return run


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """For each part (value of part_col), filter_order and step: how many documents are kept, removed, redundant and
    unique_fails there, good_lost and toxic_lost by it, and its filter's shapley sum over all orders.

    Null texts count as empty, null parts as the part of the empty string. A row with a null id is a document that has no
    label, isn't a copy of another and no other is a copy of it; its repeats aren't either. Rows that share an id count each,
    and are no copies of each other. A document has a label if any of its rows in labels has it. All parts have all rows, zeros
    included; an empty table gives none. Rows are counted by part and mask before they meet, so a part is as many rows as
    there are masks, whatever its size.
    """
    counters = Counters("".join(text_filters(F.lit(""))) + COPY)
    rows = masked(docs, labels, Scratch(docs.sparkSession, "audit"), id_col, text_col, part_col)
    counts = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return counts.groupBy("part").applyInPandas(report(counters), SCHEMA)


def audit_sql(table: str = "documents") -> str:
    """The same rows in DuckDB: each document meets each order."""
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM {table}),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CASE WHEN len(w) < 100 THEN 'A' ELSE '' END
  || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails FROM d LEFT JOIN l USING (doc_id)),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o AS filter_order, s AS step, o[s] AS x, o[:s] AS upto, o[:s - 1] AS before FROM o, range(1, 6) r(s)),
n AS (SELECT part, filter_order, step, x, translate(fails, before, '') = fails AS alive, translate(fails, upto, '') = fails AS stays, contains(fails, x) AS failed, fails = x AS only_this, good, toxic FROM f, s),
r AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, x, count(*) FILTER (stays) AS kept, count(*) FILTER (alive AND failed) AS removed, count(*) FILTER (failed AND NOT alive) AS redundant,
  count(*) FILTER (only_this) AS unique_fails, count(*) FILTER (alive AND failed AND good = 1) AS good_lost, count(*) FILTER (alive AND failed AND toxic = 1) AS toxic_lost FROM n GROUP BY ALL)
SELECT * EXCLUDE (x), CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM r
"""
