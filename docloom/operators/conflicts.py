"""Codes that differ between documents for one scope, and codes of an answer that its context doesn't hold."""

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.kept import kept
from .automaton import Automaton

#: Scopes of an automaton, about, and questions that run through it at a time.
SCOPES, QUESTIONS = 20_000, 512


def scope_codes(parents: DataFrame) -> DataFrame:
    """(scope, doc_name, codes): the distinct codes of the rows of one scope, sorted; the scope itself isn't a code."""
    rows = parents.select("doc_name", F.explode("rows").alias("row_text"))
    found = rows.select("doc_name", T.scope(F.col("row_text")).alias("scope"), F.explode(T.codes(F.col("row_text"))).alias("code"))
    found = found.where("scope is not null and code <> scope")
    return found.groupBy("scope", "doc_name").agg(F.sort_array(F.collect_set("code")).alias("codes"))


def conflict_map(parents: DataFrame) -> DataFrame:
    """The rows of scope_codes() for scopes of two or more documents whose codes are not all the same."""
    codes = scope_codes(parents)
    differing = codes.groupBy("scope").agg(F.count("*").alias("n"), F.min("codes").alias("lo"), F.max("codes").alias("hi")).where("n >= 2 and lo <> hi").select("scope")
    return codes.join(differing, "scope")


def _look_for(whole_words: bool):
    """Rows of one part of the scopes, (scope, said) first, then the questions (qid, said): a row for each scope in a question."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, found = None, [], None
        for batch in batches:
            marks = np.stack([batch[c].to_numpy() for c in ("part", "slice", "side")])
            for a, b in pairwise([0, *(np.flatnonzero((np.diff(marks, axis=1) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]):
                if a == b:
                    continue
                rows = batch.slice(a, b - a)
                if (marks[0, a], marks[1, a]) != key:
                    key, held, found = (marks[0, a], marks[1, a]), [], None
                if not marks[2, a]:
                    held += zip(rows["scope"].to_pylist(), rows["said"].to_pylist(), strict=True)
                elif held:
                    found = found or Automaton([scope for scope, _ in held])
                    for at in range(0, len(rows), QUESTIONS):
                        part = rows.slice(at, QUESTIONS)
                        who, what = found.find(part["said"].to_pylist(), whole_words)
                        scopes, said = (pa.array([held[i][j] for i in what.tolist()], pa.string()) for j in (0, 1))
                        yield pa.RecordBatch.from_arrays([part["qid"].take(pa.array(who)), scopes, said], names=["qid", "scope", "summary"])

    return run


def detect_conflicts(questions: DataFrame, conflicts: DataFrame, whole_words: bool = False) -> DataFrame:
    """(qid, scope, message) for each scope of the map that is anywhere in the upper-cased question, or only where no letter or
    digit stands next to it. The wording of the message is fixed.

    Scopes are dealt by their first letters to parts of about SCOPES; each part is one automaton in each of so many slices of
    the questions that all cores have work. A question runs through an automaton once, whatever its length and the scopes'.
    """
    summary = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_name", F.array_join("codes", ", ").alias("c")))), lambda x: F.concat_ws(": ", x["doc_name"], x["c"])), "; ")
    scopes = kept(conflicts.where("scope <> ''").groupBy("scope").agg(summary.alias("said")))
    parts = max(1, -(-scopes.count() // SCOPES))
    slices = -(-questions.sparkSession.sparkContext.defaultParallelism // parts)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = scopes.repartitionByRange(parts, "scope").withColumn("part", F.spark_partition_id()) if parts > 1 else scopes.withColumn("part", F.lit(0))
    qid = F.lit(None).cast(questions.schema["qid"].dataType)
    held = dealt.select("part", every(slices).alias("slice"), F.lit(0).alias("side"), qid.alias("qid"), "scope", "said")
    asked = questions.select("qid", F.upper(F.coalesce("question", F.lit(""))).alias("said")).withColumn("slice", F.pmod(F.xxhash64("qid", "said"), F.lit(slices)).cast("int"))
    asked = asked.select(every(parts).alias("part"), "slice", F.lit(1).alias("side"), "qid", F.lit(None).cast("string").alias("scope"), "said")
    rows = held.unionByName(asked).repartition(parts * slices, "part", "slice").sortWithinPartitions("part", "slice", "side")
    found = rows.mapInArrow(_look_for(whole_words), f"qid {questions.schema['qid'].dataType.simpleString()}, scope string, summary string")
    message = F.concat(F.lit("Conflicting SSI found for '"), "scope", F.lit("' across documents: "), "summary", F.lit(". Verify with the responsible desk before settling."))
    return found.select("qid", "scope", message.alias("message"))


def answer_codes(answer: Column) -> Column:
    """Distinct codes and account numbers of the upper-cased answer, sorted."""
    upper = F.upper(answer)
    return F.array_sort(F.array_union(F.array_distinct(T.codes(upper)), F.array_distinct(T.account_numbers(upper))))


def check_grounding(rows: DataFrame, answer: str = "answer", context: str = "context") -> DataFrame:
    """Adds grounded, ungrounded (arrays of the answer's codes that the upper-cased context holds or doesn't) and passed."""
    upper = F.upper(F.coalesce(F.col(context), F.lit("")))
    rows = rows.withColumn("_codes", answer_codes(F.coalesce(F.col(answer), F.lit(""))))
    rows = rows.withColumn("grounded", F.filter("_codes", lambda c: F.contains(upper, c))).withColumn("ungrounded", F.filter("_codes", lambda c: ~F.contains(upper, c)))
    return rows.withColumn("passed", F.size("ungrounded") == 0).drop("_codes")
