"""BM25 with repeated query terms and a floor for frequent ones, over an index in segments that grows without being rebuilt."""

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.kept import kept
from . import segments as S
from .ordering import running_offsets

#: A fixed value of the usual variant.
EPSILON = 0.25
#: Questions' terms that a task looks up at a time.
BROADCAST_TERMS = 500_000
#: Segments of a part at most: a task holds a part of the index, and the questions pass each part once.
PART_SEGMENTS = 8
#: A question of more terms, that isn't for more than so many units, is scored together with others.
SHORT_TERMS, MANY_K = 16, 1024
#: The number of questions where segments are expected: behind all of them.
_QUESTIONS = (1 << 63) - 1


@dataclass(frozen=True)
class Index:
    """rows: segments as S.SCHEMA; withdrawn: (segment, id) of units that don't count any more; counts: (term, df, tokens) of those
    that do, with their number and tokens under the term S.UNITS; n units of avgdl tokens on average."""

    rows: DataFrame
    withdrawn: DataFrame
    counts: DataFrame
    n: int
    avgdl: float
    mean: float
    version: int

    @property
    def ids(self) -> DataFrame:
        every = self.rows.where(F.col("term") == S.UNITS).select("segment", F.explode("ids").alias("id"))
        return every.join(self.withdrawn, ["segment", "id"], "left_anti").select("id")

    @property
    def terms(self) -> DataFrame:
        """(term, df, idf). An idf under zero is EPSILON times the mean over all terms."""
        raw = _raw(self.n)
        idf = F.when(raw < 0, F.lit(EPSILON * self.mean)).otherwise(raw)
        return self.counts.where(F.col("term") != S.UNITS).select("term", "df", idf.alias("idf"))

    def _counted(self, counts: DataFrame, **changes) -> "Index":
        counts = kept(counts)
        units = F.broadcast(counts.where(F.col("term") == S.UNITS).select(F.col("df").alias("_n"), F.col("tokens").alias("_tokens")))
        raw = F.log(F.col("_n") + 0.5 - F.col("df")) - F.log(F.col("df") + 0.5)
        # One row is joined to all.
        n, tokens, mean = counts.join(units, F.lit(True)).agg(F.max("_n"), F.max("_tokens"), F.avg(F.when(F.col("term") != S.UNITS, raw))).first()
        n, tokens, mean = n or 0, tokens or 0, mean or 0.0
        return replace(self, counts=counts, n=n, avgdl=tokens / n if n else 0.0, mean=mean, **changes)

    def _with(self, deltas: DataFrame, **changes) -> "Index":
        both = self.counts.unionByName(deltas).groupBy("term").agg(F.sum("df").alias("df"), F.sum("tokens").alias("tokens"))
        return self._counted(both.where((F.col("df") > 0) | (F.col("term") == S.UNITS)), **changes)

    def add(self, units: DataFrame, id_col: str = "child_idx", text_col: str = "embed_text") -> "Index":
        """The index of these units, too, whose ids aren't in it. Only they are read; the old index stays as it is."""
        more = kept(S.build_rows(units, id_col, text_col, self.version + 1), S.FILE_ROWS)
        return self._with(_deltas(more), rows=self.rows.unionByName(more), version=self.version + 1)

    def withdraw(self, ids: DataFrame) -> "Index":
        """The index without these (id). Their postings are looked up where they lie, texts aren't read, and what they added to the
        counts is taken off; searches leave them out, and merge() drops them."""
        units = self.rows.where(F.col("term") == S.UNITS).select("segment", F.posexplode("ids").alias("doc", "id"), "lengths")
        gone = units.join(ids.select(F.col("id").cast("long")).distinct(), "id").join(self.withdrawn, ["segment", "id"], "left_anti")
        gone = kept(gone.select("segment", "id", "doc", F.get("lengths", F.col("doc")).alias("dl")))
        posted = self.rows.where(F.col("term").isNull()).join(gone.select("segment").distinct(), "segment", "left_semi")
        posted = posted.select("segment", "words", "dfs", "docs", "tfs").mapInArrow(S.postings, "segment long, term string, doc int, tf int")
        posted = posted.join(gone, ["segment", "doc"]).groupBy("term").agg((-F.count("*")).alias("df"), (-F.sum("tf")).alias("tokens"))
        units = gone.groupBy(F.lit(S.UNITS).alias("term")).agg((-F.count("*")).alias("df"), (-F.sum("dl")).alias("tokens"))
        return self._with(posted.unionByName(units), withdrawn=self.withdrawn.unionByName(gone.select("segment", "id")))

    def merge(self) -> "Index":
        """The same index in fewer segments, without what was withdrawn: neighbours that together are about a segment become one,
        from their postings."""
        sizes = self.rows.where(F.col("term") == S.UNITS).select("segment", F.size("ids").alias("n"))
        bins = running_offsets(sizes, "segment", {"before": "n"}).select("segment", F.floor(F.col("before") / S.SEGMENT_UNITS).alias("bin"))
        version, average = self.version + 1, self.avgdl

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, parts = None, {}
            for bin_, rows in S.by_segment("bin", batches):
                if bin_ != at:
                    if parts:
                        yield from S.live_rows(S.segment_number(version, 0) + at, list(parts.values()))
                    at, parts = bin_, {}
                for segment, own in S.by_segment("segment", iter([rows])):
                    parts.setdefault(segment, S.Segment(average)).add(own)
            if parts:
                yield from S.live_rows(S.segment_number(version, 0) + at, list(parts.values()))

        rows = _with_withdrawn(self.rows, self.withdrawn).join(bins, "segment")
        rows = rows.repartition("bin").sortWithinPartitions("bin", "segment", "kind")
        return replace(self, rows=kept(rows.mapInArrow(run, S.SCHEMA), S.FILE_ROWS), withdrawn=self.withdrawn.limit(0), version=version)


def _raw(n: int):
    return F.log(F.lit(n + 0.5) - F.col("df")) - F.log(F.col("df") + 0.5)


def _deltas(rows: DataFrame) -> DataFrame:
    counted = rows.select("words", "dfs", "sums").mapInArrow(S.counts, "term string, df int, tokens long")
    return counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tokens").alias("tokens"))


def _with_withdrawn(rows: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """With kind, by which a segment's rows are read: its units, those withdrawn (null words), its postings."""
    listed = withdrawn.groupBy("segment").agg(F.collect_list("id").alias("ids"))
    listed = listed.select(*(F.col(f.name) if f.name in ("segment", "ids") else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields), F.lit(1).alias("kind"))
    return rows.withColumn("kind", F.when(F.col("term") == S.UNITS, 0).otherwise(2)).unionByName(listed)


def index(units: DataFrame, id_col: str = "child_idx", text_col: str = "embed_text") -> Index:
    """Segments are written once, and all statistics come from them. Ids are integers that don't repeat."""
    rows = kept(S.build_rows(units, id_col, text_col), S.FILE_ROWS)
    none = rows.sparkSession.range(0).select(F.col("id").alias("segment"), "id")
    return Index(rows, none, rows, 0, 0.0, 0.0, 0)._counted(_deltas(rows))


def query_terms(questions: DataFrame, text_col: str = "question") -> DataFrame:
    """(qid, term, qn): how often each term is in the question."""
    return questions.select("qid", F.explode(T.tokens(F.col(text_col))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qn"))


def _search(k: int, average: float, qid: pa.DataType, at_a_time: int):
    """Rows of a part's segments, then the questions (kind 3): what S.Segment finds for each."""

    def rows_of(asked: pa.RecordBatch, who, ids, scores, scored, total) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([asked["qid"].take(pa.array(who)).cast(qid), *map(pa.array, (ids, scores, scored, total))], names=["qid", "id", "score", "scored", "postings"])

    def together(asked: pa.RecordBatch, segments: list[S.Segment]) -> Iterator[pa.RecordBatch]:
        block = S.Asked(asked["terms"], asked["weights"])
        for segment in segments:
            segment.best_of_many(block, k)
        who, ids, scores = block.found
        counted = np.where(np.concatenate(([True], who[1:] != who[:-1])), block.postings[who], 0) if len(who) else np.zeros(0, np.int64)
        yield rows_of(asked, who, ids, scores, counted, counted)

    def alone(asked: pa.RecordBatch, segment: S.Segment) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        segment.meet(asked["terms"].flatten().unique())
        for i in range(len(asked)):
            ids, scores, scored, total = segment.best(asked["terms"][i].as_py(), asked["weights"][i].as_py(), min(k, 1 << 62))
            if len(ids):
                counted = np.zeros((2, len(ids)), np.int64)
                counted[:, 0] = scored, total
                out.append((np.full(len(ids), i), ids, scores, *counted))
                size += len(ids)
            if out and (size > 1 << 16 or i + 1 == len(asked)):
                yield rows_of(asked, *(np.concatenate(x) for x in zip(*out, strict=True)))
                out, size = [], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, segments = None, []
        for number, rows in S.by_segment("segment", batches):
            if number != _QUESTIONS:
                if number != at:
                    at, segments = number, [*segments, S.Segment(average)]
                segments[-1].add(rows)
                continue
            sizes = pc.list_value_length(rows["terms"]).to_numpy(zero_copy_only=False)
            # Bounds aren't for weights under zero, and a unit that scores 0 counts as found where it holds a term.
            many = (sizes > SHORT_TERMS) & (k <= MANY_K) & np.array([pc.min(w.values).as_py() > 0 for w in rows["weights"]])
            for kind in (True, False):
                asked = rows.filter(pa.array(many == kind))
                block = np.cumsum(sizes[many == kind]) // max(1, at_a_time)
                for a, b in S.runs(block):
                    if kind:
                        yield from together(asked.slice(a, b - a), segments)
                    else:
                        for segment in segments:
                            yield from alone(asked.slice(a, b - a), segment)

    return run


def search(indexed: Index, questions: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, scored, postings): units that share a term with the question, among them the k best of all, or all if they
    are fewer; all others score 0. Over a question's rows, postings sums up to those of its terms, and scored to those of them that
    were added up: bounds spare the others.

    Segments are dealt to parts, and each question goes to each part once, so that questions and index are moved once, however
    many the questions are.
    """
    kind = questions.schema["qid"].dataType
    asked = query_terms(questions).join(indexed.terms.select("term", "idf"), "term").select("qid", "term", (F.col("qn") * F.col("idf")).alias("weight"))
    asked = kept(asked.groupBy("qid").agg(F.collect_list(F.struct("term", "weight")).alias("t")).select("qid", "t.term", "t.weight").toDF("qid", "terms", "weights"))
    units = indexed.rows.where(F.col("term") == S.UNITS).select("segment")
    n = units.count()
    parts = max(1, min(n, max(indexed.rows.sparkSession.sparkContext.defaultParallelism, -(-n // PART_SEGMENTS))))
    # One row for each segment is numbered.
    part = units.select("segment", ((F.row_number().over(Window.orderBy("segment")) - 1) % parts).alias("part"))
    rows = _with_withdrawn(indexed.rows, indexed.withdrawn).join(F.broadcast(part), "segment")
    columns = [f for f in indexed.rows.schema.fields if f.name != S.UNSEARCHED]
    rows = rows.select("part", *(f.name for f in columns), "kind", F.lit(None).cast(kind).alias("qid"), F.lit(None).cast("array<string>").alias("terms"), F.lit(None).cast("array<double>").alias("weights"))
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in columns if f.name != "segment"]
    visits = asked.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(_QUESTIONS).alias("segment"), *empty, F.lit(3).alias("kind"), "qid", "terms", "weights")
    dealt = rows.unionByName(visits).repartitionById(parts, "part").sortWithinPartitions("segment", "kind")
    arrow = pa.int64() if kind.typeName() == "long" else pa.int32() if kind.typeName() == "integer" else pa.string()
    return dealt.mapInArrow(_search(k, indexed.avgdl, arrow, BROADCAST_TERMS), f"qid {kind.simpleString()}, id long, score double, scored long, postings long")


def scores(indexed: Index, questions: DataFrame) -> DataFrame:
    """(qid, id, score) of every unit that shares a term with the question; all others score 0."""
    return search(indexed, questions, 1 << 62).select("qid", "id", "score")


def touched(indexed: Index, questions: DataFrame, k: int) -> DataFrame:
    """(qid, scored, postings): how many of the postings of its terms a search for the k best adds up."""
    return search(indexed, questions, k).groupBy("qid").agg(F.sum("scored").alias("scored"), F.sum("postings").alias("postings"))
