"""An engine over a corpus: build once, then answer questions in batches."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import replies
from ..functions.text import parent_text
from ..operators import bm25
from ..operators import conflicts as C
from ..operators import retrieval as R
from ..operators.blocks import parse_blocks
from ..operators.chunking import STRATEGIES, build_children, get_strategy
from ..sources.documents import read_json
from ..sources.kept import kept
from ..sources.workers import find_package
from . import prompts as P
from .answers import Answers
from .domains import Domain, get_domain
from .pacing import RateLimit
from .providers import Chat, Embedder, Reranker, complete_column, embed_column, rerank_column

EXTRACT_TOKENS = 512
_RESULT = "qid, question, answer, raw, citation, blocked, reason, best_score, conflicts, grounded, ungrounded, passed, seconds, mode".split(", ")


class Engine:
    """Documents to answers. Batches of questions are frames (qid, question); one question is a batch of one."""

    def __init__(
        self,
        spark: SparkSession,
        source: str | DataFrame,
        chat: Chat,
        embedder: Embedder,
        reranker: Reranker | None = None,
        domain: str | Domain | None = None,
        chunk_strategy: str = "section_table",
        retrieval_mode: str = "dense",
        default_k: int = R.DEFAULT_K,
        threshold: float = R.THRESHOLD,
        small_corpus: int = R.SMALL_CORPUS,
        answers: Answers | str | None = None,
        limit: RateLimit | None = None,
    ):
        """answers: a table, or its folder, from which batches go on where they were cut short; limit: what all calls of the chat
        model together keep to."""
        if retrieval_mode not in R.MODES:
            raise ValueError(f"unknown mode {retrieval_mode!r}; known: {', '.join(R.MODES)}")
        self.spark, self.source, self.chat, self.embedder, self.reranker = find_package(spark), source, chat, embedder, reranker
        self.domain = get_domain(domain or "fx_ssi") if isinstance(domain or "fx_ssi", str) else domain
        self.strategy, self.mode, self.default_k, self.threshold, self.small = get_strategy(chunk_strategy), retrieval_mode, default_k, threshold, small_corpus
        self.answers, self.limit = Answers(spark, answers) if isinstance(answers, str) else answers, limit
        self.parents: DataFrame | None = None

    def _documents(self) -> DataFrame:
        return read_json(self.spark, self.source) if isinstance(self.source, str) else self.source

    def build(self) -> "Engine":
        """Parses, chunks, maps conflicts and embeds. Building again starts anew."""
        self.blocks = kept(parse_blocks(self._documents()))
        self.parents = kept(self.strategy.parents(self.blocks))
        children = kept(build_children(self.parents))
        self.conflicts = kept(C.conflict_map(self.parents))
        self.n_children = children.count()
        self.direct = self.n_children < self.small
        needs = not self.direct and self.mode != "sparse"
        self.children = kept(embed_column(children, self.embedder, "embed_text")) if needs else children
        self.index = bm25.index(children) if not self.direct and self.mode != "dense" else None
        return self

    def _questions(self, questions: Sequence[str] | DataFrame) -> DataFrame:
        if self.parents is None:
            raise RuntimeError("build() comes first")
        if isinstance(questions, DataFrame):
            return questions.select("qid", "question")
        return self.spark.createDataFrame(list(enumerate(questions)), "qid long, question string")

    def _found(self, questions: DataFrame, k: int | None) -> tuple[DataFrame, DataFrame]:
        """(questions with policy, matched children)"""
        asked = R.policy(questions, self.n_children, k, self.default_k, self.reranker is not None)
        if self.mode != "sparse":
            asked = embed_column(asked, self.embedder, "question", "retrieval.query")
        asked = kept(asked)
        hits = None
        # Broad questions take everything, the others a few: two numbers at most, so nobody else searches that far.
        for (n,) in asked.select("fetch_k").distinct().collect():
            own = R.retrieve(asked.where(F.col("fetch_k") == n), self.children, self.mode, max(1, n), self.index)
            hits = own if hits is None else hits.unionByName(own)
        if hits is None:
            hits = R.retrieve(asked, self.children, self.mode, 1, self.index)
        limits = asked.select("qid", "question", "k")
        matched = R.matched_children(hits, self.children.drop("vector")).join(limits, "qid")
        if self.reranker is not None:
            rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rerank_score"), "rank"))
            matched = kept(rerank_column(matched, self.reranker)).withColumn("rerank_score", F.round("rerank_score", 4)).withColumn("rank", rank).where("rank <= k")
        return asked, matched

    def prepare(self, questions: Sequence[str] | DataFrame, k: int | None = None, max_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(ready, context): what each question would be asked with, blocked or not, and its context for grounding."""
        questions = self._questions(questions)
        if self.direct:
            ready, context, cited = self._direct(questions)
        else:
            asked, matched = self._found(questions, k)
            matched = kept(matched)
            parents = kept(R.matched_parents(matched, self.parents.drop("doc_ord", "first_child")))
            best = matched.groupBy("qid").agg(F.max("best_score").alias("best_score"))
            gated = R.gate(asked.drop("vector").join(best, "qid", "left"), self.threshold)
            gated = gated.withColumn("max_tokens", F.lit(max_tokens).cast("long")) if max_tokens is not None else gated
            ready = gated.join(P.rag_prompt(questions, parents, matched), "qid").withColumn("mode", F.lit(self.mode))
            context, cited = P.contexts(parents), P.citation(parents)
        columns = ["qid", "question", "prompt", "max_tokens", "blocked", "reason", "best_score", "mode", "citation"]
        return kept(ready.join(cited, "qid", "left").select(*columns)), context

    def batch_query(self, questions: Sequence[str] | DataFrame, k: int | None = None, max_tokens: int | None = None, max_workers: int | None = None) -> DataFrame:
        """One row per question; a blocked one keeps its reason as answer, has no conflicts and no reply. Answered rows are
        kept, so reading the result again doesn't ask the model again."""
        ready, context = self.prepare(questions, k, max_tokens)
        asked = ready.where("not blocked")
        asked = asked.repartition(max_workers) if max_workers else asked
        if self.answers is not None:
            answered = self.answers.complete(asked, self.chat, self.domain.system_prompt, self.limit)
        else:
            answered = complete_column(asked, self.chat, self.domain.system_prompt, self.limit)
        answered = kept(answered)
        answered = answered.withColumn("answer", replies.answer(F.col("raw")))
        answered = C.check_grounding(answered.join(context, "qid", "left"))
        found = C.detect_conflicts(ready, self.conflicts).groupBy("qid").agg(F.array_sort(F.collect_list("message")).alias("conflicts"))
        none = F.expr("cast(array() as array<string>)")
        answered = answered.join(found, "qid", "left").withColumn("conflicts", F.coalesce("conflicts", none))
        held = ready.where("blocked")
        for name, value in {"raw": F.lit(None).cast("string"), "answer": F.col("reason"), "citation": F.lit(""), "conflicts": none, "grounded": none, "ungrounded": none, "passed": F.lit(True), "seconds": F.lit(0.0)}.items():
            held = held.withColumn(name, value)
        return answered.select(*_RESULT).unionByName(held.select(*_RESULT))

    def _direct(self, questions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """A corpus of few children goes into the prompt whole."""
        text = parent_text(F.col("heading"), F.col("preamble"), F.col("rows"), F.col("notes"))
        parts = F.transform(F.array_sort(F.collect_list(F.struct("parent_id", text.alias("t")))), lambda x: x["t"])
        every = self.parents.agg(parts.alias("parts"))
        ready = questions.join(every, F.lit(True)).withColumn("prompt", P.direct_prompt(F.col("question"), F.col("parts")))
        ready = ready.withColumn("max_tokens", F.lit(R.BROAD_TOKENS).cast("long")).withColumn("blocked", F.lit(False)).withColumn("reason", F.lit("direct-context mode")).withColumn("best_score", F.lit(1.0)).withColumn("mode", F.lit("direct"))
        context = questions.join(every, F.lit(True)).select("qid", F.array_join("parts", "\n\n").alias("context"))
        ranked = questions.select("qid").join(self.parents.withColumn("parent_rank", F.col("parent_id")), F.lit(True))
        return ready, context, P.citation(ranked)

    def query(self, question: str, k: int | None = None, max_tokens: int | None = None) -> dict:
        return self.batch_query([question], k, max_tokens).first().asDict(recursive=True)

    def extract_batch(self, items: Sequence[str], fields: Sequence[str] | None = None, batch_size: int = 5, max_workers: int | None = None) -> DataFrame:
        """(item, pos, field, value, qid, ...): several items to a question; a field that the item's object lacks is 'N/A', an
        item that the reply lacks has 'not found' everywhere."""
        fields = list(fields or self.domain.fields)
        rows = self.spark.createDataFrame(list(enumerate(items)), "pos long, item string").withColumn("qid", F.floor(F.col("pos") / batch_size))
        listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"])
        questions = rows.groupBy("qid").agg(listed.alias("items")).select("qid", P.field_question(F.col("items"), self.domain.scope_label, fields).alias("question"))
        results = self.batch_query(questions, self.default_k, EXTRACT_TOKENS, max_workers)
        return extracted(rows.join(results, "qid"), fields)

    def evaluate(self, questions: Sequence[str] | DataFrame, strategies: Sequence[str] | None = None) -> DataFrame:
        """(strategy, qid, question, best_score, n_parents, n_children, n_docs) by dense retrieval, without the model."""
        questions = self._questions(questions)
        asked = embed_column(questions, self.embedder, "question", "retrieval.query")
        asked = kept(asked)
        parts = []
        for name in strategies or STRATEGIES:
            parents, children = get_strategy(name).build(self.blocks)
            hits = R.retrieve(asked, embed_column(children, self.embedder, "embed_text"), "dense", self.default_k)
            parts.append(evaluation(questions, R.matched_children(hits, children)).withColumn("strategy", F.lit(name)))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out.select("strategy", "qid", "question", "best_score", "n_parents", "n_children", "n_docs")


def extracted(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Items with their reply (columns item, raw, answer) to one row per field."""
    rows = rows.withColumn("_object", replies.extract_json(F.coalesce("raw", "answer")))
    own = F.try_variant_get("_object", F.concat(F.lit("$['"), "item", F.lit("']")), "map<string,string>")
    rows = rows.withColumn("_own", own).drop("_object")
    value = lambda f: F.when(F.col("_own").isNull(), F.lit("not found")).otherwise(F.coalesce(F.try_element_at("_own", F.lit(f)), F.lit("N/A")))
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), value(f).alias("value")) for f in fields))
    return rows.withColumn("_pairs", pairs).drop("_own").select("*", F.inline("_pairs")).drop("_pairs")


def evaluation(questions: DataFrame, matched: DataFrame) -> DataFrame:
    """What was found for each question: best score and counts; nothing found counts as 0."""
    found = matched.groupBy("qid").agg(F.max("score").alias("best_score"), F.count_distinct("parent_id").alias("n_parents"), F.count("*").alias("n_children"), F.count_distinct("doc_name").alias("n_docs"))
    out = questions.select("qid", F.substring("question", 1, 60).alias("question")).join(found, "qid", "left")
    return out.na.fill(0.0, ["best_score"]).na.fill(0, ["n_parents", "n_children", "n_docs"])
