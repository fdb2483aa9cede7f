"""Dense, sparse and fused top-k, gates, and the parents of what was found. Ties go to the smaller child_idx everywhere."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_broad
from ..sources.kept import kept
from . import bm25, pivots
from .pivots import rows_of

RRF_K, THRESHOLD, DEFAULT_K, SMALL_CORPUS = 60, 0.15, 10, 50
DENSE_FACTOR, RERANK_FACTOR = 2, 5
BROAD_TOKENS, USUAL_TOKENS = 4096, 2048
MODES = ("dense", "sparse", "hybrid")
#: Decimals to which scores are rounded before they are ranked, so that the order of summation doesn't decide.
DECIMALS = 6
#: Units and questions of one block of the dense search at most, but for the unevenness of a hash.
UNIT_BLOCK, QUESTION_BLOCK = 16_384, 4096


def top_k(scored: DataFrame, k: Column | int, id_col: str = "id", by: str = "score") -> DataFrame:
    """Adds rank from 1 within qid and keeps k. A constant k is cut in each task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(by), id_col))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def _block_top_k(k: int):
    def compare(units: pa.Table, questions: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if units.num_rows and questions.num_rows:
            ids, qids = units["id"].to_numpy(), questions["qid"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, u, q = ids[order], rows_of(units["vector"])[order], rows_of(questions["vector"])
            for at in range(0, len(q), 256):
                near = np.round(q[at : at + 256] @ u.T, DECIMALS)
                # Only what isn't under the k-th is sorted; what isn't a number comes last.
                by = np.fmax(near, -2.0)
                least = np.partition(by, len(ids) - k, axis=1)[:, len(ids) - k, None] if k < len(ids) else -2.0
                row, unit = np.nonzero(by >= least)
                best = np.lexsort((unit, -by[row, unit], row))
                best = best[np.arange(len(row)) - np.searchsorted(row, row) < k]
                row, unit = row[best], unit[best]
                out.append((qids[at + row], ids[unit], near[row, unit]))
        qid, id_, score = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"qid": pa.array(qid, pa.int64()), "id": pa.array(id_, pa.int64()), "score": pa.array(score, pa.float64())})

    return compare


def dense_top_k(questions: DataFrame, units: DataFrame, k: int, id_col: str = "id", visits: dict[str, int] | None = None) -> DataFrame:
    """(qid, id, score, rank): the k units of the largest cosine, exactly. Ids are integers; null vectors take no part.

    Units of more than a block lie in cells round pivots. A question first visits the nearest cells, then those that can have
    a unit among its k best, see pivots. Cells and the questions that visit one are cut into blocks of bounded rows; a block
    passes on its own k best of each question, so pairs don't leave it. Units are copied once for every QUESTION_BLOCK
    questions. visits, if given, gets the numbers of visited and of all pairs of a question and a cell.
    """
    u = units.select(F.col(id_col).cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).where("vector is not null")
    q = questions.select(F.col("qid").cast("long").alias("qid"), F.col("vector").cast("array<double>").alias("vector")).where("vector is not null")
    total, asked = u.count(), q.count()
    blocks = max(1, -(-asked // QUESTION_BLOCK))
    part = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))

    def compare(u: DataFrame, q: DataFrame) -> DataFrame:
        """Of rows with cell and cuts, the number of parts of the cell."""
        own = u.withColumn("cut", part("id", F.col("cuts"))).withColumn("block", every(F.lit(blocks))).groupBy("cell", "cut", "block")
        by = q.withColumn("block", part("qid", F.lit(blocks))).withColumn("cut", every(F.col("cuts"))).groupBy("cell", "cut", "block")
        found = own.cogroup(by).applyInArrow(_block_top_k(k), "qid long, id long, score double")
        return found.withColumn("score", F.round("score", DECIMALS))

    if total <= UNIT_BLOCK:
        one = lambda df: df.withColumn("cell", F.lit(0)).withColumn("cuts", F.lit(1))
        return top_k(compare(one(u), one(q)), k)
    u, cells = pivots.cells_of(u, total)
    cuts = F.element_at(F.array(*(F.lit(max(1, -(-int(n) // UNIT_BLOCK))) for n in cells.sizes)), F.col("cell") + 1)
    u, schema = u.withColumn("cuts", cuts), "qid long, vector array<double>, cell int"
    first = q.mapInArrow(pivots.first_visits(cells, k), schema)
    near = kept(top_k(compare(u, first.withColumn("cuts", cuts)), k))
    tau = near.where(F.col("rank") == k).select("qid", F.col("score").alias("tau"))
    more = kept(q.join(tau, "qid", "left").select("qid", "vector", "tau").mapInArrow(pivots.further_visits(cells, k), schema))
    if visits is not None:
        visits |= {"visited": first.count() + more.count(), "pairs": asked * int((cells.sizes > 0).sum())}
    return top_k(near.drop("rank").unionByName(compare(u, more.withColumn("cuts", cuts))), k)


def sparse_scores(questions: DataFrame, units: DataFrame | bm25.Index, k: int, id_col: str = "child_idx", text_col: str = "embed_text") -> DataFrame:
    """(qid, id, score, rank): the k best by BM25 of units or of an index of them. Where fewer units match, the first others
    fill up with 0.

    Only questions with fewer than k positive scores need others, and only the units with the least ids can be needed.
    """
    indexed = units if isinstance(units, bm25.Index) else bm25.index(units, id_col, text_col)
    # Each segment gives its k best: a question that has fewer than k positive scores has all its matches here.
    scored = kept(bm25.search(indexed, questions, k).select("qid", "id", F.round("score", DECIMALS).alias("score")))
    # A match with a negative or zero score ties with or loses to units that don't match at all.
    best = top_k(scored.where("score > 0"), k).drop("rank")
    enough = best.groupBy("qid").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    needy = questions.select("qid").distinct().join(enough, "qid", "left_anti")
    low = scored.where("score <= 0").join(needy, "qid", "left_semi").select("qid", "id", "score")
    # Each of a question's k places may need one of them, and up to k of the first ids may be matches already.
    filler = indexed.ids if 2 * k >= indexed.n else indexed.ids.orderBy("id").limit(2 * k)
    fill = needy.join(filler, F.lit(True)).join(scored.select("qid", "id"), ["qid", "id"], "left_anti").withColumn("score", F.lit(0.0))
    return top_k(best.unionByName(low).unionByName(fill), k)


def normalised_sparse(hits: DataFrame) -> DataFrame:
    """Scores divided by the best of their question; all 0 where that isn't positive."""
    best = F.max("score").over(Window.partitionBy("qid"))
    return hits.withColumn("score", F.when(best > 0, F.round(F.col("score") / best, DECIMALS)).otherwise(F.lit(0.0)))


def fuse(dense: DataFrame, sparse: DataFrame, k: int) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (qid, id, rank): score, rank. Ties: first of the dense list, then of the sparse."""
    both = dense.select("qid", "id", F.col("rank").alias("d"), F.lit(None).cast("int").alias("s")).unionByName(sparse.select("qid", "id", F.lit(None).cast("int").alias("d"), F.col("rank").alias("s")))
    one = both.groupBy("qid", "id").agg(F.max("d").alias("d"), F.max("s").alias("s"))
    part = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    one = one.withColumn("score", part("d") + part("s"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("d"), F.asc_nulls_last("s"))
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "id", "score", "rank")


def retrieve(questions: DataFrame, units: DataFrame, mode: str = "dense", k: int = DEFAULT_K, indexed: bm25.Index | None = None) -> DataFrame:
    """(qid, id, score, rank, best_score). units: child_idx, embed_text, vector; questions: qid, question, vector; indexed: the
    units' index, if it is built already. best_score is what the gate looks at: the best cosine in dense and hybrid mode, the
    normalised best in sparse mode."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; known: {', '.join(MODES)}")
    if mode == "sparse":
        hits = normalised_sparse(sparse_scores(questions, indexed or units, k))
        return hits.withColumn("best_score", F.max("score").over(Window.partitionBy("qid")))
    wide = dense_top_k(questions, units, k if mode == "dense" else DENSE_FACTOR * k, "child_idx")
    wide = wide.withColumn("best_score", F.max("score").over(Window.partitionBy("qid")))
    if mode == "dense":
        return wide
    best = wide.groupBy("qid").agg(F.max("best_score").alias("best_score"))
    return fuse(wide, sparse_scores(questions, indexed or units, DENSE_FACTOR * k), k).join(best, "qid")


def matched_children(hits: DataFrame, children: DataFrame) -> DataFrame:
    """Hits with their child's columns; hits without a child are left out. Hits are written first, so that Spark knows how few
    they are before it moves the children."""
    return kept(hits).join(children.withColumnRenamed("child_idx", "id"), "id")


def matched_parents(matched: DataFrame, parents: DataFrame) -> DataFrame:
    """Each question's parents once, by their best child: parent_rank from 1."""
    first = matched.groupBy("qid", "parent_id").agg(F.min("rank").alias("first_rank"))
    first = first.withColumn("parent_rank", F.row_number().over(Window.partitionBy("qid").orderBy("first_rank")))
    return kept(first).join(parents, "parent_id")


def gate(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Adds blocked and reason from best_score (null counts as 0): blocked if it is below the threshold. Fixed wording."""
    best = F.coalesce(F.col("best_score"), F.lit(0.0))
    reason = F.format_string(
        "No sufficiently relevant settlement instructions found (best retrieval score %.3f < threshold %.3f). The queried instrument or currency may not be in the SSI corpus.",
        F.round(best, 3),
        F.lit(threshold),
    )
    return rows.withColumn("blocked", best < threshold).withColumn("reason", F.when(best < threshold, reason))


def policy(questions: DataFrame, n_children: int, k: int | None = None, default_k: int = DEFAULT_K, rerank: bool = False) -> DataFrame:
    """Adds broad, k, fetch_k (what retrieval asks for) and max_tokens. A given k wins; a broad question takes everything."""
    broad = is_broad(F.col("question"))
    asked = F.lit(k) if k is not None else F.when(broad, F.lit(n_children)).otherwise(F.lit(default_k))
    fetch = F.least(asked * RERANK_FACTOR, F.lit(n_children)) if rerank else asked
    return questions.withColumn("broad", broad).withColumn("k", asked.cast("long")).withColumn("fetch_k", fetch.cast("long")).withColumn("max_tokens", F.when(broad, F.lit(BROAD_TOKENS)).otherwise(F.lit(USUAL_TOKENS)).cast("long"))


def rerank(matched: DataFrame, score: Column, n: int) -> DataFrame:
    """The n best by another score, kept as rerank_score to four decimals; rank is renumbered."""
    return top_k(matched.drop("rank").withColumn("rerank_score", F.round(score, 4)), n, by="rerank_score")


def overlap_score(question: Column, text: Column) -> Column:
    """An offline stand-in for a cross-encoder: the part of the question's distinct tokens that the text has."""
    from ..functions.text import tokens

    q = F.array_distinct(tokens(question))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(text))) / F.size(q)).otherwise(F.lit(0.0))
