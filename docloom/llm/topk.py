"""Exact top-k by integer inner product: a three-phase uniform threshold over nodes that hold some of the components each.

A node has a block of the vectors, and of these some components only, so its scores are one part of a sum. First the nodes'
local lists give each query a cutoff that its k-th score can't be under; then every node sends what is at least an equal
share of it, since a sum that reaches the cutoff has a part that reaches its share; last, nodes are asked for the missing
parts of what may still be among the best.
"""

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch

#: Nodes that the components are dealt to: more of them have weaker shares of the cutoff, so they would send more.
PARTS = 2
#: Entries of a local list, as a multiple of k.
LISTED = 4
#: Vectors of a block, about.
BLOCK_VECTORS = 20_000
#: Scores that a task holds at a time.
SLICE_SCORES = 1 << 20
#: Queries whose cutoffs are broadcast; more are joined by shuffle.
BROADCAST_QUERIES = 500_000
#: A part's score beyond this counts as this: only components beyond 2 ** 25 or so reach it.
MOST = 1 << 60

_FOUND = "query_id long, vec_id long, part int, score long"


def components(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component as long."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))).cast("long"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


class _Node:
    """Part of the components of a block of vectors, by id."""

    def __init__(self, batches: list[pa.RecordBatch]):
        ids = np.concatenate([b["id"].to_numpy() for b in batches])
        width = len(batches[0]["x"][0])
        order = np.argsort(ids, kind="stable")
        self.ids, self.width = ids[order], width
        self.x = np.concatenate([_matrix(b["x"], width) for b in batches])[order]
        self.most = int(np.abs(self.x.astype(np.float64)).max(initial=0))
        self.as_kind = {kind: self.x.astype(kind) for kind in (np.float32,)}

    def scores(self, queries: np.ndarray) -> np.ndarray:
        """Exact: floating point where no sum leaves its integers, else integers of any size."""
        bound = self.width * self.most * int(np.abs(queries.astype(np.float64)).max(initial=0))
        kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else object
        if kind not in self.as_kind:
            self.as_kind[kind] = self.x.astype(kind)
        found = queries.astype(kind) @ self.as_kind[kind].T
        return np.clip(found, -MOST, MOST) if kind is object else found

    def slices(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        step = max(1, SLICE_SCORES // max(1, len(self.ids)))
        q_ids, x = batch["id"].to_numpy(), _matrix(batch["x"], self.width)
        for a in range(0, len(q_ids), step):
            yield a, q_ids[a : a + step], self.scores(x[a : a + step])

    def best(self, batch: pa.RecordBatch, n: int) -> Iterator[tuple]:
        """The n largest local scores of each query."""
        for _, q_ids, near in self.slices(batch):
            near = near.astype(np.float64)
            near[q_ids[:, None] == self.ids] = -np.inf
            top = np.argpartition(-near, n - 1, axis=1)[:, :n] if n < near.shape[1] else np.broadcast_to(np.arange(near.shape[1]), near.shape)
            score = np.take_along_axis(near, top, axis=1)
            row, col = np.nonzero(score > -np.inf)
            yield q_ids[row], self.ids[top[row, col]], score[row, col]

    def above(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        """All local scores of at least a query's cut."""
        cuts = batch["cut"].to_numpy(zero_copy_only=False)
        for a, q_ids, near in self.slices(batch):
            row, col = np.nonzero((near >= cuts[a : a + len(q_ids), None]) & (q_ids[:, None] != self.ids))
            yield q_ids[row], self.ids[col], near[row, col]

    def asked(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        """The local scores of the vectors that a query asks for."""
        asks = batch["asks"]
        flat, ends = asks.flatten().to_numpy(), asks.offsets.to_numpy() - asks.offsets[0].as_py()
        for a, q_ids, near in self.slices(batch):
            row = np.repeat(np.arange(len(q_ids)), np.diff(ends[a : a + len(q_ids) + 1]))
            ids = flat[ends[a] : ends[a + len(q_ids)]]
            yield q_ids[row], ids, near[row, np.searchsorted(self.ids, ids)]


def _at_nodes(does: Callable[[_Node, pa.RecordBatch], Iterator[tuple]]):
    """Rows of nodes (dim, part, block), in each of them the vectors (side 0) before the queries (side 1): the vectors are held,
    the queries pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = node = None
        for batch in batches:
            marks = np.stack([batch[c].to_numpy() for c in ("dim", "part", "block", "side")])
            for a, b in pairwise([0, *(np.flatnonzero((np.diff(marks, axis=1) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]):
                if a == b:
                    continue
                if tuple(marks[:3, a]) != key:
                    held, key, node = [], tuple(marks[:3, a]), None
                part = batch.slice(a, b - a)
                if not marks[3, a]:
                    held.append(part)
                elif held or node:
                    node = node or _Node(held)
                    held = []
                    for q_ids, ids, score in does(node, part):
                        yield pa.RecordBatch.from_arrays([pa.array(q_ids), pa.array(ids), pa.array(np.full(len(ids), key[1], np.int32)), pa.array(score.astype(np.int64))], names=["query_id", "vec_id", "part", "score"])

    return run


class _Search:
    def __init__(self, rows: DataFrame, is_query: str, k: int, parts: int, scratch: Scratch):
        """rows: (id, x), ids that don't repeat."""
        self.k, self.parts, self.scratch = k, parts, scratch
        least = Window.partitionBy("x").orderBy("id")
        listed = rows.withColumn("_n", F.row_number().over(least)).where(F.col("_n") <= k + 1).select("id", F.size("x").alias("dim"), "x")
        self.listed = scratch.write(listed, "listed")
        cores = rows.sparkSession.sparkContext.defaultParallelism
        self.blocks = max(2 * cores, -(-self.listed.count() // BLOCK_VECTORS))
        self.queries = scratch.write(rows.where(is_query).select("id", F.size("x").alias("dim"), "x"), "queries")
        self.few = self.queries.count() <= BROADCAST_QUERIES
        self.nodes = self._dealt(self.listed.withColumn("block", self._block("id"))).select(*self._columns(0), F.lit(None).cast("long").alias("cut"), F.lit(None).cast("array<long>").alias("asks"))

    def _block(self, of: str) -> Column:
        return F.pmod(F.xxhash64(of), F.lit(self.blocks)).cast("int")

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """A row for each part of the components."""
        parts = F.sequence(F.lit(0), F.lit(self.parts - 1)) if "part" not in rows.columns else F.array("part")
        rows = rows.withColumn("part", F.explode(parts))
        start, end = (F.floor((F.col("part") + i) * F.col("dim") / self.parts).cast("int") for i in (0, 1))
        return rows.withColumn("x", F.slice("x", start + 1, end - start))

    @staticmethod
    def _columns(side: int) -> list:
        return ["dim", "part", "block", F.lit(side).alias("side"), "id", "x"]

    def _ask(self, queries: DataFrame, does) -> DataFrame:
        """What the nodes say to queries (dim, part, block, id, x, cut, asks): _FOUND."""
        dealt = self.nodes.unionByName(queries).repartition(self.parts * self.blocks, "dim", "part", "block")
        return dealt.sortWithinPartitions("dim", "part", "block", "side").mapInArrow(_at_nodes(does), _FOUND)

    def _everywhere(self, queries: DataFrame, does) -> DataFrame:
        spread = self._dealt(queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1)))))
        return self._ask(spread.select(*self._columns(1), "cut", F.lit(None).cast("array<long>").alias("asks")), does)

    def _known(self, found: DataFrame) -> DataFrame:
        """(query_id, vec_id, known, mask): the sum of the parts' scores that are known, and which are."""
        return found.groupBy("query_id", "vec_id").agg(F.sum("score").alias("known"), F.sum(F.expr("shiftleft(1, part)")).cast("int").alias("mask"))

    def _resolved(self, pairs: DataFrame) -> DataFrame:
        """(query_id, vec_id, score) of pairs (query_id, vec_id, known, mask), whose missing parts are asked for where they lie."""
        missing = F.filter(F.sequence(F.lit(0), F.lit(self.parts - 1)), lambda p: F.get(F.array(*(F.col("mask").bitwiseAND(1 << i) for i in range(self.parts))), p) == 0)
        asks = pairs.select("query_id", "vec_id", self._block("vec_id").alias("block"), F.explode(missing).alias("part"))
        asks = asks.groupBy("query_id", "part", "block").agg(F.collect_list("vec_id").alias("asks"))
        asks = self._dealt(asks.join(self.queries.withColumnRenamed("id", "query_id"), "query_id")).withColumnRenamed("query_id", "id")
        found = self._ask(asks.select(*self._columns(1), F.lit(None).cast("long").alias("cut"), "asks"), _Node.asked)
        both = pairs.select("query_id", "vec_id", F.col("known").alias("score")).unionByName(found.select("query_id", "vec_id", "score"))
        return both.groupBy("query_id", "vec_id").agg(F.sum("score").alias("score"))

    def _kth(self, totals: DataFrame, name: str) -> DataFrame:
        """(query_id, name): the k-th largest total of each query that has as many."""
        at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
        return totals.withColumn("_n", at).where(F.col("_n") <= self.k).where(F.col("_n") == self.k).select("query_id", F.col("score").alias(name))

    def best(self) -> DataFrame:
        # First: local lists. Their entries' whole scores give a k-th largest one that the true one can't be under.
        n, k, m = LISTED * self.k, self.k, self.parts
        lists = self._everywhere(self.queries.withColumn("cut", F.lit(None).cast("long")), lambda node, batch: node.best(batch, n))
        best = F.row_number().over(Window.partitionBy("query_id", "part").orderBy(F.desc("score"), "vec_id"))
        lists = self.scratch.write(self._known(lists.withColumn("_n", best).where(F.col("_n") <= n)), "lists")
        totals = self.scratch.write(self._resolved(lists), "totals")
        # A query with fewer than k candidates has no cutoff: all is sent.
        tau, lowest = F.col("tau"), -(1 << 62)
        share = F.coalesce(F.expr(f"tau div {m}") + F.when(tau % m > 0, 1).otherwise(0), F.lit(lowest))
        cuts = self.scratch.write(self.queries.join(self._kth(totals, "tau").withColumnRenamed("query_id", "id"), "id", "left").withColumn("cut", share), "cuts")
        # Second: everything of at least its share of the cutoff. What isn't sent is under that in every part.
        seen = self.scratch.write(self._known(self._everywhere(cuts.select("id", "dim", "x", "cut"), _Node.above)), "seen")
        whole = F.col("mask") == (1 << m) - 1
        exact = seen.where(whole).select("query_id", "vec_id", F.col("known").alias("score")).unionByName(totals).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        exact = self.scratch.write(exact, "exact")
        # A part that wasn't sent is under its share, which bounds the sum.
        bounds = cuts.select(F.col("id").alias("query_id"), "cut").join(self._kth(exact, "tau"), "query_id")
        open_ = seen.where(~whole).join(F.broadcast(bounds) if self.few else bounds, "query_id")
        open_ = open_.where(F.col("known") + (m - F.bit_count("mask")) * (F.col("cut") - 1) >= F.col("tau"))
        # Third: what may still reach the k-th largest score so far is resolved.
        found = exact.unionByName(self._resolved(open_.select("query_id", "vec_id", "known", "mask"))).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(embeddings: DataFrame, is_query: str, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS) -> DataFrame:
    """Each query's k highest scores, all if there are fewer: query_id, rank, vec_id, score. is_query: a SQL condition on id.

    The score is the inner product of the vectors' components, each floor(scale * x); candidates are all vectors of the query's
    length but its own. Ties go to the smaller id. Vectors that are null or hold null or non-finite components take no part,
    nor do rows with a null id; zero vectors do. Rows that share an id count once, with the least vector. Of equal vectors only
    the k + 1 least ids can be among a query's k best, so a vector that fills a large part of the table is listed with those. A
    part of a score beyond 2 ** 60 counts as that. An empty table, or one vector alone, gives no rows. Other columns are not
    read.
    """
    scratch = Scratch(embeddings.sparkSession, "topk")
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where("id is not null and v is not null").where(finite).groupBy("id").agg(F.min("v").alias("v"))
    rows = scratch.write(rows.select("id", components(F.col("v"), scale).alias("x")), "vectors")
    return _Search(rows, is_query, k, parts, scratch).best()


def search_sql(k: int = 20, every: int = 20, scale: float = 64.0) -> str:
    """The same rows in DuckDB."""
    return f"""
WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor({scale} * x)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT q.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.x, c.x) DESC, c.vec_id) AS INTEGER) AS rank, c.vec_id AS vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % {every} = 0
QUALIFY rank <= {k}
"""
