"""Nearest neighbours by an inverted multi-index: two quantised halves, centroid pairs by a heap, exact reranking."""

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch

#: Vectors that the codebooks and the length of the search are fitted on at most, those with the least hash of their id.
SAMPLE = 20_000
#: Queries of the sample whose true neighbours set the length of the search, and the part of them that it has to reach.
TRIALS, REACHED = 200, 0.97
MOST_CENTROIDS = 128
#: Vectors of a group of cells, about twice as many of which a task holds at most; queries stream past them.
GROUP_VECTORS = 20_000


def normalised(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors**2).sum(axis=-1, keepdims=True))


def k_means(points: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), k, replace=len(points) < k)]
    for _ in range(rounds):
        at = nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, points)
        counts = np.bincount(at, minlength=k)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (points**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * points @ centres.T


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return distances(points, centres).argmin(axis=1)


@dataclass
class Codebooks:
    first: np.ndarray
    second: np.ndarray

    @property
    def half(self) -> int:
        return self.first.shape[1]

    def cells(self, unit: np.ndarray) -> np.ndarray:
        return nearest(unit[:, : self.half], self.first) * len(self.second) + nearest(unit[:, self.half :], self.second)

    def traverse(self, unit: np.ndarray, sizes: np.ndarray, wanted: int) -> list[int]:
        """Cells by the sum of their two distances, from a heap over the grid of sorted halves, until their sizes add up to
        what is wanted."""
        a = distances(unit[None, : self.half], self.first)[0]
        b = distances(unit[None, self.half :], self.second)[0]
        order_a, order_b = a.argsort(kind="stable").tolist(), b.argsort(kind="stable").tolist()
        a, b, width = np.sort(a).tolist(), np.sort(b).tolist(), len(self.second)
        heap, out, found = [(a[0] + b[0], 0, 0)], [], 0
        while heap and found < wanted:
            _, i, j = heapq.heappop(heap)
            cell = order_a[i] * width + order_b[j]
            if sizes[cell]:
                out.append(cell)
                found += sizes[cell]
            if j + 1 < len(b):
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
        return out


def fit(sample: np.ndarray, total: int, k: int) -> tuple[Codebooks, float]:
    """Codebooks, and the part of all vectors that a search has to look through.

    The part is what REACHED of the true k nearest of TRIALS sample vectors needed within the sample. A larger set is
    denser, so its neighbours are closer and need no larger part.
    """
    unit = normalised(sample)
    half = max(1, unit.shape[1] // 2)
    count = int(np.clip(round(np.sqrt(total / 12)), 1, MOST_CENTROIDS))
    count = min(count, len(unit))
    books = Codebooks(k_means(unit[:, :half], count, 1), k_means(unit[:, half:], count, 2) if unit.shape[1] > half else np.zeros((1, 0)))
    cells = books.cells(unit)
    sizes = np.bincount(cells, minlength=len(books.first) * len(books.second))
    needs = []
    for i in np.linspace(0, len(unit) - 1, min(TRIALS, len(unit))).astype(int):
        near = unit @ unit[i]
        near[i] = -2
        best = np.argsort(-near, kind="stable")[: min(k, len(unit) - 1)]
        upto = np.cumsum(sizes[order := books.traverse(unit[i], sizes, len(unit) + 1)])
        place = {c: int(n) for c, n in zip(order, upto, strict=True)}
        needs += [place[c] for c in cells[best]]
    part = float(np.quantile(needs, REACHED)) / len(unit) if needs else 1.0
    return books, min(1.0, part * 1.02)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


class _Group:
    """The vectors of a group of cells, by cell, then id."""

    def __init__(self, parts: list[pa.RecordBatch]):
        ids, cells, rows = (np.concatenate(x) for x in zip(*((p["id"].to_numpy(), p["cell"].to_numpy(), _matrix(p["vector"])) for p in parts), strict=True))
        order = np.lexsort((ids, cells))
        self.ids, self.cells, self.rows = ids[order], cells[order], rows[order]
        self.norms = np.sqrt((self.rows**2).sum(axis=1))

    def best(self, queries: pa.RecordBatch, k: int) -> pa.RecordBatch:
        """The k best of each query in those of its cells that are here."""
        q_ids, q_rows = queries["id"].to_numpy(), _matrix(queries["vector"])
        q_norms = np.sqrt((q_rows**2).sum(axis=1))
        looks = queries["cells"]
        q_at, q_cell = np.repeat(np.arange(len(q_ids)), np.diff(looks.offsets.to_numpy())), looks.flatten().to_numpy()
        by_cell = np.argsort(q_cell, kind="stable")
        q_at, q_cell = q_at[by_cell], q_cell[by_cell]
        best: list[list] = [[] for _ in q_ids]
        for cell in np.unique(q_cell):
            a, b = np.searchsorted(self.cells, (cell, cell + 1))
            if a == b:
                continue
            who = q_at[slice(*np.searchsorted(q_cell, (cell, cell + 1)))]
            near = (q_rows[who] @ self.rows[a:b].T) / self.norms[a:b]
            near[q_ids[who][:, None] == self.ids[a:b]] = -np.inf
            top = min(k, b - a)
            least = -np.partition(-near, top - 1, axis=1)[:, top - 1]
            # Rounding of the product may part equal scores, so what is as good within rounding stays.
            row, col = np.nonzero((near >= least[:, None] - 1e-9 * q_norms[who][:, None]) & (near > -np.inf))
            for r, c in zip(who[row].tolist(), (a + col).tolist(), strict=True):
                best[r].append(c)
        out_q, out_v, out_s = [], [], []
        for r, at in enumerate(best):
            if at:
                at = np.array(at)
                # One order of summation for every pair, so equal vectors score alike.
                score = (q_rows[r] * self.rows[at]).sum(axis=1) / (q_norms[r] * self.norms[at])
                keep = np.lexsort((self.ids[at], -score))[:k]
                out_q += [q_ids[r]] * len(keep)
                out_v += self.ids[at[keep]].tolist()
                out_s += score[keep].tolist()
        return pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_v, pa.int64()), pa.array(out_s, pa.float64())], names=["query_id", "vec_id", "score"])


def _compare(k: int):
    """Rows of groups (g, cut), in each of them the vectors (side 0) before the queries (side 1): the vectors are held, the
    queries pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, group = [], None, None
        for batch in batches:
            marks = np.stack([batch[c].to_numpy().astype(np.int64) for c in ("g", "cut", "side")]) if batch.num_rows else np.zeros((3, 0), np.int64)
            cuts = [0, *(np.flatnonzero((np.diff(marks, axis=1) != 0).any(axis=0)) + 1), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if tuple(marks[:2, a]) != key:
                    held, key, group = [], tuple(marks[:2, a]), None
                part = batch.slice(int(a), int(b - a))
                if marks[2, a] == 0:
                    held.append(part)
                elif held or group:
                    group = group or _Group(held)
                    held = []
                    yield group.best(part, k)

    return run


def search(embeddings: DataFrame, is_query: str, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's k nearest found by cosine: query_id, rank, vec_id, score. is_query: a SQL condition on the column id.

    Every vector is indexed. Vectors that are null, zero, or hold null or non-finite components take no part, nor do those
    whose length isn't the most common one, and rows with a null id. Rows that share an id count once, with the least
    vector. Of equal vectors only the k + 1 least ids can be among a query's k nearest, so a vector that fills a large part
    of the table is indexed with those. Ties go to the smaller id. An empty table, or one vector alone, gives no rows.
    Other columns are not read.
    """
    spark, scratch = embeddings.sparkSession, Scratch(embeddings.sparkSession, "ann")
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where("id is not null and size(vector) > 0").where(finite).where(F.exists("vector", lambda x: x != 0))
    size = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if size is None:
        return empty
    rows = scratch.write(rows.where(F.size("vector") == size.d).groupBy("id").agg(F.min("vector").alias("vector")), "vectors")
    least = Window.partitionBy("vector").orderBy("id")
    indexed = rows.withColumn("n", F.row_number().over(least)).where(F.col("n") <= k + 1).drop("n")
    indexed = scratch.write(indexed, "distinct")
    total = indexed.count()
    sample = indexed.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toArrow()
    books, part = fit(_matrix(sample["vector"]), total, k)
    wanted = int(np.ceil(part * total))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = books.cells(normalised(_matrix(batch.column(1)))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells.astype(np.int32))], names=["id", "vector", "cell"])

    indexed = scratch.write(indexed.mapInArrow(assign, "id long, vector array<double>, cell int"), "cells")
    sizes = np.zeros(len(books.first) * len(books.second), np.int64)
    for r in indexed.groupBy("cell").count().collect():  # at most MOST_CENTROIDS squared
        sizes[r.cell] = r["count"]
    # Cells go to groups of bounded size, largest first into the emptiest; a cell larger than a group is cut by its ids.
    groups = max(8, int(np.ceil(total / GROUP_VECTORS)))
    heap, group_of = [(0, g) for g in range(groups)], np.zeros(len(sizes), np.int32)
    for cell in np.argsort(-sizes, kind="stable"):
        if sizes[cell]:
            n, g = heapq.heappop(heap)
            group_of[cell] = g
            heapq.heappush(heap, (n + int(sizes[cell]), g))
    loads = np.bincount(group_of, sizes, groups)
    cuts = np.maximum(1, np.ceil(loads / (2 * GROUP_VECTORS))).astype(int)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            who, where, looks = [], [], []
            for i, unit in enumerate(normalised(_matrix(batch.column(1)))):
                cells = np.array(books.traverse(unit, sizes, wanted), np.int32)
                own = group_of[cells]
                for g in np.unique(own):
                    who.append(i)
                    where.append(int(g))
                    looks.append(cells[own == g])
            at = pa.array(who, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(where, pa.int32()), pa.array(looks, pa.list_(pa.int32()))], names=["query_id", "vector", "g", "cells"])

    n_cuts = F.element_at(F.array(*map(F.lit, cuts.tolist())), F.col("g") + 1)
    queries = rows.where(is_query).repartition(spark.sparkContext.defaultParallelism)
    routed = queries.mapInArrow(route, "query_id long, vector array<double>, g int, cells array<int>").withColumn("cut", F.explode(F.sequence(F.lit(0), n_cuts - 1)))
    to_group = spark.createDataFrame(pd.DataFrame({"cell": np.arange(len(sizes), dtype=np.int32), "g": group_of}), "cell int, g int")
    placed = indexed.join(F.broadcast(to_group), "cell").withColumn("cut", F.pmod(F.xxhash64("id"), n_cuts).cast("int"))
    placed = placed.select("g", "cut", F.lit(0).alias("side"), "id", "vector", "cell", F.lit(None).cast("array<int>").alias("cells"))
    routed = routed.select("g", "cut", F.lit(1).alias("side"), F.col("query_id").alias("id"), "vector", F.lit(None).cast("int").alias("cell"), "cells")
    dealt = placed.unionByName(routed).repartition(int(cuts.sum()), "g", "cut").sortWithinPartitions("g", "cut", "side")
    found = dealt.mapInArrow(_compare(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_sql(k: int = 5, every: int = 50) -> str:
    """Brute force, to measure recall against."""
    return f"""SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score
FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % {every} = 0
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, e.vec_id) <= {k}"""
