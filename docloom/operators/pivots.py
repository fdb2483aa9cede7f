"""Exact dense top-k over many units: cells round pivots, and the triangle inequality of angles that spares whole cells.

The angle between a question and a unit is at least the difference of their angles to a pivot. So a cell, the units nearest
to one pivot, has a bound for each question, and cells whose bound is under the k-th best so far are not visited.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.kept import kept

#: Pivots: as many as are worth it for the number of units, but never more than this; they and their cells' sizes are collected.
UNITS_OF_A_CELL, PIVOTS = 2048, 1024
#: Cosines that are nearer than this are told apart by id, so cells aren't spared for less.
SLACK = 2e-6


def rows_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows, at length 1; zero vectors stay as they are."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(length == 0, 1.0, length)


def angles(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ pivots.T, -1.0, 1.0))


@dataclass(frozen=True)
class Cells:
    """pivots, and of each one's units their number and their least and largest angle to it. Zero vectors are a cell of their
    own, the last: their cosine to anything is 0."""

    pivots: np.ndarray
    sizes: np.ndarray
    nearest: np.ndarray
    farthest: np.ndarray

    def bounds(self, rows: np.ndarray) -> np.ndarray:
        """What no cosine of a row to a unit of a cell is above; -inf for empty cells."""
        at = angles(rows, self.pivots)
        apart = np.maximum(0.0, np.maximum(at - self.farthest[:-1], self.nearest[:-1] - at))
        out = np.concatenate((np.cos(np.minimum(apart, np.pi)), np.zeros((len(rows), 1))), axis=1)
        out[~rows.any(axis=1)] = 0.0
        return np.where(self.sizes > 0, out, -np.inf)


def cells_of(units: DataFrame, total: int) -> tuple[DataFrame, Cells]:
    """(id, vector, cell) of units (id, vector), and their cells. Pivots are the units with the least hashes."""
    wanted = max(1, min(PIVOTS, total // UNITS_OF_A_CELL))
    sample = units.where(F.exists("vector", lambda x: x != 0)).orderBy(F.xxhash64("id"), "id").limit(wanted).select("vector").toArrow()
    pivots = rows_of(sample["vector"]) if sample.num_rows else np.zeros((0, len(units.select("vector").first()[0])))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                rows = rows_of(batch["vector"])
                at = angles(rows, pivots) if len(pivots) else np.zeros((len(rows), 1))
                some = rows.any(axis=1)
                cell = np.where(some, at.argmin(axis=1), len(pivots))
                yield pa.RecordBatch.from_arrays([batch["id"], batch["vector"], pa.array(cell.astype(np.int32)), pa.array(np.where(some, at.min(axis=1), 0.0))], names=["id", "vector", "cell", "angle"])

    placed = kept(units.mapInArrow(assign, "id long, vector array<double>, cell int, angle double"))
    sizes, nearest, farthest = np.zeros(len(pivots) + 1, np.int64), np.zeros(len(pivots) + 1), np.zeros(len(pivots) + 1)
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("a"), F.max("angle").alias("b")).collect():
        sizes[r.cell], nearest[r.cell], farthest[r.cell] = r.n, r.a - 1e-7, r.b + 1e-7
    return placed.drop("angle"), Cells(pivots, sizes, nearest, farthest)


def first_visits(cells: Cells, k: int):
    """(qid, vector): the cells of the best bounds that together have k units, as rows (qid, vector, cell, tau)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                order = np.argsort(-cells.bounds(rows_of(batch["vector"])), axis=1, kind="stable")
                held = np.cumsum(cells.sizes[order], axis=1) - cells.sizes[order]
                row, place = np.nonzero((held < k) & (cells.sizes[order] > 0))
                yield _rows(batch, row, order[row, place])

    return run


def further_visits(cells: Cells, k: int):
    """(qid, vector, tau): the other cells whose bound isn't under tau, the k-th best so far; all of them if it is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                bounds = cells.bounds(rows_of(batch["vector"]))
                order = np.argsort(-bounds, axis=1, kind="stable")
                held = np.cumsum(cells.sizes[order], axis=1) - cells.sizes[order]
                tau = batch["tau"].to_numpy(zero_copy_only=False)
                tau = np.where(np.isnan(tau), -np.inf, tau)
                row, place = np.nonzero((held >= k) & (cells.sizes[order] > 0) & (np.take_along_axis(bounds, order, axis=1) >= tau[:, None] - SLACK))
                yield _rows(batch, row, order[row, place])

    return run


def _rows(batch: pa.RecordBatch, row: np.ndarray, cell: np.ndarray) -> pa.RecordBatch:
    at = pa.array(row)
    return pa.RecordBatch.from_arrays([batch["qid"].take(at), batch["vector"].take(at), pa.array(cell.astype(np.int32))], names=["qid", "vector", "cell"])
