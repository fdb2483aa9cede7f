"""Toxicity: a factorization machine over hashed terms."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import split_stops
from .storage import Scratch
from .textscan import mix, slices, utf8, word_bounds, word_hashes

BITS = 18
#: Labelled rows of each class that training reads at most, those with the least hash of their id.
SAMPLE_PER_CLASS = 4000
#: Terms that enter the machine at most, those with the most telling counts; and the least chi-square that tells.
TERMS, CHI_SQUARE = 4096, 20.0
FACTORS, EPOCHS, RATE, SHRINK = 8, 60, 0.1, 1e-4
#: Word beginnings of so many bytes are terms beside whole words, so that inflected forms share one.
STEMS = (4, 5)


def held_out(id_: Column) -> Column:
    """Rows that are kept from training: one in five by the checksum of the id; a null id is in neither part."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hashed term) of all words, lower-cased in ASCII, and of their beginnings where they are long enough; repeats included."""
    starts, ends, _ = word_bounds(data, offsets)
    starts, ends = split_stops(data, starts, ends)
    row = np.searchsorted(offsets, starts, "right") - 1
    rows, found = [row], [word_hashes(data, starts, ends)]
    for n in STEMS:
        longer = ends - starts >= n
        rows.append(row[longer])
        found.append(mix(word_hashes(data, starts[longer], starts[longer] + n) + np.uint64(n)))
    return np.concatenate(rows), (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int32)


def _sampled_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        sets = []
        for a, b in slices(offsets):
            row, term = terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            keys = np.unique(row.astype(np.int64) << BITS | term)
            row, term = keys >> BITS, (keys & ((1 << BITS) - 1)).astype(np.int32)
            cuts = np.searchsorted(row, np.arange(b - a + 1))
            sets += [term[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int32()))], names=["label", "terms"])


@dataclass
class Machine:
    """Logit = bias + sum of weights + sum over pairs of the products of their factors, over a text's distinct terms."""

    bias: float
    chosen: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, texts: int, row: np.ndarray, place: np.ndarray) -> np.ndarray:
        linear = np.bincount(row, self.weights[place], texts)
        sums = np.zeros((texts, self.factors.shape[1]))
        np.add.at(sums, row, self.factors[place])
        squares = np.bincount(row, (self.factors[place] ** 2).sum(axis=1), texts)
        return self.bias + linear + 0.5 * ((sums**2).sum(axis=1) - squares)

    def scores(self, data: np.ndarray, offsets: np.ndarray, places: np.ndarray) -> np.ndarray:
        row, term = terms(data, offsets)
        place = places[term]
        keys = np.unique(row[place >= 0].astype(np.int64) << 16 | place[place >= 0])
        return 1 / (1 + np.exp(-np.clip(self.logits(len(offsets) - 1, keys >> 16, keys & 0xFFFF), -30, 30)))


def train(labels: np.ndarray, row: np.ndarray, place: np.ndarray, chosen: np.ndarray, prior: float, seed: int = 1) -> Machine:
    """Fits by Adam on all samples at once; the bias is then moved from the sample's share of label 1 to the prior."""
    rng = np.random.default_rng(seed)
    n, m = len(labels), max(1, len(chosen))
    share = np.clip(labels.mean() if n else prior, 1e-3, 1 - 1e-3)
    machine = Machine(float(np.log(share / (1 - share))), chosen, np.zeros(m), rng.normal(0, 0.05, (m, FACTORS)))
    moments = [np.zeros((2, *x.shape)) for x in (np.zeros(1), machine.weights, machine.factors)]
    for step in range(1, EPOCHS + 1 if n else 1):
        miss = 1 / (1 + np.exp(-np.clip(machine.logits(n, row, place), -30, 30))) - labels
        sums = np.zeros((n, FACTORS))
        np.add.at(sums, row, machine.factors[place])
        slope = np.zeros_like(machine.factors)
        np.add.at(slope, place, miss[row, None] * (sums[row] - machine.factors[place]))
        slopes = [np.array([miss.mean()]), np.bincount(place, miss[row], m) / n + SHRINK * machine.weights, slope / n + SHRINK * machine.factors]
        moves = []
        for g, (a, b) in zip(slopes, moments, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            moves.append(RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8))
        machine.bias -= float(moves[0][0])
        machine.weights -= moves[1]
        machine.factors -= moves[2]
    prior = np.clip(prior, 1e-4, 1 - 1e-4)
    machine.bias += float(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    return machine


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """A machine from at most SAMPLE_PER_CLASS labelled rows of each class outside the held-out part.

    Rows with a null id, label or text, and labels other than 0 and 1, aren't used. Without labelled rows the score is
    the same for every text.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").where(~held_out(F.col("id")))
    usable = usable.groupBy("id").agg(F.max("label").alias("label"))
    sizes = {r.label: r["count"] for r in usable.groupBy("label").count().collect()}
    ones = sizes.get(1, 0) / max(1, sum(sizes.values()))
    parts = [usable.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_PER_CLASS) for c in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    sample = texts.join(F.broadcast(chosen), "id").select("label", "text").mapInArrow(_sampled_terms, "label int, terms array<int>")
    sample = scratch.write(sample, "sample")
    n, n1 = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    counts = sample.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("a"), F.sum("label").alias("b"))
    n0 = n - n1
    spread = f"(b * {float(n0)} - (a - b) * {float(n1)})"
    telling = counts.where(f"a >= 4 and a < {n}").withColumn("chi", F.expr(f"{float(n)} * {spread} * {spread} / (cast(a as double) * ({float(n)} - a) * {max(1.0, float(n0) * n1)})"))
    telling = telling.where(F.col("chi") >= CHI_SQUARE).orderBy(F.desc("chi"), "term").limit(TERMS)
    best = np.array(sorted(r.term for r in telling.collect()), np.int64)
    picked = sample.select("label", F.array_intersect("terms", F.lit([int(x) for x in best]) if len(best) else F.expr("cast(array() as array<int>)")).alias("terms")).collect()
    label = np.array([r.label for r in picked], float)
    row = np.repeat(np.arange(len(picked)), [len(r.terms) for r in picked]).astype(np.int64)
    place = np.searchsorted(best, np.array([t for r in picked for t in r.terms], np.int64))
    return train(label, row, place, best, ones)


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) of every row; null and empty texts get the score of no terms."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(_scorer(machine, 1, None), f"`{id_col}` {kind}, score double")


def _scorer(machine: Machine, at: int, reject: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = np.full(1 << BITS, -1, np.int64)
        places[machine.chosen] = np.arange(len(machine.chosen))
        for batch in batches:
            data, offsets = utf8(batch.column(at))
            parts = [machine.scores(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], places) for a, b in slices(offsets)]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            if reject is None:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=[batch.schema.names[0], "score"])
            else:
                yield batch.filter(pa.array(scores < reject))

    return run


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per input row: id_col, held_out, score, predicted.

    Null and empty texts have no terms and get the machine's bias. Null ids pass through and aren't held out; repeated
    rows are scored once each; only the text enters a score. An empty table gives an empty result.
    """
    scored = score(docs, fit(docs, labels, id_col, text_col, label_col), id_col, text_col)
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of docs with a score under 0.5, with all their columns."""
    machine = fit(docs, labels, id_col, text_col, label_col)
    return docs.mapInArrow(_scorer(machine, docs.columns.index(text_col), 0.5), docs.schema)
