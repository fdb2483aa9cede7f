"""Near-duplicate classes: universal hash minima, banding, signature check, exact check, star components."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .skew import join_counted
from .storage import Scratch
from .textscan import mix, shingle_sets

MINIMA = 192
#: Documents and bytes of text on either side of a block whose pairs one task compares; a longer text is a block of its own.
BLOCK_DOCS, BLOCK_BYTES = 512, 1 << 24
#: Buckets of at most so many documents share a task with others, of so many documents together.
SMALL_BUCKET, TASK_DOCS = 64, 4096
#: A side of at most so many 8-byte ids is broadcast; a larger one is joined by shuffle.
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(7)
_MULTIPLIERS = _rng.integers(0, 2**64, MINIMA, dtype=np.uint64)[:, None]
_ADDENDS = _rng.integers(0, 2**64, MINIMA, dtype=np.uint64)[:, None]
_BLOCK = 512

SIGNED = "doc_id long, n_shingles long, n_bytes long, d1 long, d2 long, minima binary, bands array<long>"


def band_shape(threshold: float, missed: float = 1e-6) -> tuple[int, int]:
    """(bands, rows) with the most rows at which a pair just at the threshold is missed with so small a probability."""
    for rows in range(12, 0, -1):
        bands = MINIMA // rows
        if (1 - threshold**rows) ** bands <= missed:
            return bands, rows
    return MINIMA, 1


def minima(values: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The least of a*x+b mod 2^64 over the upper halves x of the set, for random a and b: the upper half of that, which is
    returned, is a strongly universal hash of x."""
    best = np.full(MINIMA, 2**64 - 1, np.uint64)
    short = values >> np.uint64(32)
    for at in range(0, len(short), _BLOCK):
        part = short[at : at + _BLOCK]
        block = room[:, : len(part)]
        np.multiply(_MULTIPLIERS, part, out=block)
        np.add(block, _ADDENDS, out=block)
        np.minimum(best, block.min(axis=1), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def _signer(k: int, bands: int, rows: int):
    salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
    place = mix(np.arange(1001, 1001 + rows, dtype=np.uint64)) | np.uint64(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = np.empty((MINIMA, _BLOCK), np.uint64)
        for batch in batches:
            n = batch.num_rows
            sizes, digests = np.zeros(n, np.int64), np.zeros((2, n), np.uint64)
            found: list[bytes | None] = [None] * n
            keys = np.zeros((n, bands), np.uint64)
            for i, values in enumerate(shingle_sets(batch.column(1), k)):
                if len(values):
                    sizes[i] = len(values)
                    digests[0, i] = values.sum(dtype=np.uint64)
                    digests[1, i] = mix(values ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                    least = minima(values, room)
                    found[i] = least.astype("<u2").tobytes()
                    wide = least[: bands * rows].reshape(bands, rows).astype(np.uint64)
                    keys[i] = mix((mix(wide) * place).sum(axis=1, dtype=np.uint64) + salt)
            full = sizes > 0
            ends = np.concatenate(([0], np.cumsum(full * bands))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64()), *(pa.array(d.view(np.int64)) for d in digests), pa.array(found, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[full].ravel().view(np.int64)))],
                names=["doc_id", "n_shingles", "n_bytes", "d1", "d2", "minima", "bands"],
            )

    return sign


def _agreeing(least: float):
    """Pairs whose signatures agree in so large a part of their minima."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, MINIMA) for i in (2, 3))
                yield batch.select([0, 1, 4]).filter(pa.array((a == b).mean(axis=1) >= least))

    return check


def _linked(k: int, num: int, den: int):
    """Pairs whose full shingle sets have den * |A and B| >= num * |A or B|."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(shingle_sets(batch.column(2), k), shingle_sets(batch.column(3), k), strict=True):
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both > 0 and den * both >= num * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return check


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right."""
    _, at, counts = np.unique(np.concatenate(left + right), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in left + right])
    often = counts > 1  # what is in one set only is in no intersection
    row, at = row[often[at]], (np.cumsum(often) - 1)[at[often[at]]]
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(often.sum()), 4096):
        a, b = np.searchsorted(at, (low, low + 4096))
        part = np.zeros((len(left) + len(right), 4096), np.float32)
        part[row[a:b], at[a:b] - low] = 1
        out += part[: len(left)] @ part[len(left) :].T
    return out.astype(np.int64)


def _each_bucket(block: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(key, rows of side 0, rows of side 1) of the buckets of a block that have both."""
    keys, side = block["key"].to_numpy(), block["side"].to_numpy()
    order = np.lexsort((side, keys))
    keys, side = keys[order], side[order]
    cuts = np.flatnonzero(np.diff(keys)) + 1
    for own, sides in zip(np.split(order, cuts), np.split(side, cuts), strict=True):
        n = int((sides == 0).sum())
        if 0 < n < len(own):
            yield int(block["key"][int(own[0])].as_py()), own[:n], own[n:]


def _near_in_block(least: float, bands: int):
    """Of the pairs of a bucket in different classes, those that share no earlier band and whose signatures agree in so large
    a part: the documents that have any."""

    def compare(block: pa.Table) -> pa.Table:
        labels = block["label"].to_numpy()
        minima = np.frombuffer(b"".join(block["minima"].to_pylist()), "<u2").reshape(-1, MINIMA)
        keys = block["bands"].combine_chunks().flatten().to_numpy().reshape(-1, bands)
        out_keys, out_ids = [], []
        ids = block["doc_id"].to_numpy()
        for key, left, right in _each_bucket(block):
            differ = labels[left][:, None] != labels[right]
            earlier = np.zeros_like(differ)
            for j in range(bands):
                same = keys[left, j][:, None] == keys[right, j]
                here = same & (keys[left, j] == key)[:, None]
                differ &= ~(earlier & here)
                earlier |= same
            a, b = np.nonzero(differ)
            near = np.zeros(len(a), bool)
            for at in range(0, len(a), 1 << 15):
                part = slice(at, at + (1 << 15))
                near[part] = (minima[left[a[part]]] == minima[right[b[part]]]).mean(axis=1) >= least
            found = np.union1d(left[a[near]], right[b[near]])
            out_keys += [key] * len(found)
            out_ids += ids[found].tolist()
        return pa.table({"key": pa.array(out_keys, pa.int64()), "doc_id": pa.array(out_ids, pa.int64())})

    return compare


def _links_in_block(k: int, num: int, den: int):
    """In each bucket, a link from each document of side 0 to every class of side 1 that it is linked to."""

    def compare(block: pa.Table) -> pa.Table:
        ids, labels = block["doc_id"].to_numpy(), block["label"].to_numpy()
        texts = block["text"].combine_chunks()
        a, b = [], []
        for _, lefts, rights in _each_bucket(block):
            left, right = (list(shingle_sets(texts.take(pa.array(x)), k)) for x in (lefts, rights))
            both = _shared(left, right)
            either = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right]) - both
            linked = (both > 0) & (den * both >= num * either) & (labels[lefts][:, None] != labels[rights])
            for i in np.flatnonzero(linked.any(axis=1)):
                to = rights[linked[i]]
                _, one = np.unique(labels[to], return_index=True)
                a += [ids[lefts[i]]] * len(one)
                b += ids[to[one]].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return compare


def _sized(rows: DataFrame) -> DataFrame:
    """Marked for broadcast if its counted size allows that."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


class _Run:
    def __init__(self, docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int, scratch: Scratch):
        self.texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        self.k, self.num, self.den, self.scratch = k, num, den, scratch
        self.bands, self.rows = band_shape(num / den)
        #: Six standard deviations of the share of agreeing minima below the threshold.
        self.least = num / den - 6 * (num / den * (1 - num / den) / MINIMA) ** 0.5
        self.signed = scratch.write(self.texts.mapInArrow(_signer(k, self.bands, self.rows), SIGNED), "signed")

    def members(self) -> DataFrame:
        """(key, doc_id, n, score): documents, one per distinct set, in the buckets that hold several (n) distinct sets, and the
        sum of the n of a document's buckets."""
        sets = self.signed.where("n_shingles > 0 and doc_id is not null")
        # Copies of a set count once from here, so that a text with very many of them is one row per bucket.
        first = sets.groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"))
        first = self.scratch.write(sets.select("doc_id", "d1", "d2", "bands").join(first, ["doc_id", "d1", "d2"], "left_semi").select("doc_id", "bands"), "one-each")
        exploded = first.select("doc_id", F.explode("bands").alias("key"))
        several = self.scratch.write(exploded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "several")
        sized = self.scratch.write(exploded.join(_sized(several), "key"), "sized")
        # A document near the middle of its class is in many large buckets, so it makes the best centre.
        score = sized.groupBy("doc_id").agg(F.sum("n").alias("score"))
        return self.scratch.write(sized.join(score, "doc_id"), "members")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b), one for each a, that pass the signature check and then the exact check.

        What hangs on a centre b is dealt to parts of about BLOCK_DOCS each; b is sent once to each part, so no key holds more.
        """
        pairs = self.scratch.write(pairs, "pairs")
        sizes = self.scratch.write(pairs.groupBy("b").agg(F.count("*").alias("n")), "hanging")
        parts = F.ceil(F.col("n") / BLOCK_DOCS).cast("int")
        pairs = join_counted(pairs, sizes, ["b"], pairs.count()).select("a", "b", F.pmod(F.xxhash64("a"), parts).cast("int").alias("part"))

        def beside(pairs: DataFrame, source: DataFrame, column: str) -> DataFrame:
            ends = pairs.groupBy("b").agg((F.max("part") + 1).alias("parts")).withColumnRenamed("b", "doc_id")
            ends = source.join(_sized(self.scratch.write(ends, f"{column}-ends")), "doc_id").select(F.col("doc_id").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col(column).alias(f"{column}_b"))
            own = source.join(_sized(pairs.select(F.col("a").alias("doc_id"))), "doc_id").select(F.col("doc_id").alias("a"), F.col(column).alias(f"{column}_a"))
            return pairs.join(own, "a").join(ends, ["b", "part"]).select("a", "b", f"{column}_a", f"{column}_b", "part")

        pairs = self.scratch.write(pairs, "dealt")
        minima = self.signed.where("minima is not null").select("doc_id", "minima")
        near = self.scratch.write(beside(pairs, minima, "minima").mapInArrow(_agreeing(self.least), "a long, b long, part int").distinct(), "near")
        return self.scratch.write(beside(near, self.texts, "text").mapInArrow(_linked(self.k, self.num, self.den), "a long, b long").distinct(), "links")

    def blocks(self, docs: DataFrame, source: DataFrame, name: str):
        """docs (key, doc_id, label, n_bytes) of buckets that hold several classes, grouped for comparison, with their rows of
        source, one for each id.

        In each bucket all documents outside its largest class (side 0) meet all its documents (side 1), in blocks of bounded
        documents and bytes; small buckets share blocks.
        """
        docs = self.scratch.write(docs, name)
        total, size = docs.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
        sizes = docs.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("bytes"))
        plan = sizes.groupBy("key").agg(F.max(F.struct("n", "label", "bytes")).alias("m"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).where("m.n < n")
        parts = lambda n, size: F.ceil(F.greatest(n / BLOCK_DOCS, size / BLOCK_BYTES)).cast("int")
        plan = plan.select("key", "n", F.col("m.label").alias("major"), parts(F.col("n"), F.col("bytes")).alias("blocks"), parts(F.col("n") - F.col("m.n"), F.col("bytes") - F.col("m.bytes")).alias("minor_blocks"))
        docs = join_counted(docs, self.scratch.write(plan, f"{name}-plan"), ["key"], total)
        small = (F.col("n") <= SMALL_BUCKET) & (F.col("blocks") == 1)
        docs = docs.withColumn("g", F.when(small, F.pmod(F.xxhash64("key"), F.lit(max(1, total // TASK_DOCS, size // BLOCK_BYTES)))).otherwise(F.col("key"))).withColumn("small", small)
        docs = self.scratch.write(docs, f"{name}-planned")
        ids = self.scratch.write(docs.select("doc_id").distinct(), f"{name}-ids")
        docs = docs.join(source.join(_sized(ids), "doc_id").dropDuplicates(["doc_id"]), "doc_id")
        part = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        columns = ["small", "g", "i", "j", "key", "side", "doc_id", "label", *(c for c in source.columns if c != "doc_id")]
        left = docs.where("label <> major").withColumn("i", part("minor_blocks")).withColumn("j", every("blocks")).withColumn("side", F.lit(0))
        right = docs.withColumn("j", part("blocks")).withColumn("i", every("minor_blocks")).withColumn("side", F.lit(1))
        return left.select(*columns).unionByName(right.select(*columns)).groupBy("small", "g", "i", "j")

    def between(self, members: DataFrame, labels: DataFrame) -> DataFrame:
        """Links between documents that share a bucket and are still in different classes (node, component).

        Their signatures are compared first, and each pair in one of its buckets only; then the texts of those documents of
        a bucket that have a near partner there, exactly.
        """
        docs = members.select("key", "doc_id").join(labels.toDF("doc_id", "label"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
        signed = self.signed.where("n_shingles > 0")
        blocks = self.blocks(docs.withColumn("n_bytes", F.lit(0).cast("long")), signed.select("doc_id", "minima", "bands"), "open")
        near = blocks.applyInArrow(_near_in_block(self.least, self.bands), "key long, doc_id long").distinct()
        near = self.scratch.write(near, "near-open")
        sizes = signed.groupBy("doc_id").agg(F.max("n_bytes").alias("n_bytes"))
        blocks = self.blocks(near.join(docs, ["key", "doc_id"]).join(sizes, "doc_id"), self.texts, "close")
        return self.scratch.write(blocks.applyInArrow(_links_in_block(self.k, self.num, self.den), "a long, b long").distinct(), "between")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Two documents are linked if den * |A and B| >= num * |A or B| for their sets of k-word shingles; component_id is the
    least id reachable, kept says that it is the document's own. Equal sets count as one document until the end, so
    thousands of copies cost one. A bucket of candidates is not expanded into pairs: each document is checked by signature
    and then exactly against the most central one it shares most buckets with, which joins nearly all of a class. Where a
    bucket then still holds several classes, its documents outside the largest are compared with all of it by signature,
    and those near enough exactly, in blocks of bounded documents and bytes. A link between different texts is lost in two
    ways: banding misses a pair at the threshold with a probability of 2.8e-7 (1e-6 at any threshold), the signature check, six
    standard deviations below the threshold, with one of 2.8e-8 at 0.85 and 1.6e-8 at 0.8; both are less for nearer pairs.

    Null and empty texts have no shingles and no links. Rows with a null id link with nothing; their component_id is
    null and kept is true. Rows that share an id count as one document. An empty table gives an empty result. Other
    columns of docs are not read.
    """
    scratch = Scratch(docs.sparkSession, "near-dedup")
    run = _Run(docs, id_col, text_col, k, num, den, scratch)
    members = run.members()
    centre = members.groupBy("key").agg(F.max(F.struct("score", (-F.col("doc_id")).alias("id"))).alias("c"), F.count("*").alias("n")).select("key", (-F.col("c.id")).alias("b"), F.col("c.score").alias("score_b"), "n")
    stars = join_counted(members.select("key", "doc_id"), scratch.write(centre, "centres"), ["key"], members.count())
    stars = stars.where("doc_id <> b").groupBy(F.col("doc_id").alias("a"), "b", "score_b").agg(F.count("*").alias("shared"))
    best = stars.groupBy("a").agg(F.max(F.struct("shared", "score_b", (-F.col("b")).alias("id"))).alias("c"))
    links = run.linked(best.select("a", (-F.col("c.id")).alias("b")))
    labels = components(links.toDF("u", "v"), scratch, "labels-0")
    more = run.between(members, labels)
    if more.count():
        labels = components(labels.toDF("u", "v").unionByName(more.toDF("u", "v")), scratch, "labels-1")
    first = run.signed.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    first = first.join(labels.toDF("first", "label"), "first", "left").where("n > 1 or label is not null")
    classes = scratch.write(first.select("d1", "d2", F.coalesce("label", "first").alias("component_id"), "n"), "classes")
    scratch.keep("signed", "classes")
    rows = run.signed.select("doc_id", "n_shingles", *(F.when(F.col("n_shingles") > 0, F.col(c)).alias(c) for c in ("d1", "d2")))
    rows = join_counted(rows, classes, ["d1", "d2"], rows.count(), "left")
    rows = rows.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
