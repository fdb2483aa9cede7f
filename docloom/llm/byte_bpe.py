"""Byte-level BPE encoding and decoding of whole texts."""

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import KnownRanges, Vocabulary, encode_split, joined, split_stops
from .textscan import slices, utf8, word_bounds, word_hashes

#: Distinct words that a worker keeps with their ids; beyond them it starts anew.
KEPT_WORDS = 400_000


class Encoder:
    """Encodes texts by a rank file and a pattern that splits them before the merges.

    The usual pattern keeps at most one space before a word and never joins two words, so words with that space, and the
    rest of the white space, are encoded once each. A text with white space outside ASCII is split whole, and so is every
    text under another pattern.
    """

    def __init__(self, path: str, pattern: str):
        import public_tokenizers
        import regex

        self.by_words = pattern == public_tokenizers.PATTERN
        self.vocabulary = Vocabulary.from_ranks(path)
        self.split = regex.compile(pattern).findall
        self.known = KnownRanges(KEPT_WORDS)

    def _learn(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        split, odd = [], np.zeros(len(raw), bool)
        for i, x in enumerate(raw):
            if (x[1:] if x[:1] == b" " else x).isalpha() or x.isspace():
                split.append([x])
                continue
            text = x.decode()
            if (text[1:] if text[:1] == " " else text).isalpha():
                split.append([x])
            else:
                odd[i] = any(c.isspace() for c in text[1:]) or (text[:1] != " " and text[:1].isspace())
                split.append([y.encode() for y in self.split(text)])
        return *encode_split(self.vocabulary, split), odd

    def whole(self, text: str) -> np.ndarray:
        return encode_split(self.vocabulary, [[y.encode() for y in self.split(text)]])[0]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and how many each has."""
        if not self.by_words:
            own = [self.whole(data[a:b].tobytes().decode()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            return np.concatenate([np.zeros(0, np.int32), *own]).astype(np.int32), np.array([len(x) for x in own], np.int64)
        starts, ends, firsts = word_bounds(data, offsets)
        counts = np.diff(firsts)
        has = counts > 0
        # The gap before each word, and the one at the end of each text.
        gap = np.zeros(len(starts), np.int64)
        gap[1:] = ends[:-1]
        gap[firsts[:-1][has]] = offsets[:-1][has]
        tail = offsets[:-1].copy()
        tail[has] = ends[firsts[1:][has] - 1]
        spaced = (starts > gap) & (data[np.maximum(starts - 1, 0)] == 32)
        bare = (starts > gap) & ~spaced
        to = starts - (starts > gap)
        cut = [(gap, to, to > gap), (to, starts, bare), (tail, offsets[1:], offsets[1:] > tail)]
        starts, ends = split_stops(data, starts - spaced, ends)
        starts = np.concatenate([starts, *(a[m] for a, _, m in cut)])
        ends = np.concatenate([ends, *(b[m] for _, b, m in cut)])
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
        at = self.known.places(data, starts, ends, word_hashes(data, starts, ends, lower=False), self._learn)
        ids, lengths = self.known.ids.gather(at)
        firsts = np.searchsorted(starts, offsets)
        lengths = np.diff(np.concatenate(([0], np.cumsum(lengths)))[firsts])
        odd = np.diff(np.concatenate(([0], np.cumsum(self.known.odd[at])))[firsts])
        own = {int(i): self.whole(data[offsets[i] : offsets[i + 1]].tobytes().decode()) for i in np.flatnonzero(odd)}
        return joined(ids, lengths, own)


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One to a worker, so later tasks find its words known."""
    return Encoder(path, pattern)


def encoded(column: pa.Array, encode) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids, lengths) of a column's texts, null as empty, in runs of bounded bytes."""
    data, offsets = utf8(column)
    for a, b in slices(offsets):
        yield a, *encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) of every text, null as empty, as tiktoken's encode_ordinary gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            for at, ids, lengths in encoded(batch.column(1), own.encode):
                ends = pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(lengths)), pa.ListArray.from_arrays(ends, pa.array(ids))], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, bytes binary): the exact bytes that the ids stand for; null ids as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.from_ranks(path)
        for batch in batches:
            out = [vocabulary.decode(np.asarray(x.as_py() or [], np.int64))[0].tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id_col, "bytes"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"`{id_col}` {kind}, bytes binary")


def round_trip_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): the ids encoded, then decoded, in one pass over each text.

    One row per input row. Null and empty texts have no ids and the digest of no bytes. Null ids pass through. Other
    columns are not read; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for _, ids, lengths in encoded(batch.column(1), own.encode):
                ends = np.concatenate(([0], np.cumsum(lengths)))
                raw, sizes = own.vocabulary.decode(ids)
                cuts = np.concatenate(([0], np.cumsum(sizes)))[ends]
                wire = ids.astype("<u4")
                counts += lengths.tolist()
                of_ids += [hashlib.sha256(wire[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                of_bytes += [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
