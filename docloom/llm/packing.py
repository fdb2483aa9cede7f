"""Packing token pieces into fixed windows by best-fit decreasing."""

import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import KnownRanges, Vocabulary, encode_split, joined, split_stops
from .byte_bpe import encoded
from .textscan import lowered, word_bounds, word_hashes

#: Distinct words that a worker keeps with their ids; beyond them it starts anew.
KEPT_WORDS = 500_000
#: Ids of short pieces that a task holds before it packs them; what is left open goes on to its next block.
BLOCK_IDS = 1 << 24
#: A window left emptier than this part of its length is filled up by cutting pieces.
LOOSE = 0.005

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordEncoder:
    """The ids of a tokenizer file that drops white space, each word encoded once.

    Plain words (letters of Latin scripts and ASCII signs) go through the same merges in matrices; any other goes through
    the tokenizers library itself. No match of the file's pattern spans white space, so words are independent.
    """

    def __init__(self, path: str):
        import json

        import regex

        self.path = path
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        self.split = regex.compile(own["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        # Characters whose lower case and composed form are a letter by letter affair.
        self.plain = regex.compile("[!-~¡-¬®-įı-ɏ]+").fullmatch
        self.vocabulary = Vocabulary.from_merges(path)
        self.known = KnownRanges(KEPT_WORDS)

    @cached_property
    def library(self):
        """Loaded by the first word that needs it."""
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(self.path)
        library.no_padding()
        library.no_truncation()
        return library

    def _learn(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        split, own = [], {}
        for i, x in enumerate(raw):
            x = x.lower()
            if x.isalpha():
                split.append([x])
                continue
            text = x.decode()
            if not self.plain(text):
                own[i] = np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)
                split.append([])
                continue
            text = text.lower()
            split.append([text.encode()] if text.isalpha() else [y.encode() for y in self.split(text)])
        return *joined(*encode_split(self.vocabulary, split), own), np.zeros(len(raw), bool)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and how many each has."""
        starts, ends, _ = word_bounds(data, offsets)
        starts, ends = split_stops(data, starts, ends)
        small = lowered(data)
        at = self.known.places(small, starts, ends, word_hashes(small, starts, ends, lower=False), self._learn)
        ids, lengths = self.known.ids.gather(at)
        lengths = np.diff(np.concatenate(([0], np.cumsum(lengths)))[np.searchsorted(starts, offsets)])
        # Texts that may hold a special token as it is written, upper and lower case apart.
        marks = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)) if len(data) else data
        rows = {int(i) for i in np.searchsorted(offsets, marks, "right") - 1}
        own = {i: np.array(self.library.encode(data[offsets[i] : offsets[i + 1]].tobytes().decode(), add_special_tokens=False).ids, np.int32) for i in rows}
        return joined(ids, lengths, own)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One to a worker, so later tasks find its words known."""
    return WordEncoder(path)


class OpenWindows:
    """Open windows by remaining capacity: a tree of counts over capacities finds the least that is large enough."""

    def __init__(self, size: int):
        self.size = size
        self.leaves = 1 << size.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.at: dict[int, list[int]] = {}

    def add(self, capacity: int, window: int) -> None:
        if capacity:
            self.at.setdefault(capacity, []).append(window)
            self._count(capacity, 1)

    def _count(self, capacity: int, by: int) -> None:
        i = self.leaves + capacity
        while i:
            self.tree[i] += by
            i >>= 1

    def take(self, needed: int) -> tuple[int, int] | None:
        """(capacity, window) of a window with the least capacity that is at least needed; it is open no more."""
        tree, i = self.tree, self.leaves + needed
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        self._count(capacity, -1)
        return capacity, self.at[capacity].pop()


def best_fit_decreasing(lengths: list[int], size: int, open_: list[list[int]] | None = None, filled: list[int] | None = None) -> tuple[list[list[int]], list[int]]:
    """Windows as lists of piece numbers, and how full each is. Longest first, ties in the given order."""
    windows, full = open_ or [], filled or []
    free = OpenWindows(size)
    for w, n in enumerate(full):
        free.add(size - n, w)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = free.take(lengths[i])
        if found is None:
            found = (size, len(windows))
            windows.append([])
            full.append(0)
        capacity, w = found
        windows[w].append(i)
        full[w] += lengths[i]
        free.add(capacity - lengths[i], w)
    return windows, full


def binary_parts(n: int) -> list[int]:
    """Powers of two that sum to n, largest first."""
    return [1 << b for b in reversed(range(n.bit_length())) if n >> b & 1]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class _Packer:
    """What one task packs: rows of PIECES."""

    def __init__(self, size: int, first_sequence: int):
        self.size, self.sequence = size, first_sequence
        self.rows: list[tuple] = []
        self.short: list[tuple] = []  # (doc_id, start, doc_tokens, ids)
        self.held = 0
        self.tail: list[tuple] = []

    def _window(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, total, ids in pieces:
            self.rows.append((doc, start, len(ids), _crc(ids), total, self.sequence, at))
            at += len(ids)
        self.sequence += 1

    def add(self, doc, ids: np.ndarray) -> None:
        """Full windows of an overlong document at once; what remains waits."""
        total, whole = len(ids), len(ids) // self.size * self.size
        for start in range(0, whole, self.size):
            self._window([(doc, start, total, ids[start : start + self.size])])
        if whole < total:
            self.short.append((doc, whole, total, ids[whole:].astype(np.uint16 if ids.max() < 1 << 16 else np.int32)))
            self.held += total - whole
        if self.held >= BLOCK_IDS:
            self.block()

    def block(self) -> None:
        """Packs what waits. Windows that stay loose are cut anew, end to end; their last part goes on."""
        pieces, self.short, self.held = self.short, [], 0
        windows, full = best_fit_decreasing([len(p[3]) for p in pieces], self.size)
        loose = list(self.tail)
        for window, n in zip(windows, full, strict=True):
            if n >= self.size * (1 - LOOSE):
                self._window([pieces[i] for i in window])
            else:
                loose += [pieces[i] for i in window]
        self.tail = []
        self.tail = self._cut(loose, lambda left: self.size if left >= self.size else 0)

    def _cut(self, pieces: list[tuple], want) -> list[tuple]:
        """Windows of the lengths that want(ids left) gives, until it gives none; the rest."""
        left = sum(len(p[3]) for p in pieces)
        pieces = pieces[::-1]
        while room := want(left):
            left -= room
            window = []
            while room:
                doc, start, total, ids = pieces.pop()
                window.append((doc, start, total, ids[:room]))
                if len(ids) > room:
                    pieces.append((doc, start + room, total, ids[room:]))
                room -= len(window[-1][3])
            self._window(window)
        return pieces[::-1]

    def finish(self) -> None:
        self.block()
        self.tail = self._cut(self.tail, lambda left: binary_parts(left)[0] if left else 0)

    def flush(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows, strict=True)) or [()] * 7
        names = [x.split()[0] for x in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def pack_documents(docs: DataFrame, path: str, size: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and then end_id. Every task packs its own documents, in blocks of bounded memory: full windows
    of long documents at once, the rest best fit first, longest first. Windows left loose are joined and cut anew, so
    that a task ends with one part window, which is cut into powers of two; those need no padding. sequence_id holds the
    partition above bit 32, so it is unique, and a task that runs again gives the same rows.

    Null and empty texts are one piece of end_id. Null ids pass through; repeated rows are packed once each. Other
    columns are not read; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        packer = _Packer(size, TaskContext.get().partitionId() << 32)
        for batch in batches:
            ids_of = iter(batch.column(0).to_pylist())
            for _, ids, lengths in encoded(batch.column(1), own.encode):
                ends = np.cumsum(lengths)
                for a, b in zip(ends - lengths, ends, strict=True):
                    packer.add(next(ids_of), np.append(ids[a:b], np.int32(end_id)))
            yield packer.flush()
        packer.finish()
        yield packer.flush()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, PIECES)
