"""Words and shingles of many texts at once, as numpy arrays over an Arrow buffer.

A word is a run of bytes outside 0x20 and 0x09-0x0D, A-Z lower-cased: both act on ASCII bytes alone, so working on
UTF-8 bytes gives the same words as working on code points.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(20240607)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLACE = [int(x) * 2 + 1 for x in _rng.integers(1, 2**62, 64)]
_keys = np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _key(n: int) -> np.ndarray:
    """A random number for each of the first n places of a word."""
    global _keys
    if len(_keys) < n:
        _keys = mix((np.arange(1, 1 << (n - 1).bit_length() | 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03))
    return _keys


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each value starts and ends; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most so many bytes, or of one text that is longer."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to
        at = to


def blocks(lengths: np.ndarray, most: int = 1 << 17) -> Iterator[tuple[int, int]]:
    """Runs of stretches of at most so many bytes together, or of one that is longer."""
    yield from slices(np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths))), most)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text the index of its first word (one more at the end)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    cut = np.unique(offsets[(offsets > 0) & (offsets < len(data))])
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes: the sum of its bytes, each times the random number of its place.

    Two stretches differ in a byte by less than 2^9, so for random keys they collide with a probability of at most 2^-56,
    whatever their pattern, length or repeats.
    """
    out = np.zeros(len(starts), np.uint64)
    for a, b in blocks(ends - starts):
        lengths = ends[a:b] - starts[a:b]
        done = np.cumsum(lengths)
        at = np.arange(done[-1])
        place = at - np.repeat(done - lengths, lengths)
        letters = data[np.repeat(starts[a:b], lengths) + place]
        letters = (_LOWER[letters] if lower else letters).astype(np.uint64) + np.uint64(1)
        total = np.zeros(len(at) + 1, np.uint64)
        np.cumsum(letters * _key(int(lengths.max()))[place], out=total[1:])
        out[a:b] = mix(total[done] - total[done - lengths] + lengths.astype(np.uint64))
    return out


def shingles(words: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles, repeats included, and for each text the index of its first one.

    A text of fewer than k words has its whole sequence as its only shingle; a text without words has none.
    """
    n = len(words)
    if not n:
        return words, np.zeros(len(firsts), np.int64)
    counts = np.diff(firsts)
    left = np.repeat(firsts[1:], counts) - np.arange(n)
    value = np.zeros(n, np.uint64)
    for j in range(k):
        part = np.zeros(n, np.uint64)
        part[: n - j] = words[j:] * np.uint64(_PLACE[j])
        part[left <= j] = 0
        value += part
    keep = left >= k
    short = firsts[:-1][(counts > 0) & (counts < k)]
    keep[short] = True
    value[short] += np.repeat(np.uint64(_PLACE[63]), len(short)) * left[short].astype(np.uint64)
    kept_before = np.concatenate(([0], np.cumsum(keep)))
    return mix(value[keep]), kept_before[firsts]


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a column."""
    data, offsets = utf8(column)
    for a, b in slices(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, firsts = word_bounds(part, at)
        values, first = shingles(word_hashes(part, starts, ends), firsts, k)
        for i in range(b - a):
            yield np.unique(values[first[i] : first[i + 1]])
