"""Byte-pair merges of many words at once, in length-bucketed padded matrices."""

import base64
import heapq
import json

import numpy as np

from .textscan import blocks

NONE = np.int32(2**31 - 1)
#: Words of more symbols are merged one at a time with a heap: a round of the matrix costs its width.
LONG = 256
_ROWS = 1 << 14
_WIDTHS = [2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 96, 128, 192, LONG]


EMPTY = np.uint64(2**64 - 1)


class Slots:
    """Open addressing for whole arrays of 64-bit keys."""

    def __init__(self, bits: int):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, EMPTY, np.uint64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The slot of each key, or the empty one where its search ends."""
        slot = ((key * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        held = self.keys[slot]
        off = np.flatnonzero((held != key) & (held != EMPTY))
        while len(off):
            slot[off] = (slot[off] + 1) & self.mask
            held = self.keys[slot[off]]
            off = off[(held != key[off]) & (held != EMPTY)]
        return slot

    def insert(self, key: np.ndarray) -> np.ndarray:
        """The slots of distinct keys that aren't there yet."""
        slot, todo = np.zeros(len(key), np.int64), np.arange(len(key))
        while len(todo):
            at = self.find(key[todo])
            _, one = np.unique(at, return_index=True)
            slot[todo[one]] = at[one]
            self.keys[at[one]] = key[todo[one]]
            todo = np.delete(todo, one)
        return slot


class PairTable:
    """(left, right) -> (rank, merged id), looked up for whole arrays."""

    def __init__(self, left, right, rank, merged):
        key = (np.asarray(left, np.uint64) << np.uint64(32)) | np.asarray(right, np.uint64)
        bits = max(4, int(len(key) * 4).bit_length())
        self.slots = Slots(bits)
        self.ranks, self.merged = np.full(1 << bits, NONE, np.int32), np.zeros(1 << bits, np.int32)
        at = self.slots.insert(key)
        self.ranks[at], self.merged[at] = rank, merged

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE where the pair doesn't merge) and merged id."""
        key = ((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)).ravel()
        at = self.slots.find(key)
        return self.ranks[at].reshape(left.shape), self.merged[at].reshape(left.shape)


class Ragged:
    """A growing list of integer sequences in one flat array."""

    def __init__(self, kind: type = np.int32):
        self.flat, self.starts, self.used, self.n = np.zeros(1 << 16, kind), np.zeros(1 << 12, np.int64), 0, 0

    def extend(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(lengths) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.starts[self.n + 1 : self.n + 1 + len(lengths)] = self.used + np.cumsum(lengths)
        self.used, self.n = self.used + len(flat), self.n + len(lengths)

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequences at these places, one after another, and their lengths."""
        starts = self.starts[at]
        lengths = self.starts[at + 1] - starts
        return gather(self.flat, starts, lengths), lengths


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


class Vocabulary:
    """Ids of single bytes, alone or at the end of a word, the pairs that merge, and words that are one token at once."""

    def __init__(self, first: np.ndarray, last: np.ndarray, pairs: PairTable, whole: dict[bytes, int], tokens: list[bytes]):
        self.first, self.last, self.pairs, self.whole = first, last, pairs, whole
        lengths = np.array([len(x) for x in tokens], np.int64)
        self.token_bytes, self.token_lengths = np.frombuffer(b"".join(tokens), np.uint8), lengths
        self.token_starts = np.cumsum(lengths) - lengths

    @classmethod
    def from_ranks(cls, path: str) -> "Vocabulary":
        """A rank file: base64 of a token's bytes and its rank, which is its id; any split of a token may merge."""
        ranks = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        tokens = [b""] * (max(ranks.values()) + 1)
        pairs = []
        for token, rank in ranks.items():
            tokens[rank] = token
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs.append((a, b, rank, rank))
        first = np.array([ranks.get(bytes([b]), 0) for b in range(256)], np.int32)
        return cls(first, first, PairTable(*zip(*pairs, strict=True)), ranks, tokens)

    @classmethod
    def from_merges(cls, path: str) -> "Vocabulary":
        """A tokenizer file with an ordered merge list over printable stand-ins of bytes and a word-end suffix."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"] or ""
        letters = byte_letters()
        pairs = []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pairs.append((ids[a], ids[b], rank, ids[a + b]))
        first, last = (np.array([ids[c + s] for c in letters], np.int32) for s in ("", end))
        return cls(first, last, PairTable(*zip(*pairs, strict=True)), {}, [])

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and how many each has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes) - sizes
        room, lengths = np.zeros(int(sizes.sum()), np.int32), np.zeros(len(words), np.int64)
        todo = np.ones(len(words), bool)
        if self.whole:
            known = np.fromiter((self.whole.get(w, -1) for w in words), np.int64, len(words))
            todo = known < 0
            room[starts[~todo]], lengths[~todo] = known[~todo], 1
        for i in np.flatnonzero(todo & ((sizes == 1) | (sizes > LONG))):
            ids = self._long(words[i])
            room[starts[i] : starts[i] + len(ids)], lengths[i] = ids, len(ids)
        low = 1
        for width in _WIDTHS:
            those = np.flatnonzero(todo & (sizes > low) & (sizes <= width))
            low = width
            for at in range(0, len(those), _ROWS):
                self._bucket(words, those[at : at + _ROWS], sizes, width, starts, room, lengths)
        return gather(room, starts, lengths), lengths

    def _bucket(self, words: list[bytes], at: np.ndarray, sizes: np.ndarray, width: int, starts: np.ndarray, room: np.ndarray, lengths: np.ndarray) -> None:
        def done(which: np.ndarray) -> None:
            own = np.arange(symbols.shape[1]) < size[which][:, None]
            room[(starts[at[which]][:, None] + np.arange(symbols.shape[1]))[own]] = symbols[which][own]
            lengths[at[which]] = size[which]

        size = sizes[at].copy()
        raw = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in at), np.uint8).reshape(-1, width)
        symbols = self.first[raw]
        rows = np.arange(len(at))
        symbols[rows, size - 1] = self.last[raw[rows, size - 1]]
        ranks, _ = self.pairs.find(symbols[:, :-1], symbols[:, 1:])
        ranks[np.arange(width - 1) >= size[:, None] - 1] = NONE
        while True:
            where = ranks.argmin(axis=1)
            going = ranks[rows, where] != NONE
            if not going.all():
                done(np.flatnonzero(~going))
            if not going.any():
                return
            symbols, ranks, size, at, where = symbols[going], ranks[going], size[going], at[going], where[going]
            rows = np.arange(len(at))
            _, merged = self.pairs.find(symbols[rows, where], symbols[rows, where + 1])
            # Each row loses the symbol after the merged one, and the rank between them.
            columns = np.arange(symbols.shape[1] - 1)
            symbols = symbols[rows[:, None], columns + (columns > where[:, None])]
            symbols[rows, where] = merged
            size -= 1
            width = int(size.max())
            if width < 2:
                done(rows)
                return
            columns = np.arange(ranks.shape[1] - 1)
            ranks = ranks[rows[:, None], columns + (columns >= where[:, None])]
            symbols, ranks = symbols[:, :width], ranks[:, : width - 1]
            left = np.flatnonzero(where > 0)
            ranks[left, where[left] - 1] = self.pairs.find(symbols[left, where[left] - 1], symbols[left, where[left]])[0]
            right = np.flatnonzero(where < size - 1)
            ranks[right, where[right]] = self.pairs.find(symbols[right, where[right]], symbols[right, where[right] + 1])[0]

    def _long(self, word: bytes) -> np.ndarray:
        """The same merges for one long word: a heap of (rank, place) over a linked list."""
        n = len(word)
        symbols = self.first[np.frombuffer(word, np.uint8)].tolist()
        symbols[-1] = int(self.last[word[-1]])
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        known: dict = {}

        def rank(a: int, b: int) -> tuple[int, int]:
            if (a, b) not in known:
                r, m = self.pairs.find(np.array([a]), np.array([b]))
                known[a, b] = int(r[0]), int(m[0])
            return known[a, b]

        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank(symbols[i], symbols[i + 1])[0]) != NONE]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i] = rank(a, b)[1]
            alive[j], after[i] = False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := rank(symbols[x], symbols[y])[0]) != NONE:
                    heapq.heappush(heap, (r, x, symbols[x], symbols[y]))
        return np.array([s for s, ok in zip(symbols, alive, strict=True) if ok], np.int32)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all tokens, and how many each has."""
        lengths = self.token_lengths[ids]
        return gather(self.token_bytes, self.token_starts[ids], lengths), lengths


def byte_letters() -> list[str]:
    """The usual printable stand-in of each byte: itself where it prints, else the next code point from 256 on."""
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printing else chr(next(spare)) for b in range(256)]


class KnownRanges:
    """Ids of stretches of bytes, each distinct one encoded once. They are found by a hash and told apart by their bytes."""

    def __init__(self, kept: int):
        self.kept, self.bits = kept, (4 * kept).bit_length()
        self.forget()

    def forget(self) -> None:
        self.slots, self.number = Slots(self.bits), np.zeros(1 << self.bits, np.int32)
        self.ids, self.bytes, self.odd = Ragged(), Ragged(np.uint8), np.zeros(0, bool)

    def _add(self, stretches: list[bytes], learn) -> None:
        ids, lengths, odd = learn(stretches)
        self.ids.extend(ids, lengths)
        self.bytes.extend(np.frombuffer(b"".join(stretches), np.uint8), np.fromiter(map(len, stretches), np.int64, len(stretches)))
        self.odd = np.concatenate([self.odd, odd])

    def places(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, learn) -> np.ndarray:
        """Where in ids each stretch is; learn(new stretches) gives ids, lengths and marks of odd ones."""
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        distinct = np.where(distinct == EMPTY, np.uint64(0), distinct)
        at = self.slots.find(distinct)
        new = np.flatnonzero(self.slots.keys[at] == EMPTY)
        if len(new):
            if self.ids.n + len(new) > self.kept and self.ids.n:
                self.forget()
                new = np.arange(len(distinct))
            if self.ids.n + len(new) > self.kept:  # one text with more distinct words than are kept
                self.kept, self.bits = 2 * (self.ids.n + len(new)), (8 * (self.ids.n + len(new))).bit_length()
                self.forget()
            before = self.ids.n
            self._add(_cut(data, starts[first[new]], ends[first[new]]), learn)
            slots = self.slots.insert(distinct[new])
            self.number[slots] = np.arange(before, self.ids.n)
            at = self.slots.find(distinct)
        found = self.number[at].astype(np.int64)[inverse]
        other = self._differing(data, starts, ends, found)
        if len(other):
            # Stretches whose hash another one holds: each is looked up by its bytes, and forgotten with the rest.
            own = _cut(data, starts[other], ends[other])
            number = {x: i for i, x in enumerate(dict.fromkeys(own))}
            before = self.ids.n
            self._add(list(number), learn)
            found[other] = [before + number[x] for x in own]
        return found

    def _differing(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Stretches whose bytes aren't those of the place found for them."""
        other = []
        for a, b in blocks(ends - starts):
            lengths, own = ends[a:b] - starts[a:b], found[a:b]
            same = lengths == self.bytes.starts[own + 1] - self.bytes.starts[own]
            held, _ = self.bytes.gather(own[same])
            unlike = np.flatnonzero(gather(data, starts[a:b][same], lengths[same]) != held)
            wrong = np.flatnonzero(same)[np.unique(np.searchsorted(np.cumsum(lengths[same]), unlike, "right"))]
            other += [a + np.flatnonzero(~same), a + wrong]
        return np.unique(np.concatenate(other)) if other else np.zeros(0, np.int64)


def _cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def split_stops(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts a last full stop or comma from words where an ASCII letter or digit stands before it."""
    at = np.flatnonzero((ends - starts > 1) & _STOP[data[ends - 1]] & _ALNUM[data[np.maximum(ends - 2, 0)]])
    cut_ends = ends.copy()
    cut_ends[at] -= 1
    return np.insert(starts, at + 1, ends[at] - 1), np.insert(cut_ends, at + 1, ends[at])


_STOP, _ALNUM = np.zeros(256, bool), np.zeros(256, bool)
_STOP[[44, 46]] = True
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def encode_split(vocabulary: Vocabulary, split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of stretches that are split already, and how many each has."""
    number: dict = {}
    at = np.fromiter((number.setdefault(x, len(number)) for parts in split for x in parts), np.int64)
    known = Ragged()
    known.extend(*vocabulary.encode(list(number)))
    ids, lengths = known.gather(at)
    ends = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum([len(x) for x in split]))).astype(np.int64)]
    return ids, np.diff(ends)


def joined(ids: np.ndarray, lengths: np.ndarray, own: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The same with some sequences replaced."""
    if not own:
        return ids, lengths
    ends = np.cumsum(lengths)
    parts = [own[i] if i in own else ids[b - n : b] for i, (b, n) in enumerate(zip(ends, lengths, strict=True))]
    return np.concatenate(parts).astype(np.int32), np.array([len(x) for x in parts], np.int64)
