"""An inverted index in segments: units are tokenised once, where they lie, and each segment searches itself with bounds.

A segment is some thousand units: a row of their ids and lengths, and rows of many terms each with their postings in tiers. The first tier
has the postings of the highest impact, each further one is twice as long; within a tier they are in order of the units. A
tier's highest impact at the segment's own average length, and its largest frequency and least length per occurrence, bound
the scores in it for any average length, so an index that grows keeps its tiers. Tiers whose postings can't bring a unit among a question's k best are skipped, but for the units that are candidates already.

Bounds spare little of a question of many terms. Many of those are scored together: a product of matrices for terms that many of
them share with many units, sums over postings for the others.
"""

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the usual variant.
K1, B = 1.5, 0.75
#: Units of a segment and their postings at most, and the postings of a first tier.
SEGMENT_UNITS, SEGMENT_POSTINGS, FIRST_TIER = 16_384, 1 << 21, 64
#: Postings that are added before the k-th best is looked at again.
ROUND = 512
#: Scores that differ by less are told apart by id, so they aren't skipped.
SLACK = 2e-6
#: The term of a segment's row of units, which no token is.
UNITS = ""

#: Terms of a row at most: of those with one tier, and of the others.
ROW_TERMS, ROW_LONG_TERMS = 1 << 14, 256
#: Scores that are held at a time, postings that are, and terms with a row of their own in the product of matrices.
SCORES, SUMMED, DENSE = 1 << 21, 1 << 20, 512
#: What a posting costs, as a number of multiplications in a product.
POSTING_COST = 128

#: words: a row's terms, each on a line; dfs and sums: in how many units each is, and how often; docs, tfs and what bounds the tiers:
#: those of all terms, one behind another. All of these move whole, as text and bytes; docs: places in the segment. term is
#: null but in the row of units, which has that term only: its df is their number, ids and lengths are theirs, and the rest is empty.
SCHEMA = "segment long, term string, words string, dfs binary, sums binary, docs binary, tfs binary, tops binary, leasts binary, highest binary, ids array<long>, lengths array<int>"
COLUMNS = ["segment", "term", "words", "dfs", "sums", "docs", "tfs", "tops", "leasts", "highest", "ids", "lengths"]
#: What the bytes are.
KINDS = {"dfs": "<i4", "sums": "<i8", "docs": "<i4", "tfs": "<i4", "tops": "<i4", "leasts": "<f8", "highest": "<f8"}
#: What a search doesn't need, and the rows of a file at most: a file's rows are read at once.
UNSEARCHED, FILE_ROWS = "sums", 64


def segment_number(version: int, task: int) -> int:
    """The first of a task's."""
    return (version << 48) | (task << 24)


def impact(tf, dl, average: float):
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))


def bound(tops, leasts, highest, own: float, average: float):
    """Of impacts with a frequency of at most tops and at least leasts tokens of the unit for each occurrence, that are at most
    highest for another average length, own: an impact doesn't grow faster than the average, and falls with it."""
    return np.minimum((K1 + 1) / (1 + K1 * (1 - B) / tops + K1 * B * leasts / average), highest * max(1.0, average / own))


def own_average(lengths: np.ndarray) -> float:
    return max(1.0, float(lengths.mean())) if len(lengths) else 1.0


def tier_cuts(n: int) -> list[int]:
    """Where tiers of n postings start, and n."""
    cuts, size = [0], FIRST_TIER
    while cuts[-1] < n:
        cuts.append(min(n, cuts[-1] + size))
        size *= 2
    return cuts


def tiers_of(df: np.ndarray) -> np.ndarray:
    """Into how many tiers so many postings are cut."""
    return np.searchsorted(FIRST_TIER * (2 ** np.arange(40) - 1), df)


def tiered(docs: np.ndarray, tfs: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """(docs, tfs, tops, leasts, highest) of a term's postings, in tiers."""
    high = impact(tfs, lengths[docs], own_average(lengths))
    order = np.lexsort((docs, -high))
    cuts = tier_cuts(len(docs))
    for a, b in pairwise(cuts):
        order[a:b] = np.sort(order[a:b])  # postings come in the order of their units
    docs, tfs, starts = docs[order], tfs[order], cuts[:-1]
    return docs, tfs, np.maximum.reduceat(tfs, starts), np.minimum.reduceat(lengths[docs] / tfs, starts), np.maximum.reduceat(high[order], starts)


def segment_rows(segment: int, ids: np.ndarray, lengths: np.ndarray, terms: pa.Array, term: np.ndarray, docs: np.ndarray, tfs: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of one segment: terms are its distinct terms, and each posting has the place of its term there. Postings come by
    term, then unit."""
    none = np.zeros(0, np.int64)
    yield _row(segment, UNITS, pa.array([UNITS]), [len(ids)], [int(lengths.sum())], *[none] * 5, ids, lengths)
    cuts = np.searchsorted(term, np.arange(len(terms) + 1))
    df, total = np.diff(cuts), np.concatenate(([0], np.cumsum(tfs)))
    total = total[cuts[1:]] - total[cuts[:-1]]
    # A single tier is its postings as they come; these are most terms, so they are cut all at once.
    few = np.flatnonzero((df > 0) & (df <= FIRST_TIER))
    for at in range(0, len(few), ROW_TERMS):
        some = few[at : at + ROW_TERMS]
        own = np.repeat(cuts[some] - np.cumsum(df[some]) + df[some], df[some]) + np.arange(df[some].sum())
        starts = np.cumsum(df[some]) - df[some]
        tops, leasts = np.maximum.reduceat(tfs[own], starts), np.minimum.reduceat(lengths[docs[own]] / tfs[own], starts)
        highest = np.maximum.reduceat(impact(tfs[own], lengths[docs[own]], own_average(lengths)), starts)
        yield _row(segment, None, terms.take(pa.array(some)), df[some], total[some], docs[own], tfs[own], tops, leasts, highest)
    many = np.flatnonzero(df > FIRST_TIER)
    for at in range(0, len(many), ROW_LONG_TERMS):
        some = many[at : at + ROW_LONG_TERMS]
        lists = [tiered(docs[cuts[i] : cuts[i + 1]], tfs[cuts[i] : cuts[i + 1]], lengths) for i in some]
        yield _row(segment, None, terms.take(pa.array(some)), df[some], total[some], *(np.concatenate(x) for x in zip(*lists, strict=True)))


def _row(segment: int, term: str | None, terms: pa.Array, dfs, sums, docs, tfs, tops, leasts, highest, ids=(), lengths=()) -> pa.RecordBatch:
    # No term holds white space.
    words = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), terms.cast(pa.string())), "\n")
    blobs = [pa.array([np.asarray(x).astype(k).tobytes()], pa.binary()) for x, k in zip((dfs, sums, docs, tfs, tops, leasts, highest), KINDS.values(), strict=True)]
    own = [pa.array([np.asarray(x, np.int64)], pa.list_(k)) for x, k in ((ids, pa.int64()), (lengths, pa.int32()))]
    return pa.RecordBatch.from_arrays([pa.array([segment], pa.int64()), pa.array([term], pa.string()), words, *blobs, *own], names=COLUMNS)


def _bytes_of(rows: pa.RecordBatch, name: str, i: int) -> np.ndarray:
    return np.frombuffer(rows[name][i].as_buffer(), KINDS[name])


def split(texts: pa.Array) -> pa.Array:
    """What lies between white space, as T.tokens has it, of texts in lower case; null as none."""
    tokens = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    flat = tokens.flatten()
    some = pc.greater(pc.binary_length(flat), 0)
    ends = np.concatenate(([0], np.cumsum(some.to_numpy(zero_copy_only=False))))[np.concatenate(([0], np.cumsum(pc.list_value_length(tokens).to_numpy(zero_copy_only=False))))]
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat.filter(some))


def _counted(batches: list[pa.RecordBatch]) -> tuple:
    """ids, lengths, distinct terms, and the postings by term, then unit."""
    table = pa.Table.from_batches(batches).combine_chunks()
    ids, tokens = table["id"].to_numpy(), table["t"].combine_chunks()
    lengths = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = tokens.flatten().dictionary_encode()
    codes, n = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(ids))
    key, tf = np.unique(codes * n + np.repeat(np.arange(len(ids)), lengths), return_counts=True)
    return ids, lengths, flat.dictionary, key // n, key % n, tf


def build_rows(units: DataFrame, id_col: str, text_col: str, version: int = 0) -> DataFrame:
    """Segments of units, as SCHEMA. A task cuts its units into segments as they come: nothing is shuffled, and a segment's number
    is made of the version, the task's and its own. Units without tokens are listed, too; ids are integers."""
    texts = units.select(F.col(id_col).cast("long").alias("id"), F.lower(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number, held, rows, size = segment_number(version, TaskContext.get().partitionId()), 0, [], 0, 0
        for batch in batches:
            batch = pa.RecordBatch.from_arrays([batch["id"], split(batch["text"])], names=["id", "t"])
            ends = np.cumsum(pc.list_value_length(batch["t"]).to_numpy(zero_copy_only=False).astype(np.int64)) if len(batch) else np.zeros(0, np.int64)
            at = 0
            while at < len(batch):
                before = ends[at - 1] if at else 0
                to = min(at + SEGMENT_UNITS - rows, int(np.searchsorted(ends, before + SEGMENT_POSTINGS - size, "right")))
                to = max(to, at + (not held))
                held += [batch.slice(at, to - at)] if to > at else []
                rows, size, full = rows + to - at, size + int(ends[to - 1] - before if to > at else 0), to < len(batch)
                at = to
                if full or rows >= SEGMENT_UNITS:
                    yield from segment_rows(first + number, *_counted(held))
                    number, held, rows, size = number + 1, [], 0, 0
        if held:
            yield from segment_rows(first + number, *_counted(held))

    return texts.mapInArrow(run, SCHEMA)


def kth(scores: np.ndarray, k: int) -> float:
    """The k-th largest, or minus infinity."""
    return float(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else -np.inf


def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA to rows (segment, term, doc, tf)."""
    for batch in batches:
        words = pc.split_pattern(batch["words"], "\n")
        for i in range(len(batch)):
            terms = words[i].values.take(pa.array(np.repeat(np.arange(len(words[i])), _bytes_of(batch, "dfs", i))))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), batch["segment"][i].as_py())), terms, *(pa.array(_bytes_of(batch, c, i)) for c in ("docs", "tfs"))], names=["segment", "term", "doc", "tf"])


def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA to rows (term, df, tokens) of each segment."""
    for batch in batches:
        if len(batch):
            df, tokens = (np.concatenate([_bytes_of(batch, c, i) for i in range(len(batch))]) for c in ("dfs", "sums"))
            yield pa.RecordBatch.from_arrays([pc.split_pattern(batch["words"], "\n").flatten(), pa.array(df), pa.array(tokens)], names=["term", "df", "tokens"])


class Asked:
    """Questions that are scored together: terms and weights are lists, one for each."""

    def __init__(self, terms: pa.ListArray, weights: pa.ListArray):
        flat = terms.flatten().dictionary_encode()
        self.n, self.words, self.codes = len(terms), flat.dictionary, flat.indices.to_numpy(zero_copy_only=False)
        self.who, self.weights = np.repeat(np.arange(self.n), pc.list_value_length(terms).to_numpy(zero_copy_only=False)), weights.flatten().to_numpy(zero_copy_only=False)
        self.found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        #: The k-th best of each so far, and the postings of its terms.
        self.least, self.postings = np.full(self.n, -np.inf), np.zeros(self.n, np.int64)

    def add(self, k: int, who: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Keeps the k best of each question."""
        who, ids, scores = (np.concatenate((x, y)) for x, y in zip(self.found, (who, ids, scores), strict=True))
        order = np.lexsort((ids, -np.round(scores, 6), who))
        who = who[order]
        order = order[np.arange(len(who)) - np.searchsorted(who, who) < k]
        who, ids, scores = self.found = np.sort(who[np.arange(len(who)) - np.searchsorted(who, who) < k]), ids[order], scores[order]
        n = np.bincount(who, minlength=self.n)
        full = n >= k
        self.least[full] = np.maximum(self.least[full], scores[(np.cumsum(n) - 1)[full]])


class Segment:
    """What a search needs of a segment: its units and the postings of its terms."""

    def __init__(self, average: float):
        self.average, self.ids, self.lengths, self.dead = average, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self._rows: list[tuple] = []
        self._flat: tuple | None = None
        self._met: dict[str, tuple | None] = {}
        self.lists: dict[str, tuple] = {}

    def add(self, rows: pa.RecordBatch) -> None:
        """Rows of SCHEMA, that of the units before the others, but null words: ids are units that have been withdrawn."""
        own = lambda c, i: rows[c][i].values.to_numpy(zero_copy_only=False)
        words = pc.split_pattern(rows["words"], "\n")
        for i, term in enumerate(rows["term"].to_pylist()):
            if not words[i].is_valid:
                self.dead |= np.isin(self.ids, own("ids", i))
            elif term == UNITS:
                self.ids, self.lengths = own("ids", i), own("lengths", i).astype(np.int64)
                self.dead = np.zeros(len(self.ids), bool)
            else:
                self._rows.append((words[i].values, *(_bytes_of(rows, c, i) for c in KINDS if c != UNSEARCHED)))

    def flat(self) -> tuple:
        """Terms, where the postings of each start and the last end, the same of tiers, and postings and tiers of all terms."""
        if self._flat is None:
            rows = self._rows or [(pa.array([], pa.string()), *[np.zeros(0, np.int32)] * 6)]
            words, (df, *values) = pa.concat_arrays([r[0] for r in rows]), (np.concatenate(x) for x in list(zip(*rows, strict=True))[1:])
            self._flat = words, *(np.concatenate(([0], np.cumsum(x, dtype=np.int64))) for x in (df, tiers_of(df))), *values
            self._rows = []
        return self._flat

    def meet(self, terms: pa.Array) -> None:
        """Looks terms up, many at a time."""
        words, cuts, tiers, docs, tfs, *bounds = self.flat()
        for t, i in zip(terms.to_pylist(), pc.index_in(terms, words).to_pylist(), strict=True):
            if i is None:
                self._met[t] = None
            else:
                a, b, c, d = cuts[i], cuts[i + 1], tiers[i], tiers[i + 1]
                self._met[t] = docs[a:b].astype(np.int64), tfs[a:b].astype(np.int64), *(x[c:d] for x in bounds)

    @property
    def terms(self) -> dict[str, tuple]:
        """Of all terms: docs, tfs, tops, leasts, highest."""
        words = self.flat()[0]
        if len(self._met) < len(words) or any(t not in self._met for t in words.to_pylist()):
            self.meet(words)
        return {t: x for t, x in self._met.items() if x is not None}

    def best_of_many(self, asked: Asked, k: int) -> None:
        """Adds to each question the k best units of those that hold one of its terms. All weights are positive."""
        words, cuts, _, docs, tfs, *_ = self.flat()
        at = pc.fill_null(pc.index_in(asked.words, words), -1).to_numpy(zero_copy_only=False)[asked.codes]
        held = at >= 0
        who, at, weights, n = asked.who[held], at[held], asked.weights[held], len(self.ids)
        if not len(who):
            return
        df, high = np.diff(cuts), impact(tfs, self.lengths[docs], self.average)
        asked.postings += np.bincount(who, df[at], asked.n).astype(np.int64)
        step, out = max(1, SCORES // n), []
        for a in range(0, asked.n, step):
            b = min(asked.n, a + step)
            own = slice(*np.searchsorted(who, (a, b)))
            score = self._scores(who[own] - a, at[own], weights[own], b - a, cuts, docs, high)
            score[:, self.dead] = 0.0
            least = asked.least[a:b]
            new = np.flatnonzero(least == -np.inf) if n >= k else []
            if len(new):
                least[new] = np.partition(score[new], n - k, axis=1)[:, n - k]
            q, doc = np.nonzero((score >= least[:, None] - SLACK) & (score > 0))
            out.append((q + a, self.ids[doc], score[q, doc]))
        asked.add(k, *(np.concatenate(x) for x in zip(*out, strict=True)))

    def _scores(self, who: np.ndarray, at: np.ndarray, weights: np.ndarray, asked: int, cuts: np.ndarray, docs: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Questions by units. at: places of the questions' terms; high: impacts of the postings."""
        n, df = len(self.ids), np.diff(cuts)
        cost = np.bincount(at, minlength=len(df)) * df
        dense = np.flatnonzero(cost * POSTING_COST > asked * n)
        dense = dense[np.argsort(-cost[dense], kind="stable")[:DENSE]]
        place = np.full(len(df), -1)
        place[dense] = np.arange(len(dense))
        inside = place[at] >= 0
        left, right = np.zeros((asked, len(dense))), np.zeros((len(dense), n))
        left[who[inside], place[at[inside]]] = weights[inside]
        for i, t in enumerate(dense):
            right[i, docs[cuts[t] : cuts[t + 1]]] = high[cuts[t] : cuts[t + 1]]
        score = left @ right
        who, at, weights = who[~inside], at[~inside], weights[~inside]
        before = np.concatenate(([0], np.cumsum(df[at])))
        first = np.searchsorted(who, np.arange(asked + 1))
        a = 0
        while a < asked:
            b = max(a + 1, int(np.searchsorted(before[first], before[first[a]] + SUMMED, "right")) - 1)
            own = slice(first[a], first[b])
            some = df[at[own]]
            posting = np.repeat(cuts[at[own]] - before[own] + before[first[a]], some) + np.arange(some.sum())
            key = np.repeat((who[own] - a) * n, some) + docs[posting]
            score[a:b] += np.bincount(key, np.repeat(weights[own], some) * high[posting], (b - a) * n).reshape(b - a, n)
            a = b
        return score

    def list_of(self, term: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A term's units, where its tiers start and the last ends, and what bounds the impacts in a tier and behind it."""
        if term not in self.lists:
            docs, _, *stated = self._met[term]
            self.lists[term] = docs, np.array(tier_cuts(len(docs))), np.maximum.accumulate(bound(*stated, own_average(self.lengths), self.average)[::-1])[::-1]
        return self.lists[term]

    def best(self, terms: list[str], weights: list[float], k: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """(ids, scores, scored, postings) of the k best units that hold one of the terms, all if they are fewer; weights: what a
        term's impact counts. scored: of the terms' postings, how many were added up."""
        if any(t not in self._met for t in terms):
            self.meet(pa.array(terms, pa.string()))
        lists = [(w, *self.list_of(t), self._met[t][1]) for t, w in zip(terms, weights, strict=True) if self._met[t] is not None]
        lists.sort(key=lambda x: -x[0] * x[3][0])
        rest = np.concatenate((np.cumsum([x[0] * x[3][0] for x in lists][::-1])[::-1], [0.0])) if lists else np.zeros(1)
        prunes = all(x[0] >= 0 for x in lists)
        score, held, least, scored, i, at, added = np.zeros(len(self.ids)), np.zeros(len(self.ids), bool), -np.inf, 0, 0, 0, 0

        def add(places: np.ndarray | slice) -> None:
            nonlocal added, scored
            own, tf = docs[places], tfs[places]
            score[own] += w * impact(tf, self.lengths[own], self.average)
            added, scored = added + len(own), scored + len(own)

        whole: list[tuple[float, np.ndarray, np.ndarray]] = []

        def add_whole() -> None:
            """Lists of which all tiers count are added together: most are short."""
            nonlocal added, scored
            if whole:
                own, tf = (np.concatenate([x[j] for x in whole]) for j in (1, 2))
                weight = np.repeat([x[0] for x in whole], [len(x[1]) for x in whole])
                score[:] += np.bincount(own, weight * impact(tf, self.lengths[own], self.average), len(score))
                held[own] = True
                added, scored = added + len(own), scored + len(own)
                whole.clear()

        # While units that haven't been met can be among the best, postings are added, from the rarest terms on, tier by tier.
        waiting = 0
        while i < len(lists) and (at or rest[i] >= least - SLACK):
            w, docs, cuts, bounds, tfs = lists[i]
            if not at and len(docs) <= ROUND and (not prunes or w * bounds[-1] + rest[i + 1] >= least - SLACK):
                whole.append((w, docs, tfs))
                waiting, i = waiting + len(docs), i + 1
                if waiting >= ROUND:
                    add_whole()
                    waiting = 0
                    if prunes:
                        least, added = max(least, kth(score[held & ~self.dead], k)), 0
                continue
            add_whole()
            waiting = 0
            end = cuts[int((w * bounds + rest[i + 1] >= least - SLACK).sum())] if prunes else len(docs)
            if at < end:
                to = min(end, cuts[min(len(cuts) - 1, int(np.searchsorted(cuts, at + ROUND - added)))]) if prunes else len(docs)
                to = max(to, cuts[int(np.searchsorted(cuts, at, "right"))])
                add(slice(at, to))
                held[docs[at:to]] = True
                at = to
            if at >= end:
                # Behind that, only units met before count.
                if at < len(docs):
                    add(np.flatnonzero(held[docs[at:]]) + at)
                i, at = i + 1, 0
            if prunes and added >= ROUND:
                least, added = max(least, kth(score[held & ~self.dead], k)), 0
        add_whole()
        if prunes:
            least = max(least, kth(score[held & ~self.dead], k))
        # The others can only be overtaken by candidates: these are looked up in each tier, or among its units if they are many.
        at = np.flatnonzero(held)
        for j in range(i, len(lists)):
            at = at[score[at] + rest[j] >= least - SLACK]
            w, docs, cuts, _, tfs = lists[j]
            if len(at) * len(cuts) * 8 > len(docs):
                alive = np.zeros(len(held), bool)
                alive[at] = True
                add(np.flatnonzero(alive[docs]))
            else:
                for a, b in pairwise(cuts):
                    place = np.minimum(np.searchsorted(docs[a:b], at), b - a - 1) + a
                    add(place[docs[place] == at])
            if added >= ROUND:
                least, added = max(least, kth(score[at[~self.dead[at]]], k)), 0
        at = at[~self.dead[at]]
        at = at[np.lexsort((self.ids[at], -np.round(score[at], 6)))[:k]]
        return self.ids[at], score[at], scored, sum(len(x[1]) for x in lists)


def live_rows(segment: int, parts: list[Segment]) -> Iterator[pa.RecordBatch]:
    """The rows of one segment of what isn't withdrawn of several."""
    keep = [~p.dead for p in parts]
    first = np.concatenate(([0], np.cumsum([k.sum() for k in keep])))
    held = [p.terms for p in parts]
    names = sorted({t for own in held for t in own})
    term, docs, tfs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lists, k, at in zip(held, keep, first, strict=False):
        place = np.cumsum(k) - 1 + at
        for i, t in enumerate(names):
            if t in lists:
                own = k[lists[t][0]]
                docs.append(place[lists[t][0][own]])
                tfs.append(lists[t][1][own])
                term.append(np.full(len(docs[-1]), i))
    term, docs, tfs = np.concatenate(term), np.concatenate(docs), np.concatenate(tfs)
    order = np.lexsort((docs, term))
    ids, lengths = (np.concatenate([x[k] for x, k in zip(xs, keep, strict=True)]) for xs in ([p.ids for p in parts], [p.lengths for p in parts]))
    return segment_rows(segment, ids, lengths, pa.array(names, pa.string()), term[order], docs[order], tfs[order])


def runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of one key start and end."""
    return [(a, b) for a, b in pairwise([0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]) if a < b]


def by_segment(key: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of rows of one key, cut at batches."""
    for batch in batches:
        keys = batch[key].to_numpy()
        for a, b in runs(keys):
            yield int(keys[a]), batch.slice(a, b - a)
