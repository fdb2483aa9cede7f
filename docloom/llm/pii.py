"""Personal data: fixed patterns, then terms whose co-occurrence in the corpus discloses a protected value."""

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import KnownRanges
from .skew import join_counted
from .storage import Scratch
from .textscan import slices, utf8, word_bounds, word_hashes

KINDS = ("email", "ip", "card", "phone")
#: Words on either side of a protected value that make its context.
REACH = 8
#: Different contexts in which a term has to stand beside a value before their co-occurrence counts.
SUPPORT = 3
#: A term is disclosing if it gives at least this part of a value's information.
DISCLOSED = 0.8
#: Distinct words, and terms, that a worker keeps; beyond them it starts anew.
KEPT_WORDS = 400_000
# Fixed patterns. The look-behinds stop a second start inside a run that the pattern takes whole from its beginning.
_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_HERE = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_CONTEXT = re.compile(r"[^\x20\x09-\x0D]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while found := _EMAIL_HERE.match(text, at) or _EMAIL.search(text, at):
        yield found.span()
        at = found.end()


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start: leftmost matches of each pattern that do not overlap; those that fail their
    test are dropped, and what they cover isn't searched again."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_byte, m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return out


def _bare(text: str, x: int, y: int) -> tuple[int, int]:
    """A word's bounds without what leads or follows its letters and digits."""
    while y > x and not text[y - 1].isalnum():
        y -= 1
    while y > x and not text[x].isalnum():
        x += 1
    return x, y


_DATE = re.compile(r"\d{1,4}([-/.])\d{1,2}\1\d{1,4}")


def word_class(word: str) -> str:
    """What a term is generalised to. No term has such a form, since terms begin with a letter or digit."""
    if word.isdigit():
        return "[NUMBER]"
    if _DATE.fullmatch(word):
        return "[DATE]"
    if any(c.isdigit() for c in word):
        return "[CODE]"
    return "[NAME]" if word[:1].isupper() else "[WORD]"


def _entity(text: str, kind: str, a: int, b: int) -> str:
    value = text[a:b].lower() if kind == "email" else _NOT_DIGIT.sub("", text[a:b]) if kind != "ip" else text[a:b]
    return f"{kind}:{value}"


def _word_bounds(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word, in code points."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    edges = np.diff(np.concatenate(([0], ((points != 32) & ((points < 9) | (points > 13))).astype(np.int8), [0])))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _marks(text: str, spans: list[tuple[str, int, int]], wanted: set[str]) -> list[tuple[str, int, int]]:
    """Every place of a wanted term in the text; values and what touches them are no terms."""
    out = []
    if wanted:
        taken = np.array(sorted((a, b) for _, a, b in spans))
        latest = np.maximum.accumulate(taken[:, 1])
        for x, y in zip(*map(np.ndarray.tolist, _word_bounds(text)), strict=True):
            x, y = _bare(text, x, y)
            if text[x:y].lower() in wanted:
                i = np.searchsorted(taken[:, 0], y)
                if i == 0 or latest[i - 1] <= x:
                    out.append(("term", x, y))
    return out


def _contexts(text: str, spans: list[tuple[str, int, int]]) -> list[tuple]:
    """(entity, term, context) of the REACH words on either side of each value, the same for each term's class, and once
    without a term for the value itself; values and what touches them are no terms."""
    starts, ends = _word_bounds(text)
    taken = np.array(sorted((a, b) for _, a, b in spans))
    latest = np.maximum.accumulate(taken[:, 1])
    out = []
    for kind, a, b in spans:
        entity = _entity(text, kind, a, b)
        before, after = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
        at = [*range(max(0, before - REACH), before), *range(after, min(len(starts), after + REACH))]
        near = [(int(starts[i]), int(ends[i])) for i in at]
        context = hashlib.blake2b("\0".join(text[x:y].lower() for x, y in near).encode(), digest_size=8).digest()
        seen = int.from_bytes(context, "little", signed=True)
        out.append((entity, None, seen))
        for x, y in near:
            x, y = _bare(text, x, y)
            i = np.searchsorted(taken[:, 0], y) if y > x else 0  # values that begin before the word ends
            if y > x and (i == 0 or latest[i - 1] <= x):
                out += [(entity, text[x:y].lower(), seen), (entity, word_class(text[x:y]), seen)]
    return out


_FOUND = "text_hash string, contexts array<struct<entity:string,term:string,context:long,first:long>>"
_SEEN = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string()), ("context", pa.int64()), ("first", pa.int64())]))


def _line(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _likely(texts: pa.Array) -> np.ndarray:
    """Places of the texts that may hold a value."""
    return np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, "[0-9@]"), False).to_numpy(zero_copy_only=False))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, seen = [], []
        for i in _likely(batch.column(0)):
            text = batch.column(0)[int(i)].as_py()
            if found := base_spans(text):
                hashes.append(hashlib.sha256(text.encode()).hexdigest())
                contexts, had = [], set()
                for entity, term, context in _contexts(text, found):
                    contexts.append({"entity": entity, "term": term, "context": context, "first": int((entity, term) not in had)})
                    had.add((entity, term))
                seen.append(contexts)
        yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.string()), pa.array(seen, _SEEN)], names=["text_hash", "contexts"])


class _Vocabulary:
    """Numbers of terms and classes; each distinct word is taken apart once."""

    def __init__(self):
        self.known, self.names, self.number = KnownRanges(KEPT_WORDS), [], {}

    def _learn(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, lengths = [], np.zeros(len(raw), np.int64)
        for i, word in enumerate(x.decode() for x in raw):
            x, y = _bare(word, 0, len(word))
            if y > x:
                lengths[i] = 2
                for name in (word[x:y].lower(), word_class(word[x:y])):
                    if name not in self.number:
                        self.number[name] = len(self.names)
                        self.names.append(name)
                    ids.append(self.number[name])
        return np.array(ids, np.int32), lengths, np.zeros(len(raw), bool)

    def count(self, data: np.ndarray, offsets: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """(words, occurrences of each number, texts that hold it)"""
        starts, ends, firsts = word_bounds(data, offsets)
        at = self.known.places(data, starts, ends, word_hashes(data, starts, ends, lower=False), self._learn)
        ids, lengths = self.known.ids.gather(at)
        row = np.repeat(np.repeat(np.arange(len(offsets) - 1), np.diff(firsts)), lengths)
        held = np.unique(row << 32 | ids) & 0xFFFFFFFF
        return len(starts), np.bincount(ids, minlength=len(self.names)), np.bincount(held, minlength=len(self.names))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of all terms and their classes in each batch, and texts that hold them; all words and texts of the batch
    stand under no term."""
    own = _Vocabulary()
    for batch in batches:
        if len(own.names) > KEPT_WORDS:
            own = _Vocabulary()
        total, words, texts = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        data, offsets = utf8(batch.column(0))
        for a, b in slices(offsets):
            n, more_words, more_texts = own.count(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            total += n
            for sums, more in ((words, more_words), (texts, more_texts)):
                more[: len(sums)] += sums
            words, texts = more_words, more_texts
        held = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array([None, *(own.names[i] for i in held)], pa.string()), pa.array([total, *words[held]], pa.int64()), pa.array([batch.num_rows, *texts[held]], pa.int64())], names=["term", "n", "texts"])


def _disclosing(found: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(entity, term) pairs whose pointwise mutual information is at least DISCLOSED of the entity's own information.

    Probabilities are over the words of the whole corpus, all in occurrences, so copies weigh alike on both sides: an
    entity's are its values', a term's its own, the pair's those of the term beside the value. A pair needs SUPPORT different
    contexts, and there copies of a context count once. Or else the same holds with texts for words: those with the value,
    with the term anywhere, and with the term beside the value.
    """
    seen = found.where(F.size("contexts") > 0).select(F.explode("contexts").alias("c")).groupBy("c.entity", "c.term", "c.context").agg(F.count("*").alias("n"), F.sum("c.first").alias("texts"))
    seen = scratch.write(seen, "contexts")
    pairs = seen.where("term is not null").groupBy("entity", "term").agg(F.sum("n").alias("both"), F.sum("texts").alias("both_texts"), F.count("*").alias("support"))
    pairs = scratch.write(pairs.where(F.col("support") >= SUPPORT), "pairs")
    values = seen.where("term is null").groupBy("entity").agg(F.sum("n").alias("n_entity"), F.sum("texts").alias("entity_texts"))
    terms = scratch.write(pairs.select("term").distinct(), "terms")
    counts = scratch.write(texts.mapInArrow(_count, "term string, n long, texts long").groupBy("term").agg(F.sum("n").alias("n_term"), F.sum("texts").alias("term_texts")), "counts")
    total = counts.where("term is null").select(F.col("n_term").alias("total"), F.col("term_texts").alias("all_texts"))
    n_term = terms.join(counts, "term", "left").select("term", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_term", "term_texts")])
    scored = pairs.join(values, "entity").join(n_term, "term").join(F.broadcast(total))
    # A context spans 2 * REACH words, so that many places would hold the term by chance.
    shared = F.log2(F.col("both") * F.col("total") / (F.col("n_entity") * 2 * REACH * F.greatest("n_term", "both")))
    own = F.log2(F.col("total") / (F.col("n_entity") * 2 * REACH))
    # The same by texts: a name that a text repeats away from the value is as close to it there.
    shared_texts = F.log2(F.col("both_texts") * F.col("all_texts") / (F.col("entity_texts") * F.greatest("term_texts", "both_texts")))
    own_texts = F.log2(F.col("all_texts") / F.col("entity_texts"))
    return scratch.write(scored.where((shared >= DISCLOSED * own) | ((own_texts > 0) & (shared_texts >= DISCLOSED * own_texts))).select("entity", "term"), "disclosing")


def _with_terms(docs: DataFrame, text_col: str, scratch: Scratch) -> DataFrame:
    """docs with a last column, the disclosing terms of the text's values and of their classes; null where there are none.

    They are joined by the text's hash. Only texts with such terms are on that side, so Spark broadcasts it where it is
    small, and splits the copies of a text where it isn't.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    found = scratch.write(texts.mapInArrow(_scan, _FOUND), "found")
    pairs = _disclosing(found, texts, scratch)
    held = found.select("text_hash", F.explode("contexts").alias("c")).where("c.term is null").select("text_hash", "c.entity").distinct()
    held = scratch.write(held, "held")
    terms = pairs.groupBy("entity").agg(F.collect_set("term").alias("terms")).join(held.groupBy("entity").agg(F.count("*").alias("n")), "entity")
    held = join_counted(held, terms, ["entity"], held.count())
    held = scratch.write(held.groupBy("text_hash").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")), "text-terms")
    scratch.keep("text-terms")
    columns = [f"c{j}" for j in range(len(docs.columns))]
    hashed = docs.toDF(*columns).withColumn("text_hash", F.sha2(F.col(columns[docs.columns.index(text_col)]).cast("string"), 256))
    return hashed.join(held, "text_hash", "left").select(*columns, "terms")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    spans has the base spans by kind, then every place in the text of a term that discloses one of the row's values, as
    kind:start:end in code points. Null and empty texts have none. Null ids pass through, repeated rows are scanned once
    each, other columns are not read; an empty table gives an empty result. A long text is scanned in time in proportion to
    its length.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    source = _with_terms(texts, "text", Scratch(docs.sparkSession, "pii"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            n, texts = batch.num_rows, batch.column(1)
            counts, sums, lines = np.zeros((len(KINDS), n), np.int64), [nothing] * n, [""] * n
            for i in _likely(texts):
                text = texts[int(i)].as_py()
                if spans := base_spans(text):
                    for kind, _, _ in spans:
                        counts[KINDS.index(kind), i] += 1
                    sums[i] = hashlib.sha256(_line(spans).encode()).hexdigest()
                    lines[i] = _line(spans + _marks(text, spans, set(batch.column(2)[int(i)].as_py() or ())))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts), pa.array(sums, pa.string()), pa.array(lines, pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return source.mapInArrow(run, f"doc_id long, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string")


def cut(text: str, spans: list[tuple[str, int, int]], disclosing: set[str] = frozenset()) -> str:
    """The text with values replaced by their kind, and terms by their class, or by nothing where the class is disclosing
    itself. Of spans that overlap, the union goes under the name of the first."""
    out, at = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b in spans):
        if start >= at:
            name = f"[{kind.upper()}]" if kind != "term" else word_class(text[start:end])
            out += [text[at:start], name if name not in disclosing else ""]
        at = max(at, end)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs with the found spans cut from the text; length_col, if given, gets the new length. Other columns stay as they are.

    A disclosing term becomes its class: [NUMBER], [DATE], [CODE], [NAME] or [WORD]; where that class discloses the value,
    too, the term is removed. Spans depend on the text and the disclosing pairs alone.
    """
    columns, at = docs.columns, docs.columns.index(text_col)
    source = _with_terms(docs, text_col, Scratch(docs.sparkSession, "sanitise"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            new = texts.to_pylist()
            for i in _likely(texts):
                if spans := base_spans(new[i]):
                    terms = set(batch.column(len(columns))[int(i)].as_py() or ())
                    new[i] = cut(new[i], spans + _marks(new[i], spans, terms), terms)
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if j == at else batch.column(j) for j in range(len(columns))], names=columns)

    out = source.mapInArrow(run, docs.schema)
    return out.withColumn(length_col, F.length(F.col(text_col)).cast(docs.schema[length_col].dataType)) if length_col else out
