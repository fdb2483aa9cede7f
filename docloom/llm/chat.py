"""Chat formatting: quoted passages lead a message to the one it answers; quotes are cut, order follows the replies."""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import join_counted
from .storage import Scratch
from .textscan import mix, utf8, word_hashes

#: A stretch of words of one quote level: level 0 is the message's own, 1 what it quotes, 2 what that quotes. first: its first
#: word's place in the message; passage: whether it is a whole run of lines, rather than a line or sentence of one.
UNITS = "row long, conv_id long, turn long, level int, first int, words int, passage boolean, hash long"
QUOTED = r"(?m)^[ \t]*>"
#: Lines and sentences of fewer words say too little to be known again; whole passages of any length are.
LEAST_WORDS = 3
_MARKS = re.compile(r"(?:[ \t]*+>)++ ?")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SENTENCE_END = re.compile(r"[.!?][\"')\]]*$")


def quote_level(line: str) -> tuple[int, str]:
    """(levels, rest): how many quote marks lead the line, and what follows them."""
    marks = _MARKS.match(line)
    return (marks.group().count(">"), line[marks.end() :]) if marks else (0, line)


def parse(text: str) -> list[tuple[int, str, list[str]]]:
    """(level, rest, words) of each line."""
    found = map(quote_level, text.split("\n"))
    return [(level, rest, _WORD.findall(rest)) for level, rest in found]


def units(lines: list[tuple[int, str, list[str]]]) -> list[tuple[int, int, int, bool]]:
    """(level, first, words, passage): runs of lines of one level, which a blank line ends, and their lines and sentences of at
    least LEAST_WORDS words."""
    out, at, last = [], 0, -1
    runs: list[tuple[int, int, list[int], list[int]]] = []  # level, first word, ends of lines, ends of sentences
    for level, _, words in lines:
        if not words:
            last = -1
            continue
        if level != last:
            runs.append((level, at, [], []))
            last = level
        runs[-1][3].extend(at + i + 1 for i, w in enumerate(words) if _SENTENCE_END.search(w[-8:]))
        at += len(words)
        runs[-1][2].append(at)
    for level, first, ends, stops in runs:
        to = ends[-1]
        found = {(first, to)}
        for cuts in (ends, stops):
            found |= set(zip([first, *cuts], [*cuts, to], strict=True))
        out += [(level, a, b - a, (a, b) == (first, to)) for a, b in sorted(found) if b - a >= LEAST_WORDS or (b > a and (a, b) == (first, to))]
    return out


def cut(text: str, linked: list[tuple[int, int]]) -> str:
    """The text without the quoted lines all of whose words are in linked stretches (first, words), and without the blank quoted
    lines beside them. Quoted lines that link to nothing stay as they are."""
    lines = parse(text)
    counts = np.array([len(words) for _, _, words in lines])
    edges = np.zeros(int(counts.sum()) + 1, np.int64)
    for first, n in linked:
        edges[first] += 1
        edges[first + n] -= 1
    covered = np.concatenate(([0], np.cumsum(np.cumsum(edges[:-1]) > 0)))
    ends = np.cumsum(counts)
    gone = [level > 0 and n > 0 and covered[b] - covered[b - n] == n for (level, _, _), n, b in zip(lines, counts, ends, strict=True)]
    for order in (range(1, len(lines)), range(len(lines) - 2, -1, -1)):
        step = 1 if order.step > 0 else -1
        for i in order:
            if lines[i][0] > 0 and not counts[i] and gone[i - step]:
                gone[i] = True
    if not any(gone):
        return text
    return "\n".join(line for line, out in zip(text.split("\n"), gone, strict=True) if not out).strip("\n")


def unit_hashes(words: list[str], starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each stretch of the words, A-Z lower-cased, so that wrapping and white space don't matter."""
    data, offsets = utf8(pa.array(words, pa.large_string()))
    each = word_hashes(data, offsets[:-1], offsets[1:])
    ends = np.cumsum(sizes)
    place = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)
    mixed = mix(each[np.repeat(starts, sizes) + place] + mix(place.astype(np.uint64) + np.uint64(1)))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed)))
    return mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64)).view(np.int64)


def _unit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, rows, found = [], [], []
        for i, text in enumerate(batch.column(3).to_pylist()):
            lines = parse(text or "")
            own = units(lines)
            rows += [i] * len(own)
            found += [(level, first, n, passage, len(words) + first) for level, first, n, passage in own]
            for _, _, x in lines:
                words += x
        level, first, n, passage, at = map(np.array, zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 5
        of = pa.array(rows, pa.int64())
        hashes = unit_hashes(words, at, n)
        yield pa.RecordBatch.from_arrays(
            [*(c.take(of) for c in batch.columns[:3]), pa.array(level, pa.int32()), pa.array(first, pa.int32()), pa.array(n, pa.int32()), pa.array(passage.astype(bool)), pa.array(hashes)],
            names=[x.split()[0] for x in UNITS.split(", ")],
        )


def _cutter(at: int, cuts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [cut(t or "", [(c["first"], c["words"]) for c in linked]) for t, linked in zip(batch.column(at).to_pylist(), batch.column(cuts).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns[:cuts])], names=batch.schema.names[:cuts])

    return run


def _latest_writers(units: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, first, words, level, seen): quoted stretches and the latest earlier turn of their conversation whose own words they
    are. Writers and quoters of a stretch are dealt by ranges of turns, so one that very many share spans tasks."""
    quoted = units.where("level > 0")
    asked = scratch.write(quoted.groupBy("conv_id", "hash", "turn").agg(F.count("*").alias("n")), "asked")
    keys = asked.groupBy("conv_id", "hash").agg(F.lit(1).alias("one"))
    wrote = units.where("level = 0").select("conv_id", "hash", "turn").distinct().join(keys, ["conv_id", "hash"], "left_semi")
    both = wrote.withColumn("by", F.col("turn")).unionByName(asked.select("conv_id", "hash", "turn", F.lit(None).cast("long").alias("by")))
    dealt = scratch.write(both.repartitionByRange("conv_id", "hash", "turn").withColumn("_p", F.spark_partition_id()), "writers")
    here = F.max("by").over(Window.partitionBy("_p", "conv_id", "hash").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1))
    parts = dealt.groupBy("_p", "conv_id", "hash").agg(F.max("by").alias("_last"))
    parts = parts.withColumn("_last", F.max("_last").over(Window.partitionBy("conv_id", "hash").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))
    seen = dealt.withColumn("_here", here).where("by is null").join(parts, ["_p", "conv_id", "hash"]).withColumn("seen", F.greatest("_here", "_last"))
    seen = seen.where("seen is not null").join(asked, ["conv_id", "hash", "turn"]).select("conv_id", "hash", "turn", "seen", "n")
    found = join_counted(quoted, scratch.write(seen, "seen"), ["conv_id", "hash", "turn"], quoted.count())
    return found.select("row", "first", "words", "level", "seen")


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, text without quotes, parent_turn, depth, position, n_quoted.

    Lines that quote marks lead are quoted, at the level of their marks. Quoted passages, and each line and sentence of them
    that has three words, are looked up among the own passages, lines and sentences of earlier messages of the conversation;
    the latest writer counts. So `>>> OK` links to a message or passage that is OK, not to a line of one. parent_turn is the writer at the lowest level; there, of the longest stretch, then the last one; a message that
    quotes nothing known answers the one before it. Lines whose words are all found are cut from the text; other quoted
    lines stay. n_quoted counts quoted passages. depth counts answers from the first message. position orders a conversation by
    replies: a message stands right behind what it answers, and answers to the same message keep their turns' order.

    Null texts are empty; a null turn or conversation stays apart: its row has no parent and depth and position 0, and
    nothing is cut from it. Equal turns of a conversation answer the turn before them. Other columns are not read; an empty
    table gives an empty result. Only conversations with quotes are parsed, in time in proportion to their texts.
    """
    scratch = Scratch(messages.sparkSession, "chat")
    base = messages.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = scratch.write(base.withColumn("row", F.monotonically_increasing_id()), "rows")
    placed = rows.where("conv_id is not null and turn is not null")
    asking = placed.groupBy("conv_id").agg(F.count("*").alias("n"), F.max(F.col("text").rlike(QUOTED)).alias("quotes")).where("quotes").drop("quotes")
    talk = join_counted(placed.select("row", "conv_id", "turn", "text"), scratch.write(asking, "asking"), ["conv_id"], rows.count())
    found = scratch.write(talk.select("row", "conv_id", "turn", "text").mapInArrow(_unit_batches, UNITS), "units")
    links = _latest_writers(found, scratch)
    best = F.max(F.struct((-F.col("level")).alias("l"), "words", "first", "seen")).alias("m")
    links = links.groupBy("row").agg(best, F.collect_list(F.struct("first", "words")).alias("cuts")).select("row", F.col("m.seen").alias("quoted_turn"), "cuts")
    links = scratch.write(links.join(found.where("level > 0 and passage").groupBy("row").agg(F.count("*").alias("n_quoted")), "row", "full"), "links")
    turns = in_order(placed.select("conv_id", "turn").distinct(), ["conv_id"], F.col("turn"), scratch, "turns")
    known = rows.join(links, "row", "left").join(turns, ["conv_id", "turn"]).withColumn("parent_turn", F.coalesce("quoted_turn", "before"))
    known = scratch.write(known.withColumn("n_quoted", F.coalesce("n_quoted", F.lit(0)).cast("long")), "known")
    linked = scratch.write(known.where("quoted_turn is not null").groupBy("conv_id").agg(F.lit(1).alias("one")), "linked")
    # Where nothing is quoted the replies follow the turns.
    straight = known.join(linked, "conv_id", "left_anti").withColumn("depth", F.col("place")).withColumn("position", F.col("place"))
    ordered = _reply_order(scratch.write(known.join(linked, "conv_id", "left_semi"), "replies"), scratch)
    apart = rows.where("conv_id is null or turn is null").select("*", F.lit(None).cast("long").alias("parent_turn"), *(F.lit(0).cast("long").alias(c) for c in ("depth", "position", "n_quoted")))
    columns = ["conv_id", "turn", "role", "text", "parent_turn", "depth", "position", "n_quoted"]
    whole = straight.select(*columns).unionByName(ordered.where("cuts is null").select(*columns)).unionByName(apart.select(*columns))
    quoting = ordered.where("cuts is not null").select(*columns, "cuts")
    return whole.unionByName(quoting.mapInArrow(_cutter(3, 8), whole.schema))


def in_order(rows: DataFrame, keys: list[str], order: Column, scratch: Scratch, name: str) -> DataFrame:
    """Adds to distinct rows their place within their keys, from 0, and the order value before theirs.

    Rows are dealt by ranges of keys and order, so a group may span partitions: each part counts its own, and the parts of
    a group, one row for each, are then summed up.
    """
    dealt = rows.withColumn("_o", order).repartitionByRange(*[F.col(c) for c in keys], F.col("_o")).withColumn("_p", F.spark_partition_id())
    dealt = scratch.write(dealt, name)
    own = Window.partitionBy("_p", *keys).orderBy("_o")
    local = dealt.withColumn("_n", F.row_number().over(own)).withColumn("_b", F.lag("_o").over(own))
    earlier = Window.partitionBy(*keys).orderBy("_p")
    parts = dealt.groupBy("_p", *keys).agg(F.count("*").alias("_c"), F.max("_o").alias("_last"))
    parts = parts.withColumn("_before", F.sum("_c").over(earlier) - F.col("_c")).withColumn("_last", F.lag("_last").over(earlier)).drop("_c")
    joined = local.join(parts, ["_p", *keys])
    return joined.withColumn("place", (F.col("_n") - 1 + F.col("_before")).cast("long")).withColumn("before", F.coalesce("_b", "_last")).drop("_o", "_p", "_n", "_b", "_before", "_last")


def _reply_order(known: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds depth and position: the walk round each conversation's tree enters and leaves every message once, and sums along
    it double their reach each round, so a long chain of answers takes the logarithm of its length in rounds."""
    nodes = scratch.write(known.select("conv_id", "turn", F.col("parent_turn").alias("up")).groupBy("conv_id", "turn").agg(F.max("up").alias("up")), "nodes")
    child = nodes.where("up is not null").groupBy("conv_id", F.col("up").alias("turn")).agg(F.min("turn").alias("child"))
    beside = in_order(nodes.where("up is not null"), ["conv_id", "up"], -F.col("turn"), scratch, "beside").select("conv_id", "turn", (-F.col("before")).alias("beside"))
    nodes = nodes.join(child, ["conv_id", "turn"], "left").join(beside, ["conv_id", "turn"], "left")
    enter = nodes.select("conv_id", "turn", F.lit(0).alias("out"), F.coalesce("child", "turn").alias("to"), F.col("child").isNull().cast("int").alias("to_out"), F.lit(1).alias("messages"), F.lit(1).alias("level"))
    leave = nodes.select("conv_id", "turn", F.lit(1).alias("out"), F.coalesce("beside", "up").alias("to"), F.col("beside").isNull().cast("int").alias("to_out"), F.lit(0).alias("messages"), F.lit(-1).alias("level"))
    walk = enter.unionByName(leave).withColumn("messages", F.col("messages").cast("long")).withColumn("level", F.col("level").cast("long"))
    walk, step = scratch.write(walk, "walk-0"), 0
    while walk.where("to is not null").limit(1).count():
        step += 1
        ahead = walk.select("conv_id", F.col("turn").alias("to"), F.col("out").alias("to_out"), F.col("to").alias("to2"), F.col("to_out").alias("to_out2"), F.col("messages").alias("messages2"), F.col("level").alias("level2"))
        both = walk.join(ahead, ["conv_id", "to", "to_out"], "left")
        more = lambda c: (F.col(c) + F.coalesce(f"{c}2", F.lit(0))).alias(c)
        walk = scratch.write(both.select("conv_id", "turn", "out", F.col("to2").alias("to"), F.col("to_out2").alias("to_out"), more("messages"), more("level")), f"walk-{step}")
        scratch.drop(f"walk-{step - 1}")
    total = walk.where("out = 0").groupBy("conv_id").agg(F.max("messages").alias("all"))
    placed = walk.where("out = 0").join(total, "conv_id").select("conv_id", "turn", (-F.col("level")).alias("depth"), (F.col("all") - F.col("messages")).alias("position"))
    return known.join(placed, ["conv_id", "turn"])


def chat_text(linked: DataFrame) -> DataFrame:
    """(conv_id, messages): each conversation's rows in reply order, as an array of role and text. For conversations that
    fit into a row; link_quotes() itself has no such limit."""
    one = F.struct("position", "turn", "role", "text")
    rows = linked.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("m"))
    return rows.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("messages"))


def chat_sql() -> str:
    """The same rows in DuckDB where no message quotes: what the given table holds. Quoted lines make it differ."""
    return """
SELECT conv_id, turn, role, coalesce(text, '') AS text,
  max(turn) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent_turn,
  CAST(dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS depth,
  CAST(dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS position, CAST(0 AS BIGINT) AS n_quoted
FROM conversations
"""
