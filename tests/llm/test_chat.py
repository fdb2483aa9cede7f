import random
import re
import time

import duckdb

from docloom.llm import chat, skew


def levels(text):
    """(level, words) of each line, by counting marks one after another."""
    out = []
    for line in text.split("\n"):
        level, rest = 0, line
        while rest.lstrip(" \t").startswith(">"):
            level, rest = level + 1, rest.lstrip(" \t")[1:]
        out.append((level, rest.split()))
    return out


def stretches(text):
    """{(level, first, words)}: passages, and lines and sentences of three words or more."""
    out, at, run = set(), 0, []

    def close():
        if run:
            level, first, words = run[0][0], run[0][1], [w for _, _, own in run for w in own]
            for _, a, own in run:
                if len(own) > 2:
                    out.add((level, a, tuple(x.lower() for x in own)))
            start = 0
            for i, w in enumerate(words, 1):
                if re.search(r"[.!?][\"')\]]*$", w) or i == len(words):
                    if i - start > 2:
                        out.add((level, first + start, tuple(x.lower() for x in words[start:i])))
                    start = i
            out.add((level, first, tuple(x.lower() for x in words)))
            run.clear()

    for level, words in levels(text):
        if not words or (run and run[0][0] != level):
            close()
        if words:
            run.append((level, at, words))
            at += len(words)
    close()
    return out


def brute_force(rows):
    """{(conv, turn): (text, parent, depth, position)} by walking each conversation."""
    out = {}
    for conv in {c for c, *_ in rows}:
        own = dict(sorted((t, x or "") for c, t, x in rows if c == conv))
        parent, texts = {}, {}
        for t, x in own.items():
            wrote = {}
            for u in (u for u in own if u < t):
                wrote |= {words: u for level, _, words in stretches(own[u]) if level == 0}
            found = [(-level, len(words), first, wrote[words]) for level, first, words in stretches(x) if level > 0 and words in wrote]
            parent[t] = max(found)[3] if found else max((u for u in own if u < t), default=None)
            held = {i for _, n, first, _ in found for i in range(first, first + n)}
            kept, at, lines = [], 0, levels(x)
            for level, words in lines:
                kept.append(level == 0 or not words or not held.issuperset(range(at, at + len(words))))
                at += len(words)
            cut = [level > 0 and bool(words) and not k for (level, words), k in zip(lines, kept, strict=True)]
            for i, (level, words) in enumerate(lines):
                if level > 0 and not words:
                    near = [next((j for j in order if lines[j][1] or lines[j][0] == 0), None) for order in (range(i - 1, -1, -1), range(i + 1, len(lines)))]
                    kept[i] = not any(j is not None and cut[j] for j in near)
            texts[t] = x if all(kept) else "\n".join(line for line, k in zip(x.split("\n"), kept, strict=True) if k).strip("\n")

        def walk(t, depth):
            out[conv, t] = (texts[t], parent[t], depth, sum(c == conv for c, _ in out))
            for child in sorted(u for u in parent if parent[u] == t):
                walk(child, depth + 1)

        walk(min(own), 0)
    return out


def test_quote_levels():
    assert chat.quote_level("> > a") == (2, "a") and chat.quote_level(">>a") == (2, "a") and chat.quote_level(">") == (1, "") and chat.quote_level(" > a") == (1, "a")
    assert chat.quote_level("a > b") == (0, "a > b") and chat.quote_level("  a") == (0, "  a")
    found = chat.units(chat.parse("> one\n> a b two. three x y\n>> deep\n\nmine\nmore\n"))
    assert found == [(1, 0, 4, False), (1, 0, 7, True), (1, 1, 6, False), (1, 4, 3, False), (2, 7, 1, True), (0, 8, 2, True)]
    assert chat.cut("> one two\n>\n> three\nmine\n", [(0, 2)]) == "> three\nmine" and chat.cut(">>> print(1)\n\n", []) == ">>> print(1)\n\n"


def test_long_lines_take_linear_time():
    for line in (" " * 1_000_000 + ">", "> " * 500_000, " \t" * 500_000, ">" * 1_000_000 + " x"):
        began = time.time()
        chat.cut(line, [])
        assert time.time() - began < 1


def test_replies_match_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    rows = []
    for conv in range(10):
        said = []
        for turn in range(rng.choice([1, 2, 9, 25])):
            lines = [f"message {conv % 3} {turn} says {rng.randint(0, 6)}. And more?" if rng.random() < 0.8 else "Fine." for _ in range(rng.randint(1, 3))]
            text = "\n".join(lines)
            if said and rng.random() < 0.8:
                old = rng.choice(said)
                part = rng.choice([old, rng.choice(old.split("\n")), old.split(".")[0] + ".", old.upper(), old.replace(" ", "\n", 1), "never said"])
                quote = ["> " + x for x in part.split("\n")] + [">"] * rng.randint(0, 1)
                if rng.random() < 0.4:
                    quote.insert(rng.randint(0, len(quote)), rng.choice(["> > ", ">>", " > >"]) + rng.choice(said).split("\n")[0])
                text = "\n".join([*quote, text] if rng.random() < 0.7 else [lines[0], "", *quote, text])
            rows.append((conv, turn, text))
            said.append("\n".join(lines))
    rows += [(20, 0, "Run this:\n>>> print(1)\n> a maxim"), (20, 1, "> a maxim\nNo."), (20, 2, "> > print(1)\n\n>>> print(1)\nyes")]
    df = spark.createDataFrame([(c, t, "user", x, "x") for c, t, x in rows], "conv_id long, turn long, role string, text string, place string").repartition(3)
    want = brute_force(rows)
    for bound in (100_000, 3):
        monkeypatch.setattr(skew, "HOT_KEYS", bound)
        assert {(r.conv_id, r.turn): (r.text, r.parent_turn, r.depth, r.position) for r in chat.link_quotes(df).collect()} == want
    assert any(p is not None and p < t - 1 for (_, t), (_, p, _, _) in want.items())
    assert want[20, 0][0] == rows[-3][2]


def test_single_lines_and_nested_quotes_link(spark):
    rows = [(1, 0, "First line.\nSecond line, which is longer.\nAnd the third."), (1, 1, "other"), (1, 2, "> Second line, which is\n> longer.\nI agree"), (1, 3, ">> And the third.\n> unknown words\nhm"), (1, 4, "> I agree\n>> And the third.\nok")]
    found = {r.turn: (r.parent_turn, r.text, r.n_quoted) for r in chat.link_quotes(spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")).collect()}
    assert found == {0: (None, rows[0][2], 0), 1: (0, "other", 0), 2: (0, "I agree", 1), 3: (0, "> unknown words\nhm", 2), 4: (2, "ok", 2)}


def test_chat_text(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "v", "b"), (1, 2, "u", "> a\nc")]
    found = chat.chat_text(chat.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert [(m.role, m.text) for m in found[0].messages] == [("u", "a"), ("v", "b"), ("u", "c")]


def test_nulls_and_ties(spark):
    rows = [(1, 0, "u", None), (1, 1, "a", "x"), (1, 1, "a", "x"), (None, 0, "u", "y"), (2, None, "u", "> z"), (3, 5, None, "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(map(tuple, chat.link_quotes(df).collect()), key=repr)
    want = [(1, 0, "u", "", None, 0, 0, 0), (1, 1, "a", "x", 0, 1, 1, 0), (1, 1, "a", "x", 0, 1, 1, 0), (None, 0, "u", "y", None, 0, 0, 0), (2, None, "u", "> z", None, 0, 0, 0), (3, 5, None, "", None, 0, 0, 0)]
    assert got == sorted(want, key=repr)
    assert chat.link_quotes(df.limit(0)).count() == 0
    con = duckdb.connect()
    table = df.where("conv_id is not null and turn is not null").toArrow()
    con.register("conversations", table)
    assert sorted(con.execute(chat.chat_sql()).fetchall(), key=repr) == sorted((r for r in want if r[0] and r[1] is not None), key=repr)


def test_short_lines_link_as_whole_passages_only(spark):
    """A shell example isn't a quote of a message that has its one word on a line; it is one of a message that is this word."""
    rows = [
        (1, 0, "OK\nthen we go on with the other part"), (1, 1, "start it:\n>>> OK\ndone"), (1, 2, "> then we go on with the other part\nyes"),
        (2, 0, "OK"), (2, 1, "something else altogether"), (2, 2, "> OK\ngood"), (3, 0, "well. no. so it is then."), (3, 1, "x"), (3, 2, "> well. so it is then.\nhm"),
    ]
    found = {(r.conv_id, r.turn): (r.parent_turn, r.text) for r in chat.link_quotes(spark.createDataFrame([(*r, "user") for r in rows], "conv_id long, turn long, text string, role string")).collect()}
    assert found[1, 1] == (0, "start it:\n>>> OK\ndone") and found[1, 2] == (0, "yes")
    assert found[2, 2] == (0, "good") and found[3, 2] == (0, "> well. so it is then.\nhm")
    want = brute_force([r[:3] for r in rows])
    assert all(found[key] == (want[key][1], want[key][0]) for key in found)
