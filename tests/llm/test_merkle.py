import hashlib
import zlib

import pytest

from docloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, node string, digest string, tree long"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(r, text):
    parts = [str(v) if v is not None else None for v in (r[0], r[3], r[2], r[4], text)]
    return _h(*("-" if v is None else f"{len(v.encode())}:{v}" for v in parts))


def _up(level):
    """The last digest of a list of them, and for each place the runs on its way: (digests before, digests behind)."""
    ways = [[] for _ in level]
    at = list(range(len(level)))
    while len(level) > 1:
        for i, way in enumerate(ways):
            a = at[i] // 8 * 8
            run = level[a : a + 8]
            way.append((run[: at[i] - a], run[at[i] - a + 1 :]))
            at[i] //= 8
        level = [_h(*level[a : a + 8]) for a in range(0, len(level), 8)]
    return level[0], ways


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own, subroots = {}, []
    for lang in langs:
        own[lang] = sorted(((_leaf(r, r[1]), r) for r in rows if r[2] == lang), key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        subroots.append(_up([leaf for leaf, _ in own[lang]]))
    root, top = _up([s for s, _ in subroots])
    out = []
    for t, lang in enumerate(langs):
        for (leaf, r), way in zip(own[lang], subroots[t][1], strict=True):
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            folded, beside = _leaf(r, text), []
            for before, behind in way + top[t]:
                folded = _h(*before, folded, *behind)
                beside += before + behind
            out.append((r[0], leaf, subroots[t][0], root, _h(*beside), folded, folded == root))
    return sorted(out, key=repr)


def _rows(n, langs):
    return [(i, f"Text {i} Ä" if i % 2 else f"text {i}", langs[i * i % len(langs)], f"s{i % 3}", i) for i in range(n)]


def _found(spark, rows):
    df = spark.createDataFrame([(*r, "x", "x", "x", 1) for r in rows], SCHEMA).repartition(3)
    found = merkle.verify(df)
    assert found.columns == COLUMNS
    return sorted(map(tuple, found.collect()), key=repr)


@pytest.mark.parametrize("hot", [50_000, 3])
def test_equals_the_definition(spark, monkeypatch, hot):
    """Trees of different heights, null groups, repeated rows, null fields; with all nodes broadcast and with few."""
    monkeypatch.setattr(merkle, "HOT_NODES", hot)
    rows = _rows(150, ["en"] * 30 + [None, "", "é", "z"])
    rows += [(None, "A", "en", None, None), (None, None, None, None, None), (7, "Again", "en", "s", 1), (7, "Again", "en", "s", 1), (200, "", "one", "s", 0)]
    rows += [(300 + i, "x", f"l{i:02}", None, i) for i in range(12)]
    assert _found(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_heights(spark, n):
    rows = _rows(n, ["en"])
    assert _found(spark, rows) == brute(rows)


def test_a_leaf_alone_is_the_root(spark):
    (row,) = _found(spark, [(1, "abc", "en", "s", 3)])
    assert row[1] == row[2] == row[3] and row[4] == hashlib.sha256(b"").hexdigest() and row[6]


def test_odd_texts(spark, odd_texts):
    rows = [(i, t, None if i == 3 else "en", None, i) for i, t in odd_texts]
    assert _found(spark, rows) == brute(rows)


def test_empty(spark):
    assert _found(spark, []) == []


def test_nodes_are_linked_to_the_root(spark):
    from docloom.llm.storage import Scratch
    from pyspark.sql import functions as F

    rows = spark.range(700).select(F.when(F.col("id") < 600, "a").otherwise("b").alias("g"), "id", merkle.digest(F.col("id").cast("string")).alias("digest"))
    tree = merkle.build(rows, "g", ["id"], ["id"], Scratch(spark, "test"))
    nodes = {tuple(r.node): r for r in tree.nodes.collect()}
    assert len(nodes) == 75 + 10 + 2 + 1 + 13 + 2 + 1 + 1
    (top,) = (r for r in nodes.values() if r.parent is None)
    assert hashlib.sha256(top.children.hex().encode()).digest() == tree.root and top.size == 700
    for r in nodes.values():
        if r.parent is not None:
            up = nodes[tuple(r.parent)].children
            assert up[32 * r.place : 32 * r.place + 32] == hashlib.sha256(r.children.hex().encode()).digest()
