import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import bm25, segments

UNITS, QUESTIONS = "child_idx long, embed_text string", "qid long, question string"


def _texts(n, seed=1, first=0):
    """Words by a steep law, so that some are in most texts; lengths from none to 80 words."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    return [(first + i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(400)], k=rng.randint(0, 80)))) for i in range(n)]


def brute(texts, questions):
    """(qid, id) -> score, by the definition."""
    tokens = {i: (t or "").lower().split() for i, t in texts}
    n, average = len(tokens), sum(map(len, tokens.values())) / max(1, len(tokens))
    df = {}
    for own in tokens.values():
        for t in set(own):
            df[t] = df.get(t, 0) + 1
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    mean = sum(raw.values()) / max(1, len(raw))
    idf = {t: 0.25 * mean if r < 0 else r for t, r in raw.items()}
    out = {}
    for q, question in questions:
        for i, own in tokens.items():
            shared = [t for t in question.lower().split() if t in own]
            if shared:
                out[q, i] = sum(idf[t] * (f := own.count(t)) * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(own) / average)) for t in shared)
    return out


def _check(spark, index, texts, questions, ks=(1, 5, 1000)):
    want = brute(texts, questions)
    asked = spark.createDataFrame(questions, QUESTIONS)
    found = {(r.qid, r.id): r.score for r in bm25.scores(index, asked).collect()}
    assert found.keys() == want.keys() and all(abs(found[x] - want[x]) < 1e-9 for x in want)
    for k in ks:
        rows = [(r.qid, r.id, r.score) for r in bm25.search(index, asked, k).collect()]
        for q, _ in questions:
            best = sorted(((round(s, 6), -i) for (p, i), s in want.items() if p == q), reverse=True)[:k]
            assert sorted(((round(s, 6), -i) for p, i, s in rows if p == q), reverse=True)[:k] == best


@pytest.fixture
def small(monkeypatch):
    """Tiers of two postings, and a look at the best after every hundred."""
    monkeypatch.setattr(segments, "FIRST_TIER", 2)
    monkeypatch.setattr(segments, "ROUND", 100)


QUERIES = [(0, "w0 w1 w2"), (1, "w399 w0"), (2, "w7 w7 W90 nothing"), (3, "zzz"), (4, " ".join(f"w{i}" for i in range(60))), (5, "")]


def test_equals_the_definition(spark):
    texts = [*_texts(700), (700, None), (701, " "), (702, "W0 w0 x")]
    index = bm25.index(spark.createDataFrame(texts, UNITS).repartition(3))
    assert index.n == 703
    _check(spark, index, texts, QUERIES)
    assert sorted(r.id for r in index.ids.collect()) == list(range(703))


def test_a_segment_prunes_without_losing_the_best(small):
    """A segment by itself against its own whole scores, for many questions, ties and a k of each size; few postings are added up."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    lengths = rng.integers(20, 400, 3000)
    lists = {f"t{i}": np.sort(rng.choice(3000, int(3000 / (i + 2)) + 1, replace=False)) for i in range(60)}
    term = np.repeat(np.arange(60), [len(x) for x in lists.values()])
    docs, tfs = np.concatenate(list(lists.values())), rng.integers(1, 6, len(term))
    seg = segments.Segment(150.0)
    for rows in segments.segment_rows(0, np.arange(3000) * 2, lengths, pa.array(list(lists)), term, docs, tfs):
        seg.add(rows)
    for t, (own, _, tops, leasts, highest) in seg.terms.items():
        cuts = segments.tier_cuts(len(own))
        assert len(cuts) == len(tops) + 1 == len(leasts) + 1 and sorted(own.tolist()) == lists[t].tolist()
        for n, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            for average in (50.0, 150.0, 900.0):
                assert segments.impact(seg.terms[t][1][a:b], lengths[own[a:b]], average).max() <= segments.bound(tops[n], leasts[n], highest[n], segments.own_average(lengths), average) + 1e-12
    seg.dead[::7] = True
    spared = []
    for q in range(60):
        terms = [f"t{i}" for i in rng.choice(60, int(rng.integers(1, 12)), replace=False)] + ["none"]
        weights = [round(math.log(1 + (3000 - len(lists.get(t, ()))) / (len(lists.get(t, ())) + 0.5)), 1) for t in terms]
        if q % 10 == 0:
            weights[0] = -0.5
        score, held = np.zeros(3000), np.zeros(3000, bool)
        for t, w in zip(terms, weights, strict=True):
            if t in lists:
                f = tfs[term == list(lists).index(t)]
                score[lists[t]] += w * segments.impact(f, lengths[lists[t]], 150.0)
                held[lists[t]] = True
        held &= ~seg.dead
        at = np.flatnonzero(held)
        for k in (1, 10, 5000):
            want = at[np.lexsort((at, -np.round(score[at], 6)))[:k]]
            ids, found, scored, total = seg.best(terms, weights, k)
            assert ids.tolist() == (want * 2).tolist() and np.allclose(found, score[want])
            assert scored <= total and (k < 5000 or scored == total)
            if k == 1 and q % 10:
                spared.append(1 - scored / total)
    assert sum(spared) / len(spared) > 0.3, sum(spared) / len(spared)


def test_added_and_withdrawn_units(spark, tmp_path):
    """The index of A, then B, without some of either, is that of the rest; A is never read again; merging changes no row."""
    a, b = _texts(300), _texts(200, 2, 300)
    spark.createDataFrame(a, UNITS).repartition(3).write.parquet(str(tmp_path / "a"))
    index = bm25.index(spark.read.parquet(str(tmp_path / "a")))
    (tmp_path / "a").rename(tmp_path / "gone")
    both = index.add(spark.createDataFrame(b, UNITS).repartition(2))
    _check(spark, both, a + b, QUERIES, (5,))
    less = both.withdraw(spark.createDataFrame([(i,) for i in range(0, 500, 3)] + [(0,), (9999,)], "id long"))
    rest = [x for x in a + b if x[0] % 3]
    assert less.n == len(rest)
    _check(spark, less, rest, QUERIES, (5,))
    _check(spark, less.withdraw(spark.createDataFrame([(0,), (3,)], "id long")), rest, QUERIES[:1], (5,))
    again = less.add(spark.createDataFrame([(0, "w0 back"), (1000, None)], UNITS))
    rest += [(0, "w0 back"), (1000, None)]
    merged = again.merge()
    assert merged.rows.where("term = ''").count() < again.rows.where("term = ''").count()
    assert merged.rows.where("term = ''").agg(F.sum(F.size("ids"))).first()[0] == len(rest)
    _check(spark, merged, rest, QUERIES, (5,))
    _check(spark, index, a, QUERIES[:2], (5,))
    _check(spark, merged.add(spark.createDataFrame(_texts(20, 3, 2000), UNITS)), rest + _texts(20, 3, 2000), QUERIES[:2], (5,))


def test_touched_postings(spark):
    texts = _texts(2000, 5)
    index = bm25.index(spark.createDataFrame(texts, UNITS).coalesce(1))
    asked = spark.createDataFrame([(0, "w300 w0 w1"), (1, "w0")], QUESTIONS)
    found = {r.qid: r for r in bm25.touched(index, asked, 5).collect()}
    df = {w: sum(w in t.split() for _, t in texts) for w in ("w300", "w0", "w1")}
    assert found[0].postings == sum(df.values()) and found[1].postings == df["w0"]
    assert all(r.scored < 0.8 * r.postings for r in found.values()), found


def test_no_units(spark):
    index = bm25.index(spark.createDataFrame([], UNITS))
    assert index.n == 0 and bm25.scores(index, spark.createDataFrame(QUERIES, QUESTIONS)).count() == 0
    added = index.add(spark.createDataFrame([(1, "a b"), (2, "c")], UNITS))
    _check(spark, added, [(1, "a b"), (2, "c")], [(0, "a")], (1,))


def test_questions_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(bm25, "BROADCAST_TERMS", 3)
    texts = _texts(100)
    _check(spark, bm25.index(spark.createDataFrame(texts, UNITS)), texts, QUERIES, (5,))


def test_many_questions_of_many_terms(spark, monkeypatch):
    """Whole texts as questions are scored together, over several segments, parts and blocks; each goes to a part once, not to each
    segment, and only a part's k best come back."""
    monkeypatch.setattr(bm25, "PART_SEGMENTS", 3)
    texts = [(i, f"{t} {' '.join(f'r{i % 50}x{j}' for j in range(20))}") for i, t in _texts(300, 7)] + [(1000 + i, "w1 copy") for i in range(40)]
    index = bm25.index(spark.createDataFrame(texts, UNITS).repartition(24))
    assert index.rows.where("term = ''").count() == 24
    questions = [(i, t) for i, t in texts if i % 20 == 0 and i < 1000]
    _check(spark, index, texts, questions, (1, 5))
    asked = spark.createDataFrame(questions, QUESTIONS)
    assert bm25.search(index, asked, 5).count() <= len(questions) * 8 * 5
    monkeypatch.setattr(bm25, "BROADCAST_TERMS", 100)
    _check(spark, index, texts, questions, (5,))
    less = index.withdraw(spark.createDataFrame([(i,) for i in range(0, 300, 3)], "id long"))
    _check(spark, less, [x for x in texts if x[0] >= 300 or x[0] % 3], questions, (5,))


def test_questions_of_many_terms_against_a_segment(monkeypatch):
    """Products, sums over postings and cuts of both give what one question at a time gives, ties, withdrawn units and a small k included."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    lengths = rng.integers(20, 400, 900)
    lengths[500:] = 50
    lists = [np.sort(rng.choice(900, int(900 / (i + 2)) + 1, replace=False)) for i in range(80)]
    term, docs = np.repeat(np.arange(80), [len(x) for x in lists]), np.concatenate(lists)
    seg = segments.Segment(150.0)
    for rows in segments.segment_rows(0, np.arange(900) * 2, lengths, pa.array([f"t{i}" for i in range(80)]), term, docs, np.ones(len(term), int)):
        seg.add(rows)
    seg.dead[::7] = True
    terms = [[f"t{i}" for i in rng.choice(90, int(rng.integers(0, 30)), replace=False)] for _ in range(70)]
    weights = [[1 + int(t[1:]) % 9 / 4 for t in own] for own in terms]
    for scores, summed, dense in ((1 << 21, 1 << 20, 512), (5000, 700, 3), (1, 1, 0)):
        for name, value in (("SCORES", scores), ("SUMMED", summed), ("DENSE", dense)):
            monkeypatch.setattr(segments, name, value)
        for k in (1, 10, 5000):
            asked = segments.Asked(pa.array(terms, pa.list_(pa.string())), pa.array(weights, pa.list_(pa.float64())))
            seg.best_of_many(asked, k)
            who, ids, found = asked.found
            for q, (own, w) in enumerate(zip(terms, weights, strict=True)):
                want, score, _, total = seg.best(own, w, k)
                assert ids[who == q].tolist() == want.tolist() and np.allclose(found[who == q], score) and asked.postings[q] == total


def test_rows_of_an_index_hold_many_terms(spark):
    """An index of thousands of terms has a few rows for each segment; its units are cut at what T.tokens cuts at."""
    from docloom.functions import text as T

    texts = [(i, f" {' '.join(f'V{i}n{j}' for j in range(50))}　x\x1cİY\x85 z​ \t") for i in range(100)] + [(100, None), (101, "")]
    units = spark.createDataFrame(texts, UNITS).repartition(2)
    index = bm25.index(units)
    assert index.rows.count() <= 6
    want = {r.term: (r.df, r.n) for r in units.select("child_idx", F.explode(T.tokens(F.col("embed_text"))).alias("term")).groupBy("term").agg(F.count_distinct("child_idx").alias("df"), F.count("*").alias("n")).collect()}
    assert {r.term: (r.df, r.tokens) for r in index.counts.where("term <> ''").collect()} == want and len(want) > 5000


def test_files_of_an_index_are_small(spark, monkeypatch):
    """A reader holds a file's rows at once, and an index has rows of megabytes: no file has many of them, and no row has lists of
    its terms, which are slow to move."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(segments, "FILE_ROWS", 2, raising=False)
    texts = _texts(900, 4)
    index = bm25.index(spark.createDataFrame(texts, UNITS).coalesce(1))
    files = index.rows.inputFiles()
    assert len(files) > 1 and max(pq.read_metadata(f.removeprefix("file://")).num_rows for f in files) <= 2
    assert {f.name for f in index.rows.schema.fields if f.dataType.typeName() == "array"} == {"ids", "lengths"}
    _check(spark, index, texts, QUERIES, (5,))
