import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import near_dedup, skew
from docloom.llm.components import components
from docloom.llm.storage import Scratch

from .test_tokens import thue_morse


def shingles(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute_force(rows, k, num, den):
    """{doc_id: least id reachable} by comparing all pairs."""
    sets = {i: shingles(t, k) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: root(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def corpus(seed, groups=12):
    """Copies and near copies at every distance from their base, and texts that share a passage only."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(words) for _ in range(60)]
    texts = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(20, 250))] + (passage if rng.random() < 0.5 else [])
        for _ in range(rng.choice([1, 1, 2, 5, 30])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(base) // 40, len(base) // 25])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return list(enumerate(texts, 100))


@pytest.mark.parametrize(("k", "num", "groups"), [(3, 85, 14), (5, 80, 6)])
def test_matches_brute_force(spark, odd_texts, k, num, groups):
    rows = corpus(k, groups) + odd_texts
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, bands string").repartition(4)
    found = near_dedup.near_duplicate_classes(df, k=k, num=num).collect()
    want, sizes = brute_force(rows, k, num, 100)
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], sizes[r.doc_id], want[r.doc_id] == r.doc_id)
    assert len(set(want.values())) < len(want) - 10
    assert want[8] == 7 and sizes[1] == sizes[2] == sizes[3] == 0 and want[2] == 2


@pytest.mark.parametrize("seed", [11, 12])
def test_every_bound_at_its_least(spark, monkeypatch, seed):
    """Blocks of few documents or few bytes, no small buckets, and shuffles and hot keys instead of broadcasts."""
    for name, value in {"BLOCK_DOCS": 4, "BLOCK_BYTES": 4000, "SMALL_BUCKET": 2, "TASK_DOCS": 8, "BROADCAST_IDS": 0}.items():
        monkeypatch.setattr(near_dedup, name, value)
    monkeypatch.setattr(skew, "HOT_KEYS", 30)
    rows = corpus(seed, 8)
    found = near_dedup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k=3, num=85)
    want, _ = brute_force(rows, 3, 85, 100)
    assert {r.doc_id: r.component_id for r in found.collect()} == want


def test_thousands_of_near_copies_of_one_text(spark):
    """20,000 different near copies of one text, beside others: one class, whose centre is sent to every part of them."""
    base = " ".join(f"w{i}" for i in range(60))
    own = F.when(F.col("id") < 20_000, F.concat(F.lit(base), F.lit(" "), F.col("id"))).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: F.hash("id", i)), " "))
    found = near_dedup.near_duplicate_classes(spark.range(20_300, numPartitions=8).select(F.col("id").alias("doc_id"), own.alias("text")), k=3, num=85)
    assert sorted(map(tuple, found.groupBy((F.col("doc_id") < 20_000).alias("near")).agg(F.count_distinct("component_id"), F.count("*"), F.sum(F.col("kept").cast("int"))).collect())) == [(False, 300, 300, 300), (True, 1, 20_000, 1)]


def test_words_that_collide_in_polynomials(spark):
    words = [w for n in (10, 11, 12) for w in thue_morse(n)]
    found = near_dedup.near_duplicate_classes(spark.createDataFrame(list(enumerate(words)), "doc_id long, text string"), k=3, num=85)
    assert all(r.component_id == r.doc_id and r.n_shingles == 1 for r in found.collect())


def test_counted_joins_agree(spark, monkeypatch):
    rows = spark.createDataFrame([(i % 7 if i % 3 else 100, i) for i in range(200)] + [(None, 0), (55, 1)], "k int, x int")
    keyed = rows.where("k is not null and k <> 55").groupBy("k").agg(F.count("*").alias("n"), F.max("x").alias("m"))
    for how in ("inner", "left"):
        got = []
        for bound in (100_000, 10, 1):
            monkeypatch.setattr(skew, "HOT_KEYS", bound)
            got.append(sorted(map(tuple, skew.join_counted(rows, keyed, ["k"], 202, how).select("k", "x", "n", "m").collect()), key=repr))
        assert got[0] == got[1] == got[2] and len(got[0]) == (200 if how == "inner" else 202)


def test_empty_table(empty):
    assert near_dedup.near_duplicate_classes(empty).columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert near_dedup.near_duplicate_classes(empty).count() == 0


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (None, 5)]
    found = dict(map(tuple, components(spark.createDataFrame(links, "u long, v long"), Scratch(spark, "test"), "c").collect()))
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_band_shape_and_signatures():
    for threshold in (0.5, 0.8, 0.85, 0.95):
        bands, rows = near_dedup.band_shape(threshold)
        assert bands * rows <= near_dedup.MINIMA and (1 - threshold**rows) ** bands <= 1e-6
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**64, 900, dtype=np.uint64)
    room = np.empty((near_dedup.MINIMA, 512), np.uint64)
    agree = (near_dedup.minima(x[:850], room) == near_dedup.minima(x, room)).mean()
    assert abs(agree - 850 / 900) < 0.08


def test_shared_counts_all_intersections():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 9000, n).astype(np.uint64)) for n in (0, 1, 50, 4000, 8000)]
    got = near_dedup._shared(sets[:3], sets)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets[:3]]
