import itertools
import math
import random
import re

import numpy as np

from docloom.llm import toxicity
from docloom.llm.textscan import mix, word_hashes


def corpus(n=900, seed=4):
    """Toxic where an insult and a group meet; either alone is harmless, so no sum of weights can part them well."""
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(n):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))] + (["Grumbold"] if insult else []) + (["zogs,"] if group else [])
        rng.shuffle(text)
        docs.append((i, " ".join(text)))
        labels.append((i, 1, int(insult and group)))
    return docs, labels


def test_pairs_are_learnt_and_held_out_rows_agree(spark, odd, odd_texts):
    docs, labels = corpus()
    df = spark.createDataFrame(docs + [(i if i is None else i + 5000, t) for i, t in odd_texts], "doc_id long, text string").repartition(4)
    label = spark.createDataFrame(labels + [(None, 1, 1), (3, 0, None), (5001, 0, 5)], "doc_id long, quality int, toxic int")
    found = toxicity.toxicity(df, label)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = found.collect()
    assert len(rows) == len(docs) + len(odd_texts)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    truth = {i: t for i, _, t in labels}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    empty = {r.score for r in rows if r.doc_id in (5001, 5002, 5003)}
    assert len(empty) == 1
    kept = toxicity.accepted(df, label)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted == 0 for r in rows)
    # Without labels every text gets the same score.
    assert toxicity.toxicity(odd, label.limit(0)).select("score").distinct().count() == 1


def by_hand(machine, text):
    """The score from the definition: terms one by one, pairs two by two."""
    stretches = set()
    for word in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()):
        word = bytes(c + 32 if 65 <= c <= 90 else c for c in word)
        parts = [word[:-1], word[-1:]] if re.search(rb"[0-9a-z][.,]$", word) else [word]
        stretches |= {(x, 0) for x in parts} | {(x[:n], n) for x in parts for n in (4, 5) if len(x) >= n}
    own = set()
    for x, n in stretches:
        value = word_hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))
        place = np.flatnonzero(machine.chosen == int((mix(value + np.uint64(n)) if n else value)[0] >> np.uint64(64 - toxicity.BITS)))
        own.update(place.tolist())
    pairs = sum(float(machine.factors[a] @ machine.factors[b]) for a, b in itertools.combinations(sorted(own), 2))
    return 1 / (1 + math.exp(-min(30, max(-30, machine.bias + sum(machine.weights[i] for i in own) + pairs))))


def test_scores_match_the_definition(spark, odd_texts):
    docs, labels = corpus(400)
    df = spark.createDataFrame(docs + [(i if i is None else i + 5000, t) for i, t in odd_texts], "doc_id long, text string").repartition(4)
    machine = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert len(machine.chosen) > 3
    for r in df.join(toxicity.score(df, machine), "doc_id").where("doc_id % 3 = 0 or doc_id > 5000").collect():
        assert math.isclose(r.score, by_hand(machine, r.text), rel_tol=1e-9)


def test_empty_table(spark, empty):
    label = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity(empty, label).count() == 0


def test_logit_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    m = toxicity.Machine(0.3, np.arange(5), rng.normal(size=5), rng.normal(size=(5, 3)))
    own = [0, 2, 4]
    want = 0.3 + m.weights[own].sum() + sum(m.factors[a] @ m.factors[b] for i, a in enumerate(own) for b in own[i + 1 :])
    assert np.isclose(m.logits(1, np.zeros(3, int), np.array(own))[0], want)
