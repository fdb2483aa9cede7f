import random
import time

import pytest

from docloom.operators import automaton, conflicts
from docloom.operators.automaton import Automaton


def _brute(patterns, texts, whole=False):
    def inside(p, t):
        at = t.find(p)
        while at >= 0:
            if not whole or not ((at > 0 and t[at - 1].isalnum()) or (at + len(p) < len(t) and t[at + len(p)].isalnum())):
                return True
            at = t.find(p, at + 1)
        return False

    return {(i, j) for i, t in enumerate(texts) for j, p in enumerate(patterns) if inside(p, t)}


@pytest.mark.parametrize("whole", [False, True])
def test_equals_a_search_for_each_pattern(monkeypatch, whole):
    monkeypatch.setattr(automaton, "LANE", 7)
    monkeypatch.setattr(automaton, "LANES", 5)
    rng = random.Random(3)
    for letters in ("AB", "A B", "Aé\U0001f600 .", "ABCDEFGH"):
        patterns = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(40)})
        texts = ["", "A", *("".join(rng.choice(letters) for _ in range(rng.randint(0, 120))) for _ in range(30))]
        found = Automaton(patterns).find(texts, whole)
        assert set(zip(*(x.tolist() for x in found), strict=True)) == _brute(patterns, texts, whole)


def test_nothing_to_find():
    assert [len(x) for x in Automaton([]).find(["abc"])] == [0, 0]
    assert [len(x) for x in Automaton(["a"]).find([])] == [0, 0]


def test_failure_links_are_the_longest_suffixes():
    patterns = ["ABAB", "BABA", "BA", "ABC"]
    a = Automaton(patterns)
    prefixes = sorted({p[:n] for p in patterns for n in range(len(p) + 1)}, key=lambda x: (len(x), x))
    suffix = {p: max((q for q in prefixes if q != p and p.endswith(q)), key=len, default="") for p in prefixes}
    assert len(a.fail) == len(prefixes)
    lengths = {len(p): [] for p in prefixes}
    for p in prefixes:
        lengths[len(p)].append(p)
    for depth, own in lengths.items():
        assert [len(suffix[p]) for p in own] == [next(d for d in range(depth + 1) if a.depths[d] <= f < a.depths[d + 1]) for f in a.fail[a.depths[depth] : a.depths[depth + 1]]]


def test_a_long_question_and_many_scopes(spark, monkeypatch):
    """A question of a megabyte against 100,000 scopes: the automaton alone, and as a query in parts."""
    rng = random.Random(4)
    scopes = sorted({f"DESK {rng.randrange(10**9)}" + "X" * rng.randint(0, 30) for _ in range(100_000)})
    planted = rng.sample(scopes, 50)
    words = [f"desk {rng.randrange(10**9)}x" for _ in range(64_000)]
    for at, p in zip(rng.sample(range(len(words)), 50), planted, strict=True):
        words[at] = p.lower()
    question = " ".join(words)
    assert len(question) > 900_000
    a, began = Automaton(scopes), time.time()
    found = {scopes[i] for i in a.find([question.upper()])[1].tolist()}
    assert time.time() - began < 10  # about one second on an idle core
    assert found >= set(planted) and all(s in question.upper() for s in found)
    monkeypatch.setattr(conflicts, "SCOPES", 30_000)
    known = spark.createDataFrame([(s, d, ["AAAABBCC"]) for s in scopes[:70_000] + planted for d in ("a", "b")], "scope string, doc_name string, codes array<string>").distinct()
    asked = spark.createDataFrame([(1, question), (2, None), (3, "nothing"), (4, planted[0])], "qid long, question string")
    rows = {(r.qid, r.scope) for r in conflicts.detect_conflicts(asked, known).select("qid", "scope").collect()}
    known = {r.scope for r in known.select("scope").distinct().collect()}
    assert rows == {(1, s) for s in found & known} | {(4, s) for s in known if s in planted[0]}


def test_one_question_of_many_lengths(spark):
    """Scopes of 37 lengths and a question of 60,000 characters."""
    scopes = ["S" * n + "T" for n in range(1, 38)]
    known = spark.createDataFrame([(s, d, ["AAAABBCC"]) for s in scopes for d in ("a", "b")], "scope string, doc_name string, codes array<string>")
    asked = spark.createDataFrame([(1, "u" * 30_000 + "s" * 20 + "t" + "u" * 30_000)], "qid long, question string")
    assert {r.scope for r in conflicts.detect_conflicts(asked, known).collect()} == set(scopes[:20])
