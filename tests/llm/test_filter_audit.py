import re
from itertools import permutations

import pytest

from docloom.llm import filter_audit
from docloom.llm.filter_audit import Counters, audit

COLUMNS = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def _fails(rows):
    """The letters that each of (doc_id, text, lang) fails, by the definition."""
    for i, text, _ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        own["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        yield {x for x, failed in own.items() if failed}


def brute(rows, good, toxic):
    failed, out = list(_fails(rows)), []
    for part in {r[2] or "" for r in rows}:
        mine = [(f, r[0] in good, r[0] in toxic) for f, r in zip(failed, rows, strict=True) if (r[2] or "") == part]
        found, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            alive = [True] * len(mine)
            for step, x in enumerate(order, 1):
                gone = [a and x in f for a, (f, _, _) in zip(alive, mine, strict=True)]
                redundant = sum(not a and x in f for a, (f, _, _) in zip(alive, mine, strict=True))
                alive = [a and not g for a, g in zip(alive, gone, strict=True)]
                lost = [m for m, g in zip(mine, gone, strict=True) if g]
                shapley[x] += len(lost)
                found.append((part, order, step, sum(alive), len(lost), redundant, sum(f == {x} for f, _, _ in mine), sum(g for _, g, _ in lost), sum(t for _, _, t in lost)))
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in found]
    return sorted(out)


def _text(words=120, distinct=120, more=""):
    return " ".join(f"w{i % distinct}" for i in range(words)) + more


ROWS = [
    (1, _text(), "en"), (2, _text(), "en"), (3, _text(), "fr"), (3, _text(), "fr"), (4, _text(50, 50), "en"), (5, _text(120, 10), "en"), (6, _text(more=" CAPITALS" * 30), "en"),
    (7, _text(more=" #"), "en"), (8, _text(10, 1, " $ ABC" * 9), "fr"), (9, None, "fr"), (10, "", None), (11, " \t\n", ""), (None, _text(), "en"), (None, _text(), "en"), (0, "ÀÉ" * 9 + "A" * 2, "é"),
    (12, "ÀÉ" * 9 + "A" * 2 + "b", "é"), (13, "a" * 9 + "A", "é"), (14, _text(200, 160), "en"), (15, _text(200, 159), "en"), (16, _text(100, 100), "en"), (17, _text(99, 99), "en"),
]
LABELS = [(1, 1, 0), (4, 1, 1), (4, 0, 0), (7, 0, 1), (9, 1, None), (None, 1, 1), (99, 1, 1), (3, 1, 0), (15, None, 1)]


def _frames(spark, rows, labels=LABELS):
    docs = spark.createDataFrame([(*r, "x", 1, "x", 2) for r in rows], "doc_id long, text string, lang string, part string, mask int, sha string, n long").repartition(3)
    return docs, spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string")


@pytest.mark.parametrize("hot", [100_000, 2])
def test_equals_the_definition(spark, monkeypatch, hot):
    monkeypatch.setattr("docloom.llm.skew.HOT_KEYS", hot)
    found = audit(*_frames(spark, ROWS))
    assert found.columns == COLUMNS
    good, toxic = {i for i, q, _ in LABELS if q == 1} - {None}, {i for i, _, t in LABELS if t == 1} - {None}
    assert sorted(map(tuple, found.collect())) == brute(ROWS, good, toxic)


def test_odd_texts_without_labels(spark, odd_texts):
    rows = [(i, t, "en") for i, t in odd_texts]
    assert sorted(map(tuple, audit(*_frames(spark, rows, [])).collect())) == brute(rows, set(), set())


def test_empty(spark):
    assert audit(*_frames(spark, [])).collect() == []


def test_fields_hold_every_count_without_running_over():
    counters = Counters("ABCDE")
    assert counters.fields == 600 and len(set(counters.orders)) == 120
    most = (1 << 63) - 1
    for mask, own in counters.packed.items():
        for packed in own.values():
            assert set(counters.unpack(packed)) <= {0, 1}
            assert counters.unpack(packed * most) == [x * most for x in counters.unpack(packed)]
        steps = zip(*(counters.unpack(own[x]) for x in ("kept", "removed", "redundant")), strict=True)
        kept, removed, redundant = zip(*steps, strict=True)
        assert sum(removed) == 120 * (mask > 0) and sum(removed) + sum(redundant) == 120 * mask.bit_count()
        assert all(k == (mask == 0) for k in kept[4::5])


def test_a_hot_part_is_as_many_rows_as_masks(spark):
    rows = [(i, f"a{i % 50}", "en") for i in range(3000)]
    docs, labels = _frames(spark, rows)
    found = {(r.filter_order, r.step): r for r in audit(docs, labels).collect()}
    assert found["AEBCD", 1].removed == 3000 and found["EABCD", 1].removed == 2950 and found["EABCD", 2].removed == 50
    assert filter_audit.FIELD_BITS == 64
