import duckdb
import pytest

from docloom.llm import quality


def brute_force(text):
    words = (text or "").encode().split()
    words = [w.decode() for w in words]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {w for w in windows if windows.count(w) > 1}
    covered = {i + j for i, w in enumerate(windows) if w in again for j in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in quality.SYMBOLS), len(lines) - len(set(lines)), len(covered)


TEXTS = ["a b c a b c d", "x\nx\n \nx y\nx y\n", "a a a a", "# * $ % & | < > !", "a b c\x0bd a b c", "1 2 3 4 5 1 2 3 4 6 5 1 2", "é è z é è z q"]


def test_counts_match_brute_force(spark, odd_texts):
    rows = list(enumerate(TEXTS, 50)) + [r for r in odd_texts if r[0] != 6]
    found = quality.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found), key=repr)
    assert got == sorted(((i, *brute_force(t)) for i, t in rows), key=repr)


def test_matches_sql_with_long_and_odd_texts(spark, odd, odd_texts):
    good = "the house of the man is in a street and it was not by the sea but for him that is " * 1
    rows = odd_texts + [(20, " ".join(good.split() + [f"word{i} of" for i in range(40)])), (21, "x " * 60), (22, "THE!! " + " ".join(f"W{i}!!" for i in range(80)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    table = df.toArrow()
    con.register("documents", table)
    want = con.execute(quality.quality_sql())
    columns = [d[0] for d in want.description]
    found = quality.quality(df)
    assert found.columns == columns
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want.fetchall(), key=repr)
    verdict = {r.doc_id: (r.base_failed, r.kept) for r in found.collect()}
    assert verdict[20] == (False, True) and verdict[21] == (True, False) and verdict[22] == (False, False) and verdict[1] == (True, False)


def test_accepted_keeps_all_columns(spark, odd, empty):
    assert quality.accepted(odd).columns == odd.columns
    assert {r.doc_id for r in quality.accepted(odd).collect()} <= {6}
    assert quality.accepted(empty).count() == 0 and quality.quality(empty).count() == 0


def test_main_path_is_native(odd):
    plan = odd.sparkSession._jvm.PythonSQLUtils.explainString(quality.quality(odd)._jdf.queryExecution(), "simple")
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_rules_bound_both_ends(spark):
    rule = quality.Rule("r", "x", 1, 2)
    df = spark.createDataFrame([(0.9,), (1.0,), (2.0,), (2.1,)], "x double")
    assert [r[0] for r in df.select(rule.holds()).collect()] == [False, True, True, False]


@pytest.mark.parametrize("rule", quality.RULES)
def test_every_rule_has_a_bound(rule):
    assert rule.least is not None or rule.most is not None
