"""Batches against a service that counts: its token budget, and what is asked again after a failure."""

import fcntl
import json
import time

import pytest
from pyspark.sql import functions as F

from docloom.plans import pacing, providers
from docloom.plans.answers import Answers
from docloom.plans.engine import Engine
from docloom.plans.pacing import Pace, RateLimit

ROWS = "qid long, prompt string, max_tokens long"


class Service(providers.Chat):
    """Refuses what would be over its tokens in any of its windows, and everything from a number of calls on. All processes of
    the machine write into one log."""

    def __init__(self, log: str, tokens: int = 1 << 40, seconds: float = 1.0, calls: int = 1 << 40):
        self.log, self.tokens, self.seconds, self.calls = log, tokens, seconds, calls

    def complete(self, prompt, system="", max_tokens=2048, temperature=0):
        with open(self.log, "a+") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            f.seek(0)
            past, now = [json.loads(x) for x in f], time.time()
            size = len(prompt + system) // 4 + max_tokens
            refused = sum(s for t, s, r, _ in past if t > now - self.seconds and not r) + size > self.tokens or len(past) >= self.calls
            f.write(json.dumps([now, size, refused, prompt]) + "\n")
        if refused:
            raise RuntimeError("429")
        return f"answer to {prompt}"


def _log(path):
    return [json.loads(x) for x in path.read_text().splitlines()] if path.exists() else []


def _asked(spark, n, tokens=500, parts=8):
    return spark.createDataFrame([(i, f"prompt {i}", tokens) for i in range(n)], ROWS).repartition(parts)


def test_tasks_share_a_budget(spark, tmp_path):
    """12,000 tokens a window, eight tasks that would otherwise start together: no refusal, and most of the budget is used."""
    log, limit = tmp_path / "log", RateLimit(12_000, 2.0, largest=520)
    began = time.time()
    found = providers.complete_column(_asked(spark, 60), Service(str(log), 12_000, 2.0), "s", limit).collect()
    took = time.time() - began
    assert sorted(r.raw for r in found) == sorted(f"answer to prompt {i}" for i in range(60))
    assert not any(r for _, _, r, _ in _log(log)) and took < 40
    with pytest.raises(Exception, match="429"):
        providers.complete_column(_asked(spark, 60), Service(str(tmp_path / "log2"), 12_000, 20.0), "s").collect()


def test_no_window_is_over_the_budget():
    """The pace of several tasks, by a clock of their own, against every window."""
    limit, started = RateLimit(10_000, 60.0, largest=900), []
    tasks = limit.tasks(16)
    assert tasks == 5 and RateLimit(100, largest=900).tasks(16) == 1
    for task in range(tasks):
        now = [float(task)]
        pace = limit.pace(tasks)
        pace = Pace(pace.rate, lambda now=now: now[0], lambda s, now=now: now.__setitem__(0, now[0] + s))
        for i in range(60):
            size = 100 + 800 * ((i * 7 + task) % 3) // 2
            pace.wait(size)
            started.append((now[0], size))
            now[0] += 0.3
    for t, _ in started:
        assert sum(s for u, s in started if t <= u < t + 60) <= 10_000
    assert pacing.tokens_of("abcd", "", "é") == 3


def test_embeddings_are_paced(spark):
    rows = spark.createDataFrame([(i, "word " * 10) for i in range(40)], "id long, text string")
    found = providers.embed_column(rows, providers.HashedEmbedder(), "text", limit=RateLimit(4000, 1.0, largest=100)).collect()
    assert len(found) == 40 and all(len(r.vector) == 64 for r in found)


def test_a_batch_goes_on_where_it_was_cut_short(spark, tmp_path):
    """The service fails after 25 of 60 calls; the second run asks only what has no answer, the third nothing."""
    answers = Answers(spark, str(tmp_path / "answers"), wave=10)
    rows = _asked(spark, 60).unionByName(_asked(spark, 5).withColumn("qid", F.col("qid") + 100))
    one, two = tmp_path / "one", tmp_path / "two"
    with pytest.raises(Exception, match="429"):
        answers.complete(rows, Service(str(one), calls=25), "s")
    done = answers.read().count()
    assert 0 < done <= 25
    found = answers.complete(rows, Service(str(two)), "s").collect()
    assert sorted((r.qid, r.raw) for r in found) == sorted((q, f"answer to prompt {q % 100}") for q in [*range(60), *range(100, 105)])
    assert len(_log(two)) == 60 - done and answers.read().count() == 60
    assert answers.complete(rows, Service(str(two)), "s").count() == 65 and len(_log(two)) == 60 - done
    # Other tokens, another system prompt or another model are other questions.
    assert answers.complete(_asked(spark, 3, 400), Service(str(two)), "s").count() == 3
    assert answers.complete(_asked(spark, 3), Service(str(two)), "t").count() == 3 and len(_log(two)) == 66 - done
    chats = [providers.RestChat("http://h", "k", m, extra=e).identity() for m, e in (("a", {}), ("b", {}), ("a", {"top_p": 1}))]
    assert len(set(chats)) == 3 and providers.RestChat("http://h", "other", "a").identity() == chats[0]


def test_no_rows_and_null_prompts(spark, tmp_path):
    answers = Answers(spark, str(tmp_path / "answers"))
    assert answers.complete(_asked(spark, 0), Service(str(tmp_path / "log")), "s").count() == 0
    assert Answers(spark, answers.path).read().count() == 0


def test_an_engine_with_a_table_of_answers(spark, tmp_path):
    docs = spark.createDataFrame([(0, "d", "# H\nCHF is paid to BANKCHZ0.\n")], "doc_ord long, doc_name string, content string")
    log = tmp_path / "log"
    make = lambda: Engine(spark, docs, Service(str(log)), providers.HashedEmbedder(), answers=str(tmp_path / "answers"), limit=RateLimit(1 << 30)).build()
    first = {r.qid: r.answer for r in make().batch_query(["one?", "two?"]).collect()}
    again = {r.qid: r.answer for r in make().batch_query(["one?", "two?", "three?"]).collect()}
    assert len(_log(log)) == 3 and again[0] == first[0] and len(again) == 3
