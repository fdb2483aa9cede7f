"""Documents to answers without a network, and the providers' handling of replies."""

import importlib.util
import json
import pickle
import subprocess
import sys
import time
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import chunking, conflicts, retrieval
from docloom.operators.blocks import parse_blocks
from docloom.operators.ordering import running_offsets
from docloom.plans import prompts, providers
from docloom.plans.domains import custom_domain, get_domain
from docloom.plans.engine import Engine
from docloom.sources import documents

from .conftest import ROOT

TABLE = "<table><tr><th>Currency</th><th>SWIFT</th></tr>{}</table>"


def document(name, rows, after="Note."):
    body = TABLE.format("".join(f"<tr><td>{c}</td><td>{s}</td></tr>" for c, s in rows))
    return {"doc_name": name, "content": f"Intro of {name}\n\n# Spot\nBefore.\n{body}\n{after}\n# Empty\n"}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("docs")
    currencies = ["CHF", "GBP", "USD", "JPY", "EUR", "AUD"]
    (at / "b.json").write_text(json.dumps(document("b.json", [(c, f"BANK{c[:2]}B{i}") for i, c in enumerate(currencies)])))
    (at / "a.json").write_text(json.dumps({"content": document("a", [(c, f"BANK{c[:2]}A{i}") for i, c in enumerate(currencies)])["content"]}))
    (at / "c.json").write_text(json.dumps({"doc_name": "c.json"}))
    return str(at)


def make(spark, folder, **options):
    return Engine(spark, folder, providers.EchoChat(), providers.HashedEmbedder(), **options).build()


def test_chunks_of_files(spark, folder):
    e = make(spark, folder)
    parents = e.parents.orderBy("parent_id").collect()
    assert [(p.doc_name, p.parent_id, p.type, p.heading) for p in parents] == [("a.json", 0, "narrative", ""), ("a.json", 1, "table", "Spot"), ("b.json", 2, "narrative", ""), ("b.json", 3, "table", "Spot")]
    assert parents[3].preamble == "Intro of b.json\nBefore."
    assert parents[3].notes == ["Note."]
    assert e.direct
    assert [c.child_idx for c in e.children.orderBy("child_idx").collect()] == list(range(14))


def test_direct_mode(spark, folder):
    found = make(spark, folder).query("What is the SWIFT for CHF?")
    assert (found["mode"], found["blocked"], found["reason"], found["best_score"]) == ("direct", False, "direct-context mode", 1.0)
    assert len(found["conflicts"]) == 1 and "'CHF'" in found["conflicts"][0]


@pytest.mark.parametrize("mode", ["dense", "sparse", "hybrid"])
def test_retrieval_modes(spark, folder, mode):
    e = make(spark, folder, retrieval_mode=mode, small_corpus=1, reranker=providers.OverlapReranker() if mode == "hybrid" else None, default_k=3)
    rows = {r.qid: r for r in e.batch_query(["Currency: CHF SWIFT: code", "zzz qqq"]).collect()}
    assert not rows[0].blocked and rows[0].passed and rows[0].citation.startswith("Sources:\n  - ")
    assert len(rows) == 2


def test_blocked(spark, folder):
    found = make(spark, folder, small_corpus=1, threshold=2.0).query("CHF")
    assert found["blocked"] and found["raw"] is None and found["conflicts"] == [] and "2.000" in found["answer"]


def test_extraction(spark, folder):
    class Fields(providers.Chat):
        def complete(self, prompt, system="", max_tokens=2048, temperature=0):
            return json.dumps({"CHF": {"SWIFT": "BANKCHA0"}})

    e = Engine(spark, folder, Fields(), providers.HashedEmbedder()).build()
    rows = e.extract_batch(["CHF", "XYZ"], ["SWIFT", "IBAN"], batch_size=2).select("item", "field", "value").collect()
    assert sorted(map(tuple, rows)) == [("CHF", "IBAN", "N/A"), ("CHF", "SWIFT", "BANKCHA0"), ("XYZ", "IBAN", "not found"), ("XYZ", "SWIFT", "not found")]


def test_evaluate(spark, folder):
    rows = make(spark, folder).evaluate(["CHF SWIFT"]).collect()
    assert sorted(r.strategy for r in rows) == ["paragraph", "section_table", "sliding_window"]


def test_states_and_names(spark, folder):
    with pytest.raises(RuntimeError):
        Engine(spark, folder, providers.EchoChat(), providers.HashedEmbedder()).query("x")
    for bad in ({"retrieval_mode": "x"}, {"domain": "x"}, {"chunk_strategy": "x"}):
        with pytest.raises(ValueError):
            Engine(spark, folder, providers.EchoChat(), providers.HashedEmbedder(), **bad)
    with pytest.raises(ValueError):
        providers.make_chat("x")
    with pytest.raises(ValueError):
        providers.make_chat("keyed", base_url="u")
    assert providers.make_reranker(None) is None
    assert "Spot" in custom_domain("desk", ["Spot"]).system_prompt
    assert len(get_domain("fx_ssi").fields) == 9


def test_merged_tables_and_empty_input(spark):
    two = TABLE.format("<tr><td>CHF</td><td>UBSWCHZH</td></tr>") * 2
    docs = spark.createDataFrame([(0, "d", f"# H\n{two}"), (1, "e", None), (2, "f", "")], "doc_ord long, doc_name string, content string")
    parents, children = chunking.get_strategy("section_table").build(parse_blocks(docs))
    assert [len(p.rows) for p in parents.collect()] == [2]
    assert children.count() == 2
    assert chunking.build_parents(parse_blocks(docs.limit(0))).count() == 0
    assert conflicts.conflict_map(parents).count() == 0


def test_conflicts_are_found_inside_of_words(spark):
    rows = [("CHF", "a", ["X"]), ("CHF", "b", ["Y"]), ("NEW YORK", "a", ["X", "Z"]), ("NEW YORK", "b", ["Y"])]
    found = spark.createDataFrame(rows, "scope string, doc_name string, codes array<string>")
    questions = spark.createDataFrame([(1, "the chf account"), (2, "xCHFy in new york"), (3, ""), (4, None), (5, "New  York CH")], "qid long, question string")
    assert sorted(map(tuple, conflicts.detect_conflicts(questions, found).select("qid", "scope").collect())) == [(1, "CHF"), (2, "CHF"), (2, "NEW YORK")]
    assert sorted(map(tuple, conflicts.detect_conflicts(questions, found, whole_words=True).select("qid", "scope").collect())) == [(1, "CHF"), (2, "NEW YORK")]
    message = conflicts.detect_conflicts(questions.where("qid = 1"), found).first().message
    assert "'CHF' across documents: a: X; b: Y." in message
    assert conflicts.detect_conflicts(questions, found.limit(0)).count() == 0


def test_sparse_fills_up_with_zero_scores(spark):
    units = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "c d", "e f", "g h", None])], "child_idx long, embed_text string")
    hits = retrieval.sparse_scores(spark.createDataFrame([(0, "c")], "qid long, question string"), units, 3)
    assert [(r.id, r.score > 0) for r in hits.orderBy("rank").collect()] == [(1, True), (0, False), (2, False)]


def test_rest_providers(monkeypatch):
    waits, sent = [], []
    monkeypatch.setattr(providers.time, "sleep", waits.append)
    replies = [(429, "please try again in 1m2.5s"), (500, ""), (200, json.dumps({"choices": [{"message": {"content": " hi "}}]}))]

    def transport(url, headers, payload, timeout):
        sent.append((url, headers, payload, timeout))
        return replies.pop(0)

    chat = providers.RestChat("http://h/", "key", "m", transport)
    assert chat.complete("q", "s") == "hi"
    assert waits == [63.5, 2.0]
    assert sent[0][0] == "http://h/chat/completions" and sent[0][1] == {"Authorization": "Bearer key"} and sent[0][3] == 60
    replies[:] = [(400, "no")]
    with pytest.raises(RuntimeError):
        chat.complete("q")
    data = {"data": [{"index": 1, "embedding": [0, 2]}, {"index": 0, "embedding": [3, 4]}]}
    replies[:] = [(200, json.dumps(data))]
    assert providers.RestEmbedder("http://h", transport=transport).embed(["a", "b"]) == [[0.6, 0.8], [0.0, 1.0]]
    with pytest.raises(ValueError):
        providers.RestEmbedder("http://h").embed([])
    assert providers.retry_wait("soon") == 15.0 and providers.retry_wait("soon", 3.0) == 3.0 and providers.retry_wait("try again in 7s") == 8.0


def test_scores_of_one_question_over_many_batches(spark):
    rows = spark.createDataFrame([(q, f"a b {q}", f"a {i}") for i in range(30) for q in range(3)], "qid long, question string, row_text string").repartition(5)
    found = providers.rerank_column(rows, providers.OverlapReranker()).collect()
    assert len(found) == 90 and all(r.rerank_score == len({"a", r.row_text.split()[1]} & set(r.question.split())) / 3 for r in found)


def test_local_models_load_where_they_run(monkeypatch):
    class Model:
        def __init__(self, name):
            self.name = name

        def encode(self, texts, **options):
            self.texts = texts
            return [[3.0, 4.0]] * len(texts)

        def predict(self, pairs, **options):
            return [0.0 if q == t else 100.0 for q, t in pairs]

    monkeypatch.setitem(sys.modules, "sentence_transformers", types.SimpleNamespace(SentenceTransformer=Model, CrossEncoder=Model))
    embedder, reranker = providers.make_embedder("local", model="m"), providers.make_reranker("local")
    assert embedder.embed(["a", "b"]) == [[0.6, 0.8]] * 2 and embedder.loaded.name == "m"
    assert embedder.loaded.texts == ["a", "b"] and embedder.embed_query("a") == [0.6, 0.8] and embedder.loaded.texts == [providers.QUERY_PREFIX + "a"]
    assert reranker.score("a", ["a", "b"]) == [0.5, pytest.approx(1.0)] and reranker.score("a", []) == []
    assert "loaded" not in pickle.loads(pickle.dumps(embedder)).__dict__
    with pytest.raises(ValueError):
        embedder.embed([])


def test_broad_and_usual_questions_in_one_batch(spark, folder):
    e = make(spark, folder, retrieval_mode="sparse", small_corpus=1, default_k=2)
    asked, matched = e._found(e._questions(["Currency: CHF", "list all codes"]), None)
    assert {(r.qid, r["count"]) for r in matched.groupBy("qid").count().collect()} == {(0, 2), (1, e.n_children)}


def test_pages_to_documents_and_back(spark, tmp_path):
    words = [("d", 0, "low", 5.0, 9.0, 40.0, 44.0), ("d", 0, "right", 50.0, 60.0, 12.0, 14.0), ("d", 0, "left", 1.0, 9.0, 11.0, 13.0), ("d", 0, "held", 22.0, 24.0, 22.0, 24.0), ("d", 2, "last", 1.0, 2.0, 1.0, 2.0), ("d", 1, " ", 1.0, 2.0, 1.0, 2.0)]
    tables = [("d", 0, 20.0, 20.0, 30.0, 30.0, [["NAME", "CODE"], ["a", "b"]])]
    pages = documents.page_content(spark.createDataFrame(words, documents.WORDS), spark.createDataFrame(tables, documents.TABLES))
    docs = documents.pages_to_documents(pages)
    table = "<table><tr><th>NAME</th><th>CODE</th></tr><tr><td>a</td><td>b</td></tr></table>"
    assert [tuple(r) for r in docs.collect()] == [("d", f"left right\n{table}\nlow\n\nlast")]
    documents.write_json(docs, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out")).collect()
    assert (back[0].doc_name, back[0].content, back[0].model_id) == ("d", docs.first().content, documents.MODEL_ID)


def test_custom_templates():
    assert prompts.render_custom("$a and $b", a=1, b=2) == "1 and 2" if importlib.util.find_spec("jinja2") is None else prompts.render_custom("{{ a }} and {{ b }}", a=1, b=2) == "1 and 2"
    with pytest.raises(Exception):
        prompts.render_custom("$a {{ a }}")


def test_offsets_of_sparse_and_uneven_orders(spark):
    rows = [(i * i * 7919 - 5000, i % 4) for i in range(300)]
    found = running_offsets(spark.createDataFrame(rows, "k long, n int").repartition(6), "k", {"a": "n", "b": "k"})
    want, a, b = {}, 0, 0
    for k, n in sorted(rows):
        want[k] = (a, b)
        a, b = a + n, b + k
    assert {r.k: (r.a, r.b) for r in found.collect()} == want
    assert running_offsets(spark.createDataFrame([], "k long, n int"), "k", {"a": "n"}).count() == 0


def test_dense_search_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-3, 4, 5).astype(float).tolist()) for i in range(200)] + [(200, [0.0] * 5), (201, None)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    vectors = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, v in rows if v}
    for units, questions in ((16_384, 4096), (32, 7)):
        monkeypatch.setattr(retrieval, "UNIT_BLOCK", units)
        monkeypatch.setattr(retrieval, "QUESTION_BLOCK", questions)
        found = retrieval.dense_top_k(df.where("id % 9 = 0").withColumnRenamed("id", "qid"), df, 4)
        got = {(r.qid, r["rank"]): (r.id, r.score) for r in found.collect()}
        for q in range(0, 202, 9):
            best = sorted((-round(float(vectors[q] @ v), 6), i) for i, v in vectors.items())[:4]
            assert [got[q, n] for n in range(1, 5)] == [(i, pytest.approx(-s)) for s, i in best]


def test_windows_of_a_very_long_document(spark):
    n = 5_000_000
    docs = spark.range(2).select(F.col("id").alias("doc_ord"), F.lit("d").alias("doc_name"), F.when(F.col("id") == 1, F.expr(f"repeat('word ', {n})")).otherwise(F.lit("a b")).alias("content"))
    began = time.time()
    found = chunking.build_children(chunking.windows_of(docs)).agg(F.count("*"), F.max("child_idx"), F.sum(F.length("row_text"))).first()
    assert found[0] == 1 + -(-n // 120) and found[1] == found[0] - 1 and found[2] > 5 * n
    assert time.time() - began < 60


def test_queries_without_the_training_data_part(spark):
    code = "import sys; sys.modules['public_tokenizers'] = None; import warnings; warnings.simplefilter('ignore'); import __spark_entry__ as e; q = e.queries(); assert len(q) > 45 and not any(n.startswith('op') for n in q) and e.oracle_sql().keys() <= q.keys()"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, timeout=120).returncode == 0


def test_stream(spark, folder, tmp_path):
    from docloom.streaming import ingest

    table = str(tmp_path / "codes")
    for _ in range(2):
        ingest.start(ingest.stream_codes(ingest.stream_documents(spark, folder)), table, str(tmp_path / "state")).awaitTermination()
    rows = spark.read.parquet(table).collect()
    assert len(rows) == 12 and {r.scope for r in rows} >= {"CHF", "AUD"}
