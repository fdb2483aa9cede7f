"""Models behind an engine: chat, embeddings and rerankers, over HTTP with a transport of one's own, or offline.

Every provider is picklable; the HTTP ones open their connection where they run.
"""

import hashlib
import json
import math
import re
import time
import urllib.error
import urllib.request
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pacing import RateLimit, tokens_of

CHAT_TIMEOUT, EMBED_TIMEOUT, RERANK_TIMEOUT = 60, 60, 30
EMBED_BATCH, LOCAL_BATCH, RETRIES = 256, 64, 8
DEFAULT_WAIT, WAIT_MARGIN, SERVER_WAIT = 15.0, 1.0, 2.0

#: (url, headers, payload, timeout) -> (status, text)
Transport = Callable[[str, dict, dict, float], tuple[int, str]]


class Chat(ABC):
    @abstractmethod
    def complete(self, prompt: str, system: str = "", max_tokens: int = 2048, temperature: float = 0) -> str: ...

    def identity(self) -> str:
        """What tells its answers from those of another model or of other settings."""
        return type(self).__name__


class Embedder(ABC):
    @abstractmethod
    def embed(self, texts: list[str], task: str = "retrieval.passage") -> list[list[float]]: ...

    def embed_query(self, text: str) -> list[float]:
        return self.embed([text], "retrieval.query")[0]


class Reranker(ABC):
    @abstractmethod
    def score(self, query: str, texts: list[str]) -> list[float]: ...


def post(url: str, headers: dict, payload: dict, timeout: float) -> tuple[int, str]:
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return reply.status, reply.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode(errors="replace")


def retry_wait(text: str, default: float = DEFAULT_WAIT) -> float:
    """Seconds that a rate limit's 'try again in 1m2.5s' asks for, with a margin; the default where it doesn't say."""
    found = re.search(r"try again in (?:(\d+)m)?\s*([\d.]+)s", text)  # a fixed value: the services' wording
    return int(found[1] or 0) * 60 + float(found[2].rstrip(".")) + WAIT_MARGIN if found else default


def unit(vector: list[float]) -> list[float]:
    norm = math.sqrt(sum(x * x for x in vector)) or 1.0
    return [x / norm for x in vector]


class _Rest:
    path = ""

    def __init__(self, base_url: str, api_key: str = "", model: str = "", transport: Transport = post, extra: dict | None = None):
        self.url, self.key, self.model, self.transport, self.extra = base_url.rstrip("/") + self.path, api_key, model, transport, extra or {}

    def _send(self, payload: dict, timeout: float) -> tuple[int, str]:
        return self.transport(self.url, {"Authorization": f"Bearer {self.key}"} if self.key else {}, {"model": self.model, **payload, **self.extra}, timeout)


class RestChat(_Rest, Chat):
    path = "/chat/completions"
    retries = RETRIES

    def identity(self) -> str:
        return json.dumps([self.url, self.model, self.extra], sort_keys=True, default=str)

    def complete(self, prompt: str, system: str = "", max_tokens: int = 2048, temperature: float = 0) -> str:
        """Waits as a rate limit asks and tries again; a server error is tried again too; anything else is an error."""
        messages = [*([{"role": "system", "content": system}] if system else []), {"role": "user", "content": prompt}]
        for attempt in range(self.retries):
            status, text = self._send({"messages": messages, "max_tokens": max_tokens, "temperature": temperature}, CHAT_TIMEOUT)
            if status == 429:
                time.sleep(retry_wait(text))
            elif status >= 500 and attempt + 1 < self.retries:
                time.sleep(SERVER_WAIT)
            elif status >= 400:
                raise RuntimeError(f"chat: HTTP {status}: {text[:200]}")
            else:
                return json.loads(text)["choices"][0]["message"]["content"].strip()
        raise RuntimeError(f"chat: still over the rate limit after {self.retries} attempts")


class RestEmbedder(_Rest, Embedder):
    path = "/embeddings"
    sends_task = False

    def embed(self, texts: list[str], task: str = "retrieval.passage") -> list[list[float]]:
        if not texts:
            raise ValueError("no texts to embed")
        out = []
        for at in range(0, len(texts), EMBED_BATCH):
            status, text = self._send({"input": texts[at : at + EMBED_BATCH], **({"task": task} if self.sends_task else {})}, EMBED_TIMEOUT)
            if status >= 400:
                raise RuntimeError(f"embeddings: HTTP {status}: {text[:200]}")
            out += [unit(x["embedding"]) for x in sorted(json.loads(text)["data"], key=lambda x: x["index"])]
        return out


class TaskEmbedder(RestEmbedder):
    """Tells the service whether it embeds queries or passages."""

    sends_task = True


class RestReranker(_Rest, Reranker):
    path = "/rerank"

    def score(self, query: str, texts: list[str]) -> list[float]:
        if not texts:
            return []
        status, text = self._send({"query": query, "documents": texts, "top_n": len(texts)}, RERANK_TIMEOUT)
        if status >= 400:
            raise RuntimeError(f"rerank: HTTP {status}: {text[:200]}")
        scores = [0.0] * len(texts)
        for x in json.loads(text)["results"]:
            scores[x["index"]] = x["relevance_score"]
        return scores


class HashedEmbedder(Embedder):
    """Offline: counts of tokens in hashed places, at length 1. It has the shape of a model's vectors, not their quality."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str], task: str = "retrieval.passage") -> list[list[float]]:
        if not texts:
            raise ValueError("no texts to embed")
        out = []
        for text in texts:
            vector = [0.0] * self.dim
            for token in text.lower().split():
                vector[int.from_bytes(hashlib.blake2b(token.encode(), digest_size=4).digest(), "little") % self.dim] += 1
            out.append(unit(vector))
        return out


class _Loaded:
    """A model of a library that may be absent: loaded once by each worker that uses it, never sent there."""

    def __init__(self, model: str):
        self.model = model

    @cached_property
    def loaded(self):
        return self._load()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "loaded"}


#: A fixed value: what the default model expects before a query, and not before a passage.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


class LocalEmbedder(_Loaded, Embedder):
    """A sentence-transformers model on the workers. Needs that library and the model there. Queries get a prefix, passages none."""

    def __init__(self, model: str = "BAAI/bge-small-en-v1.5", prefix: str = QUERY_PREFIX):
        super().__init__(model)
        self.prefix = prefix

    def _load(self):
        from sentence_transformers import SentenceTransformer

        return SentenceTransformer(self.model)

    def embed(self, texts: list[str], task: str = "retrieval.passage") -> list[list[float]]:
        if not texts:
            raise ValueError("no texts to embed")
        texts = [self.prefix + t for t in texts] if task == "retrieval.query" else texts
        return [unit([float(x) for x in v]) for v in self.loaded.encode(texts, batch_size=LOCAL_BATCH, normalize_embeddings=True, show_progress_bar=False)]


class LocalReranker(_Loaded, Reranker):
    """A sentence-transformers cross-encoder on the workers; its scores go through a logistic function."""

    def __init__(self, model: str = "cross-encoder/ms-marco-MiniLM-L-6-v2"):
        super().__init__(model)

    def _load(self):
        from sentence_transformers import CrossEncoder

        return CrossEncoder(self.model)

    def score(self, query: str, texts: list[str]) -> list[float]:
        return [1 / (1 + math.exp(-float(x))) for x in self.loaded.predict([(query, t) for t in texts], show_progress_bar=False)] if texts else []


class OverlapReranker(Reranker):
    """Offline: the part of the query's distinct tokens that a text has."""

    def score(self, query: str, texts: list[str]) -> list[float]:
        wanted = set(query.lower().split())
        return [len(wanted & set(t.lower().split())) / len(wanted) if wanted else 0.0 for t in texts]


class EchoChat(Chat):
    """Offline: answers with the first context line that shares most words with the question, as JSON."""

    def complete(self, prompt: str, system: str = "", max_tokens: int = 2048, temperature: float = 0) -> str:
        context, _, question = prompt.rpartition("Question: ")
        wanted = set(question.lower().split())
        lines = [x for x in context.split("\n") if x and not x.startswith("[Source:")]
        best = max(lines, key=lambda x: len(wanted & set(x.lower().split())), default="")
        return json.dumps({"answer": best or "not found", "source": None})


def _needs_key(make):
    def build(key: str = "", **options):
        if not key:
            raise ValueError("this provider needs an API key")
        return make(api_key=key, **options)

    return build


CHATS = {"rest": RestChat, "keyed": _needs_key(RestChat), "echo": EchoChat}
EMBEDDERS = {"rest": RestEmbedder, "task": TaskEmbedder, "local": LocalEmbedder, "hashed": HashedEmbedder}
RERANKERS = {"rest": RestReranker, "local": LocalReranker, "overlap": OverlapReranker}


def _make(known: dict, kind: str, name: str, options: dict):
    if name not in known:
        raise ValueError(f"unknown {kind} {name!r}; known: {', '.join(known)}")
    return known[name](**options)


def make_chat(name: str, **options) -> Chat:
    return _make(CHATS, "chat", name, options)


def make_embedder(name: str, **options) -> Embedder:
    return _make(EMBEDDERS, "embedder", name, options)


def make_reranker(name: str | None, **options) -> Reranker | None:
    return _make(RERANKERS, "reranker", name, options) if name else None


def _paced(rows: DataFrame, limit: RateLimit | None) -> tuple[DataFrame, int]:
    """rows dealt to as many tasks as may call at a time, and how many; as they are without a limit."""
    if limit is None:
        return rows, 0
    tasks = limit.tasks(rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(tasks), tasks


def embed_column(rows: DataFrame, embedder: Embedder, text_col: str, task: str = "retrieval.passage", limit: RateLimit | None = None) -> DataFrame:
    """Adds vector; each Arrow batch is one call to the embedder. With a limit the tasks share its tokens, and calls have as many
    texts as its largest request."""
    rows, tasks = _paced(rows, limit)

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pace = limit.pace(tasks) if limit else None
        for texts in batches:
            held = texts.fillna("").tolist()
            if pace is None:
                yield pd.Series(embedder.embed(held, task) if held else [], dtype=object)
                continue
            out, at = [], 0
            while at < len(held):
                to, size = at + 1, tokens_of(held[at])
                while to < len(held) and size + tokens_of(held[to]) <= limit.largest:
                    size, to = size + tokens_of(held[to]), to + 1
                pace.wait(size)
                out += embedder.embed(held[at:to], task)
                at = to
            yield pd.Series(out, dtype=object)

    return rows.withColumn("vector", run(F.col(text_col)))


def rerank_column(rows: DataFrame, reranker: Reranker, by: str = "qid", question: str = "question", text: str = "row_text") -> DataFrame:
    """Adds rerank_score; rows of one question that lie in one Arrow batch are one call. Rows stay where they are, so a question
    that takes the whole corpus is scored by many tasks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, part in frame.groupby(by, sort=False):
                yield part.assign(rerank_score=reranker.score(part[question].iloc[0], part[text].tolist()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{schema}, rerank_score double")


def complete_column(rows: DataFrame, chat: Chat, system: str, limit: RateLimit | None = None) -> DataFrame:
    """Adds raw, seconds. rows: prompt, max_tokens and others. Call it on rows that aren't blocked: Spark moves no filter past it.

    With a limit the rows are dealt to as many tasks as its budget bears, and each of them keeps to its share of it: prompt,
    system and all tokens asked for count. A task that runs alone or again stays within its share, too.
    """
    columns = [c for c in rows.columns if c not in ("raw", "seconds")]
    rows, tasks = _paced(rows.select(*columns), limit)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace = limit.pace(tasks) if limit else None
        for frame in frames:
            raw, seconds = [], []
            for prompt, tokens in zip(frame["prompt"], frame["max_tokens"], strict=True):
                if pace is not None:
                    pace.wait(tokens_of(prompt, system) + int(tokens))
                began = time.time()
                raw.append(chat.complete(prompt, system, int(tokens)))
                seconds.append(time.time() - began)
            yield frame.assign(raw=raw, seconds=seconds)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{schema}, raw string, seconds double")
