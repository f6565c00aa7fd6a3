"""Embedding and reranking providers, and their use inside Arrow UDFs.

A provider is any picklable object with the method of its protocol. ``HashEmbedder`` needs no
model and no network; the HTTP providers speak the common JSON interfaces.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import math
import os
import subprocess
import sys
import time
import urllib.error
import urllib.request
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumdex.functions.text import CJK_RUN_RE, WORD_RE, fold


class Embedder(Protocol):
    def embed_texts(self, texts: Sequence[str], input_type: str = "document") -> list[list[float]]: ...


class Reranker(Protocol):
    def score(self, query: str, documents: Sequence[str]) -> list[float]: ...


class ProviderError(RuntimeError):
    """A provider that is misconfigured or does not answer as it should."""


def unit(vector: Sequence[float]) -> list[float]:
    norm = math.sqrt(sum(x * x for x in vector))
    return [float(x) / norm for x in vector] if norm else [float(x) for x in vector]


@dataclasses.dataclass(frozen=True)
class HashEmbedder:
    """Signed hashing of words and Chinese character pairs into a unit vector; the same everywhere."""

    dim: int = 64

    def embed_texts(self, texts: Sequence[str], input_type: str = "document") -> list[list[float]]:
        out = []
        for text in texts:
            norm = fold(text)
            runs = CJK_RUN_RE.findall(norm)
            tokens = WORD_RE.findall(norm) + [r[i : i + 2] for r in runs for i in range(max(1, len(r) - 1))]
            vector = np.zeros(self.dim)
            for token in tokens:
                h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little")
                vector[h % self.dim] += 1 if h >> 63 else -1
            out.append(unit(vector.tolist()))
        return out


def _post(url: str, body: dict, headers: dict[str, str], timeout: float, retries: int, on_network_error: bool) -> dict:
    """JSON in, JSON out; waits 1, 2, 4 ... s after status 429 and 5xx."""
    for attempt in range(retries + 1):
        request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as e:
            if attempt == retries or not (e.code == 429 or e.code >= 500):
                raise ProviderError(f"status {e.code}: {e.read()[:500].decode('utf-8', 'replace')}") from e
        except urllib.error.URLError as e:
            if attempt == retries or not on_network_error:
                raise ProviderError(f"cannot reach {url}: {e.reason}") from e
        time.sleep(2**attempt)
    raise AssertionError


@dataclasses.dataclass(frozen=True)
class RemoteEmbedder:
    """An embeddings endpoint with a key: batches of 16, four retries; vectors ordered by their index."""

    model: str
    api_key: str
    url: str = "https://openrouter.ai/api/v1/embeddings"
    batch: int = 16
    timeout: float = 60.0
    retries: int = 4

    def embed_texts(self, texts: Sequence[str], input_type: str = "document") -> list[list[float]]:
        out: list[list[float]] = []
        for i in range(0, len(texts), self.batch):
            part = list(texts[i : i + self.batch])
            body = {"model": self.model, "input": part}
            try:
                data = self._call(body | {"input_type": input_type})
            except ProviderError as e:
                if "input_type" not in str(e):
                    raise
                data = self._call(body)
            rows = sorted(data.get("data", []), key=lambda x: x.get("index", 0))
            if len(rows) != len(part):
                raise ProviderError(f"{len(rows)} vectors for {len(part)} texts")
            out += [unit(r["embedding"]) for r in rows]
        return out

    def _call(self, body: dict) -> dict:
        return _post(self.url, body, {"Authorization": f"Bearer {self.api_key}"}, self.timeout, self.retries, False)


@dataclasses.dataclass(frozen=True)
class LocalServerEmbedder:
    """An embedding server on this host or network: batches of 16, two retries, connection errors too."""

    model: str
    url: str = "http://localhost:11434/api/embed"
    batch: int = 16
    timeout: float = 60.0
    retries: int = 2

    def embed_texts(self, texts: Sequence[str], input_type: str = "document") -> list[list[float]]:
        out: list[list[float]] = []
        for i in range(0, len(texts), self.batch):
            part = list(texts[i : i + self.batch])
            try:
                data = _post(self.url, {"model": self.model, "input": part}, {}, self.timeout, self.retries, True)
            except ProviderError as e:
                raise ProviderError(f"model {self.model} is not found") if "status 404" in str(e) else e from None
            vectors = data.get("embeddings") or data.get("embedding") or []
            if vectors and not isinstance(vectors[0], list):
                vectors = [vectors]
            if len(vectors) != len(part):
                raise ProviderError(f"{len(vectors)} vectors for {len(part)} texts")
            out += [unit(v) for v in vectors]
        return out


@dataclasses.dataclass(frozen=True)
class RemoteReranker:
    """A rerank endpoint: one call with all documents, no retry; scores go back to their documents by index."""

    model: str
    api_key: str
    url: str
    timeout: float = 60.0
    max_tokens_per_doc: int = 4096

    def score(self, query: str, documents: Sequence[str]) -> list[float]:
        if not documents:
            return []
        body = {"model": self.model, "query": query, "documents": list(documents), "top_n": len(documents), "max_tokens_per_doc": self.max_tokens_per_doc}
        data = _post(self.url, body, {"Authorization": f"Bearer {self.api_key}"}, self.timeout, 0, False)
        return scattered(data.get("results", []), len(documents))


def scattered(results: Sequence[dict], n: int) -> list[float]:
    """Scores in the documents' order; a missing or invalid one is 0."""
    out = [0.0] * n
    for r in results:
        i, score = r.get("index"), r.get("relevance_score")
        if isinstance(i, int) and 0 <= i < n and isinstance(score, (int, float)):
            out[i] = float(score)
    return out


# Default models, the instruction and the prompts that local rerankers were trained with.
LOCAL_RERANKER = "tomaarsen/Qwen3-Reranker-0.6B-seq-cls"
REMOTE_RERANKERS = {
    "cohere": ("https://api.cohere.com/v2/rerank", "rerank-v4.0-fast", "COHERE_API_KEY"),
    "openrouter": ("https://openrouter.ai/api/v1/rerank", "cohere/rerank-v3.5", "OPENROUTER_API_KEY"),
}
INSTRUCTION = "Given a search query, retrieve relevant passages that answer the query."
CHAT_START = (
    "<|im_start|>system\nJudge whether the Document meets the requirements based on the Query and the Instruct provided. "
    'Note that the answer can only be "yes" or "no".<|im_end|>\n<|im_start|>user\n'
)
CHAT_END = "<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\n"
CLASSIFIER_ENDING = "-seq-cls"


@dataclasses.dataclass(frozen=True)
class TransformersReranker:
    """A local model run in the worker, loaded at its first use.

    A model whose name ends with ``-seq-cls`` is a classifier: it reads the chat form of the prompt and
    the sigmoid of its one logit is the score. Any other is a language model that reads the plain form;
    the score is how likely its next token is ``yes`` rather than ``no``.
    """

    model: str = LOCAL_RERANKER
    device: str = "auto"
    max_tokens: int = 8192
    instruction: str = INSTRUCTION

    @property
    def is_classifier(self) -> bool:
        return self.model.endswith(CLASSIFIER_ENDING)

    def prompt(self, query: str, document: str) -> str:
        plain = f"<Instruct>: {self.instruction}\n<Query>: {query}\n<Document>: {document}"
        return CHAT_START + plain + CHAT_END if self.is_classifier else plain

    def _loaded(self) -> dict:
        if self not in _models:
            try:
                import torch
                import transformers
            except ImportError as e:
                raise ProviderError("a local reranker needs torch and transformers") from e
            mps = getattr(torch.backends, "mps", None)
            device = self.device if self.device != "auto" else "mps" if mps is not None and mps.is_available() else "cpu"
            kind = transformers.AutoModelForSequenceClassification if self.is_classifier else transformers.AutoModelForCausalLM
            tokenizer = transformers.AutoTokenizer.from_pretrained(self.model, padding_side="left")  # the last token must be a real one
            answers = None
            if not self.is_classifier:
                answers = [tokenizer.convert_tokens_to_ids(t) for t in ("no", "yes")]
                if None in answers:
                    raise ProviderError(f"the vocabulary of {self.model} has no yes or no")
            _models[self] = {"torch": torch, "tokenizer": tokenizer, "model": kind.from_pretrained(self.model).eval().to(device), "device": device, "answers": answers}
        return _models[self]

    def score(self, query: str, documents: Sequence[str]) -> list[float]:
        if not documents:
            return []
        own = self._loaded()
        batch = own["tokenizer"]([self.prompt(query, d) for d in documents], padding=True, truncation=True, max_length=self.max_tokens, return_tensors="pt")
        with own["torch"].no_grad():
            logits = own["model"](**{k: v.to(own["device"]) for k, v in batch.items()}).logits
        found = np.asarray(logits.detach().cpu().tolist(), np.float64)
        if self.is_classifier:
            return (1 / (1 + np.exp(-found.reshape(len(documents), -1)[:, 0]))).tolist()
        no, yes = (found[:, -1, i] for i in own["answers"])
        return (1 / (1 + np.exp(no - yes))).tolist()


_models: dict = {}


@dataclasses.dataclass(frozen=True)
class SubprocessReranker:
    """A reranker in a process of its own, so that its memory is given back after each query: JSON in, JSON out."""

    model: str = LOCAL_RERANKER
    device: str = "auto"
    max_tokens: int = 8192
    instruction: str = INSTRUCTION
    command: tuple[str, ...] = (sys.executable, "-m", "vellumdex.functions.rerank_worker")

    def score(self, query: str, documents: Sequence[str]) -> list[float]:
        if not documents:
            return []
        payload = {"model": self.model, "device": self.device, "max_length": self.max_tokens, "instruction": self.instruction, "query": query, "documents": list(documents)}
        path = os.pathsep.join([os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), *filter(None, [os.environ.get("PYTHONPATH")])])
        done = subprocess.run(self.command, input=json.dumps(payload), text=True, capture_output=True, check=False, env=os.environ | {"PYTHONPATH": path})
        if done.returncode:
            raise ProviderError(f"the reranker's process failed: {done.stderr.strip() or done.stdout.strip() or done.returncode}")
        try:
            scores = json.loads(done.stdout)["scores"]
        except (json.JSONDecodeError, KeyError, TypeError) as e:
            raise ProviderError(f"the reranker's process gave no scores: {done.stdout[:500]!r}") from e
        return [float(x) for x in scores]


@dataclasses.dataclass(frozen=True)
class Runtime:
    """A provider with the names under which its vectors are cached."""

    provider: str
    model: str
    cache_key: str
    embedder: Embedder


def resolve_embedder(provider: str = "hash", model: str | None = None, api_key: str | None = None, **options) -> Runtime:
    """``hash`` (offline), ``local`` (embedding server) or ``remote`` (endpoint with a key)."""
    if provider == "hash":
        embedder = HashEmbedder(**options)
        return Runtime("hash", f"hash-{embedder.dim}", f"hash::{embedder.dim}", embedder)
    if provider == "local":
        name = model or "nomic-embed-text"
        return Runtime("ollama", name, f"ollama::{name}", LocalServerEmbedder(name, **options))
    if provider == "remote":
        if not (api_key or os.environ.get("OPENROUTER_API_KEY")):
            raise ProviderError("the remote provider needs OPENROUTER_API_KEY")
        name = model or "openai/text-embedding-3-small"
        return Runtime("openrouter", name, name, RemoteEmbedder(name, api_key or os.environ["OPENROUTER_API_KEY"], **options))
    raise ProviderError(f"unknown embedding provider {provider}")


def resolve_reranker(provider: str = "local", model: str | None = None, device: str = "auto", api_key: str | None = None, instruction: str = INSTRUCTION, own_process: bool = False) -> Reranker:
    """``local`` (model in the worker, or in a process of its own), ``cohere`` or ``openrouter`` (endpoints with a key)."""
    if provider == "local":
        kind = SubprocessReranker if own_process else TransformersReranker
        return kind(model or LOCAL_RERANKER, device, instruction=instruction)
    if provider not in REMOTE_RERANKERS:
        raise ProviderError(f"unknown reranker provider {provider}")
    url, default, variable = REMOTE_RERANKERS[provider]
    key = api_key or os.environ.get(variable)
    if not key:
        raise ProviderError(f"the {provider} reranker needs {variable}")
    return RemoteReranker(model or default, key, url)


def sliced(texts: Sequence[str], limit: int = 4 << 20) -> Iterator[list[str]]:
    """The texts in order, in parts of about ``limit`` characters; a single longer text is a part of its own."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > limit:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def embedding_of(embedder: Embedder, text: Column, input_type: str = "document") -> Column:
    """The vector of each text, as an Arrow UDF that calls the provider once for each slice of bounded size."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = ["" if t is None else t for t in batch]
            found: list = []
            for part in sliced(texts):
                found += [np.asarray(v, np.float32) for v in embedder.embed_texts(part, input_type)]
            yield pd.Series(found, dtype=object)

    return embed(text)


def rerank_scores(rows: DataFrame, reranker: Reranker, query: str = "query", text: str = "text", query_id: str = "query_id") -> DataFrame:
    """``rows`` with ``rerank_score``; the documents of a query are scored in one call.

    Rows are the candidates of a search, of which there are at most a few dozen for a query.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("rerank_score", T.DoubleType())])

    def score(group: pa.Table) -> pa.Table:
        texts = ["" if t is None else t for t in group.column(text).to_pylist()]
        found = reranker.score(group.column(query)[0].as_py() or "", texts)
        if len(found) != len(texts):
            raise ProviderError(f"{len(found)} scores for {len(texts)} documents")
        return group.append_column("rerank_score", pa.array([float(x) for x in found], pa.float64()))

    return rows.groupBy(query_id).applyInArrow(score, schema)
