"""Remote embedders, language models and vector collections: what is sent and how answers are read.

Nothing here opens a connection.  A transport is a function of (path, payload) that
returns the decoded JSON, which the caller passes; it runs in the tasks, so it must be
picklable.  Failures of it are the engine's errors, so retries, breakers and error rows
work on them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corvid.operators.batch import EmbeddingError, GenerationError, RateLimiter, Retry, StoreError, with_retry
from corvid.operators.prompting import GenerationOptions

Transport = Callable[[str, dict[str, Any]], Any]


def _checked(vectors: Any, n: int, dim: int) -> list[list[float]]:
    out = np.asarray(vectors, float)
    if out.shape != (n, dim):
        raise EmbeddingError(f"the service gave {out.shape}, not {(n, dim)}")
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(size > 0, size, 1.0)).tolist()


@dataclass(frozen=True)
class ListEmbedder:
    """A service that takes a list and answers ``{"data": [{"index", "embedding"}]}`` in any order."""

    send: Transport
    model: str
    dim: int = 1536
    path: str = "/v1/embeddings"
    retry: Retry = Retry()

    def __call__(self, texts: list[str]) -> list[list[float]]:
        got = with_retry(lambda: self.send(self.path, {"model": self.model, "input": texts}), self.retry)
        try:
            rows = sorted(got["data"], key=lambda r: r["index"])
            return _checked([r["embedding"] for r in rows], len(texts), self.dim)
        except (KeyError, TypeError, ValueError) as e:
            raise EmbeddingError(f"an answer without vectors: {e}") from e


@dataclass(frozen=True)
class FeatureEmbedder:
    """A service that takes ``inputs``, a few at a time, and answers with the vectors alone."""

    send: Transport
    model: str
    dim: int = 384
    size: int = 8
    retry: Retry = Retry()

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for lo in range(0, len(texts), self.size):
            part = texts[lo : lo + self.size]
            got = with_retry(lambda part=part: self.send(f"/models/{self.model}", {"inputs": part, "options": {"wait_for_model": True}}), self.retry)
            try:
                out += _checked(got, len(part), self.dim)
            except (TypeError, ValueError) as e:
                raise EmbeddingError(f"an answer without vectors: {e}") from e
        return out


def chat_payload(model: str, prompt: str, o: GenerationOptions, system: str | None = None) -> dict[str, Any]:
    """Messages with the system's among them."""
    messages = [{"role": "system", "content": system}] if system else []
    out: dict[str, Any] = {"model": model, "messages": [*messages, {"role": "user", "content": prompt}], "max_tokens": o.max_tokens, "temperature": o.temperature, "top_p": o.top_p}
    return out | ({"stop": list(o.stop)} if o.stop else {})


def chat_text(answer: Any) -> str:
    return answer["choices"][0]["message"]["content"]


def blocks_payload(model: str, prompt: str, o: GenerationOptions, system: str | None = None) -> dict[str, Any]:
    """Messages with the system's beside them; answers come as blocks."""
    out: dict[str, Any] = {"model": model, "max_tokens": o.max_tokens, "temperature": o.temperature, "top_p": o.top_p, "messages": [{"role": "user", "content": prompt}]}
    return out | ({"system": system} if system else {}) | ({"stop_sequences": list(o.stop)} if o.stop else {})


def blocks_text(answer: Any) -> str:
    return "".join(b["text"] for b in answer["content"] if b.get("type", "text") == "text")


@dataclass(frozen=True)
class LanguageModel:
    """A provider for :func:`corvid.operators.prompting.generate`: a call a prompt, evenly spaced, with attempts."""

    send: Transport
    model: str
    path: str = "/v1/chat/completions"
    payload: Callable[..., dict[str, Any]] = chat_payload
    text: Callable[[Any], str] = chat_text
    system: str | None = None
    per_minute: float | None = 60
    retry: Retry = Retry(attempts=3, first=1.0)

    def __call__(self, prompts: list[str], options: GenerationOptions) -> list[str]:
        limiter = RateLimiter(self.per_minute) if self.per_minute else None
        out = []
        for p in prompts:
            if limiter:
                limiter.wait()
            got = with_retry(lambda p=p: self.send(self.path, self.payload(self.model, p, options, self.system)), self.retry)
            try:
                out.append(self.text(got))
            except (KeyError, IndexError, TypeError) as e:
                raise GenerationError(f"an answer without text: {e!r}") from e
        return out


def blocks_model(send: Transport, model: str, **values: Any) -> LanguageModel:
    """The provider for services whose answers are blocks."""
    return LanguageModel(send, model, "/v1/messages", blocks_payload, blocks_text, **values)


def collection_query(vectors: list[list[float]], k: int, where: Mapping[str, Any] | None = None) -> dict[str, Any]:
    out: dict[str, Any] = {"query_embeddings": vectors, "n_results": k, "include": ["documents", "metadatas", "distances"]}
    return out | ({"where": dict(where)} if where else {})


def collection_hits(answer: Any) -> list[list[tuple[str, float, str | None, str]]]:
    """(id, score, content, metadata as JSON) of each query; the score is 1 less the distance."""
    out = []
    for i, ids in enumerate(answer["ids"]):
        rows = [(answer.get(c) or [[None] * len(ids)] * len(answer["ids"]))[i] for c in ("documents", "metadatas", "distances")]
        if any(len(r) != len(ids) for r in rows):
            raise StoreError("the answer's columns differ in length")
        out.append([(str(d), 1.0 - float(x or 0.0), t, json.dumps(m or {}, sort_keys=True)) for d, t, m, x in zip(ids, *rows)])
    return out


def search_collection(queries: DataFrame, send: Transport, collection: str, k: int = 5, where: Mapping[str, Any] | None = None, size: int = 64, retry: Retry = Retry()) -> DataFrame:
    """``query_id, rank, id, score, content, metadata_json, error`` from a remote collection, many queries a call.

    Queries of a call that fails give one row with the error each.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), size):
                part = pdf.iloc[lo : lo + size]
                rows: list[tuple[Any, ...]] = []
                try:
                    payload = collection_query([list(map(float, v)) for v in part["qvec"]], k, where)
                    got = collection_hits(with_retry(lambda payload=payload: send(f"/collections/{collection}/query", payload), retry))
                    for q, hits in zip(part["query_id"], got):
                        rows += [(q, i, *hit, None) for i, hit in enumerate(sorted(hits, key=lambda h: (-h[1], h[0])), 1)]
                except Exception as e:  # noqa: BLE001 - becomes a row
                    rows = [(q, None, None, None, None, None, f"{type(e).__name__}: {e}") for q in part["query_id"]]
                out = pd.DataFrame(rows, columns=["query_id", "rank", "id", "score", "content", "metadata_json", "error"])
                yield out.astype({"rank": "Int64"})

    schema = T.StructType([*queries.select("query_id").schema]).add("rank", "long").add("id", "string").add("score", "double").add("content", "string").add("metadata_json", "string").add("error", "string")
    return queries.where("qvec is not null").select("query_id", "qvec").mapInPandas(run, schema)
