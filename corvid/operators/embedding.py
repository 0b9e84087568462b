"""Embedding: a provider port, a deterministic hashing embedder, and reuse of what was embedded before."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvid.functions import vector as V

Embed = Callable[[list[str]], "list[list[float]]"]
_TOKEN = re.compile("[a-z0-9]+").findall


def bucket(token: Column, dim: int) -> Column:
    """Bucket of a token by its MD5, which other engines have too."""
    return F.pmod(F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(dim))


class _Buckets(dict):
    """Bucket of each token that was met, by its MD5; emptied when it is large."""

    def __init__(self, dim: int) -> None:
        self.dim = dim

    def __missing__(self, token: str) -> int:
        if len(self) > 1 << 20:
            self.clear()
        self[token] = out = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % self.dim
        return out


def _counts(text: str, buckets: _Buckets) -> np.ndarray:
    return np.bincount([buckets[t] for t in _TOKEN(text)], minlength=buckets.dim)


def buckets(dim: int) -> dict[str, int]:
    """Bucket of any token, each computed once while the table lasts."""
    return _Buckets(dim)


def hashed(texts: list[str], table: _Buckets) -> np.ndarray:
    """Unit vectors of the texts' token counts, all counted together; zeros without a token."""
    found = [_TOKEN((t or "").lower()) for t in texts]
    row = np.repeat(np.arange(len(texts)), [len(f) for f in found])
    at = np.fromiter((table[t] for f in found for t in f), np.int64, len(row))
    counts = np.bincount(row * table.dim + at, minlength=len(texts) * table.dim).reshape(len(texts), table.dim).astype(np.float64)
    size = np.linalg.norm(counts, axis=1, keepdims=True)
    return counts / np.where(size > 0, size, 1.0)


def hashing_vectors(texts: DataFrame, key: str, content: str, dim: int = 64) -> DataFrame:
    """``key, bucket, weight``: token counts by bucket, of unit length together; a map, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets(dim)
        for batch in batches:
            if not batch.num_rows:
                continue
            counts = np.stack([_counts(t or "", buckets) for t in batch.column(1).to_pylist()])
            size = np.sqrt((counts.astype(np.float64) ** 2).sum(axis=1))
            row, at = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(at), pa.array(counts[row, at] / size[row])], [key, "bucket", "weight"])

    low = texts.select(key, F.lower(content).alias("text"))
    return low.mapInArrow(run, T.StructType([*texts.select(key).schema, T.StructField("bucket", T.LongType()), T.StructField("weight", T.DoubleType())]))


def hashing_embedding(text: Column, dim: int = 64) -> Column:
    """The same as one dense array; a text without a token is all zero."""
    tokens = F.transform(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != ""), lambda t: bucket(t, dim).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(tokens, lambda t: t == i)).cast("double"))
    return V.normalize(counts)


class HashingEmbedder:
    """The same for a provider: any list of texts to unit vectors."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def __call__(self, texts: list[str]) -> list[list[float]]:
        buckets = _Buckets(self.dim)
        out = np.array([_counts((t or "").lower(), buckets) for t in texts], float).reshape(len(texts), self.dim)
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(size > 0, size, 1.0)).tolist()


def embed(texts: DataFrame, provider: Embed, dim: int, content: str = "content", batch: int = 64, normalize: bool = True) -> DataFrame:
    """The rows with ``embedding``; blank texts get zeros without a call, a provider sees ``batch`` texts at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = np.zeros((len(pdf), dim))
            full = np.flatnonzero(pdf[content].fillna("").str.strip().ne("").to_numpy())
            for lo in range(0, len(full), batch):
                at = full[lo : lo + batch]
                got = np.asarray(provider(pdf[content].iloc[at].tolist()), float)
                if got.shape != (len(at), dim):
                    raise ValueError(f"the provider gave {got.shape}, not {(len(at), dim)}")
                out[at] = got
            if normalize:
                size = np.linalg.norm(out, axis=1, keepdims=True)
                out = out / np.where(size > 0, size, 1.0)
            yield pdf.assign(embedding=list(out.astype(np.float32)))

    return texts.mapInPandas(run, T.StructType([*texts.schema, T.StructField("embedding", T.ArrayType(T.FloatType()))]))
