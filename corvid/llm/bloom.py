"""Blocked Bloom filters over 64-bit hashes.

An entry sets 8 bits in one block of 256, so a probe touches one block.  Tasks send the
blocks that they touched, which are joined by ``bit_or``.  The filter has
``BITS_PER_KEY`` bits an entry and at most ``MAX_BYTES``: past that its blocks fill up
and it passes more of what isn't in it, but never loses what is.  So what is broadcast
has a bound, and whoever needs an exact answer looks up what passes.

Defined results: null hashes aren't entries and never pass; repeated ones count once; a
filter without entries passes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS_PER_KEY = 16
MAX_BYTES = 64 << 20
WORDS = [f"w{i}" for i in range(4)]
_SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint64)


def blocks_for(n: int, bits_per_key: int = BITS_PER_KEY, max_bytes: int | None = MAX_BYTES) -> int:
    """Blocks of 32 bytes for n entries."""
    wanted = max(1, -(-n * bits_per_key // 256))
    return wanted if max_bytes is None else max(1, min(wanted, max_bytes // 32))


def bits(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash, and its 256 bits as 4 words."""
    h = hashes.view(np.uint64)
    block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    at = (((h & np.uint64(0xFFFFFFFF))[:, None] * _SALTS) & np.uint64(0xFFFFFFFF)) >> np.uint64(27)
    half = np.uint64(1) << at
    return block.astype(np.int64), half[:, 0::2] | (half[:, 1::2] << np.uint64(32))


def filter_table(hashes: DataFrame, blocks: int) -> DataFrame:
    """``block, w0 .. w3`` of the touched blocks, from a table with one long column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0).drop_null()
            block, words = bits(column.to_numpy(), blocks)
            order = np.argsort(block, kind="stable")
            block, words = block[order], words[order]
            starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
            joined = np.bitwise_or.reduceat(words, starts, axis=0) if len(starts) else words
            yield pa.RecordBatch.from_arrays([pa.array(block[starts]), *(pa.array(joined[:, i].view(np.int64)) for i in range(4))], ["block", *WORDS])

    touched = hashes.mapInArrow(run, "block long, w0 long, w1 long, w2 long, w3 long")
    return touched.groupBy("block").agg(*(F.bit_or(w).alias(w) for w in WORDS))


def build(hashes: DataFrame, n: int, bits_per_key: int = BITS_PER_KEY, max_bytes: int | None = MAX_BYTES) -> np.ndarray:
    """The filter (blocks x 4 words) of a table of n hashes in one long column."""
    blocks = blocks_for(n, bits_per_key, max_bytes)
    rows = filter_table(hashes, blocks).toPandas()
    out = np.zeros((blocks, 4), np.uint64)
    for i, w in enumerate(WORDS):
        out[rows.block, i] = rows[w].to_numpy(np.int64).view(np.uint64)
    return out


def may_contain(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each of the hashes; never false for one that it holds."""
    block, words = bits(hashes, len(table))
    return ((table[block] & words) == words).all(axis=1)


def share(spark: SparkSession, hashes: DataFrame, n: int, bits_per_key: int = BITS_PER_KEY, max_bytes: int | None = MAX_BYTES) -> Any:
    """The filter, broadcast."""
    return spark.sparkContext.broadcast(build(hashes, n, bits_per_key, max_bytes))


def probe(shared: Any, hashes: Column) -> Column:
    """Whether the broadcast filter may hold the hash; only the hash goes to Python. False for null."""

    @F.pandas_udf("boolean")
    def held(h: pd.Series) -> pd.Series:
        return pd.Series(may_contain(shared.value, h.to_numpy(np.int64)))

    # pandas would make a column with nulls floats, which don't hold 64 bits
    return hashes.isNotNull() & held(F.coalesce(hashes, F.lit(0).cast("long")))
