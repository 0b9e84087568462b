"""Quality rules: hashed n-gram log-likelihood ratio.

Every text becomes tokens (runs of word bytes and runs of punctuation, lower
case) and their 1-grams and 2-grams, hashed into ``2**bits`` buckets.  Two
multinomials over the buckets are counted: one of the trusted target documents,
one of the whole raw corpus.  A document's score is the sum over its n-grams of
``log p_target - log p_raw``, divided by the number of its n-grams, and the
document is kept when the score reaches the threshold.

Two passes over the text: counting leaves at most ``2**bits`` rows a task, scoring is a
map.  Which texts are trusted is told without moving them: a Bloom filter of bounded size
holds the trusted ids, a second one those ids of the corpus that the first lets pass
though they aren't trusted (found by a join of ids alone).  A text that passes the first
and not the second is trusted for sure; only the few that pass both are joined with the
ids.  Where the filters are full more texts take part in that join; the counts are the
same.

Defined results: a null, empty or blank text has no n-grams, a null score and is not
kept.  Very long texts are cut into words piece by piece and count whole.  A score equal
to the threshold is kept.  Repeated rows are scored each.  Rows with a null doc_id are
scored but never trusted; other doc_ids must be integers.  An empty target gives every
document the score 0 under equal multinomials; an empty table gives no rows.  Only
``doc_id`` and ``text`` are read; other columns, of any name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.llm import bloom
from corvid.llm import textscan as ts
from corvid.storage import cut, scratch

BITS = 16
#: Mean log-ratio at which a document is kept.
THRESHOLD = -0.1
ALPHA = 1.0
#: Log-ratios are held as integers of this fraction, so that sums are exact in any order.
UNIT = 1 << 20
_ONE, _TWO, _NEXT = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB


def buckets(buf: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the 1-grams and of the 2-grams, each with where the documents begin."""
    h, first = ts.tokens(buf, offsets, punctuation=True)
    shift = np.uint64(64 - bits)
    one = (h * np.uint64(_ONE)) >> shift
    pair = np.ones(len(h), bool)
    ends = first[1:]
    pair[ends[ends > first[:-1]] - 1] = False
    two = (h[:-1] * np.uint64(_TWO) + h[1:] * np.uint64(_NEXT)) >> shift if len(h) else h
    n = np.diff(first)
    first_two = np.concatenate([[0], np.cumsum(np.maximum(n - 1, 0))])
    return one.astype(np.int64), first, two[pair[:-1]].astype(np.int64) if len(h) else one.astype(np.int64), first_two


def _counter(bits: int) -> Any:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            trusted = batch.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, buf, offsets in ts.slices(batch.column("text")):
                one, f1, two, f2 = buckets(buf, offsets, bits)
                for b, f in ((one, f1), (two, f2)):
                    total[0] += np.bincount(b, minlength=1 << bits)
                    total[1] += np.bincount(b[np.repeat(trusted[lo:hi], np.diff(f))], minlength=1 << bits)
        seen = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[0][seen]), pa.array(total[1][seen])], ["bucket", "raw", "target"])

    return count


def _scorer(weights: Any, bits: int, threshold: float) -> Any:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            n, s = np.zeros((2, batch.num_rows), np.int64)
            for lo, hi, buf, offsets in ts.slices(batch.column("text")):
                one, f1, two, f2 = buckets(buf, offsets, bits)
                n[lo:hi] = np.diff(f1) + np.diff(f2)
                s[lo:hi] = ts.sums(w[one], f1) + ts.sums(w[two], f2)
            with np.errstate(invalid="ignore"):
                mean = np.round(s / (n * float(UNIT)), 6)
            none = n == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.array(mean, mask=none), pa.array(np.where(none, False, mean >= threshold))],
                ["doc_id", "n_grams", "llr", "keep"],
            )

    return score


def trusted_texts(docs: DataFrame, trusted: DataFrame, filter_bytes: int = bloom.MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """``text, trusted`` of all documents, with true only where both filters agree, and ``text, trusted`` of the trusted ones that they leave open."""
    spark = docs.sparkSession
    ids = cut(trusted.select(F.col("doc_id").cast("long").alias("id")).where("id is not null").distinct(), "trusted-ids")
    own = F.col("doc_id").cast("long")
    code = F.when(own.isNotNull(), F.xxhash64(own))
    in_first = bloom.probe(bloom.share(spark, ids.select(F.xxhash64("id")), ids.count(), max_bytes=filter_bytes), code)
    false = cut(docs.where(in_first).select(own.alias("id")).distinct().join(ids, "id", "left_anti"), "false-ids")
    in_second = bloom.probe(bloom.share(spark, false.select(F.xxhash64("id")), false.count(), max_bytes=filter_bytes), code)
    sure = docs.select("text", (in_first & ~in_second).alias("trusted"))
    left_open = docs.select(own.alias("id"), "text", "doc_id").where(in_first & in_second).join(ids, "id", "left_semi").select("text", F.lit(True).alias("trusted"))
    return sure, left_open


def fit(docs: DataFrame, trusted: DataFrame, bits: int = BITS, alpha: float = ALPHA, filter_bytes: int = bloom.MAX_BYTES) -> np.ndarray:
    """Log-ratio of each bucket in units of 1 / UNIT, from the counts over all documents."""
    counted = "bucket int, raw long, target long"
    with scratch(docs.sparkSession):
        sure, left_open = trusted_texts(docs, trusted, filter_bytes)
        # the open ones are in the first table too: here they count for the target only
        every = sure.mapInArrow(_counter(bits), counted).unionAll(left_open.mapInArrow(_counter(bits), counted).withColumn("raw", F.lit(0).cast("long")))
        rows = every.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    counts = np.zeros((2, 1 << bits))
    counts[0, rows.bucket], counts[1, rows.bucket] = rows.raw, rows.target
    if not counts[1].sum():
        counts[1] = counts[0]
    p = (counts + alpha) / (counts.sum(axis=1, keepdims=True) + alpha * (1 << bits))
    return np.rint(np.log(p[1] / p[0]) * UNIT).astype(np.int64)


def quality(docs: DataFrame, trusted: DataFrame, bits: int = BITS, alpha: float = ALPHA, threshold: float = THRESHOLD, filter_bytes: int = bloom.MAX_BYTES) -> DataFrame:
    """``doc_id, n_grams, llr, keep`` of every document."""
    weights = docs.sparkSession.sparkContext.broadcast(fit(docs, trusted, bits, alpha, filter_bytes))
    schema = docs.select("doc_id").schema.add("n_grams", "long").add("llr", "double").add("keep", "boolean")
    return docs.select("doc_id", "text").mapInArrow(_scorer(weights, bits, threshold), schema)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents labelled good and not toxic."""
    good: Column = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return labels.where(good).select("doc_id")
