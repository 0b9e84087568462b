"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

A document longer than a sequence is first cut into whole sequences and a rest.
Bins are filled one at a time: greedily with the longest piece that still fits,
until none does; then the bin's smallest piece is replaced by the two unpacked
pieces whose sum fills the expanded gap best, if they fill it more tightly than
that piece and no worse than any other two (ties: the larger first piece).

Pieces of one length are alike, so the choice depends only on how many of each
length are left.  The plan is therefore made from the histogram of lengths, which
has at most ``capacity`` entries at any input size: a bin's pattern is repeated
for as long as the lengths it takes last, and each repetition ends with a length
running short.  Distributed, every piece then gets its rank among those of its
length (counts per length and hash shard give each shard's first rank, a window
ranks within the shard; a length has a shard for every ``SHARD_ROWS`` of its pieces, so
no task ranks more at any size), and the rank gives its bin and place by binary search in
the plan.  Only (doc_id, piece, length) move between executors, never texts.

Tokens are white-space separated words by default; any integer column can be the
length instead.  The result has one row a piece: ``bin_id, slot, doc_id, piece,
start, n_tokens``, where the piece is n_tokens tokens of the document from start.
:func:`pack_tokens` packs the ids that :mod:`corvid.llm.bpe` gives and returns each
piece's ids with its place, so a bin's rows in the order of slot are a training sequence.

Defined results: documents of length 0 (null, empty or blank texts, null or
negative lengths) take no place and give no row.  Very long documents become as many
pieces as they fill.  Documents of one length are placed in the order of a hash and then
of doc_id; repeated rows are packed each.  Rows with a null doc_id are packed.  An empty
table gives no rows.  Other columns, of any name, are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvid.llm import bpe
from corvid.llm import textscan as ts
from corvid.storage import cut

CAPACITY = 2048
#: Pieces of one length that a task ranks, on the mean.
SHARD_ROWS = 1 << 19
#: word count: starts of runs of bytes that aren't ASCII white space
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True


def word_counts(column: pa.Array) -> np.ndarray:
    """White-space separated words of each text."""
    out = np.zeros(len(column), np.int64)
    for lo, hi, buf, offsets in ts.slices(column):
        if len(buf) > ts.PIECE:
            # one long text: the byte before a piece tells whether a word goes on
            for at in range(0, len(buf), ts.PIECE):
                space = _SPACE[buf[max(0, at - 1) : at + ts.PIECE]]
                out[lo] += np.count_nonzero(~space[1:] & space[:-1]) + int(at == 0 and not space[0])
            continue
        space = _SPACE[buf]
        start = ~space
        if len(buf) > 1:
            start[1:] &= space[:-1]
            first = offsets[:-1][np.diff(offsets) > 0]
            start[first] = ~space[first]
        out[lo:hi] = np.diff(np.concatenate([[0], np.cumsum(start)])[offsets])
    return out


def lengths(docs: DataFrame) -> DataFrame:
    """``doc_id, n_tokens`` of every document by its white-space separated words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(word_counts(batch.column("text")))], ["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id").schema.add("n_tokens", "long"))


def pieces(sized: DataFrame, capacity: int) -> DataFrame:
    """``doc_id, piece, start, n_tokens`` of the whole sequences and the rest of each document."""
    n: Column = F.col("n_tokens")
    return (
        sized.where("n_tokens > 0")
        .select("doc_id", n.alias("all"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / capacity).cast("long"))).alias("piece"))
        .select("doc_id", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("all") - F.col("piece") * capacity).alias("n_tokens"))
    )


def one_bin(left: np.ndarray, capacity: int) -> list[int]:
    """Lengths of the next bin; ``left[n]`` pieces of length n are unpacked, some of them at least."""
    present = np.flatnonzero(left[: capacity + 1])
    there = present.tolist()
    used: dict[int, int] = {}
    out: list[int] = []
    gap, hi = capacity, len(there)
    while gap:
        hi = bisect_right(there, gap, 0, hi)
        while hi and used.get(there[hi - 1], 0) >= left[there[hi - 1]]:
            hi -= 1
        if not hi:
            break
        n = there[hi - 1]
        out.append(n)
        used[n] = used.get(n, 0) + 1
        gap -= n
    if not gap or len(out) < 1:
        return out
    # the smallest piece is the last; its place and the gap are for two others
    smallest = out[-1]
    room = gap + smallest
    rest = left[present].copy()
    for n, k in used.items():
        rest[np.searchsorted(present, n)] -= k
    free, spare = present[rest > 0], rest[rest > 0]
    free_ok = free < room
    free, spare = free[free_ok], spare[free_ok]
    if not len(free):
        return out
    partner = np.searchsorted(free, np.minimum(room - free, free), "right") - 1
    # two of one length need two of them
    same = (partner >= 0) & (free[partner] == free) & (spare < 2)
    partner = np.where(same, partner - 1, partner)
    total = np.where(partner >= 0, free + free[np.maximum(partner, 0)], 0)
    best = len(total) - 1 - int(np.argmax(total[::-1]))
    if total[best] > smallest:
        out[-1:] = [int(free[best]), int(free[partner[best]])]
    return out


def plan(counts: dict[int, int], capacity: int) -> tuple[dict[int, np.ndarray], int]:
    """For each length the rows (first rank, first bin, pieces a bin, first slot) in the order of ranks; the number of bins."""
    left = np.zeros(capacity + 1, np.int64)
    for n, k in counts.items():
        left[n] = k
    rank = np.zeros(capacity + 1, np.int64)
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    bins = 0
    while left.any():
        taken = one_bin(left, capacity)
        use: dict[int, int] = {}
        for n in taken:
            use[n] = use.get(n, 0) + 1
        times = min(int(left[n]) // k for n, k in use.items())
        slot = 0
        for n in sorted(use, reverse=True):
            k = use[n]
            rows.setdefault(n, []).append((int(rank[n]), bins, k, slot))
            rank[n] += k * times
            left[n] -= k * times
            slot += k
        bins += times
    return {n: np.array(r, np.int64) for n, r in rows.items()}, bins


def _placer(table: dict[int, np.ndarray]) -> Any:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n_tokens").to_numpy()
            rank = batch.column("rank").to_numpy()
            bin_id, slot = np.zeros((2, len(n)), np.int64)
            for length in np.unique(n):
                rows, at = table[int(length)], n == length
                row = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                past = rank[at] - row[:, 0]
                bin_id[at] = row[:, 1] + past // row[:, 2]
                slot[at] = row[:, 3] + past % row[:, 2]
            keep = [batch.column(c) for c in ("doc_id", "piece", "start", "n_tokens")]
            yield pa.RecordBatch.from_arrays([pa.array(bin_id), pa.array(slot), *keep], ["bin_id", "slot", "doc_id", "piece", "start", "n_tokens"])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, length: str | None = None, key: str = "doc_id", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The place of every piece of every document; ``key`` is the column that names a document."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = docs.sparkSession
    sized = lengths(docs) if length is None else docs.select(F.col(key).alias("doc_id"), F.col(length).cast("long").alias("n_tokens"))
    sized = cut(sized, "packing-lengths")
    # at most capacity rows at any input size
    counts = pieces(sized, capacity).groupBy("n_tokens").count().toPandas()
    shards = np.ones(capacity + 1, np.int64)
    shards[counts["n_tokens"]] = -(-counts["count"] // shard_rows)
    by_length = F.broadcast(spark.createDataFrame([(i, int(n)) for i, n in enumerate(shards)], "n_tokens long, shards long"))
    placed = pieces(sized, capacity).join(by_length, "n_tokens").select("doc_id", "piece", "start", "n_tokens", F.pmod(F.xxhash64("doc_id", "piece"), "shards").cast("int").alias("shard"))
    # a row for each length and for each shard_rows pieces
    histogram = placed.groupBy("n_tokens", "shard").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values(["n_tokens", "shard"])
    table, _ = plan({int(k): int(v) for k, v in histogram.groupby("n_tokens").n.sum().items()}, capacity)
    base = np.concatenate([[0], np.cumsum(shards)])
    firsts = np.zeros(base[-1], np.int64)
    firsts[base[histogram.n_tokens] + histogram.shard] = histogram.groupby("n_tokens").n.cumsum() - histogram.n
    shared = spark.sparkContext.broadcast((table, base, firsts))

    def with_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, begin, first = shared.value
        place = _placer(own)

        def ranked() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = begin[batch.column("n_tokens").to_numpy()] + batch.column("shard").to_numpy()
                yield batch.append_column("rank", pa.array(batch.column("within").to_numpy() - 1 + first[at], pa.int64()))

        yield from place(ranked())

    w = Window.partitionBy("n_tokens", "shard").orderBy("doc_id", "piece")
    ranked = placed.withColumn("within", F.row_number().over(w).cast("long"))
    schema = T.StructType([T.StructField("bin_id", T.LongType()), T.StructField("slot", T.LongType()), *placed.select("doc_id", "piece", "start", "n_tokens").schema])
    return ranked.mapInArrow(with_first, schema)


def pack_tokens(docs: DataFrame, capacity: int = CAPACITY, path: str = bpe.VOCABULARY) -> DataFrame:
    """The place of every piece of every document's tokens, and ``token_ids``, the piece's ids.

    Rows are told apart by a number of their own, so those that share a doc_id, or have
    none, keep their own ids.
    """
    encoded = cut(bpe.encode(docs, path).select("doc_id", "n_tokens", "token_ids", F.monotonically_increasing_id().alias("row")), "packing-tokens")
    places = pack(encoded, capacity, "n_tokens", "row").withColumnRenamed("doc_id", "row")
    ids = encoded.select("row", "doc_id", "token_ids")
    out = places.join(ids, "row")
    return out.select("bin_id", "slot", "doc_id", "piece", "start", "n_tokens", F.slice("token_ids", F.col("start").cast("int") + 1, F.col("n_tokens").cast("int")).alias("token_ids"))


def sequences(packed: DataFrame) -> DataFrame:
    """``bin_id, token_ids, doc_ids``: a training sequence a row, its pieces in the order of slot; a bin has ``capacity`` tokens at most."""
    parts = packed.groupBy("bin_id").agg(F.sort_array(F.collect_list(F.struct("slot", "doc_id", "token_ids"))).alias("p"))
    return parts.select("bin_id", F.flatten(F.transform("p", lambda x: x["token_ids"])).alias("token_ids"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"))
