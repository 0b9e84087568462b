"""Sharding by balanced label propagation.

Documents are linked if they share a run of sentences (the runs of
:mod:`corvid.llm.spans`): every document with a run is linked to the least doc_id that
has it, and the weight of a link is the number of runs the two share so.  A star for
each run keeps the number of links below the number of runs, however many documents
share one; the least doc_id of a run is an aggregate, which tasks begin before the
shuffle.

A document's label is its shard, at first a hash of doc_id.  In each round one half of
the documents looks at the labels of its neighbours, in the next the other half; every two
rounds a hash of doc_id draws new halves, so that two documents can't change places
for ever.  The shard with the greatest total weight is where a document would go (ties:
the least shard), its gain the weight there less the weight in its own shard.  How many
go from shard i to shard j is a quota: all that would, scaled down until no shard holds
more than ``(1 + SLACK)`` of the mean of all documents, or so few that the documents
without a link couldn't fill it up to ``(1 - SLACK)``.  Those with the
greatest gain go first; of those at the border a share by hash, three standard deviations
under what the quota has left.  Quotas come from a histogram of (from, to, gain, hash
bin) whose size depends on the number of shards, not of documents; only it and the
quotas pass through the driver.

Rounds end when both halves in turn have moved nothing: then no document gains by a move
that its quota allows.  ``ROUNDS`` only stands against endless change between equals.

Documents without a link then fill the shards up to even sizes: each has a rank among
them (counts by hash bin, then a rank within the bin), and the rank gives the shard.
So the sizes differ by what linked documents alone make uneven, and by one at most
where there are enough others.

Labels and links are written to the shared folder each round, which cuts lineage.

Defined results: one row for each distinct doc_id, none for null; doc_ids must be
integers.  Rows that share a doc_id are one document with the runs of them all.  Null,
empty and very short texts have no link; very long ones are cut into sentences piece by
piece.  An empty table gives no rows.  Only ``doc_id`` and ``text`` are read; other
columns, of any name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.llm import spans
from corvid.storage import cut, drop, scratch

SHARDS = 16
ROUNDS = 60
SLACK = 0.05
GAIN_LEVELS = 48
BINS = 64
FILL_BINS = 1024
#: Documents that a bin of the last step should have.
FILL_ROWS = 200_000
_LOT = 1 << 31


def links(docs: DataFrame) -> DataFrame:
    """``src, dst, w`` both ways, of the documents that share runs of sentences."""
    shared = spans.sharers(docs).where("doc_id <> first_doc")
    pairs = shared.groupBy(F.col("first_doc").alias("hub"), "doc_id").agg(F.count(F.lit(1)).alias("w"))
    return pairs.select(F.explode(F.array(F.struct(F.col("hub").alias("src"), F.col("doc_id").alias("dst"), "w"), F.struct(F.col("doc_id").alias("src"), F.col("hub").alias("dst"), "w"))).alias("l")).select("l.*")


def _first_shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")


def quotas(wish: np.ndarray, sizes: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """How many of the ``wish[i, j]`` documents may go from i to j, so that all sizes stay (or come no further from) within lo and hi."""
    x = wish.astype(np.int64).copy()
    np.fill_diagonal(x, 0)
    top, bottom = np.maximum(hi, sizes), np.minimum(lo, sizes)
    while True:
        after = sizes + x.sum(axis=0) - x.sum(axis=1)
        over, under = after - top, bottom - after
        if over.max(initial=0) <= 0 and under.max(initial=0) <= 0:
            return x
        for j in np.flatnonzero(over > 0):
            into = x[:, j].sum()
            x[:, j] = x[:, j] * max(0, into - over[j]) // into
        for i in np.flatnonzero(under > 0):
            out = x[i].sum()
            x[i] = x[i] * max(0, out - under[i]) // out if out else 0


def _order() -> Column:
    """Movers of greater gain come first; in one level the hash bin decides."""
    level = F.least(F.lit(GAIN_LEVELS - 1), F.floor(F.log2(F.col("gain").cast("double"))).cast("int"))
    return (F.lit(GAIN_LEVELS - 1) - level) * BINS + F.pmod(F.xxhash64("doc_id", F.lit("bin")), F.lit(BINS)).cast("int")


def _lot() -> Column:
    """What draws among the documents of one bin."""
    return F.pmod(F.xxhash64("doc_id", F.lit("lot")), F.lit(_LOT))


def _active(turn: int) -> Column:
    """The half of the documents that acts in a turn; a turn and the next are all of them."""
    return F.pmod(F.xxhash64("doc_id", F.lit(turn // 2)), F.lit(2)) == turn % 2


def wishes(labels: DataFrame, edges: DataFrame, turn: int) -> DataFrame:
    """``doc_id, shard, target, place, lot`` of the active documents that would gain by moving."""
    told = edges.join(labels, F.col("dst") == F.col("doc_id")).select(F.col("src").alias("doc_id"), "shard", "w", F.lit(0).alias("own"))
    both = told.unionByName(labels.select("doc_id", "shard", F.lit(0).cast("long").alias("w"), F.lit(1).alias("own"))).where(_active(turn))
    summed = both.groupBy("doc_id", "shard").agg(F.sum("w").alias("w"), F.max("own").alias("own"))
    best = summed.groupBy("doc_id").agg(
        F.max(F.struct("w", (-F.col("shard")).alias("minus"))).alias("best"),
        F.max(F.struct("own", "shard", "w")).alias("now"),
    )
    gains = best.select("doc_id", F.col("now.shard").alias("shard"), (-F.col("best.minus")).alias("target"), (F.col("best.w") - F.col("now.w")).alias("gain"))
    return gains.where("gain > 0 and target <> shard").select("doc_id", "shard", "target", _order().alias("place"), _lot().alias("lot"))


def admitted(histogram: pd.DataFrame, allowed: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(from, to, place, lot): who goes has a place before, or that place and a lesser lot. Rows of the histogram are in the order of place."""
    out = []
    for (i, j), cells in histogram.groupby(["shard", "target"]):
        left, place, lot = int(allowed[i, j]), -1, 0
        for at, n in zip(cells["place"], cells["count"]):
            if n > left:
                # a share of the cell: under its expectation by three deviations of a draw
                share = left / n
                sure = int((share - 3 * np.sqrt(share * (1 - share) / n)) * _LOT)
                if sure > 0:
                    place, lot = int(at), sure
                break
            left, place, lot = left - int(n), int(at), _LOT
        if place >= 0:
            out.append((int(i), int(j), place, lot))
    return out


def propagate(labels: DataFrame, edges: DataFrame, shards: int, rounds: int, lo: int, hi: int) -> tuple[DataFrame, int]:
    """``doc_id, shard`` after the rounds, and how many rounds there were; labels: a table made by ``cut``; lo, hi: bounds of a shard's linked documents."""
    spark = labels.sparkSession
    idle, sizes = 0, None
    for turn in range(rounds):
        # only both halves of one draw are all documents
        idle *= turn % 2
        if sizes is None:
            # at most shards rows
            size = labels.groupBy("shard").count().toPandas()
            sizes = np.zeros(shards, np.int64)
            sizes[size["shard"]] = size["count"]
        asked = cut(wishes(labels, edges, turn), "shard-wishes")
        # at most shards**2 x levels x bins
        histogram = asked.groupBy("shard", "target", "place").count().toPandas().sort_values(["shard", "target", "place"])
        wish = np.zeros((shards, shards), np.int64)
        np.add.at(wish, (histogram["shard"], histogram["target"]), histogram["count"])
        allowed = quotas(wish, sizes, lo, hi)
        bounds = admitted(histogram, allowed)
        if not bounds:
            drop(asked)
            idle += 1
            if idle == 2:
                return labels, turn + 1
            continue
        idle = 0
        # one row a pair of shards
        last = F.broadcast(spark.createDataFrame(bounds, "shard int, target int, last int, upto long"))
        movers = asked.join(last, ["shard", "target"]).where("place < last or place = last and lot < upto").select(F.col("doc_id").alias("mover"), "target")
        new = cut(labels.join(movers, F.col("doc_id") == F.col("mover"), "left").select("doc_id", F.coalesce("target", "shard").alias("shard")), "shard-labels")
        # where all that would may go, the new sizes are known; after a draw they are counted
        sizes = sizes + wish.sum(axis=0) - wish.sum(axis=1) if (allowed == wish).all() else None
        drop(asked)
        drop(labels)
        labels = new
    return labels, rounds


def fill(rest: DataFrame, sizes: np.ndarray) -> DataFrame:
    """``doc_id, shard`` of the unlinked documents, which even out the sizes of the linked ones."""
    shards = len(sizes)
    bins = max(FILL_BINS, rest.count() // FILL_ROWS)
    binned = rest.withColumn("bin", F.pmod(F.xxhash64("doc_id"), F.lit(bins)).cast("int"))
    counted = binned.groupBy("bin").count().toPandas().sort_values("bin")
    counts = np.zeros(bins, np.int64)
    counts[counted["bin"]] = counted["count"]
    first = np.cumsum(counts) - counts
    level = water_level(sizes, int(counts.sum()))
    ends = np.cumsum(level - sizes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("nth").to_numpy() - 1 + first[batch.column("bin").to_numpy()]
            shard = np.minimum(np.searchsorted(ends, rank, "right"), shards - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shard)], ["doc_id", "shard"])

    nth = F.row_number().over(Window.partitionBy("bin").orderBy("doc_id"))
    return binned.withColumn("nth", nth.cast("long")).mapInArrow(place, "doc_id long, shard int")


def water_level(sizes: np.ndarray, more: int) -> np.ndarray:
    """The sizes once ``more`` documents went to the smallest shards, one after another."""
    order = np.argsort(sizes, kind="stable")
    level = sizes.astype(np.int64)[order]
    for k in range(1, len(level) + 1):
        total = int(level[:k].sum()) + more
        if k == len(level) or total <= level[k] * k:
            base, extra = divmod(total, k)
            level[:k] = base
            level[:extra] += 1
            break
    out = np.empty_like(level)
    out[order] = level
    return out


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, slack: float = SLACK) -> DataFrame:
    """``doc_id, shard`` of every document."""
    if shards < 1:
        raise ValueError("there must be a shard at least")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    with scratch(docs.sparkSession) as keep:
        edges = keep(cut(links(ids), "shard-links"))
    labels = cut(edges.select(F.col("src").alias("doc_id")).distinct().withColumn("shard", _first_shard(shards)), "shard-labels")
    rest = cut(ids.select("doc_id").distinct().join(labels.select("doc_id"), "doc_id", "left_anti"), "shard-rest")
    labels, _ = propagate(labels, edges, shards, rounds, *limits(labels.count(), rest.count(), shards, slack))
    drop(edges)
    size = labels.groupBy("shard").count().toPandas()
    sizes = np.zeros(shards, np.int64)
    sizes[size["shard"]] = size["count"]
    return labels.unionByName(fill(rest, sizes))


def limits(linked: int, others: int, shards: int, slack: float) -> tuple[int, int]:
    """Least and most linked documents of a shard, such that with the others it has within ``slack`` of the mean."""
    total = linked + others
    mean = total / shards
    hi = int(-(-mean * (1 + slack) // 1))
    # the most shards that linked documents alone can fill, and what each of the rest then gets
    full = linked // hi if hi else 0
    if full < shards and (total - full * hi) / (shards - full) >= mean * (1 - slack):
        return 0, hi
    return max(0, int(mean * (1 - slack)) - others // shards), hi
