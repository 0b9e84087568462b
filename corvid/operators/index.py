"""An approximate index that is built, stored, added to and searched: cells of vectors.

Centres are fitted on a bounded sample (``SAMPLE`` rows by a hash of the id, a documented
bound); every row of the store is assigned to its nearest centre and stored with its cell.
A query is compared with the rows of its nearest cells only.  How many cells that is, is
measured at the build: sample rows as queries against all of the sample, the least number
that reaches the wanted recall with a margin.  The number of cells grows with the square
root of the store.

Rows go through the tasks in the order of their cells, as in exact search, and each cell
meets those of a task's queries that have it among their nearest.  A task compares
``BLOCK_ROWS`` rows at a time and has ``BLOCK_QUERIES`` queries or about so many, so none
holds a hot cell, and a query's vector isn't sent once a cell.  Filters come before the
comparison, so a filtered search loses nothing to rows that don't match.

Vectors are compared by cosine.  Null and zero vectors are stored but never found; a null
query has no answer; an empty store gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvid.functions import filters
from corvid.operators.retrieval import QUERY_BYTES, nearest_rows, upsert
from corvid.storage import cut

SAMPLE = 20_000
#: Rows that a task compares at a time, and queries that it has.
BLOCK_ROWS, BLOCK_QUERIES = 1 << 12, 1 << 15
RECALL = 0.95


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1.0)


def fit_centres(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centres of unit vectors by k-means on the sphere."""
    rng = np.random.RandomState(seed)
    x = _unit(sample)
    centres = x[rng.permutation(len(x))[:cells]]
    for _ in range(rounds):
        own = np.concatenate([(x[lo : lo + 4096] @ centres.T).argmax(axis=1) for lo in range(0, len(x), 4096)])
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        empty = np.bincount(own, minlength=len(centres)) == 0
        total[empty] = x[rng.randint(0, len(x), empty.sum())]
        centres = _unit(total)
    return centres


def probes_for(sample: np.ndarray, centres: np.ndarray, k: int, recall: float, queries: int = 500) -> int:
    """The least number of nearest cells that hold that share of the true nearest k, over the sample."""
    x = _unit(sample)
    asked = x[: min(queries, len(x))]
    own = np.concatenate([(x[lo : lo + 4096] @ centres.T).argmax(axis=1) for lo in range(0, len(x), 4096)])
    rank = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)
    true = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, :k]
    depth = np.take_along_axis(rank, own[true], axis=1).ravel()
    return int(np.sort(depth)[min(len(depth) - 1, int(np.ceil(recall * len(depth))))]) + 1


@dataclass
class CellIndex:
    """``table`` is the store with a column ``cell``."""

    table: DataFrame
    centres: np.ndarray
    probes: int

    def _assigned(self, rows: DataFrame) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(self.centres)
        at = rows.columns.index("embedding")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column(at)
                cell = np.zeros(batch.num_rows, np.int32)
                there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
                if len(there):
                    x = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(len(there), -1).astype(np.float64)
                    cell[there] = (x @ shared.value.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

        return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField("cell", T.IntegerType())]))

    def add(self, rows: DataFrame) -> CellIndex:
        """With these rows, in place of those with the same id; the centres stay."""
        new = self._assigned(rows.select([c for c in self.table.columns if c != "cell"]))
        return CellIndex(cut(upsert(self.table, new.withColumn("seq", F.lit(0))), "cells"), self.centres, self.probes)

    def delete(self, ids: DataFrame) -> CellIndex:
        return CellIndex(self.table.join(ids.select("id").distinct(), "id", "left_anti"), self.centres, self.probes)

    def save(self, path: str) -> None:
        """Rows by cell, and the centres and their number of probes as one small file."""
        self.table.write.mode("overwrite").parquet(f"{path}/rows")
        about = json.dumps({"probes": self.probes, "centres": self.centres.tolist()})
        self.table.sparkSession.createDataFrame([(about,)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> CellIndex:
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        return CellIndex(spark.read.parquet(f"{path}/rows"), np.array(about["centres"]), about["probes"])

    def search(self, queries: DataFrame, k: int = 5, min_score: float | None = None, above: float | None = 0.0, where: filters.Condition | filters.Group | Mapping[str, Any] | None = None, probes: int | None = None) -> DataFrame:
        """``query_id, rank, id, score`` as :func:`corvid.operators.retrieval.search` gives, from the nearest cells."""
        nearest = min(probes or self.probes, len(self.centres))
        rows = filters.apply_filter(self.table, where).where("embedding is not null").select("cell", "id", F.col("embedding").alias("v"))
        return nearest_rows(rows, queries, k, "cosine", min_score, above, BLOCK_ROWS, QUERY_BYTES, BLOCK_QUERIES, self.centres, nearest)

    def compared(self, queries: DataFrame) -> float:
        """Share of all pairs of a query and a row that a search of these queries compares."""
        sizes = {r["cell"]: r["n"] for r in self.table.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        q = np.array([list(r["qvec"]) for r in queries.where("qvec is not null").select("qvec").collect()])
        cells = np.argsort(-(q @ self.centres.T), axis=1)[:, : self.probes]
        n = np.array([sizes.get(c, 0) for c in range(len(self.centres))])
        return float(n[cells].sum() / (len(q) * n.sum()))


def build(store: DataFrame, k: int = 10, cells: int | None = None, recall: float = RECALL, sample: int = SAMPLE) -> CellIndex:
    """The index of every row of a store; only the centres and the number of probes come from a sample."""
    n = store.count()
    picked = store.where("embedding is not null").orderBy(F.xxhash64("id"), "id").limit(sample).select(F.col("embedding").cast("array<double>").alias("v")).toPandas()
    if not len(picked):
        return CellIndex(store.withColumn("cell", F.lit(0)), np.zeros((1, 1)), 1)
    x = np.array(picked["v"].tolist())
    cells = min(len(x), cells or max(1, int(2 * np.sqrt(n))))
    centres = fit_centres(x, cells)
    index = CellIndex(store, centres, probes_for(x, centres, k, recall))
    index.table = cut(index._assigned(store).sortWithinPartitions("cell"), "cells")
    return index
