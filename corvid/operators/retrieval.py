"""Vector tables: exact and approximate search, upsert, delete.

A store is a DataFrame ``id, embedding`` with any other columns for filters.  Search
takes a table of queries (``query_id, qvec``) and answers all of them in one job.  While
the queries, as counted, and their best k take at most ``QUERY_BYTES``, every task has
them all and goes through its part of the store, which is read once and never moves.
More queries are dealt into groups of at most ``GROUP_BYTES`` and the store into parts; a
task has one group and goes through one part, a batch of vectors at a time, so that its
memory depends on neither table.  Each pair is compared once, and a window keeps the best
of what the tasks leave.  Ties go to the least id.  :mod:`corvid.operators.index` searches
a part.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from math import ceil, isqrt
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvid.functions import filters
from corvid.functions import vector as V

BLOCK = 4096
#: Queries that every task may hold with their best; checked by a count before.
QUERY_BYTES = 64 << 20
#: Queries with their best that one task has if there are more.
GROUP_BYTES = 128 << 20
#: Queries whose scores are computed at a time, and numbers of the vectors whose exact scores are.
ROWS, NUMBERS = 512, 1 << 21
#: Queries whose best are merged at a time.
SLICE = 2048


def _places(mask: np.ndarray) -> np.ndarray:
    """Places of what is true: where few are, eight at a time are passed over."""
    flat = mask.ravel()
    if len(flat) % 8:
        return np.flatnonzero(flat)
    words = np.flatnonzero(flat.view(np.uint64))
    at = np.flatnonzero(flat.reshape(-1, 8)[words])
    return words[at >> 3] * 8 + (at & 7)


def scores(metric: str, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Queries by vectors."""
    if metric == "manhattan":
        return np.stack([1.0 / (1.0 + np.abs(v - x).sum(axis=1)) for x in q])
    dots = q @ v.T
    if metric == "dot":
        return dots
    if metric in ("cosine", "angular"):
        size = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :]
        cosine = np.divide(dots, size, out=np.zeros_like(dots), where=size > 0)
        return cosine if metric == "cosine" else 1.0 - np.arccos(np.clip(cosine, -1.0, 1.0)) / np.pi
    far = np.stack([((v - x) ** 2).sum(axis=1) for x in q])
    if metric == "euclidean":
        return 1.0 / (1.0 + np.sqrt(far))
    if metric == "rbf":
        return np.exp(-far)
    raise ValueError(f"unknown metric {metric!r}; there are {', '.join(V.METRICS)}")


def _score(metric: str, x: np.ndarray) -> np.ndarray:
    """Score of a cosine, product or negative squared distance."""
    if metric == "angular":
        return 1.0 - np.arccos(np.clip(x, -1.0, 1.0)) / np.pi
    if metric == "euclidean":
        return 1.0 / (1.0 + np.sqrt(np.maximum(-x, 0.0)))
    return np.exp(np.minimum(x, 0.0)) if metric == "rbf" else x


def _each(metric: str, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Scores of the rows of q and of v side by side; all metrics but manhattan."""
    if metric in ("euclidean", "rbf"):
        return _score(metric, -((q - v) ** 2).sum(axis=1))
    dots = np.einsum("ij,ij->i", q, v)
    if metric == "dot":
        return dots
    size = np.linalg.norm(q, axis=1) * np.linalg.norm(v, axis=1)
    return _score(metric, np.divide(dots, size, out=np.zeros_like(dots), where=size > 0))


def _reach(metric: str, score: np.ndarray) -> np.ndarray:
    """The least cosine, product or negative squared distance of a pair whose rounded score is at least that."""
    score = np.asarray(score, np.float64) - 2e-12
    with np.errstate(divide="ignore", invalid="ignore"):
        if metric == "angular":
            return np.where(score > 0, np.cos(np.pi * (1.0 - np.minimum(score, 1.0))), -np.inf)
        if metric == "euclidean":
            return np.where(score > 0, -((1.0 / score - 1.0) ** 2), -np.inf)
        if metric == "rbf":
            return np.where(score > 0, np.log(np.maximum(score, 1e-300)), -np.inf)
    return score


class Best:
    """The best k a query of vectors that come in parts; equal scores go to the least id.

    Products in single precision tell which pairs can reach what a query has, with a
    margin for their error; only these pairs' scores are computed in double precision,
    and only those decide.  Where single precision can't hold the numbers, and for
    manhattan, all scores are computed in double.  A score that isn't a number is no hit.
    What is left is kept and merged by slices of the queries, each when it has several
    times its best, so that nothing is sorted or copied for all queries at once.
    """

    def __init__(self, metric: str, q: np.ndarray, k: int, min_score: float | None, above: float | None, block: int = BLOCK) -> None:
        self.metric, self.q, self.k, self.min_score, self.above, self.block = metric, q.astype(np.float64, copy=False), k, min_score, above, block
        least = max([x for x in (min_score, above) if x is not None], default=-np.inf)
        #: A rounded score that a pair must reach, and what its product must reach.
        self.least = np.full(len(q), least)
        self.own = np.zeros(len(q))
        self.at = self.size = None
        #: Where products and what they reach are written, again and again.
        self.room: tuple[np.ndarray, np.ndarray] | None = None
        if metric != "manhattan":
            with np.errstate(over="ignore"):
                self.at = self._single(self.q, True)
            self.size = np.linalg.norm(self.at.astype(np.float64), axis=1)
            if metric in ("euclidean", "rbf"):
                self.own = (self.q**2).sum(axis=1)
        self.reach = _reach(metric, self.least)
        self.slice = SLICE
        self.left: list[list[tuple[np.ndarray, pa.Array, np.ndarray]]] = [[] for _ in range(ceil(len(q) / SLICE))]
        self.held = [0] * len(self.left)

    @property
    def n(self) -> int:
        """Pairs kept at the moment."""
        return sum(self.held)

    def _single(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Rows whose products order a query's pairs as the metric does: for distances 2qv - vv."""
        if self.metric in ("cosine", "angular"):
            size = np.linalg.norm(x, axis=1, keepdims=True)
            x = x / np.where(size > 0, size, 1.0)
        elif self.metric != "dot":
            x = np.hstack([2.0 * x, np.full((len(x), 1), -1.0)]) if query else np.hstack([x, (x**2).sum(axis=1, keepdims=True)])
        return x.astype(np.float32)

    def add(self, ids: pa.Array, v: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Compares vectors with the queries, or with those in rows, which are in order."""
        if len(v) and len(self.q) and self.q.shape[1] != v.shape[1]:
            raise ValueError(f"queries have {self.q.shape[1]} dimensions, the store {v.shape[1]}")
        rows = np.arange(len(self.q)) if rows is None else rows
        for lo in range(0, len(v) if len(rows) else 0, self.block):
            part = v[lo : lo + self.block].astype(np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                single = None if self.at is None else self._single(part, False)
            far = None if single is None else float(np.linalg.norm(single.astype(np.float64), axis=1).max())
            for at in range(0, len(rows), ROWS):
                some = rows[at : at + ROWS]
                if far is not None and far < 1e30 and self.size[some].max() < 1e7 * 1e30 / max(far, 1e7):
                    self._some(some, ids, part, lo, single, far)
                else:
                    self._all(some, ids, part, lo)

    def _some(self, some: np.ndarray, ids: pa.Array, part: np.ndarray, lo: int, single: np.ndarray, far: float) -> None:
        m, n = len(part), len(some)
        if self.room is None or self.room[0].size < n * m:
            self.room = np.empty(max(n, min(ROWS, len(self.q))) * m, np.float32), np.empty(max(n, min(ROWS, len(self.q))) * m, bool)
        product, mask = (x[: n * m].reshape(n, m) for x in self.room)
        np.matmul(self.at[some], single.T, out=product)
        # the error of a sum of as many products, each less than what the sizes give, and of its factors' rounding
        slack = (single.shape[1] + 8) * 2.0**-22 * self.size[some] * far
        bound = self.reach[some] + self.own[some] - slack
        np.greater_equal(product, bound.astype(np.float32)[:, None], out=mask)
        # hits are counted before they are looked up: at first most pairs are
        if m > self.k and np.count_nonzero(mask) > 4 * self.k * n:
            # k vectors of this part reach the k-th product: what is under it by more than the errors is not among the best
            nth = np.partition(product, m - self.k, axis=1)[:, m - self.k].astype(np.float64) - slack
            self.reach[some] = np.maximum(self.reach[some], _reach(self.metric, _score(self.metric, nth - self.own[some])))
            bound = self.reach[some] + self.own[some] - slack
            np.greater_equal(product, bound.astype(np.float32)[:, None], out=mask)
        hits = _places(mask)
        step = max(1, NUMBERS // part.shape[1])
        for i in range(0, len(hits), step):
            row, col = np.divmod(hits[i : i + step], m)
            row = some[row]
            self._keep(row, ids, lo, col, np.round(_each(self.metric, self.q[row], part[col]), 12))

    def _all(self, some: np.ndarray, ids: pa.Array, part: np.ndarray, lo: int) -> None:
        got = np.round(scores(self.metric, self.q[some], part), 12)
        row, col = np.nonzero(got >= self.least[some][:, None])
        self._keep(some[row], ids, lo, col, got[row, col])

    def _keep(self, row: np.ndarray, ids: pa.Array, lo: int, col: np.ndarray, value: np.ndarray) -> None:
        keep = value >= self.least[row]
        if self.above is not None:
            keep &= value > self.above
        if self.min_score is not None:
            keep &= value >= self.min_score
        if not keep.all():
            row, col, value = row[keep], col[keep], value[keep]
        for n in range(row[0] // self.slice, row[-1] // self.slice + 1) if len(row) else []:
            at, end = np.searchsorted(row, (n * self.slice, (n + 1) * self.slice))
            if at == end:
                continue
            self.left[n].append((row[at:end], ids.take(pa.array(col[at:end] + lo)), value[at:end]))
            self.held[n] += int(end - at)
            if self.held[n] > max(4 * self.k * min(self.slice, len(self.q)), 1 << 15) or len(self.left[n]) > 1024:
                self._merge(n)

    def _merge(self, n: int) -> None:
        """Keeps the best k of each query of a slice of what is left so far."""
        row, ids, value = np.concatenate([x[0] for x in self.left[n]]), pa.concat_arrays([x[1] for x in self.left[n]]), np.concatenate([x[2] for x in self.left[n]])
        by_id = pc.array_sort_indices(ids, null_placement="at_start").to_numpy().astype(np.int64)
        ranked = by_id[np.lexsort((-value[by_id], row[by_id]))]
        nth = np.arange(len(row)) - np.searchsorted(row[ranked], row[ranked])
        last = ranked[nth == self.k - 1]
        self.least[row[last]] = np.maximum(self.least[row[last]], value[last])
        own = slice(n * self.slice, (n + 1) * self.slice)
        self.reach[own] = np.maximum(self.reach[own], _reach(self.metric, self.least[own]))
        keep = ranked[nth < self.k]
        self.left[n] = [(row[keep], ids.take(pa.array(keep)), value[keep])]
        self.held[n] = len(keep)

    def rows(self, keys: pa.Array) -> pa.RecordBatch | None:
        """``query_id, id, score``, unless there are none."""
        for n, held in enumerate(self.held):
            if held:
                self._merge(n)
        left = [x for part in self.left for x in part]
        if not left:
            return None
        row, ids, value = np.concatenate([x[0] for x in left]), pa.concat_arrays([x[1] for x in left]), np.concatenate([x[2] for x in left])
        return pa.RecordBatch.from_arrays([keys.take(pa.array(row)), ids, pa.array(value)], ["query_id", "id", "score"])


class Cells:
    """Which queries are compared with a cell: those that have it among their nearest."""

    def __init__(self, q: np.ndarray, centres: np.ndarray, nearest: int) -> None:
        self.n, self.bits = len(q), np.zeros((len(centres), (len(q) + 7) // 8), np.uint8)
        # whole bytes of queries at a time
        step = max(8, NUMBERS // len(centres) // 8 * 8)
        for lo in range(0, len(q), step):
            near = -(q[lo : lo + step] @ centres.T)
            cells = np.argpartition(near, nearest - 1, axis=1)[:, :nearest] if nearest < len(centres) else np.tile(np.arange(len(centres)), (len(near), 1))
            mask = np.zeros((len(centres), len(near)), bool)
            mask[cells.ravel(), np.repeat(np.arange(len(near)), nearest)] = True
            self.bits[:, lo // 8 : lo // 8 + (len(near) + 7) // 8] = np.packbits(mask, axis=1)

    def of(self, cell: int) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self.bits[cell], count=self.n))


def _dense(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _add(best: Best, cells: Cells | None, cell: np.ndarray | None, ids: pa.Array, v: np.ndarray) -> None:
    """A batch of vectors, in the order of its cells if there are any."""
    if cells is None:
        best.add(ids, v)
        return
    order = np.argsort(cell, kind="stable")
    edges = np.flatnonzero(np.diff(cell[order])) + 1
    for own in np.split(order, edges) if len(order) else []:
        best.add(ids.take(pa.array(own)), v[own], cells.of(int(cell[own[0]])))


def _native(df: DataFrame, vector: str) -> str:
    kind = df.schema[vector].dataType
    return "array<float>" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "array<double>"


def _search_held(rows: DataFrame, asked: DataFrame, schema: T.StructType, options: tuple, centres: Any, nearest: int) -> DataFrame:
    """Every task has the queries and goes through its part of the store."""
    held = asked.toArrow().combine_chunks()
    keys = held.column("query_id").combine_chunks()
    shared = rows.sparkSession.sparkContext.broadcast((keys, _dense(held.column("qvec").combine_chunks())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, q = shared.value
        best, cells = None, None
        for batch in batches:
            if not len(keys) or not batch.num_rows:
                continue
            if best is None:
                best, cells = Best(options[0], q, *options[1:]), centres and Cells(q, centres.value, nearest)
            _add(best, cells, batch.column("cell").to_numpy() if cells else None, batch.column("id"), _dense(batch.column("v")))
        if best is not None and (out := best.rows(keys)) is not None:
            yield out

    return rows.mapInArrow(run, schema)


def _search_groups(rows: DataFrame, asked: DataFrame, schema: T.StructType, options: tuple, centres: Any, nearest: int, groups: int, parts: int) -> DataFrame:
    """A task has a group of the queries and goes through a part of the store; its queries come first."""
    kind = "array<float>" if _native(asked, "qvec") == _native(rows, "v") == "array<float>" else "array<double>"
    vector = lambda c: F.col(c).cast(kind).alias("v")
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    group, part = F.pmod(F.xxhash64("query_id", "qvec"), F.lit(groups)).cast("int"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    left = asked.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: group * parts + i)).alias("task"), F.lit(-1).alias("cell"), "query_id", none(rows, "id"), vector("qvec"))
    right = rows.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda i: i * parts + part)).alias("task"), "cell" if centres else F.lit(0).alias("cell"), none(asked, "query_id"), "id", vector("v"))
    dealt = left.union(right).repartitionById(groups * parts, "task").sortWithinPartitions("task", "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, best, cells = -1, None, None
        held: list[tuple[pa.Array, np.ndarray]] = []
        keys: pa.Array | None = None
        for batch in batches:
            tasks = batch.column("task").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(tasks)) + 1).tolist(), len(tasks)]
            for lo, hi in zip(edges, edges[1:]) if len(tasks) else []:
                if tasks[lo] != task:
                    if best is not None and (out := best.rows(keys)) is not None:
                        yield out
                    task, best, held = tasks[lo], None, []
                own = batch.slice(lo, hi - lo)
                cell = own.column("cell").to_numpy()
                first = int(np.searchsorted(cell, 0))
                if first:
                    held.append((own.column("query_id").slice(0, first), _dense(own.column("v").slice(0, first))))
                if first == len(cell) or not (held or best):
                    continue
                if best is None:
                    keys, q = pa.concat_arrays([x[0] for x in held]), np.concatenate([x[1] for x in held])
                    best, cells, held = Best(options[0], q, *options[1:]), centres and Cells(q, centres.value, nearest), []
                _add(best, cells, cell[first:] if cells else None, own.column("id").slice(first), _dense(own.column("v").slice(first)))
        if best is not None and (out := best.rows(keys)) is not None:
            yield out

    return dealt.mapInArrow(run, schema)


def _dealt(least: int, slots: int) -> tuple[int, int]:
    """Groups, at least so many, and parts: twice as many tasks as run at once or more, so that the last round of tasks is nearly full."""
    groups = max(least, isqrt(2 * slots), 1)
    parts = ceil(2 * slots / groups)
    return ceil(groups * parts / slots) * slots // parts, parts


def nearest_rows(
    rows: DataFrame, queries: DataFrame, k: int, metric: str, min_score: float | None, above: float | None, block: int, query_bytes: int, group: int | None = None, centres: np.ndarray | None = None, nearest: int = 0,
) -> DataFrame:
    """Search over ``id, v`` without nulls; with centres also ``cell``, and a query meets its nearest cells only. ``group``: queries a task has at most."""
    schema = T.StructType([*queries.select("query_id").schema, *rows.select("id").schema]).add("score", "double")
    asked = queries.where("qvec is not null").select("query_id", F.col("qvec").cast(_native(queries, "qvec")).alias("qvec"))
    small = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("qvec").cast("long")), F.lit(0)).alias("numbers")).first()
    n, numbers, options = small["n"], small["numbers"], (metric, k, min_score, above, block)
    context = rows.sparkSession.sparkContext
    shared = None if centres is None else context.broadcast(centres)
    if numbers * 8 + n * k * 48 <= query_bytes and n <= (group or n):
        found = _search_held(rows, asked, schema, options, shared, nearest)
    else:
        least = max(ceil((numbers * 16 + n * k * 128) / GROUP_BYTES), ceil(n / (group or n)) if n else 1)
        found = _search_groups(rows, asked, schema, options, shared, nearest, *_dealt(least, context.defaultParallelism))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def search(
    store: DataFrame, queries: DataFrame, k: int = 5, metric: str = "cosine", min_score: float | None = None, above: float | None = 0.0,
    where: filters.Condition | filters.Group | Mapping[str, Any] | None = None, block: int = BLOCK, query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """``query_id, rank, id, score``: the k best of the store for every query.

    The filter comes first.  ``above`` drops scores that aren't greater (None: keeps
    all), ``min_score`` those that are less.
    """
    if metric not in V.METRICS:
        raise ValueError(f"unknown metric {metric!r}; there are {', '.join(V.METRICS)}")
    if k < 1:
        raise ValueError("k must be positive")
    kept = filters.apply_filter(store, where).where("embedding is not null")
    rows = kept.select("id", F.col("embedding").cast(_native(store, "embedding")).alias("v"))
    return nearest_rows(rows, queries, k, metric, min_score, above, block, query_bytes)


def upsert(store: DataFrame, changes: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The store with the last change of each key in place of its row; both are read once."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    last = changes.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", order)
    return store.join(last.select(key), key, "left_anti").unionByName(last.select(store.columns))


def delete(store: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Without the rows of those keys; keys that aren't there do no harm."""
    return store.join(ids.select(key).distinct(), key, "left_anti")


def clear(store: DataFrame) -> DataFrame:
    return store.where(F.lit(False))


def size(store: DataFrame) -> DataFrame:
    return store.agg(F.count(F.lit(1)).alias("n"))


def fail_at(df: DataFrame, key: str, rate: float) -> DataFrame:
    """Marks ``ok`` false for that share of the keys, by hash: a repeatable fault for tests of resilience."""
    return df.withColumn("ok", F.pmod(F.xxhash64(key), F.lit(10_000)) >= int(rate * 10_000))
