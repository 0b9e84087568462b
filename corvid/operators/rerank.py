"""Rerankers over candidates ``query_id, id, score`` (and ``embedding``, ``qvec`` where they are compared)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Column of similarities to one chosen candidate, from its place and its score.
Similar = Callable[[int, float], np.ndarray]


def _ranked(df: DataFrame, limit: int, threshold: float | None) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    out = df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= limit)
    return out if threshold is None else out.where(F.col("score") >= threshold)


def take(candidates: DataFrame, limit: int = 5, threshold: float | None = None) -> DataFrame:
    """No reranking: the best by score."""
    return _ranked(candidates.select("query_id", "id", "score"), limit, threshold)


def greedy(scores: np.ndarray, limit: int, similar: Similar, value: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[list[int], list[float]]:
    """Places of the chosen and their values; scores come in falling order, and the best is chosen first with its own."""
    chosen, values = [0], [float(scores[0])]
    worst = similar(0, values[0])
    while len(chosen) < min(limit, len(scores)):
        gain = value(scores, worst)
        gain[chosen] = -np.inf
        # ties within rounding go to the better candidate
        best = int(np.argmax(np.round(gain, 9)))
        chosen.append(best)
        values.append(float(gain[best]))
        if len(chosen) < limit:
            worst = np.maximum(worst, similar(best, values[-1]))
    return chosen, values


def _run(candidates: DataFrame, limit: int, vectors: bool, pick: Callable[[np.ndarray, np.ndarray | None], tuple[list[int], list[float]]]) -> DataFrame:
    """A query's candidates are one row, many queries one Arrow batch."""
    fields = [(-F.col("score").cast("double")).alias("neg"), F.col("id").alias("id"), *([F.col("embedding").alias("x")] if vectors else [])]
    rows = candidates.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("c")
            at, held = lists.offsets.to_numpy(), lists.values
            scores, ids = -held.field("neg").to_numpy(), held.field("id")
            row: list[int] = []
            places: list[int] = []
            values: list[float] = []
            ranks: list[int] = []
            for i, (lo, hi) in enumerate(zip(at, at[1:])):
                x = held.field("x").slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(hi - lo, -1) if vectors else None
                chosen, got = pick(scores[lo:hi], x)
                row += [i] * len(chosen)
                places += [int(lo) + c for c in chosen]
                values += got
                ranks += range(1, len(chosen) + 1)
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(row, pa.int64())), ids.take(pa.array(places, pa.int64())), pa.array(scores[places] if places else [], pa.float64()), pa.array(values, pa.float64()), pa.array(ranks, pa.int64())], ["query_id", "id", "score", "mmr_score", "rank"])

    schema = T.StructType([*candidates.select("query_id", "id").schema]).add("score", "double").add("mmr_score", "double").add("rank", "long")
    return rows.mapInArrow(run, schema)


def mmr(candidates: DataFrame, limit: int = 5, weight: float = 0.7) -> DataFrame:
    """Greedy diversification by the candidates' embeddings.

    The best comes first with its own score; then always the one with the greatest
    ``weight * score - (1 - weight) * max(0, most similar of the chosen)``.  Only the
    similarities to chosen ones are computed.
    """

    def pick(scores: np.ndarray, x: np.ndarray | None) -> tuple[list[int], list[float]]:
        size = np.linalg.norm(x, axis=1)
        unit = x / np.where(size > 0, size, 1.0)[:, None]
        return greedy(scores, limit, lambda j, _: np.maximum(0.0, unit @ unit[j]), lambda r, s: weight * r - (1 - weight) * s)

    return _run(candidates, limit, True, pick)


def mmr_by_score(candidates: DataFrame, limit: int = 5, weight: float = 0.7) -> DataFrame:
    """The same without vectors: the product of the scores stands in for similarity."""

    def pick(scores: np.ndarray, _: np.ndarray | None) -> tuple[list[int], list[float]]:
        return greedy(scores, limit, lambda j, chosen: scores * chosen, lambda r, s: weight * r + (1 - weight) * (1 - s))

    return _run(candidates, limit, False, pick)


def cross_encode(candidates: DataFrame, score: Column | None = None, limit: int = 5, threshold: float | None = 0.0) -> DataFrame:
    """Scored anew by a column (such as a pandas UDF over question and text); without one the order stays."""
    df = candidates if score is None else candidates.withColumn("score", score)
    return _ranked(df.select("query_id", "id", "score"), limit, threshold)


def ensemble(candidates: DataFrame, outputs: Sequence[tuple[DataFrame, float]], limit: int = 5, threshold: float | None = 0.0) -> DataFrame:
    """Weighted mean of the rerankers' scores; a candidate that one of them lacks gets 0 there."""
    if not outputs:
        return take(candidates, limit)
    total = sum(w for _, w in outputs)
    every = candidates.select("query_id", "id", F.lit(0.0).alias("part"), F.lit(True).alias("asked"))
    for df, w in outputs:
        every = every.unionByName(df.select("query_id", "id", (F.col("score") * w / total).alias("part"), F.lit(False).alias("asked")))
    # what a reranker adds to the candidates has no row that was asked for
    scored = every.groupBy("query_id", "id").agg(F.sum("part").alias("score"), F.max("asked").alias("asked"))
    return _ranked(scored.where("asked").drop("asked"), limit, threshold)


def boost(candidates: DataFrame, boosts: dict[str, float], limit: int = 5, threshold: float | None = 0.0) -> DataFrame:
    """Scores times the boost of every field that is there, whatever its value."""
    score = F.col("score")
    for field, by in boosts.items():
        there = F.col(field).isNotNull() if field in candidates.columns else F.map_contains_key("metadata", F.lit(field))
        score = score * F.when(there, F.lit(by)).otherwise(F.lit(1.0))
    return _ranked(candidates.select("query_id", "id", score.alias("score")), limit, threshold)


def composite(candidates: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One reranker after another."""
    for step in steps:
        candidates = step(candidates)
    return candidates


def rerank(candidates: DataFrame, strategy: str = "mmr", limit: int = 5, **options: Any) -> DataFrame:
    """By name: none, mmr, mmr_by_score, cross_encoder, ensemble and hierarchical (both as mmr)."""
    if strategy == "none":
        return take(candidates, limit)
    if strategy == "cross_encoder":
        return cross_encode(candidates, limit=limit, **options)
    if strategy in ("mmr", "ensemble", "hierarchical"):
        return (mmr if "embedding" in candidates.columns else mmr_by_score)(candidates, limit, **options)
    if strategy == "mmr_by_score":
        return mmr_by_score(candidates, limit, **options)
    raise ValueError(f"unknown strategy {strategy!r}")
