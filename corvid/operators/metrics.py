"""Metrics over a table of samples ``name, value, ts``, and a small registry for the driver's own."""

from __future__ import annotations

import math
import threading
import time
from collections import defaultdict
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERCENTS = (50, 90, 95, 99)


def counters(samples: DataFrame, key: str = "name") -> DataFrame:
    return samples.groupBy(key).agg(F.sum("value").alias("total"))


def gauges(samples: DataFrame, key: str = "name", tie: str = "event_id") -> DataFrame:
    """The last value of each; of one time the greatest ``tie``."""
    return samples.groupBy(key).agg(F.max_by("value", F.struct("ts", tie)).alias("last"))


def timers(samples: DataFrame, key: str = "name", percents: Sequence[int] = PERCENTS) -> DataFrame:
    """``count, min, max, mean`` and for each percent the value at ``floor(p / 100 * (n - 1))`` of the sorted ones.

    Equal values are counted first, which tasks begin before the shuffle; what is cumulated
    and searched is one row a distinct value, and no list of a key's values is held.
    """
    found = samples.where("value is not null").groupBy(key, "value").agg(F.count(F.lit(1)).alias("__k"))
    w = Window.partitionBy(key)
    ranked = found.withColumn("__upto", F.sum("__k").over(w.orderBy("value"))).withColumn("__n", F.sum("__k").over(w))
    place = lambda p: F.floor(F.lit(p) * (F.col("__n") - 1) / F.lit(100))
    # the least value with more than so many at or under it
    wanted: list[Column] = [F.min(F.when(F.col("__upto") > place(p), F.col("value"))).alias(f"p{p}") for p in percents]
    mean = F.sum(F.col("value") * F.col("__k")) / F.sum("__k")
    return ranked.groupBy(key).agg(F.sum("__k").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), mean.alias("mean"), *wanted)


def windowed(samples: DataFrame, width: str = "1 hour", key: str = "name") -> DataFrame:
    """Counts and sums by event time; works on streams as on tables."""
    return samples.groupBy(F.window("ts", width), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def report(stats: DataFrame, key: str = "name") -> DataFrame:
    """One text line a metric."""
    line = F.format_string("%s: n=%d min=%.3f max=%.3f mean=%.3f p50=%.3f p90=%.3f p95=%.3f p99=%.3f", key, "n", *(F.col(c).cast("double") for c in ("min", "max", "mean", "p50", "p90", "p95", "p99")))
    return stats.select(key, line.alias("line"))


class Metrics:
    """Counters, gauges, timers and histograms of this process."""

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self.reset()

    def reset(self) -> None:
        with self._lock:
            self.counts: dict[str, int] = defaultdict(int)
            self.values: dict[str, float] = {}
            self.samples: dict[str, list[float]] = defaultdict(list)

    def count(self, name: str, by: int = 1) -> None:
        with self._lock:
            self.counts[name] += by

    def gauge(self, name: str, value: float) -> None:
        with self._lock:
            self.values[name] = value

    def record(self, name: str, value: float) -> None:
        with self._lock:
            self.samples[name].append(value)

    @contextmanager
    def time(self, name: str) -> Iterator[None]:
        """Records milliseconds, also if the body raises."""
        began = time.perf_counter()
        try:
            yield
        finally:
            self.record(name, (time.perf_counter() - began) * 1000)

    def stats(self, name: str) -> dict[str, float] | None:
        x = sorted(self.samples.get(name, ()))
        if not x:
            return None
        return {"count": len(x), "min": x[0], "max": x[-1], "mean": math.fsum(x) / len(x)} | {f"p{p}": x[p * (len(x) - 1) // 100] for p in PERCENTS}

    def report(self) -> str:
        lines = [f"{k}: {v}" for k, v in sorted(self.counts.items())] + [f"{k}: {v}" for k, v in sorted(self.values.items())]
        lines += [f"{k}: " + ", ".join(f"{a}={b:g}" for a, b in (self.stats(k) or {}).items()) for k in sorted(self.samples)]
        return "\n".join(lines)


METRICS = Metrics()


def observed(df: DataFrame, name: str, **columns: Column) -> tuple[DataFrame, object]:
    """The frame with metrics taken while it runs, and what holds them afterwards."""
    from pyspark.sql import Observation

    held = Observation(name)
    return df.observe(held, *(c.alias(k) for k, c in columns.items())), held


def union_samples(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
