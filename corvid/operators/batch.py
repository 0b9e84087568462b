"""Batches, rate limits, retries and circuit breaking, with a row for every outcome."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout
from dataclasses import dataclass
from typing import Any, TypeVar

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

R = TypeVar("R")


class EngineError(Exception):
    """Root of the engine's errors; ``kind`` names the step that failed."""

    kind = "engine"


class EmbeddingError(EngineError):
    kind = "embedding"


class StoreError(EngineError):
    kind = "store"


class GenerationError(EngineError):
    kind = "generation"


class ExtractionError(EngineError):
    kind = "extraction"


class ChunkingError(EngineError):
    kind = "chunking"


class RerankError(EngineError):
    kind = "rerank"


class TimedOut(EngineError):
    kind = "timeout"


class RateLimited(EngineError):
    kind = "rate_limit"


class BreakerOpen(EngineError):
    kind = "breaker"


MESSAGES = {
    "embedding": "The question could not be embedded.", "store": "The documents could not be searched.", "generation": "No answer could be generated.", "timeout": "The request took too long.",
    "rate_limit": "There are too many requests now.", "breaker": "The service is not available now.",
}


def error_answer(error_type: Column) -> Column:
    """What a failed row says instead of an answer."""
    out = F.when(F.lit(False), F.lit(""))
    for kind, text in MESSAGES.items():
        out = out.when(error_type == kind, F.lit(text))
    return out.when(error_type.isNotNull(), F.lit("The request failed."))


def batch_ids(df: DataFrame, order: str, size: int = 20) -> DataFrame:
    """``batch`` and ``place`` of each row in the order of a unique key.

    Ranks come from counts by range partition: no single task sorts the whole table.
    """
    if size < 1:
        raise ValueError("a batch has a row at least")
    spark = df.sparkSession
    ranged = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__part", F.spark_partition_id())
    from corvid.storage import cut

    held = cut(ranged, "batches")
    # a row a partition
    counts = held.groupBy("__part").count().toPandas().sort_values("__part")
    firsts = counts["count"].cumsum() - counts["count"]
    offsets = spark.createDataFrame([(int(p), int(f)) for p, f in zip(counts["__part"], firsts)], "__part int, __first long")
    w = Window.partitionBy("__part").orderBy(order)
    at = F.col("__first") + F.row_number().over(w) - 1
    return held.join(F.broadcast(offsets), "__part").withColumn("__at", at).withColumn("batch", F.floor(F.col("__at") / size)).withColumn("place", F.col("__at") % size).drop("__part", "__first", "__at")


def by_priority(df: DataFrame, priority: Column, key: str) -> DataFrame:
    """In the order of launch: greatest priority first, then the key."""
    return df.orderBy(priority.desc(), key)


class RateLimiter:
    """At most so many calls a minute in this process, evenly spaced."""

    def __init__(self, per_minute: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.gap, self.clock, self.sleep, self.next = 60.0 / per_minute, clock, sleep, 0.0

    def wait(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
            now = self.next
        self.next = now + self.gap


@dataclass(frozen=True)
class Retry:
    """Attempts in all, and the pause before the next: ``first * factor ** i`` with jitter, up to ``most`` seconds."""

    attempts: int = 3
    first: float = 0.1
    factor: float = 2.0
    most: float = 10.0
    jitter: float = 0.1

    def pause(self, i: int, rng: random.Random) -> float:
        return min(self.most, self.first * self.factor**i) * (1 + self.jitter * (2 * rng.random() - 1))


def with_retry(call: Callable[[], R], retry: Retry = Retry(), on: tuple[type[BaseException], ...] = (Exception,), sleep: Callable[[float], None] = time.sleep) -> R:
    """The call's result; the last error once the attempts are used up."""
    rng = random.Random(0)
    for i in range(retry.attempts):
        try:
            return call()
        except on:
            if i + 1 == retry.attempts:
                raise
            sleep(retry.pause(i, rng))
    raise ValueError("there must be an attempt at least")


def with_fallback(primary: Callable[[], R], fallback: Callable[[Exception], R]) -> R:
    try:
        return primary()
    except Exception as e:  # noqa: BLE001 - any failure of the first is the second's turn
        return fallback(e)


def first_result(*results: Column) -> Column:
    """The same for columns: the first that isn't null."""
    return F.coalesce(*results)


class CircuitBreaker:
    """Closed, until ``failures`` in a row open it; after ``reset`` seconds half open, and closed again after ``successes``.

    ``cumulative`` keeps the count of failures over a success while closed.
    """

    def __init__(self, failures: int = 5, reset: float = 60.0, successes: int = 2, cumulative: bool = False, clock: Callable[[], float] = time.monotonic) -> None:
        self.failures, self.reset_s, self.successes, self.cumulative, self.clock = failures, reset, successes, cumulative, clock
        self.state, self.failed, self.succeeded, self.opened = "closed", 0, 0, 0.0

    def allows(self) -> bool:
        if self.state == "open" and self.clock() - self.opened >= self.reset_s:
            self.state, self.succeeded = "half_open", 0
        return self.state != "open"

    def record(self, ok: bool) -> None:
        if ok:
            if self.state == "half_open":
                self.succeeded += 1
                if self.succeeded >= self.successes:
                    self.state, self.failed = "closed", 0
            elif not self.cumulative:
                self.failed = 0
            return
        self.failed += 1
        if self.state == "half_open" or self.failed >= self.failures:
            self.state, self.opened = "open", self.clock()

    def call(self, f: Callable[[], R]) -> R:
        if not self.allows():
            raise BreakerOpen("the breaker is open")
        try:
            out = f()
        except Exception:
            self.record(False)
            raise
        self.record(True)
        return out


_OUTCOME = (T.StructField("result", T.StringType()), T.StructField("ok", T.BooleanType()), T.StructField("error", T.StringType()), T.StructField("error_type", T.StringType()))


def _kind(e: BaseException) -> str:
    return getattr(e, "kind", type(e).__name__)


def in_time(call: Callable[[], R], seconds: float | None) -> R:
    """The call's result, or ``TimedOut`` after so many seconds; the call itself isn't stopped, its result is dropped."""
    if seconds is None:
        return call()
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(call).result(seconds)
    except FutureTimeout as e:
        raise TimedOut(f"no result within {seconds:g} s") from e
    finally:
        pool.shutdown(wait=False)


def process(
    df: DataFrame, f: Callable[[list[Any]], list[str | None]], column: str, size: int = 20, retry: Retry = Retry(), per_minute: float | None = None, breaker: bool = False, timeout: float | None = None, tasks: int | None = None,
) -> DataFrame:
    """The rows with ``result, ok, error, error_type``: f is called for ``size`` values at a time in each task.

    A batch that fails after its attempts, or isn't there in time, leaves rows with the
    error; nothing is lost and the job goes on.  The breaker is per task.  ``per_minute``
    is the rate of the whole job: the rows are dealt to ``tasks`` (by default as many as
    the session runs at a time) and each of them keeps an equal share of it.
    """
    if per_minute is not None:
        tasks = tasks or max(1, df.sparkSession.sparkContext.defaultParallelism)
        df, per_minute = df.repartition(tasks), per_minute / tasks

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limiter = RateLimiter(per_minute) if per_minute else None
        guard = CircuitBreaker() if breaker else None
        for pdf in batches:
            for lo in range(0, len(pdf), size):
                part = pdf.iloc[lo : lo + size]
                values = part[column].tolist()

                def once(values: list[Any] = values) -> list[str | None]:
                    if limiter:
                        limiter.wait()
                    return in_time(lambda: f(values), timeout)

                def call(once: Callable[[], list[str | None]] = once) -> list[str | None]:
                    return with_retry(once, retry)

                try:
                    got = guard.call(call) if guard else call()
                    yield part.assign(result=got, ok=True, error=None, error_type=None)
                except Exception as e:  # noqa: BLE001 - becomes a row
                    yield part.assign(result=None, ok=False, error=str(e), error_type=_kind(e))

    return df.mapInPandas(run, T.StructType([*df.schema, *_OUTCOME]))


class AdaptiveConcurrency:
    """How many calls run at a time: more after a batch that went well, fewer after failures."""

    def __init__(self, start: int = 4, least: int = 1, most: int = 16, factor: float = 0.5) -> None:
        if not 1 <= least <= start <= most:
            raise ValueError("least <= start <= most must hold")
        self.now, self.least, self.most, self.factor = start, least, most, factor

    def record(self, succeeded: int, failed: int) -> int:
        """By the batch's success rate: unchanged at a half, by ``factor`` up at 1 and down at 0."""
        if succeeded + failed:
            rate = succeeded / (succeeded + failed)
            change = (rate - 0.5) * 2 * self.factor * self.now
            self.now = min(self.most, max(self.least, self.now + (max(1, round(change)) if change > 0 else min(-1, round(change)) if change < 0 else 0)))
        return self.now


def process_items(
    df: DataFrame, f: Callable[[Any], str | None], column: str, size: int = 10, retry: Retry = Retry(), timeout: float | None = None, concurrency: int | AdaptiveConcurrency = 4,
) -> DataFrame:
    """The rows with ``result, ok, error, error_type, attempts``: f is called for one value at a time.

    Each value has attempts and an outcome of its own, so one that fails takes no other
    with it.  ``concurrency`` calls run at a time in a task; an adaptive one is changed
    after every ``size`` values by how many of them failed.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a task has its own copy
        adapt = replace_concurrency(concurrency)
        with ThreadPoolExecutor(adapt.most) as pool:
            for pdf in batches:
                lo = 0
                while lo < len(pdf):
                    part = pdf.iloc[lo : lo + size]
                    rows: list[tuple[Any, ...]] = []
                    values = part[column].tolist()
                    for at in range(0, len(values), adapt.now):
                        rows += pool.map(one, values[at : at + adapt.now])
                    failed = sum(not r[1] for r in rows)
                    adapt.record(len(rows) - failed, failed)
                    yield part.assign(**{n: pd.Series([r[i] for r in rows], index=part.index, dtype=object if i != 4 else "int64") for i, n in enumerate(("result", "ok", "error", "error_type", "attempts"))})
                    lo += size

    def one(value: Any) -> tuple[Any, ...]:
        tries = 0

        def call() -> str | None:
            nonlocal tries
            tries += 1
            return in_time(lambda: f(value), timeout)

        try:
            return with_retry(call, retry), True, None, None, tries
        except Exception as e:  # noqa: BLE001 - becomes a row
            return None, False, str(e), _kind(e), tries

    return df.mapInPandas(run, T.StructType([*df.schema, *_OUTCOME, T.StructField("attempts", T.LongType())]))


def replace_concurrency(given: int | AdaptiveConcurrency) -> AdaptiveConcurrency:
    """A fresh one; a number stays as it is."""
    if isinstance(given, AdaptiveConcurrency):
        return AdaptiveConcurrency(given.now, given.least, given.most, given.factor)
    return AdaptiveConcurrency(given, given, given)


def retry_failed(done: DataFrame, again: Callable[[DataFrame], DataFrame], rounds: int = 2) -> DataFrame:
    """The outcomes after failed rows ran again, as jobs of their own: rows that succeeded aren't called again.

    ``done`` is what :func:`process` or :func:`process_items` gave; ``again`` does it once
    more for the rows without their outcome.
    """
    outcome = {"result", "ok", "error", "error_type", "attempts"}
    from corvid.storage import cut

    done = cut(done, "outcomes")
    for _ in range(rounds):
        failed = done.where("not ok")
        if failed.isEmpty():
            break
        done = cut(done.where("ok").unionByName(again(failed.drop(*outcome))), "outcomes")
    return done


def breaker_states(events: DataFrame, key: str, order: list[str], failed: str, failures: int = 5, successes: int = 2, reset_s: float = 60.0, at: str = "ts") -> DataFrame:
    """``key`` with the breaker's final ``state`` and how often it ``opened``, replayed over each key's events in order.

    A key's events are one group in one task: replay is sequential by its nature.
    """

    def replay(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        clock = [0.0]
        guard = CircuitBreaker(failures, reset_s, successes, clock=lambda: clock[0])
        opened = skipped = 0
        for t, bad in zip(group[at], group[failed]):
            clock[0] = t.timestamp()
            if not guard.allows():
                skipped += 1
                continue
            before = guard.state
            guard.record(not bad)
            opened += guard.state == "open" and before != "open"
        return pd.DataFrame({key: [group[key].iloc[0]], "state": [guard.state], "opened": [opened], "skipped": [skipped]})

    schema = events.select(key).schema.add("state", "string").add("opened", "long").add("skipped", "long")
    return events.select(*dict.fromkeys([key, *order, failed, at])).groupBy(key).applyInPandas(replay, schema)
