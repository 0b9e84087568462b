"""Reuse of embeddings by content hash, kept as a table; retention by last access; levels with promotion."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Hashable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvid.operators.embedding import Embed, embed
from corvid.storage import cut


def key_of(content: Column) -> Column:
    return F.sha2(content, 256)


def embed_cached(texts: DataFrame, cache: DataFrame, provider: Embed, dim: int, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """The rows with ``embedding``, and the new rows ``key, embedding`` for the cache.

    Every distinct text that the cache lacks is embedded once, however often it occurs
    and however often the result is used: new vectors are written before they are joined.
    """
    keyed = texts.withColumn("key", key_of(F.col(content)))
    missing = keyed.join(cache.select("key"), "key", "left_anti").groupBy("key").agg(F.any_value(content).alias(content))
    new = cut(embed(missing, provider, dim, content).select("key", "embedding"), "embedded")
    return keyed.join(cache.select("key", "embedding").unionByName(new), "key", "left").drop("key"), new


def hits(texts: DataFrame, cache_keys: DataFrame, content: str = "content") -> DataFrame:
    """``hits, misses, hit_rate`` of the texts against a cache."""
    keyed = texts.select(key_of(F.col(content)).alias("key"))
    found = keyed.join(cache_keys.select("key").distinct().withColumn("hit", F.lit(True)), "key", "left")
    n = found.agg(F.count_if("hit").alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"))
    return n.withColumn("hit_rate", F.coalesce(F.try_divide("hits", F.col("hits") + F.col("misses")), F.lit(0.0)))


def retained(accesses: DataFrame, capacity: int, key: str = "key", at: str = "ts", tie: str = "event_id") -> DataFrame:
    """The ``capacity`` keys that were used last, as a cache of that size keeps them."""
    last = accesses.groupBy(key).agg(F.max(F.struct(at, tie)).alias("last"))
    return last.orderBy(F.desc("last"), key).limit(capacity).select(key)


def level_stats(stats: DataFrame) -> DataFrame:
    """Several levels as one: hits add up, misses are those of the last level."""
    return stats.agg(F.sum("hits").alias("hits"), F.min_by("misses", -F.col("level")).alias("misses")).withColumn("hit_rate", F.coalesce(F.try_divide("hits", F.col("hits") + F.col("misses")), F.lit(0.0)))


def read_through(levels: list[DataFrame], keys: DataFrame) -> DataFrame:
    """``key, level, embedding``: each key from the first level that has it; null where none has."""
    every = None
    for i, t in enumerate(levels):
        part = t.select("key", F.lit(i).alias("level"), "embedding")
        every = part if every is None else every.unionByName(part)
    w = Window.partitionBy("key").orderBy("level")
    first = every.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return keys.select("key").distinct().join(first, "key", "left")


@dataclass
class Stats:
    hits: int = 0
    misses: int = 0

    @property
    def hit_rate(self) -> float:
        asked = self.hits + self.misses
        return self.hits / asked if asked else 0.0


class LruCache:
    """Keys and values of this process; at capacity the one used longest ago goes."""

    def __init__(self, capacity: int = 1000) -> None:
        if capacity < 1:
            raise ValueError("a cache holds an entry at least")
        self.capacity, self.stats = capacity, Stats()
        self._held: OrderedDict[Hashable, Any] = OrderedDict()

    def get(self, key: Hashable) -> Any | None:
        if key not in self._held:
            self.stats.misses += 1
            return None
        self.stats.hits += 1
        self._held.move_to_end(key)
        return self._held[key]

    def put(self, key: Hashable, value: Any) -> None:
        self._held[key] = value
        self._held.move_to_end(key)
        if len(self._held) > self.capacity:
            self._held.popitem(last=False)

    def get_all(self, keys: Sequence[Hashable]) -> dict[Hashable, Any]:
        return {k: v for k in keys if (v := self.get(k)) is not None}

    def put_all(self, entries: dict[Hashable, Any]) -> None:
        for k, v in entries.items():
            self.put(k, v)

    def clear(self) -> None:
        self._held.clear()
        self.stats = Stats()

    def __len__(self) -> int:
        return len(self._held)

    def __contains__(self, key: Hashable) -> bool:
        return key in self._held


class LayeredCache:
    """Caches in the order in which they are asked: a hit goes to all before it, a new value to all."""

    def __init__(self, *levels: LruCache) -> None:
        self.levels = levels

    def get(self, key: Hashable) -> Any | None:
        for i, level in enumerate(self.levels):
            if (value := level.get(key)) is not None:
                for before in self.levels[:i]:
                    before.put(key, value)
                return value
        return None

    def put(self, key: Hashable, value: Any) -> None:
        for level in self.levels:
            level.put(key, value)

    def clear(self) -> None:
        for level in self.levels:
            level.clear()

    @property
    def stats(self) -> Stats:
        """Hits of all levels, and the misses of the last."""
        return Stats(sum(x.stats.hits for x in self.levels), self.levels[-1].stats.misses if self.levels else 0)


class TableCache:
    """Embeddings by content hash as a Parquet table at a path: one folder a batch, so what is there is never rewritten."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.stats = spark, path.rstrip("/"), Stats()

    def table(self) -> DataFrame:
        """``key, embedding``, one row a key."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], "key string, embedding array<float>")
        return self.spark.read.option("recursiveFileLookup", "true").parquet(self.path).dropDuplicates(["key"])

    def put(self, new: DataFrame) -> None:
        new.select("key", "embedding").write.mode("append").parquet(self.path)

    def embedded(self, texts: DataFrame, provider: Embed, dim: int, content: str = "content") -> DataFrame:
        """The rows with ``embedding``; what the table lacks is embedded once and put into it."""
        out, new = embed_cached(texts, self.table(), provider, dim, content)
        missed = new.count()
        if missed:
            self.put(new)
        self.stats.misses += missed
        self.stats.hits += texts.select(key_of(F.col(content))).distinct().count() - missed
        return out

    def clear(self) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        self.stats = Stats()


def promote(levels: list[DataFrame], asked: DataFrame) -> list[DataFrame]:
    """The levels' tables after a read of those keys: each hit is in every level before its own too."""
    found = read_through(levels, asked).where("level is not null")
    return [t.select("key", "embedding").unionByName(found.where(F.col("level") > i).select("key", "embedding")) for i, t in enumerate(levels)]
