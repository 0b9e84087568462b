"""Connected components of a table of links, by large and small stars.

Each round writes the links to the shared folder, so that neither lineage nor a
lost executor grows the work; the rounds end when the links no longer change,
after about the logarithm of the longest chain.

A node's least neighbour is an aggregate, which tasks begin before the shuffle, and is
joined back to the node's links: a hub with a large part of all links is a long run of
rows in a join, which adaptive execution splits, and no task holds or sorts it alone.

Defined results: null ends, links of a node to itself and repeated links count for
nothing; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.storage import cut, drop


def _least(adjacent: DataFrame) -> DataFrame:
    """Each row (n, v) with m, the least of n and all its v."""
    least = adjacent.groupBy("n").agg(F.min("v").alias("m"))
    return adjacent.join(least.hint("merge"), "n").select("n", "v", F.least("n", "m").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every linked node that isn't its component's least; links: two long columns a and b."""
    now = cut(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct(), "links")
    mark = None
    while True:
        both = now.select(F.col("v").alias("n"), F.col("m").alias("v")).unionByName(now.select(F.col("m").alias("n"), "v"))
        large = _least(both).where("v > n").select("v", "m")
        down = large.where("v <> m").select(F.col("v").alias("n"), F.col("m").alias("v")).distinct()
        small = _least(down)
        new = cut(small.select("v", "m").unionByName(small.select(F.col("n").alias("v"), "m")).where("v <> m").distinct(), "links")
        got = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        drop(now)
        now = new
        if got == mark:
            return now.select(F.col("v").alias("node"), F.col("m").alias("root"))
        mark = got
