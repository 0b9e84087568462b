"""Chunking: one row a document in, one row a chunk out.

Strategies are column expressions that give an array of chunk texts, exploded with
their place; only the chunker that optimises over a document's boundaries needs
Python, in Arrow batches.  Input: ``id, content`` and optionally a map ``metadata``.
Output: ``id, parent_id, chunk_index, chunk_count, chunk_strategy, content`` and the
map again where there was one.  Null content gives no chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.functions import vector as V

HEADER = r"(?m)^(?:<h[1-6]>|#{1,6}\s).*$"
SECTION = r"(?m)^(?:[A-Z][A-Za-z\s]+\n[=-]+$|#{1,6}\s.+$)"
SENTENCE_END = r"(?<=[.!?])\s+"
_MARK = "\u0001"


@dataclass(frozen=True)
class Chunking:
    """Sizes are in characters; ``threshold`` is the cosine under which neighbouring paragraphs part."""

    size: int = 500
    overlap: int = 50
    window: int = 500
    stride: int = 250
    min_size: int = 50
    levels: int = 2
    threshold: float = 0.7

    def __post_init__(self) -> None:
        if self.size < 1 or self.window < 1 or self.stride < 1 or self.overlap < 0:
            raise ValueError("sizes and strides must be positive")
        if self.overlap >= self.size:
            raise ValueError("the overlap must be less than the size, or a window never moves on")


def _filled(units: Column) -> Column:
    return F.filter(F.transform(units, lambda u: F.regexp_replace(u, r"^\s+|\s+$", "")), lambda u: u != "")


def merge_units(units: Column, size: int, overlap: int) -> Column:
    """Units joined by blank lines up to about ``size``; a new chunk begins with the end of the one before.

    The fold carries lengths and the places of breaks, never chunks: a chunk's length
    follows from its units' (the end of the one before and two blank lines come first),
    so the finished chunks aren't copied at every unit.  The texts are joined once, in the
    fold's last step, where units and breaks are values and aren't computed again.
    """
    # the least of the overlap and the length before, and the lines after it
    seed = lambda n: F.least(n, F.lit(overlap)) + 2 if overlap else F.lit(0)

    def step(s: Column, u: Column) -> Column:
        full = (s["n"] + F.length(u) > size) & (s["n"] > 0)
        base = F.when(full, seed(s["n"])).otherwise(s["n"])
        n = base + F.when(base > 0, 2).otherwise(0) + F.length(u)
        return F.struct(s["u"].alias("u"), F.when(full, F.array_append(s["breaks"], s["at"])).otherwise(s["breaks"]).alias("breaks"), n.alias("n"), (s["at"] + 1).alias("at"))

    def extend(s: Column, c: Column) -> Column:
        whole = F.when(s["before"] != "", F.concat(F.substring(s["before"], -overlap, overlap), F.lit("\n\n\n\n"), c)).otherwise(c)
        return F.struct(F.array_append(s["done"], whole).alias("done"), whole.alias("before"))

    def finish(s: Column) -> Column:
        begins = F.concat(F.array(F.lit(0)), s["breaks"])
        own = F.transform(begins, lambda b, i: F.array_join(F.slice(s["u"], b + 1, F.coalesce(F.get(s["breaks"], i), F.size(s["u"])) - b), "\n\n"))
        if overlap:
            first = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("before"))
            own = F.aggregate(own, first, extend, lambda x: x["done"])
        return F.when(s["at"] > 0, own).otherwise(F.array().cast("array<string>"))

    def merged(u: Column) -> Column:
        return F.aggregate(u, F.struct(u.alias("u"), F.array().cast("array<int>").alias("breaks"), F.lit(0).alias("n"), F.lit(0).alias("at")), step, finish)

    # bound to a variable, the units are made once
    return F.flatten(F.transform(F.array(units), merged))


def paragraphs(text: Column, c: Chunking) -> Column:
    return merge_units(_filled(F.split(text, r"\n\s*\n")), c.size, c.overlap)


def sentences(text: Column, c: Chunking) -> Column:
    return merge_units(_filled(F.split(text, SENTENCE_END)), c.size, c.overlap)


def sections(text: Column, c: Chunking) -> Column:
    """Between header lines; the header lines themselves are dropped."""
    return merge_units(_filled(F.split(text, HEADER)), c.size, c.overlap)


def windows(text: Column, size: int, step: int) -> Column:
    """Windows of ``size`` every ``step`` characters while one begins inside the text."""
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), F.length(text) - 1, F.lit(step)), lambda i: F.substring(text, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def fixed(text: Column, c: Chunking) -> Column:
    return windows(text, c.size, c.size - c.overlap)


def sliding(text: Column, c: Chunking) -> Column:
    return windows(text, c.window, c.stride)


def fallback(text: Column, c: Chunking) -> Column:
    return windows(text, c.window, c.window)


def nested(text: Column, c: Chunking) -> Column:
    """Sections without their markers, each folded by paragraphs; the overlap repeats the next paragraph's beginning."""

    def fold(section: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

        def step(s: Column, p: Column) -> Column:
            now = s["now"]
            full = (F.length(now) + F.length(p) > c.size) & (now != "")
            base = F.when(full, F.substring(p, 1, c.overlap) if c.overlap else F.lit("")).otherwise(now)
            joined = F.concat(base, F.when(base != "", F.lit("\n\n")).otherwise(F.lit("")), p)
            return F.struct(F.when(full, F.concat(s["done"], F.array(now))).otherwise(s["done"]).alias("done"), joined.alias("now"))

        return F.aggregate(F.split(section, "\n\n"), start, step, lambda s: F.when(s["now"] != "", F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]))

    return F.flatten(F.transform(F.filter(F.split(text, r"(?m)^#+\s+"), lambda s: s != ""), fold))


def find_sections(text: Column) -> Column:
    """Sections that begin with their header lines."""
    return _filled(F.split(F.regexp_replace(text, SECTION, _MARK + "$0"), _MARK))


def hybrid(text: Column, c: Chunking) -> Column:
    """Sections, those longer than a window cut by sliding windows."""
    return F.flatten(F.transform(find_sections(text), lambda s: F.when(F.length(s) <= c.window, F.array(s)).otherwise(windows(s, c.window, c.stride))))


STRATEGIES: dict[str, Callable[[Column, Chunking], Column]] = {
    "paragraph": paragraphs,
    "sentence": sentences,
    "section": sections,
    "fixed": fixed,
    "semantic_basic": paragraphs,
    "hierarchical_basic": nested,
    "sliding": sliding,
    "hybrid": hybrid,
    "fallback": fallback,
}


def _numbered(df: DataFrame, strategy: str) -> DataFrame:
    """From ``id, [metadata,] chunks`` one row a chunk."""
    extra = ["metadata"] if "metadata" in df.columns else []
    # bound to a variable, the chunks are made once and not again for their number
    rows = F.flatten(F.transform(F.array("chunks"), lambda c: F.transform(c, lambda x, i: F.struct(i.alias("i"), F.size(c).alias("n"), x.alias("content")))))
    out = df.select(F.col("id").alias("parent_id"), *extra, F.explode(rows).alias("r"))
    return out.select(
        F.concat(F.col("parent_id").cast("string"), F.lit("_chunk_"), F.col("r.i").cast("string")).alias("id"),
        "parent_id", F.col("r.i").cast("long").alias("chunk_index"), F.col("r.n").cast("long").alias("chunk_count"), F.lit(strategy).alias("chunk_strategy"), F.col("r.content").alias("content"), *extra,
    )


def chunk(docs: DataFrame, strategy: str = "paragraph", options: Chunking = Chunking(), embed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The chunks of every document; ``embed`` is for the semantic strategy."""
    extra = ["metadata"] if "metadata" in docs.columns else []
    if strategy == "content_aware":
        return content_aware(docs, options)
    if strategy == "hierarchical":
        return hierarchical(docs, options)
    if strategy == "semantic":
        return semantic_documents(docs, options, embed)
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; there are {', '.join([*STRATEGIES, 'hierarchical', 'content_aware', 'semantic'])}")
    return _numbered(docs.where("content is not null").select("id", *extra, STRATEGIES[strategy](F.col("content"), options).alias("chunks")), strategy)


def hierarchical(docs: DataFrame, c: Chunking = Chunking()) -> DataFrame:
    """Sections, their paragraphs of a least size, and with three levels packs of sentences of long paragraphs.

    Rows: ``id, parent_id, chunk_index, chunk_count, hierarchy_level, section_index,
    paragraph_index, pack_index, parent_chunk_id, content``, numbered through the document.
    """
    none = F.lit(None)

    def packs(p: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

        def step(s: Column, u: Column) -> Column:
            full = (F.length(s["now"]) + F.length(u) > c.window) & (s["now"] != "")
            base = F.when(full, F.lit("")).otherwise(s["now"])
            joined = F.concat(base, F.when(base != "", F.lit(" ")).otherwise(F.lit("")), u)
            return F.struct(F.when(full, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]).alias("done"), joined.alias("now"))

        return F.aggregate(F.split(p, SENTENCE_END), start, step, lambda s: F.when(s["now"] != "", F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]))

    def row(level: int, section: Column, paragraph: Column, pack: Column, text: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), section.cast("int").alias("section"), paragraph.cast("int").alias("paragraph"), pack.cast("int").alias("pack"), text.alias("content"))

    def of_paragraph(p: Column, j: Column, i: Column) -> Column:
        rows = F.array(row(1, i, j, none, p))
        if c.levels > 2:
            deeper = F.transform(packs(p), lambda t, k: row(2, i, j, k, t))
            rows = F.when(F.length(p) > c.window, F.concat(rows, deeper)).otherwise(rows)
        return F.when(F.length(p) >= c.min_size, rows).otherwise(F.slice(rows, 1, 0))

    def of_section(s: Column, i: Column) -> Column:
        rows = F.array(row(0, i, none, none, s))
        if c.levels > 1:
            rows = F.concat(rows, F.flatten(F.transform(F.split(s, "\n\n"), lambda p, j: of_paragraph(p, j, i))))
        return rows

    found = docs.where("content is not null").select(F.col("id").alias("parent_id"), F.flatten(F.transform(find_sections(F.col("content")), of_section)).alias("rows"))
    out = found.select("parent_id", F.size("rows").cast("long").alias("chunk_count"), "rows", F.posexplode("rows").alias("chunk_index", "r"))
    above = F.expr("filter(transform(rows, (x, at) -> struct(at as at, x.level as level, x.section as section, x.paragraph as paragraph)), y -> y.level = r.level - 1 and y.section = r.section and (y.level = 0 or y.paragraph = r.paragraph))")
    name: Callable[[Column], Column] = lambda i: F.concat(F.col("parent_id").cast("string"), F.lit("-chunk-"), i.cast("string"))
    return out.select(
        name(F.col("chunk_index")).alias("id"), "parent_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_count",
        F.col("r.level").alias("hierarchy_level"), F.col("r.section").alias("section_index"), F.col("r.paragraph").alias("paragraph_index"), F.col("r.pack").alias("pack_index"),
        F.when(F.col("r.level") > 0, name(F.get(above, F.lit(0))["at"])).alias("parent_chunk_id"), F.col("r.content").alias("content"),
    )


def best_cuts(at: np.ndarray, window: int, least: int) -> list[int]:
    """Indices of the boundaries where chunks of least total cost end.

    A chunk under ``least`` can't be, one over ``window`` costs the square of the
    excess, any other what it lacks; ties keep the earliest cut.  An end that can't be
    reached makes the whole text one chunk.

    Only so far back is searched as a chunk can still pay: what comes before costs at
    least the square of the excess, so once this is more than the best found, and costs
    are never negative, all earlier cuts are dearer.
    """
    n = len(at)
    cost, parent = np.full(n, np.inf), np.full(n, -1)
    cost[0] = 0.0
    for i in range(1, n):
        hi, width = i, 64
        best, choice = np.inf, -1
        while hi > 0:
            lo = max(0, hi - width)
            size = (at[i] - at[lo:hi]).astype(np.float64)
            each = np.where(size > window, (size - window) ** 2, window - size)
            each[size < least] = np.inf
            total = cost[lo:hi] + each
            j = int(np.argmin(total))
            # an equal one further back is earlier
            if total[j] <= best and total[j] < np.inf:
                best, choice = total[j], lo + j
            excess = at[i] - at[lo] - window
            if excess > 0 and float(excess) ** 2 > best:
                break
            hi, width = lo, width * 2
        if best < np.inf:
            cost[i], parent[i] = best, choice
    if not np.isfinite(cost[-1]):
        return [n - 1]
    out, i = [], n - 1
    while i > 0:
        out.append(i)
        i = int(parent[i])
    return out[::-1]


def content_aware(docs: DataFrame, c: Chunking = Chunking()) -> DataFrame:
    """Chunks that end at paragraph, sentence or header bounds and are as near a window as can be; together they are the text."""
    import re

    ends, heads = re.compile(r"\n\s*\n|(?<=[.!?])\s+"), re.compile(r"(?m)^#{1,6}\s")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("content").to_pylist():
                at = sorted({0, len(text), *(m.end() for m in ends.finditer(text)), *(m.start() for m in heads.finditer(text))})
                if len(at) < 2:
                    out.append([])
                    continue
                cuts, start, parts = best_cuts(np.array(at), c.window, c.min_size), 0, []
                for i in cuts:
                    parts.append(text[start : at[i]])
                    start = at[i]
                out.append(parts)
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), pa.array(out, pa.list_(pa.string()))], [*kept, "chunks"])

    kept = ["id", *(["metadata"] if "metadata" in docs.columns else [])]
    rows = docs.where("content is not null").select(*kept, "content")
    schema = rows.select(*kept, F.array().cast("array<string>").alias("chunks")).schema
    return _numbered(rows.mapInArrow(split, schema), "content_aware")


def semantic(units: DataFrame, key: str, order: str, content: str, embedding: str, options: Chunking = Chunking()) -> DataFrame:
    """Neighbouring units of one key joined while their cosine is the threshold at least.

    ``key, chunk_index, n_units, content``: islands by a running sum over the bounds, for
    units that have vectors already; :func:`semantic_documents` begins with texts.
    """
    w = Window.partitionBy(key).orderBy(order)
    near = V.cosine(F.lag(embedding).over(w), F.col(embedding))
    marked = units.withColumn("__bound", F.when(near < options.threshold, 1).otherwise(0))
    island = marked.withColumn("chunk_index", F.sum("__bound").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return (
        island.groupBy(key, "chunk_index")
        .agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(content).alias("c")))).alias("units"))
        .select(key, "chunk_index", F.size("units").cast("long").alias("n_units"), F.array_join(F.transform("units", lambda u: u["c"]), "\n\n").alias("content"))
    )


def _hashed_bounds(threshold: float) -> Callable[[Column], Column]:
    """Places of the units of a list whose cosine with the one before, by hashed tokens, is under the threshold; null if there are none."""
    from corvid.operators import embedding

    at_once = 1 << 13

    def run(lists: pa.Array) -> pa.Array:
        buckets, lists = embedding.buckets(64), pa.concat_arrays([lists])
        sizes = np.array([0 if n is None else n for n in pc.list_value_length(lists).to_pylist()], np.int64)
        ends = np.cumsum(sizes)
        units, starts = lists.flatten(), np.repeat(ends - sizes, sizes)
        near, last = np.zeros(len(units)), None
        for lo in range(0, len(units), at_once):
            x = embedding.hashed(units.slice(lo, at_once).to_pylist(), buckets)
            x = x.astype(np.float32).astype(np.float64) if last is None else np.vstack([last, x.astype(np.float32)])
            size = np.linalg.norm(x, axis=1)
            both = size[1:] * size[:-1]
            cosine = np.divide(np.einsum("ij,ij->i", x[1:], x[:-1]), both, out=np.zeros(len(both)), where=both > 0)
            first = lo + (last is None)
            near[first : first + len(cosine)] = cosine
            last = x[-1:]
        bound = np.flatnonzero((near < threshold) & (np.arange(len(units)) > starts))
        own = np.searchsorted(ends, bound, side="right")
        count = np.bincount(own, minlength=len(lists))
        offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
        places = pa.array((bound - starts[bound]).astype(np.int32))
        return pa.ListArray.from_arrays(pa.array(offsets), places, mask=pa.array(count == 0))

    return F.arrow_udf(run, "array<int>")


def semantic_documents(docs: DataFrame, c: Chunking = Chunking(), embed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Paragraphs of a document joined while neighbours are similar, from the text itself.

    Paragraphs are what lies between blank lines; they are embedded (``embed`` adds
    ``embedding`` to rows with ``content``; without one, tokens are hashed, a document at
    a time and without a shuffle), and a chunk ends where the cosine of two neighbours is
    under the threshold.  A chunk longer than
    the window is cut into windows.  A document of one paragraph, or without a bound, is
    cut into windows as a whole.
    """
    extra = ["metadata"] if "metadata" in docs.columns else []
    texts = docs.where("content is not null").select("id", *extra, "content").withColumn("__units", F.filter(F.transform(F.split("content", "\n\n"), lambda u: F.regexp_replace(u, r"^\s+|\s+$", "")), lambda u: u != ""))
    if embed is None:
        joined = texts.withColumn("__bounds", _hashed_bounds(c.threshold)(F.col("__units")))
    else:
        vectors = embed(texts.where(F.size("__units") > 1).select("id", F.posexplode("__units").alias("place", "content")))
        w = Window.partitionBy("id").orderBy("place")
        near = V.cosine(F.lag("embedding").over(w), F.col("embedding"))
        bounds = vectors.withColumn("near", near).where(F.col("near") < c.threshold).groupBy("id").agg(F.sort_array(F.collect_list("place")).alias("__bounds"))
        joined = texts.join(bounds, "id", "left")
    begins = F.concat(F.array(F.lit(0)), F.col("__bounds"))
    groups = F.transform(begins, lambda b, i: F.array_join(F.slice("__units", b + 1, F.coalesce(F.get("__bounds", i), F.size("__units")) - b), "\n\n"))
    cut = F.flatten(F.transform(groups, lambda g: F.when(F.length(g) > c.window, windows(g, c.window, c.window)).otherwise(F.array(g))))
    chunks = F.when(F.col("__bounds").isNull(), fallback(F.col("content"), c)).otherwise(cut)
    return _numbered(joined.select("id", *extra, chunks.alias("chunks")), "semantic")
