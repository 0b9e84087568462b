"""Document fingerprints by spot signatures.

A signature begins at an anchor, a common word of one of four languages, and is the
anchor with the chain of the next ``CHAIN`` content words (words that aren't anchors),
``DISTANCE`` apart.  A document is the set of its signatures; two documents are near
copies if the Jaccard similarity of their sets is ``THRESHOLD`` at least.  A text
without a signature is the set of its chains of ``CHAIN`` + 1 successive words instead
(a shorter text is one chain), so it too is compared by what it shares.

The join is exact.  Documents of each signature are counted by an aggregate that tasks
begin before the shuffle: a signature of a third of all documents is a row a task there.
What the counts are for needs no join: Bloom filters of bounded size hold the signatures
that more than ``LEVELS`` documents have.  One that the first filter doesn't hold is no
other document's, so it can't be in an intersection and is left out; how many filters
hold a signature is its level, and sets are ordered by level, rarest first, and then by
hash.  A false positive keeps a signature or puts it later, for all documents alike; so
full filters cost time and no pair.  A document stays if the rest of its set is large
enough to reach the threshold.  Equal sets are one from here on.

Two similar sets share one of their first n - ceil(tn) + 1, so only under these are sets
listed.  Lists are partitioned by set length: the bounds grow by 1 / t, so a set is
compared in its own partition and, if it is long enough for the shortest of the next
one, there.  A list's members are never gathered to be counted: sums of hashes of them
tell which lists have the same ones, of which one is kept.  A list of more than
``LIST_ROWS`` is dealt into groups by a hash of doc_id and compared as pairs of groups, so
every two of its sets meet and a task holds the sets of two groups.  Within a list, sets
in the order of length are compared as arrays of their 64-bit signatures, those too long
for the threshold are left out, and what is found similar leaves the list, so copies of
one text leave a star and not their pairs.

Groups are the connected components of similarity; the least doc_id of each is kept.

Defined results: one row for each distinct doc_id, none for null; doc_ids must be
integers.  Null, empty and wordless texts are groups of their own.  Very long texts are
cut into words piece by piece and compared whole.  Rows that share a doc_id are compared
each, and what any is similar to joins the group.  Signatures of
one level are ordered by their hash.  An empty table gives no rows.  Only ``doc_id`` and ``text`` are
read; other columns, of any name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm import bloom
from corvid.llm import textscan as ts
from corvid.llm.bpe import spread
from corvid.llm.components import components
from corvid.storage import cut, scratch

CHAIN = 2
DISTANCE = 1
THRESHOLD = 0.55
#: A text with fewer, which is one with none, has word chains in their place.
MIN_SIGNATURES = 1
#: Sets of a list that are compared in one task; more are compared in pairs of groups of half as many.
LIST_ROWS = 1 << 14
#: Numbers of documents whose passing puts a signature a level later, and the bytes of the first filter and of each other one.
LEVELS = tuple(8**i for i in range(9))
FILTER_BYTES = (32 << 20, 8 << 20)
#: Common words of English, German, French and Spanish; every other word is a content word.
ANCHORS = (
    "the a of and to in is was that "
    "der die das den und ist ein "
    "le la les un une des et est "
    "el los las de que y en"
).split()
_ANCHOR, _TAIL = 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9


def _word_hashes(words: list[str]) -> np.ndarray:
    column = pa.array(sorted(set(words)), pa.string())
    return np.sort(ts.tokens(*ts.text_buffers(column))[0])


def signatures(buf: np.ndarray, offsets: np.ndarray, chain: int = CHAIN, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """The documents' distinct signatures, and where each document's begin."""
    h, first = ts.tokens(buf, offsets)
    docs = len(first) - 1
    anchors = _word_hashes(ANCHORS)
    spot = anchors[np.minimum(np.searchsorted(anchors, h), len(anchors) - 1)] == h
    content = h[~spot]
    after = np.cumsum(~spot)
    doc = np.repeat(np.arange(docs), np.diff(first))
    limit = np.concatenate([[0], after])[first[1:]]
    at = np.flatnonzero(spot)
    start = after[at]
    at, start = (x[start + (chain - 1) * distance < limit[doc[at]]] for x in (at, start))
    sig = h[at] * np.uint64(_ANCHOR)
    for j in range(chain):
        sig = ts.mix(sig + content[start + j * distance]) if len(sig) else sig
    owner = doc[at]
    count = np.bincount(owner, minlength=docs)
    # words of the texts that have word chains instead
    bare = np.flatnonzero(count[doc] < MIN_SIGNATURES)
    if len(bare):
        n = np.minimum(np.diff(first), chain + 1)[doc[bare]]
        left = first[1:][doc[bare]] - bare
        bare, n = bare[left >= n], n[left >= n]
        chains = h[bare] * np.uint64(_TAIL)
        for j in range(1, chain + 1):
            chains = np.where(j < n, ts.mix(chains + h[np.minimum(bare + j, len(h) - 1)]), chains)
        sig, owner = np.concatenate([sig, ts.mix(chains)]), np.concatenate([owner, doc[bare]])
    order = np.lexsort((sig, owner))
    sig, owner = sig[order], owner[order]
    if len(sig):
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (owner[1:] != owner[:-1])])
        sig, owner = sig[new], owner[new]
    return sig, np.searchsorted(owner, np.arange(docs + 1))


def counted(docs: DataFrame, chain: int = CHAIN, distance: int = DISTANCE) -> DataFrame:
    """``sig, df`` of the signatures that more than one document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, offsets in ts.slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(signatures(buf, offsets, chain, distance)[0].view(np.int64))], ["sig"])

    found = docs.where("doc_id is not null and text is not null").select("text").mapInArrow(run, "sig long")
    return found.groupBy("sig").agg(F.count(F.lit(1)).alias("df")).where("df > 1")


def level_filters(common: DataFrame, filter_bytes: tuple[int, int] = FILTER_BYTES) -> list[np.ndarray]:
    """A filter for each of the levels that has signatures."""
    sizes = common.agg(*(F.count_if(F.col("df") > n).alias(str(n)) for n in LEVELS)).first()
    return [bloom.build(common.where(F.col("df") > n).select("sig"), sizes[i], max_bytes=filter_bytes[i > 0]) for i, n in enumerate(LEVELS) if i == 0 or sizes[i]]


def shared_sets(docs: DataFrame, threshold: float = THRESHOLD, chain: int = CHAIN, distance: int = DISTANCE, filter_bytes: tuple[int, int] = FILTER_BYTES) -> DataFrame:
    """``doc_id, n, sigs``: the signatures that others have too, rarest first, of the documents that have enough of them."""
    filters = docs.sparkSession.sparkContext.broadcast(level_filters(cut(counted(docs, chain, distance), "common-signatures"), filter_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = filters.value
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for lo, hi, buf, offsets in ts.slices(batch.column("text")):
                sig, first = signatures(buf, offsets, chain, distance)
                n = np.diff(first)
                level, held = np.zeros(len(sig), np.int8), np.arange(len(sig))
                for table in tables:
                    held = held[bloom.may_contain(table, sig[held].view(np.int64))]
                    level[held] += 1
                owner = np.repeat(np.arange(hi - lo), n)
                order = np.lexsort((sig, level, owner))
                order = order[level[order] > 0]
                kept = np.bincount(owner[order], minlength=hi - lo)
                enough = (kept >= np.ceil(n * threshold - 1e-9)) & (n > 0)
                order = order[enough[owner[order]]]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept[enough])]), pa.int32()), pa.array(sig[order].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][enough]), pa.array(n[enough].astype(np.int32)), lists], ["doc_id", "n", "sigs"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    return texts.mapInArrow(run, "doc_id long, n int, sigs array<long>").where("size(sigs) > 0")


def bounds(top: int, threshold: float) -> np.ndarray:
    """The least length of each partition, up to one beyond ``top``."""
    out = [1]
    while out[-1] <= top:
        out.append(int(out[-1] / threshold + 1e-9) + 1)
    return np.array(out, np.int64)


def stars(starts: np.ndarray, sigs: np.ndarray, n: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """(member, root) of the sets of one list that are connected by similarity; sets are given by where each begins in sigs, and in the order of length."""
    m = len(n)
    size = np.diff(starts)
    _, codes = np.unique(sigs, return_inverse=True)
    seen = np.zeros(codes.max(initial=0) + 1, bool)
    waiting, links = np.ones(m, bool), []
    owner = np.repeat(np.arange(m), size)
    for root in range(m):
        if not waiting[root]:
            continue
        waiting[root] = False
        edge = [root]
        while edge:
            x = edge.pop()
            lo, hi = np.searchsorted(n, [ceil(n[x] * threshold - 1e-9), int(n[x] / threshold + 1e-9) + 1])
            if not waiting[lo:hi].any():
                continue
            seen[codes[starts[x] : starts[x + 1]]] = True
            part = slice(starts[lo], starts[hi])
            common = np.bincount(owner[part][seen[codes[part]]] - lo, minlength=hi - lo)
            seen[codes[starts[x] : starts[x + 1]]] = False
            near = lo + np.flatnonzero(waiting[lo:hi] & (common >= threshold * (n[lo:hi] + n[x] - common) - 1e-9))
            waiting[near] = False
            edge.extend(near.tolist())
            links.extend((int(y), root) for y in near)
    return links


def links(sets: DataFrame, threshold: float = THRESHOLD, list_rows: int = LIST_ROWS) -> DataFrame:
    """``a, b`` links between similar ones of distinct sets (``doc_id, n, sigs``)."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids = batch.column("n").to_numpy().astype(np.int64), batch.column("doc_id").to_numpy()
            lists = batch.column("sigs")
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            edges = bounds(int(n.max(initial=1)), threshold)
            part = np.searchsorted(edges, n, "right") - 1
            take = np.minimum(np.diff(at), n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1 - (n - np.diff(at)))
            use = np.flatnonzero(take > 0)
            row = np.repeat(use, take[use])
            sig = flat[spread(at[use].astype(np.int64), take[use], np.concatenate([[0], np.cumsum(take[use])]))]
            for ahead in (0, 1):
                # a visitor is long enough for the shortest set of the next partition
                ok = np.ones(len(row), bool) if not ahead else n[row] >= threshold * edges[np.minimum(part[row] + 1, len(edges) - 1)] - 1e-9
                key = ts.mix(sig[ok] + (part[row[ok]] + ahead).astype(np.uint64) * np.uint64(ts.BASE))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[row[ok]]), pa.array(np.full(len(key), not ahead))], ["list", "doc_id", "home"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at: int | None = None

        def done() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            if len(table) < 2:
                return
            n = table.column("n").to_numpy()
            order = np.argsort(n, kind="stable")
            whole = table.take(pa.array(order)).combine_chunks()
            lists = whole.column("sigs").combine_chunks()
            starts = lists.offsets.to_numpy().astype(np.int64)
            got = np.array(stars(starts - starts[0], lists.flatten().to_numpy(), n[order].astype(np.int64), threshold), np.int64).reshape(-1, 2)
            if len(got):
                ids = whole.column("doc_id").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(ids[got[:, 0]]), pa.array(ids[got[:, 1]])], ["a", "b"])

        for batch in batches:
            key = batch.column("list").to_numpy()
            marks = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for lo, hi in zip(marks, marks[1:]):
                if lo == hi:
                    continue
                if key[lo] != at:
                    if held:
                        yield from done()
                    held, at = [], int(key[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from done()

    places = sets.mapInArrow(listed, "list long, doc_id long, home boolean")
    # sums of 30 bits of three hashes and a count over the members: lists of which all agree have the same members and one is compared
    mark = [F.sum(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(i)), 34)).alias(f"m{i}") for i in (1, 2, 3)]
    sizes = places.groupBy("list").agg(F.count(F.lit(1)).alias("m"), F.max("home").alias("home"), *mark).where("home and m > 1")
    lists = sizes.groupBy("m", "m1", "m2", "m3").agg(F.min("list").alias("list")).select("list", F.ceil(F.col("m") / (list_rows / 2)).alias("groups"), (F.col("m") > list_rows).alias("long"))
    # a long list's member goes to every pair of groups that its own is in
    own = F.pmod(F.xxhash64("doc_id"), F.col("groups"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1), lambda j: F.xxhash64("list", F.least(own, j), F.greatest(own, j)))
    sent = places.join(lists.hint("merge"), "list").select("doc_id", F.explode(F.when(F.col("long"), pairs).otherwise(F.array("list"))).alias("list"))
    whole = sent.join(sets.hint("merge"), "doc_id").select("list", "doc_id", "n", "sigs")
    return whole.repartition("list").sortWithinPartitions("list").mapInArrow(compared, "a long, b long").where("a <> b").distinct()


def groups(docs: DataFrame, threshold: float = THRESHOLD, chain: int = CHAIN, distance: int = DISTANCE) -> DataFrame:
    """``doc_id, group_id, keep`` of every document."""
    with scratch(docs.sparkSession) as keep:
        sets = cut(shared_sets(docs, threshold, chain, distance), "spot-sets").withColumn("same", F.xxhash64("n", "sigs"))
        first = sets.groupBy("same", "n").agg(F.min("doc_id").alias("first"))
        equal = sets.select("doc_id", "same", "n").join(first, ["same", "n"]).where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
        one = cut(sets.join(first, ["same", "n"]).where("doc_id = first").dropDuplicates(["same", "n"]).select("doc_id", "n", "sigs"), "distinct-sets")
        found = keep(components(equal.unionByName(links(one, threshold))))
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    return every.join(found, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("root", "doc_id").alias("group_id"), F.col("root").isNull().alias("keep"))
