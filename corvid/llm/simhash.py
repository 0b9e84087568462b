"""SimHash near-duplicates by recursive filtering of fingerprints.

The fingerprint of a document is 256 bits: every bit is the majority vote of that
bit in the hashes of its 2-shingles of lower-cased words (a text of one word has
that word as its shingle).  Two documents are near copies if their fingerprints
differ in at most ``DISTANCE`` bits.

Pairs are found as in the nearest-neighbour recursion of May and Ozerov.  Equal
fingerprints are joined first, so a list never holds copies.  A repetition orders
the coordinates at random and cuts them into strips of 16.  For each of a set of
random centres a list takes the fingerprints whose partial weight against the
centre, on the first strip, is at most the limit; a list longer than ``LEAF`` is
filtered again on the next strip, as often as the number of fingerprints asks for on
the mean, and what is left is compared pair by pair, however long.  The number of
repetitions follows from these filters so that a pair at the full distance is in a
common list with probability ``RECALL`` at least; closer pairs nearly always are.

The first filter is the shuffle key: lists are spread over the cluster, read in
key order and compared in arrays.  Where the mean list would be longer than half of
``LIST_ROWS``, as many further filters come before the shuffle as bring it below that.
Lists are counted first (by an aggregate that tasks begin before the shuffle); one that is
still longer than ``LIST_ROWS`` is dealt into groups by a hash of the fingerprint's id and
compared as pairs of groups, so every two of its members meet.  So a task holds
``LIST_ROWS`` fingerprints of 40 bytes, whatever the corpus and its skew.  A list leaves
the links of its spanning stars, not its pairs, so thousands of copies leave thousands of
rows.  Groups are the connected components; the document with the least doc_id of each
group stays.

Defined results: null, empty and wordless texts have no fingerprint and form groups of
their own.  Very long texts are cut into words piece by piece and every word votes.  A
tie of votes is a 0.  Repeated rows with one doc_id are one document (its fingerprint is
that of any of them; as a filter, all its rows stay or go).  Rows with a null doc_id
aren't compared and stay; other doc_ids must be integers.  An empty table gives no rows.
``groups`` reads doc_id and text only; ``deduplicate`` keeps all columns of its input,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm import textscan as ts
from corvid.llm.bpe import spread
from corvid.llm.components import components
from corvid.storage import cut, scratch

BITS = 256
SHINGLE = 2
DISTANCE = 52
RECALL = 0.95
LEAF = 2048
STRIP = 16
#: Fingerprints of a list that a task holds, 40 MB; more filters before the shuffle send each fingerprint more often.
LIST_ROWS = 1 << 20
#: Fingerprints that are filtered at a time.
BLOCK = 1 << 16
#: Partial weight and mean lists a fingerprint of the first filter and of later ones.
FIRST, LATER = (2, 1.0), (4, 4.0)
WORDS = ("f0", "f1", "f2", "f3")
_SALTS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)
_LANE_MAX = 60_000
_PATH = (1 << 48) - 1
#: Shingles that vote at a time.
_AT_ONCE = 1 << 20
#: For each byte its 8 bits in 16-bit lanes of two words.
_LANES = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype("<u2")).view("<u8")


def fingerprints(buf: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (documents x 4 words) and the number of shingles of each document."""
    h, first = ts.tokens(buf, offsets)
    n = np.diff(first)
    s = h
    for j in range(1, min(k, int(n.max(initial=1)))):
        s = s[:-1] * np.uint64(ts.BASE) + h[j:] if len(s) > 1 else s
    # the shingle that begins at a word; those that would leave the document are dropped
    s = np.concatenate([s, h[len(s) :]])
    left = np.repeat(first[1:], n) - np.arange(len(h))
    keep = left >= k
    short = np.flatnonzero((n > 0) & (n < k))
    for d in short:
        word = h[first[d] : first[d + 1]]
        keep[first[d]] = True
        s[first[d]] = np.bitwise_xor.reduce(word * (np.arange(len(word), dtype=np.uint64) * np.uint64(2) + np.uint64(1)))
    s = s[keep]
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    out = np.zeros((len(n), 4), np.uint64)
    full = count > 0
    if not full.any():
        return out, count
    size = count[full]
    begin = np.cumsum(size) - size
    # lanes hold 16 bits, so a longer document is summed in blocks
    blocks = -(-size // _LANE_MAX)
    at = np.repeat(begin, blocks) + (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * _LANE_MAX
    of = np.cumsum(blocks) - blocks
    for w, salt in enumerate(_SALTS):
        votes = np.empty((len(at), 64), np.int64)
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + _AT_ONCE)))
            begins = at[lo:hi]
            part = s[begins[0] : at[hi] if hi < len(at) else len(s)]
            raw = ts.mix(part ^ np.uint64(salt)).view(np.uint8).reshape(-1, 8)
            for b in range(8):
                votes[lo:hi, 8 * b : 8 * b + 8] = np.add.reduceat(_LANES[raw[:, b]], begins - begins[0], axis=0).view("<u2").reshape(hi - lo, 8)
            lo = hi
        if len(at) > len(of):
            votes = np.add.reduceat(votes, of, axis=0)
        out[full, w] = np.packbits(votes * 2 > size[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out, count


def _chance(weight: int, differing: int) -> float:
    """Probability that a random centre takes both of two strips with so many differing bits."""
    hits = sum(comb(differing, a) * comb(STRIP - differing, j) for a in range(differing + 1) for j in range(STRIP - differing + 1) if a + j <= weight and differing - a + j <= weight)
    return hits / 2**STRIP


def _centres(weight: int, lists: float) -> int:
    return max(1, round(lists / _chance(weight, 0)))


def _survives(weight: int, lists: float, distance: int) -> float:
    """Probability that a pair at the distance is in a common list of one filter."""
    total = 0.0
    for k in range(min(STRIP, distance) + 1):
        at = comb(distance, k) * comb(BITS - distance, STRIP - k) / comb(BITS, STRIP)
        total += at * (1 - (1 - _chance(weight, k)) ** _centres(weight, lists))
    return total


def filters(n: int) -> int:
    """Filters after the first that the mean list of n fingerprints needs to be short."""
    size = max(n, 1) * _chance(FIRST[0], 0)
    return max(0, ceil(log(size / LEAF) / -log(_chance(LATER[0], 0)))) if size > LEAF else 0


def repetitions(n: int, distance: int = DISTANCE, recall: float = RECALL) -> int:
    """Repetitions for n fingerprints."""
    q = _survives(*FIRST, distance) * _survives(*LATER, distance) ** filters(n)
    return ceil(log(1 - recall) / log(1 - q))


def depth(n: int, list_rows: int = LIST_ROWS) -> int:
    """Filters after the first that come before the shuffle."""
    size, out = n * _chance(FIRST[0], 0), 0
    while size > list_rows / 2 and (out + 2) * STRIP < BITS:
        size, out = size * _chance(LATER[0], 0), out + 1
    return out


def _strip(rep: int, level: int) -> np.ndarray:
    """Coordinates of a repetition's strip."""
    return np.random.RandomState(1_000 + rep).permutation(BITS)[level * STRIP : (level + 1) * STRIP]


@lru_cache(maxsize=64)
def _lists(rep: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """For each value of the strip where its centres begin in the second array, which has the centres."""
    weight, lists = LATER if level else FIRST
    centres = np.random.RandomState(7_000_000 + 100 * rep + level).randint(0, 1 << STRIP, _centres(weight, lists)).astype(np.uint16)
    near = np.flatnonzero(np.bitwise_count(np.arange(1 << STRIP, dtype=np.uint16)) <= weight).astype(np.uint16)
    # a centre takes the values at most weight away from it
    value = (near[None, :] ^ centres[:, None]).ravel()
    centre = np.repeat(np.arange(len(centres), dtype=np.int32), len(near))
    order = np.argsort(value, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << STRIP))])
    return first, centre[order]


def _filter(words: np.ndarray, rep: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and centre of each list place that the fingerprints get."""
    if len(words) > BLOCK:
        parts = [_filter(words[lo : lo + BLOCK], rep, level) for lo in range(0, len(words), BLOCK)]
        return np.concatenate([row + i * BLOCK for i, (row, _) in enumerate(parts)]), np.concatenate([c for _, c in parts])
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(len(words), BITS // 8), axis=1, bitorder="little")
    value = bits[:, _strip(rep, level)].astype(np.int64) @ (1 << np.arange(STRIP))
    first, centre = _lists(rep, level)
    n = first[value + 1] - first[value]
    ends = np.concatenate([[0], np.cumsum(n)])
    return np.repeat(np.arange(len(words)), n), centre[spread(first[value], n, ends)]


def _near(words: np.ndarray, distance: int) -> np.ndarray:
    """Which pairs of the fingerprints are near, as a matrix."""
    m = len(words)
    out = np.empty((m, m), bool)
    step = max(1, (1 << 18) // max(m, 1))
    for lo in range(0, m, step):
        part = words[lo : lo + step]
        far = np.bitwise_count(part[:, None, 0] ^ words[None, :, 0])
        for w in range(1, 4):
            far += np.bitwise_count(part[:, None, w] ^ words[None, :, w])
        out[lo : lo + step] = far <= distance
    return out


def stars(words: np.ndarray, distance: int) -> np.ndarray:
    """(member, root) rows that connect what is near, of the positions in a list."""
    m = len(words)
    if m > 4 * LEAF:
        return _stars_in_blocks(words, distance)
    near = _near(words, distance)
    np.fill_diagonal(near, False)
    waiting = near.any(axis=1)
    links = []
    while waiting.any():
        root = int(np.argmax(waiting))
        waiting[root] = False
        edge = np.array([root])
        while len(edge):
            reached = near[edge].any(axis=0) & waiting
            waiting[reached] = False
            edge = np.flatnonzero(reached)
            links.append(np.stack([edge, np.full(len(edge), root)], axis=1))
    return np.concatenate(links) if links else np.zeros((0, 2), np.int64)


def _stars_in_blocks(words: np.ndarray, distance: int) -> np.ndarray:
    """The same for a list too long for a matrix: a search from each fingerprint not yet reached."""
    m = len(words)
    waiting = np.ones(m, bool)
    links = []
    for root in range(m):
        if not waiting[root]:
            continue
        waiting[root] = False
        edge = [root]
        while edge:
            x = edge.pop()
            rest = np.flatnonzero(waiting)
            far = np.bitwise_count(words[rest] ^ words[x]).sum(axis=1)
            reached = rest[far <= distance]
            waiting[reached] = False
            edge.extend(reached.tolist())
            links.append(np.stack([reached, np.full(len(reached), root)], axis=1))
    return np.concatenate(links) if links else np.zeros((0, 2), np.int64)


def compare(ids: np.ndarray, words: np.ndarray, rep: int, level: int, distance: int, leaf: int = LEAF, planned: int = BITS // STRIP) -> list[np.ndarray]:
    """Links of one list: filtered again while it is long and filters are planned, else compared pair by pair."""
    if len(ids) < 2:
        return []
    if len(ids) <= leaf or level > planned or (level + 1) * STRIP > BITS:
        return [ids[stars(words, distance)]]
    row, centre = _filter(words, rep, level)
    order = np.argsort(centre, kind="stable")
    row, centre = row[order], centre[order]
    cuts = np.flatnonzero(np.diff(centre)) + 1
    out: list[np.ndarray] = []
    for part in np.split(row, cuts):
        # a list that the filter hardly shortens is one cluster
        if len(part) > 0.8 * len(ids):
            out.append(ids[part][stars(words[part], distance)])
        else:
            out += compare(ids[part], words[part], rep, level + 1, distance, leaf, planned)
    return out


def table(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles, f0 .. f3`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = np.zeros((batch.num_rows, 4), np.uint64), np.zeros(batch.num_rows, np.int64)
            for lo, hi, buf, offsets in ts.slices(batch.column("text")):
                words[lo:hi], n[lo:hi] = fingerprints(buf, offsets, k)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *(pa.array(words[:, w].view(np.int64)) for w in range(4))], ["doc_id", "n_shingles", *WORDS])

    schema = docs.select("doc_id").schema.add("n_shingles", "long")
    for w in WORDS:
        schema = schema.add(w, "long")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _words(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(w).to_numpy() for w in WORDS], axis=1).view(np.uint64)


def deal(row: np.ndarray, key: np.ndarray, ids: np.ndarray, hot: np.ndarray, dealt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and lists with each of the hot lists (sorted) replaced by the pairs of its groups that the row's own is in."""
    at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
    long = hot[at] == key
    rows, keys = [row[~long]], [key[~long]]
    for r, k, n in zip(row[long], key[long], dealt[at[long]]):
        own = ts.mix(ids[r : r + 1]) % np.uint64(n)
        other = np.arange(n, dtype=np.uint64)
        pair = np.minimum(own, other) * np.uint64(n) + np.maximum(own, other)
        path = ts.mix(np.full(n, k & _PATH, np.uint64) * np.uint64(ts.BASE) + pair + np.uint64(1)) & np.uint64(_PATH)
        rows.append(np.full(n, r))
        keys.append((k & ~_PATH) + path.astype(np.int64))
    return np.concatenate(rows), np.concatenate(keys)


def links(distinct: DataFrame, n: int, distance: int = DISTANCE, recall: float = RECALL, list_rows: int = LIST_ROWS) -> DataFrame:
    """``a, b`` links between near ones of n distinct fingerprints (``id, f0 .. f3``)."""
    reps, planned, deeper = repetitions(n, distance, recall), filters(n), depth(n, list_rows)

    def placed(words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row and list of each place that the fingerprints get, a repetition at a time."""
        for rep in range(reps):
            row, path = _filter(words, rep, 0)
            path = path.astype(np.uint64)
            for level in range(1, deeper + 1):
                sub, centre = _filter(words[row], rep, level)
                row, path = row[sub], ts.mix(path[sub] * np.uint64(ts.BASE) + centre.astype(np.uint64))
            # lists whose paths share 48 bits are compared as one
            yield row, (rep << 48) + (path & np.uint64(_PATH)).astype(np.int64)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, key in placed(_words(batch)):
                lists, m = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(lists), pa.array(m)], ["list", "m"])

    # one row for list_rows places at least
    long = distinct.select(*WORDS).mapInArrow(counts, "list long, m long").groupBy("list").agg(F.sum("m").alias("m")).where(F.col("m") > list_rows).toPandas()
    long = long.sort_values("list")
    hot, dealt = long["list"].to_numpy(np.int64), -(-2 * long["m"].to_numpy(np.int64) // list_rows)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                ids = batch.column("id").to_numpy().view(np.uint64)
                for row, key in placed(_words(batch)):
                    if len(hot):
                        row, key = deal(row, key, ids, hot, dealt)
                    yield pa.RecordBatch.from_arrays([pa.array(key), *(batch.column(c).take(pa.array(row)) for c in ("id", *WORDS))], ["list", "id", *WORDS])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        at = -1

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                got = compare(np.concatenate([i for i, _ in held]), np.concatenate([w for _, w in held]), at >> 48, deeper + 1, distance, planned=planned)
                got = [g for g in got if len(g)]
                if got:
                    both = np.unique(np.concatenate(got), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        for batch in batches:
            key, ids, words = batch.column("list").to_numpy(), batch.column("id").to_numpy(), _words(batch)
            bounds = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for lo, hi in zip(bounds, bounds[1:]):
                if lo == hi:
                    continue
                if key[lo] != at:
                    yield from done()
                    held, at = [], int(key[lo])
                held.append((ids[lo:hi], words[lo:hi]))
        yield from done()

    listed = distinct.mapInArrow(keys, "list long, id long, f0 long, f1 long, f2 long, f3 long")
    return listed.repartition("list").sortWithinPartitions("list").mapInArrow(lists, "a long, b long").distinct()


def groups(docs: DataFrame, distance: int = DISTANCE, recall: float = RECALL, k: int = SHINGLE) -> DataFrame:
    """``doc_id, group_id, keep`` of every document: group_id is the least doc_id of its group, which is kept."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with scratch(docs.sparkSession) as keep:
        prints = cut(table(ids.where("doc_id is not null"), k), "fingerprints")
        known = prints.where("n_shingles > 0")
        distinct = cut(known.groupBy(*WORDS).agg(F.min("doc_id").alias("id")), "distinct-fingerprints")
        near = links(distinct, distinct.count(), distance, recall)
        same = known.join(distinct, list(WORDS)).select(F.col("doc_id").alias("a"), F.col("id").alias("b")).where("a <> b")
        # one doc_id may have rows with different texts: their fingerprints' ids are linked through it
        found = keep(components(same.unionByName(near)))
    every = ids.where("doc_id is not null").select("doc_id").distinct()
    joined = every.join(found, F.col("doc_id") == F.col("node"), "left")
    return joined.select("doc_id", F.coalesce("root", "doc_id").alias("group_id"), F.col("root").isNull().alias("keep"))


def deduplicate(docs: DataFrame, distance: int = DISTANCE, recall: float = RECALL, k: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` without the copies, all columns."""
    gone = groups(docs, distance, recall, k).where("not keep").select(F.col("doc_id").alias("__copy"))
    named = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    id_at = f"c{docs.columns.index('doc_id')}"
    return named.join(gone, F.col(id_at).cast("long") == F.col("__copy"), "left_anti").toDF(*docs.columns)
