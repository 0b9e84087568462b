"""Substring deduplication by sliding spans of sentences.

A sentence ends after a line end, or after one of ``. ! ?`` with any ASCII punctuation
behind it and a space; one of more than ``LONG_WORDS`` words counts as its clauses, which
end after ``, ; :`` and a space.  They are compared without the white space around them
and blank ones don't count.  From every one a run goes on for ``SENTENCES`` of them at
least and until it has ``MIN_WORDS`` words.  A run is hashed to 64 bits, and all runs of
the corpus meet on their hash; in the order of (doc_id, text hash, place) every
occurrence but the first is a repeat, within a document as well as between documents.  A
sentence is removed if any repeated run covers it, with the white space after it; the
rest of the text stays as it is.

A passage set into the middle of a text has its first sentence run into the one before;
long sentences count as clauses so that enough of such a passage stays whole.  The word
bound keeps short boiler-plate lines, which meet by chance, out of it.

Runs are written once.  Their first occurrences are an aggregate that tasks begin before
the shuffle, so a run that a third of all documents share is a row a task there; those
found more than once are joined back to the occurrences, in a sort-merge join that
adaptive execution splits at a hot run.  A Bloom filter of bounded size keeps most
other occurrences out of that join, and another one keeps texts without a repeat out of
the join with the places to remove: these texts pass without a shuffle.  Past the
filters' bounds more rows take part in the joins, with the same result.

Defined results: null texts stay null, empty ones empty; an empty table gives no rows.
Very long texts are worked off in pieces at sentence ends (memory follows the longest
sentence).  Rows that share a doc_id and a text are one document and change alike; rows
that share only the doc_id are told apart by the text.  Ties can't occur: equal places
are one occurrence.  Rows with a null doc_id take no part and stay unchanged; other
doc_ids must be integers.  All columns of the input are returned, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm import bloom
from corvid.llm import textscan as ts
from corvid.storage import cut

SENTENCES = 2
MIN_WORDS = 30
#: A sentence of more words counts as its clauses.
LONG_WORDS = 25
#: Bytes of a text that are cut into sentences at a time.
PIECE = 8 << 20
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\r\x0b\x0c")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_PAUSE = np.zeros(256, bool)
_PAUSE[list(b",;:")] = True
_PLACE = 32


class _Words:
    """Where the words of a text are: what lies between edges can be trimmed and counted."""

    def __init__(self, buf: np.ndarray) -> None:
        solid = ~_BLANK[buf]
        self.place = np.flatnonzero(solid)
        self.begins = solid
        if len(buf) > 1:
            self.begins = solid.copy()
            self.begins[1:] &= ~solid[:-1]
        # the number of words that begin before each solid byte's successor
        self.count = np.cumsum(self.begins[self.place])

    def between(self, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of what lies between the edges and isn't blank: start, end, trimmed start and end, words."""
        nth = np.searchsorted(self.place, at)
        some = nth[1:] > nth[:-1]
        start, end, lo, hi = at[:-1][some], at[1:][some], nth[:-1][some], nth[1:][some] - 1
        # the first solid byte begins a word even if what comes before it ends in one
        return start, end, self.place[lo], self.place[hi] + 1, self.count[hi] - self.count[lo] + 1


def _sentences(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    n = len(buf)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    edge[1:] |= buf == 10
    space = np.flatnonzero(buf[1:] == 32) + 1
    before = buf[space - 1]
    # the space ends a sentence if there is a stop in the punctuation right before it, in the space's own document
    open_ = space[_PUNCT[before]]
    at, first = open_ - 1, None
    while len(open_):
        if first is None:
            first = offsets[np.searchsorted(offsets, open_, "right") - 1]
        stop = _STOP[buf[at]] & (at >= first)
        edge[open_[stop] + 1] = True
        go = ~stop & (at > first)
        open_, at, first = open_[go], at[go] - 1, first[go]
        go = _PUNCT[buf[at]]
        open_, at, first = open_[go], at[go], first[go]
    words = _Words(buf)
    found = words.between(np.flatnonzero(edge))
    start, end, _, _, count = found
    if (count > LONG_WORDS).any():
        pause = space[_PAUSE[before]]
        own = np.searchsorted(start, pause, "right") - 1
        # mark and space must be in the same long sentence
        inside = (own >= 0) & (pause - 1 >= start[own]) & (pause < end[own]) & (count[own] > LONG_WORDS)
        edge[pause[inside] + 1] = True
        found = words.between(np.flatnonzero(edge))
    return found


def sentences(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the sentences that aren't blank: start, end of the white space after, end, words; and where each document's begin."""
    if len(buf) <= PIECE:
        found = _sentences(buf, offsets)
        return *found, np.searchsorted(found[0], offsets)
    parts, at, size = [], 0, PIECE
    while at < len(buf):
        hi = min(len(buf), at + size)
        inner = np.unique(np.concatenate([[0], np.clip(offsets, at, hi) - at, [hi - at]]))
        part = _sentences(buf[at:hi], inner)
        done, to = len(part[0]), hi
        if hi < len(buf):
            # what the piece ends in may go on: it begins the next one, with whatever clauses the last sentence has
            line = _last_end(buf[at:hi], inner)
            if not line:
                size *= 2
                continue
            done, to = int(np.searchsorted(part[0], line)), at + line
        parts.append([x[:done] + (at if i < 4 else 0) for i, x in enumerate(part)])
        at, size = to, PIECE
    whole = [np.concatenate(x) for x in zip(*parts)]
    return *whole, np.searchsorted(whole[0], offsets)


def _last_end(buf: np.ndarray, inner: np.ndarray) -> int:
    """Where the last line, document or sentence ends before the end of the piece, if one does."""
    n = len(buf)
    ends = [int(e) for e in inner[1:-1][-1:]]
    lines = np.flatnonzero(buf[: n - 1] == 10)
    if len(lines):
        return max([int(lines[-1]) + 1, *ends])
    space = np.flatnonzero((buf[1 : n - 1] == 32) & _STOP[buf[: n - 2]]) + 2
    return max([int(space[-1]) if len(space) else 0, *ends])


def run_ends(words: np.ndarray, ends: np.ndarray, k: int, min_words: int) -> np.ndarray:
    """The sentence after the last of the run that begins at each; 0 if the document ends before. ends: the sentence after each one's document."""
    total = np.concatenate([[0], np.cumsum(words)])
    enough = np.searchsorted(total, total[:-1] + min_words, "left")
    end = np.maximum(np.arange(len(words)) + k, enough)
    return np.where(end <= ends, end, 0)


def span_keys(buf: np.ndarray, offsets: np.ndarray, k: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and first sentence of every run."""
    _, _, trimmed, last, count, first = sentences(buf, offsets)
    h = ts.mix(ts.span_hashes(buf, trimmed, last) + (last - trimmed).astype(np.uint64))
    n = np.diff(first)
    end = run_ends(count, np.repeat(first[1:], n), k, min_words)
    doc = np.repeat(np.arange(len(n)), n)
    index = np.arange(len(h)) - np.repeat(first[:-1], n)
    at = np.flatnonzero(end)
    run = ts.span_hashes(h, at, end[at]) + (end[at] - at).astype(np.uint64)
    return ts.mix(run).view(np.int64), doc[at], index[at]


def text_marks(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """31-bit hash of each text, to tell rows of one doc_id apart."""
    h = ts.mix(ts.span_hashes(buf, offsets[:-1], offsets[1:]) + np.diff(offsets).astype(np.uint64))
    return (h >> np.uint64(33)).astype(np.int64)


def spans(docs: DataFrame, k: int = SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """``span, doc_id, place`` of every run; place holds the text's mark and the index of the first sentence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for lo, hi, buf, offsets in ts.slices(batch.column("text")):
                key, doc, index = span_keys(buf, offsets, k, min_words)
                place = (text_marks(buf, offsets)[doc] << _PLACE) + index
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[lo:hi][doc]), pa.array(place)], ["span", "doc_id", "place"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null").mapInArrow(run, "span long, doc_id long, place long")


def _joined(found: DataFrame, first: DataFrame, filter_bytes: int) -> DataFrame:
    """The occurrences of the runs in ``first``; a filter keeps most others out of the join."""
    held = bloom.share(found.sparkSession, first.select(F.xxhash64("span")), first.count(), max_bytes=filter_bytes)
    return found.where(bloom.probe(held, F.xxhash64("span"))).join(first.hint("merge"), "span")


def occurrences(docs: DataFrame, k: int = SENTENCES, min_words: int = MIN_WORDS, filter_bytes: int = bloom.MAX_BYTES) -> DataFrame:
    """``span, doc_id, place, first_doc, first_place`` of every run that is found more than once."""
    found = cut(spans(docs, k, min_words), "sentence-runs")
    # copies of a row have the same place: they are one occurrence, so none of them comes after the first
    several = found.groupBy("span").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = cut(several.select("span", F.col("first.doc_id").alias("first_doc"), F.col("first.place").alias("first_place")), "first-runs")
    return _joined(found, first, filter_bytes)


def sharers(docs: DataFrame, k: int = SENTENCES, min_words: int = MIN_WORDS, filter_bytes: int = bloom.MAX_BYTES) -> DataFrame:
    """``span, doc_id, first_doc`` of every run that several documents share."""
    found = cut(spans(docs, k, min_words).select("span", "doc_id"), "sentence-runs")
    several = found.groupBy("span").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last")).where("first_doc <> last")
    return _joined(found, cut(several.select("span", "first_doc"), "first-runs"), filter_bytes)


def repeats(docs: DataFrame, k: int = SENTENCES, min_words: int = MIN_WORDS, filter_bytes: int = bloom.MAX_BYTES) -> DataFrame:
    """``doc_id, place`` of the runs that aren't the first of their kind."""
    found = occurrences(docs, k, min_words, filter_bytes)
    return found.where("doc_id <> first_doc or place <> first_place").select("doc_id", "place")


def without(buf: np.ndarray, places: np.ndarray, k: int, min_words: int) -> tuple[bytes, int]:
    """One text without the sentences that the runs at the places cover, and how many those are."""
    offsets = np.array([0, len(buf)])
    start, end, _, _, count, _ = sentences(buf, offsets)
    mark = text_marks(buf, offsets)[0]
    places = places[places >> _PLACE == mark] & ((1 << _PLACE) - 1)
    gone = np.zeros(len(start) + 1, np.int64)
    np.add.at(gone, places, 1)
    np.add.at(gone, run_ends(count, np.full(len(count), len(count)), k, min_words)[places], -1)
    gone = np.cumsum(gone)[:-1] > 0
    left, at = [], 0
    for lo, hi in zip(start[gone], end[gone]):
        left.append(buf[at:lo].tobytes())
        at = hi
    return b"".join([*left, buf[at:].tobytes()]), int(gone.sum())


def remove_repeats(docs: DataFrame, k: int = SENTENCES, min_words: int = MIN_WORDS, counted: str = "n_removed", filter_bytes: int = bloom.MAX_BYTES) -> DataFrame:
    """``docs`` without its repeated sentences, all columns, and in ``counted`` how many sentences went."""
    gone = repeats(docs, k, min_words, filter_bytes).repartition("doc_id").groupBy("doc_id").agg(F.collect_set("place").alias("__places"))
    by_doc = cut(gone.withColumnRenamed("doc_id", "__doc"), "repeated-runs")
    held = bloom.share(docs.sparkSession, by_doc.select(F.xxhash64("__doc")), by_doc.count(), max_bytes=filter_bytes)
    n = len(docs.columns)
    at, text_at = docs.columns.index("doc_id"), docs.columns.index("text")
    named = docs.toDF(*(f"c{i}" for i in range(n)))
    names = [*named.columns, "n"]
    own = F.col(f"c{at}").cast("long")
    # xxhash64 of null is a number
    may = bloom.probe(held, F.when(own.isNotNull(), F.xxhash64(own)))
    joined = named.where(may).join(by_doc.hint("merge"), own == F.col("__doc"), "left").drop("__doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            lists, text = columns.pop(), columns[text_at]
            count = np.zeros(batch.num_rows, np.int64)
            raw, offsets = ts.text_buffers(text)
            rows, new = [], []
            for i in np.flatnonzero(pc.and_(lists.is_valid(), text.is_valid()).to_numpy(zero_copy_only=False)):
                left, lost = without(raw[offsets[i] : offsets[i + 1]], lists[int(i)].values.to_numpy(), k, min_words)
                if lost:
                    count[i] = lost
                    rows.append(i)
                    new.append(left.decode("utf-8", "replace"))
            if rows:
                mask = np.zeros(batch.num_rows, bool)
                mask[rows] = True
                columns[text_at] = pc.replace_with_mask(text, pa.array(mask), pa.array(new, text.type))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(count)], names)

    changed = joined.mapInArrow(run, named.select("*").schema.add("n", "long"))
    return changed.unionAll(named.where(~may).withColumn("n", F.lit(0).cast("long"))).toDF(*docs.columns, counted)


#: The same with the runs' texts in place of their hashes, for a table whose doc_ids are unique and not null.
ORACLE_SQL = f"""
WITH whole AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '\\n', chr(10) || chr(1), 'g'), '([.!?][!-/:-@[-`{{-~]*) ', '\\1 ' || chr(1), 'g'), chr(1))) AS q, generate_subscripts(string_split(regexp_replace(regexp_replace(text, '\\n', chr(10) || chr(1), 'g'), '([.!?][!-/:-@[-`{{-~]*) ', '\\1 ' || chr(1), 'g'), chr(1)), 1) AS major FROM documents),
cut AS (SELECT doc_id, major, CASE WHEN len(regexp_split_to_array(regexp_replace(q, '^\\s+|\\s+$', '', 'g'), '\\s+')) > {LONG_WORDS} THEN string_split(regexp_replace(q, '([,;:]) ', '\\1 ' || chr(1), 'g'), chr(1)) ELSE [q] END AS p FROM whole),
piece AS (SELECT doc_id, major * 100000000 + minor AS i, p[minor] AS piece, regexp_replace(p[minor], '^\\s+|\\s+$', '', 'g') AS s FROM cut, unnest(range(1, len(p) + 1)) AS t(minor)),
sentence AS (SELECT *, len(regexp_split_to_array(s, '\\s+')) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place FROM piece WHERE s <> ''),
listed AS (SELECT doc_id, list(s ORDER BY place) AS s, list_prepend(0, list(total ORDER BY place)) AS total FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY place)::BIGINT AS total FROM sentence) GROUP BY doc_id),
ended AS (SELECT *, list_filter(range(place, least(place + {max(MIN_WORDS, SENTENCES)}, len(s)) + 1), lambda e: total[e + 1] - total[place] >= {MIN_WORDS} AND e - place + 1 >= {SENTENCES})[1] AS e FROM listed, unnest(range(1, len(s) + 1)) AS t(place)),
repeated AS (SELECT doc_id, place, e FROM ended WHERE e IS NOT NULL QUALIFY row_number() OVER (PARTITION BY array_to_string(s[place:e], chr(2)) ORDER BY doc_id, place) > 1),
gone AS (SELECT DISTINCT doc_id, j AS place FROM repeated, unnest(range(place, e + 1)) AS t(j)),
marked AS (SELECT p.doc_id, p.i, p.piece, g.place IS NOT NULL AS lost FROM piece p LEFT JOIN sentence s ON s.doc_id = p.doc_id AND s.i = p.i LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.place = s.place),
done AS (SELECT doc_id, coalesce(string_agg(piece, '' ORDER BY i) FILTER (WHERE NOT lost), '') AS text, count(*) FILTER (WHERE lost) AS n_removed FROM marked GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(x.text, '') END AS text, coalesce(x.n_removed, 0) AS n_removed FROM documents d LEFT JOIN done x ON x.doc_id = d.doc_id
"""
