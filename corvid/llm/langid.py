"""Language identification with string kernels.

The blended-spectrum presence kernel of two texts is the number of distinct
n-grams (1 to 3 bytes of the folded text) that both have, cosine-normalised by the
number of distinct n-grams of each.  Only n-grams of the landmark texts can be in a
product; others count in a text's norm, so what a text has of an unknown language takes
from its scores.  Landmarks and training texts are drawn from the labelled rows in the
order of a hash of doc_id, at most ``TRAIN_ROWS`` a language and of ``TRAIN_CHARS``
characters at most (the documented bounds of the fit, with at most ``MAX_LANGUAGES``
labels).  With K the landmarks' kernel matrix and C that of texts by landmarks, Nystrom
features are C K**-1/2; kernel ridge regression on them, one language against the rest,
gives weights on the landmarks.  A block of documents is scored by two matrix products:
presence by landmarks, then by weights.

Folding lower-cases ASCII and Latin-1 letters and makes every run of other ASCII
bytes one space, so digits, signs and line ends carry no language.

A document is rejected (``accepted`` false) if it has no letter, if fewer than
``MIN_KNOWN`` of its 3-grams are known, or if its best score is under ``MIN_SCORE``,
unless ``MIXED_KNOWN`` of its 3-grams are known: then its languages are known, though no
one of them claims it.  The rule is the same at every length of text.

Defined results: null, empty and letterless texts get a null language and score
and are rejected.  Very long texts are folded and looked up piece by piece, at spaces,
and scored whole.  Ties between languages go to the first in alphabetical order.
Rows with a null label aren't trained on but are scored; repeated rows are scored
each.  Without any labelled text, every document is rejected; an empty table gives no
rows.  ``identify`` reads ``doc_id``, ``text`` and the label column only;
``keep_identified`` returns all columns of its input, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvid.llm import textscan as ts

TRAIN_ROWS = 300
LANDMARKS = 40
RIDGE = 1e-2
MIN_SCORE = 0.1
MIN_KNOWN = 0.5
TRAIN_CHARS = 1 << 17
MAX_LANGUAGES = 40
#: Cells of a presence matrix that are held at a time.
CELLS = 1 << 24
MIXED_KNOWN = 0.9
_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def fold(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded texts, each with one space before and after, and their offsets."""
    n = len(buf)
    low = _FOLD[ts.lower(buf)]
    drop = np.zeros(n, bool)
    if n > 1:
        np.logical_and(low[1:] == 32, low[:-1] == 32, out=drop[1:])
    inner = offsets[(offsets > 0) & (offsets < n)]
    drop[inner] = False
    kept = np.concatenate([[0], np.cumsum(~drop)])[offsets]
    low = low[~drop]
    docs = len(offsets) - 1
    # one space before each document; the next document's serves as the last one's end
    out = np.full(len(low) + docs + 1, 32, np.uint8)
    out[np.arange(len(low)) + np.repeat(np.arange(1, docs + 1), np.diff(kept))] = low
    return out, kept + np.arange(docs + 1)


def gram_keys(text: np.ndarray, n: int) -> np.ndarray:
    """Key of the n bytes from each position that has as many."""
    m = max(0, len(text) - n + 1)
    key = np.zeros(m, np.int32)
    for j in range(n):
        key = (key << 8) | text[j : j + m]
    return key


class Space:
    """The n-grams of the landmarks: for each length a table from key to column + 1."""

    def __init__(self, keys: list[np.ndarray]) -> None:
        self.tables, self.size = [], 0
        for n, k in enumerate(keys, 1):
            table = np.zeros(1 << (8 * n), np.int32)
            table[k] = np.arange(self.size + 1, self.size + len(k) + 1)
            self.size += len(k)
            self.tables.append(table)

    def presence(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents by n-grams as 0 or 1, the share of known ones among each document's longest n-grams, and its number of distinct n-grams, known or not."""
        seen, known, long, strange = self._looked_up(buf, offsets) if len(buf) <= ts.PIECE or len(offsets) > 2 else self._by_pieces(buf)
        distinct = seen.sum(axis=1, dtype=np.int64) + np.bincount(strange >> 32, minlength=len(seen))
        return seen, known / np.maximum(long, 1), distinct

    def _looked_up(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Presence, known and all of the longest n-grams' places, and (document, length, key) codes of the distinct unknown n-grams."""
        text, first = fold(buf, offsets)
        docs, m = len(first) - 1, int(first[-1])
        seen = np.zeros((docs, self.size + 1), np.uint8)
        flat = seen.reshape(-1)
        # an n-gram belongs to the document it starts in and ends at the space after it at the latest
        left = np.diff(first)
        doc = np.repeat(np.arange(docs), left)
        row = doc * (self.size + 1)
        text = np.concatenate([text, np.full(len(self.tables), 32, np.uint8)])
        key = np.zeros(m, np.int32)
        hits, strange = np.zeros(docs, np.int64), []
        for n, table in enumerate(self.tables, 1):
            key <<= 8
            key |= text[n - 1 : n - 1 + m]
            column = table[key]
            new = column == 0
            for back in range(1, n - 1):
                # too close to the end: it would reach into the next document
                over = first[1:][left >= back] - back
                column[over], new[over] = 0, False
            if n == len(self.tables):
                hits = np.diff(np.concatenate([[0], np.cumsum(column > 0)])[first])
            at = np.flatnonzero(new)
            # a folded byte is never 0, so keys of other lengths differ
            strange.append(np.unique((doc[at] << 32) | key[at]))
            flat[column + row] = 1
        return seen[:, 1:], hits, left - (len(self.tables) - 2), np.concatenate(strange)

    def _by_pieces(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same of one long document; each piece begins with the last word of the one before."""
        seen, hits, places, strange, at, size = None, 0, 0, np.zeros(0, np.int64), 0, ts.PIECE
        while at < len(buf):
            hi = min(len(buf), at + size)
            after = hi
            if hi < len(buf):
                space = np.flatnonzero(_FOLD[buf[at:hi]] == 32)
                begins, ends = space[np.diff(space, prepend=-2) > 1], space[np.diff(space, append=len(buf) + 1) > 1]
                if len(begins) > 1:
                    hi, after = at + int(begins[-1]), at + int(ends[-2]) + 1
                elif size < 8 * ts.PIECE:
                    size *= 2
                    continue
                # else a word of many pieces is cut anywhere
            one, known, long, new = self._looked_up(buf[at:hi], np.array([0, hi - at]))
            seen = one if seen is None else seen | one
            hits, places, strange = hits + known, places + long, np.union1d(strange, new)
            at, size = after, ts.PIECE
        return seen, hits, places, strange


class Model:
    """What the scoring tasks need; its size is bounded by the training bounds."""

    def __init__(self, keys: list[np.ndarray], landmarks: np.ndarray, weights: np.ndarray, languages: list[str]) -> None:
        self.keys, self.landmarks, self.weights, self.languages = keys, landmarks, weights, languages
        self.space: Space | None = None

    def __getstate__(self) -> dict[str, Any]:
        return self.__dict__ | {"space": None}

    def block(self) -> int:
        """Documents that are scored at a time."""
        return max(1, CELLS // (sum(map(len, self.keys)) + 1))

    def score(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores by language, the known share of the 3-grams, and the number of distinct n-grams."""
        self.space = self.space or Space(self.keys)
        seen, share, n = self.space.presence(buf, offsets)
        kernel = (seen.astype(np.float32) @ self.landmarks) / np.sqrt(np.maximum(n, 1)).astype(np.float32)[:, None]
        return kernel @ self.weights, share, n


def training_rows(docs: DataFrame, label: str, rows: int, chars: int = TRAIN_CHARS) -> DataFrame:
    """``label, text`` of at most ``rows`` labelled documents a language, first by a hash of doc_id, of those with at most ``chars`` characters."""
    order = F.xxhash64("doc_id")
    w = Window.partitionBy("label").orderBy("order", "doc_id")
    picked = (
        docs.select(F.col(label).alias("label"), F.col("doc_id").alias("id"), order.alias("order"), F.length("text").alias("chars"))
        .where(F.expr("label is not null and id is not null") & (F.col("chars") <= chars))
        .select("label", "order", F.col("id").alias("doc_id"))
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= rows)
        .select("label", F.col("doc_id").alias("id"))
    )
    # bounded by rows x languages, so the side is small by construction
    texts = docs.select("doc_id", "text", F.col(label).alias("own")).where(F.length("text") <= chars)
    return texts.join(F.broadcast(picked.distinct()), (F.col("doc_id") == F.col("id")) & (F.col("own") == F.col("label")), "inner").select("label", "doc_id", "text")


def fit(docs: DataFrame, label: str = "lang", rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """The model, or None if no labelled text has a letter."""
    got = training_rows(docs, label, rows).toPandas()
    got = got[got.text.notna()].sort_values(["label", "doc_id", "text"]).drop_duplicates(["label", "doc_id"])
    return fit_local(got.label.tolist(), got.text.tolist(), landmarks, ridge)


def fit_local(labels: list[str], texts: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """The model from labelled texts in order; the first ``landmarks`` of each language become landmarks."""
    column = pa.array(texts, pa.string())
    raw, offsets = ts.text_buffers(column)
    has_letter = [bool(np.any(_FOLD[raw[a:b]] != 32)) for a, b in zip(offsets, offsets[1:])]
    use = [i for i, ok in enumerate(has_letter) if ok]
    if not use:
        return None
    labels, column = [labels[i] for i in use], column.take(pa.array(use))
    languages = sorted(set(labels))
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} labels; one model holds {MAX_LANGUAGES} at most")
    y = np.array([[1.0 if x == lang else -1.0 for lang in languages] for x in labels])
    marks, met = [], dict.fromkeys(languages, 0)
    for i, x in enumerate(labels):
        if met[x] < landmarks:
            met[x] += 1
            marks.append(i)
    grams: list[set[int]] = [set(), set(), set()]
    for _, _, buf, off in ts.slices(column.take(pa.array(marks)), 1):
        text, _ = fold(buf, off)
        for n in (1, 2, 3):
            grams[n - 1].update(np.unique(gram_keys(text, n)).tolist())
    keys = [np.array(sorted(g), np.int64) for g in grams]
    space = Space(keys)
    found = [space.presence(buf, off) for _, _, buf, off in ts.slices(column, rows=max(1, CELLS // (space.size + 1)))]
    unit = np.concatenate([seen for seen, _, _ in found]).astype(np.float32)
    unit /= np.sqrt(np.maximum(np.concatenate([n for *_, n in found]), 1.0))[:, None]
    own = unit[marks].astype(np.float64)
    values, vectors = np.linalg.eigh(own @ own.T)
    good = values > values.max() * 1e-9
    root = vectors[:, good] / np.sqrt(values[good])
    features = (unit @ own.T.astype(np.float32)).astype(np.float64) @ root
    # every language weighs the same, however many rows it has
    per = np.array([1.0 / labels.count(x) for x in labels])[:, None] / len(languages)
    gram = features.T @ (features * per) + ridge * np.eye(features.shape[1]) / len(labels)
    weights = root @ np.linalg.solve(gram, features.T @ (y * per))
    return Model(keys, own.T.astype(np.float32), weights.astype(np.float32), languages)


def decide(model: Model | None, column: pa.Array, min_score: float, min_known: float) -> tuple[list[str | None], np.ndarray, np.ndarray]:
    """Language, score (NaN where none) and acceptance of each text."""
    n = len(column)
    langs: list[str | None] = [None] * n
    scores, accepted = np.full(n, np.nan), np.zeros(n, bool)
    if model is None:
        return langs, scores, accepted
    for lo, hi, buf, offsets in ts.slices(column, rows=model.block()):
        got, known, _ = model.score(buf, offsets)
        got = np.round(got.astype(np.float64), 4)
        letters = np.diff(np.concatenate([[0], np.cumsum(_FOLD[buf] != 32)])[offsets]) > 0
        best = got.argmax(axis=1)
        top = got[np.arange(hi - lo), best]
        for i in np.flatnonzero(letters):
            langs[lo + i] = model.languages[best[i]]
        scores[lo:hi] = np.where(letters, top, np.nan)
        accepted[lo:hi] = letters & (known >= min_known) & ((top >= min_score) | (known >= MIXED_KNOWN))
    return langs, scores, accepted


def identify(docs: DataFrame, label: str = "lang", rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS, ridge: float = RIDGE, min_score: float = MIN_SCORE, min_known: float = MIN_KNOWN) -> DataFrame:
    """``doc_id, language, score, accepted`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, label, rows, landmarks, ridge))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, accepted = decide(shared.value, batch.column("text"), min_score, min_known)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, mask=np.isnan(scores)), pa.array(accepted)], ["doc_id", "language", "score", "accepted"])

    schema = docs.select("doc_id").schema.add("language", "string").add("score", "double").add("accepted", "boolean")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def keep_identified(docs: DataFrame, label: str = "lang", rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS, ridge: float = RIDGE, min_score: float = MIN_SCORE, min_known: float = MIN_KNOWN) -> DataFrame:
    """The accepted rows of ``docs`` with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, label, rows, landmarks, ridge))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            accepted = decide(shared.value, batch.column(at), min_score, min_known)[2]
            yield batch.filter(pa.array(accepted))

    return docs.mapInArrow(run, docs.schema)
