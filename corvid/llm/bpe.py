"""Byte-pair encoding and decoding with exact ids.

A text is split by the vocabulary's pattern; each piece is encoded by dynamic
programming over its prefixes.  An automaton with suffix links gives all tokens
that end at each position, longest first.  The last token of a prefix's encoding
is unique: the one that is compatible with the last token of the prefix before
it, where a pair is compatible if merging by rank would keep the border between
them.  Back-pointers from the end give the ids, equal to those of merging by rank
and linear in the length of the piece however long it is.

Pieces recur, so each Python worker keeps the ids of those it has met, in a table
that is emptied when it holds ``CACHE_PIECES`` or ``CACHE_BYTES``; this changes time, not
results.  The vocabulary is fixed in size and broadcast; its file's path is a parameter,
read by the driver, and workers know it by its content.

Defined results: a null text has null ids and 0 tokens; an empty one has no ids.
Very long texts are split a few million characters at a time, between two words, where
the pattern has a border whatever comes before.  Ties can't occur: a text has one
encoding.  Repeated rows are encoded each, a null doc_id is kept; an empty table gives no
rows.  Only ``doc_id`` and ``text`` are read; other columns, of any name, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corvid.llm import textscan as ts

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same pattern for texts below U+0240, where the classes are short ranges; the standard module is faster.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-\u023f", "0-9²³¹¼-¾", r" \t\n\r\x0b\x0c\x85\xa0"
_LATIN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: UTF-8 of U+0240 and above has a byte of at least this.
_BEYOND_LATIN = 0xC9
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHE_PIECES = 100_000
CACHE_BYTES = 8 << 20
#: Characters of a text that are split at a time.
PART = 4 << 20
CACHE_PAIRS = 200_000


def load(path: str = VOCABULARY) -> list[bytes]:
    """Tokens in the order of their ranks, which are their ids."""
    rows = (line.split() for line in Path(path).read_bytes().splitlines() if line)
    ranks = {int(rank): base64.b64decode(token) for token, rank in rows}
    return [ranks[i] for i in range(len(ranks))]


def splits(tokens: list[bytes]) -> tuple[list[int], list[int], dict[tuple[int, int], int]]:
    """The two tokens that each token is merged from (itself twice for a byte), and the merges."""
    ids = {t: i for i, t in enumerate(tokens)}
    left, right = list(range(len(tokens))), list(range(len(tokens)))
    merges: dict[tuple[int, int], int] = {}
    for i, t in enumerate(tokens):
        for cut in range(len(t) - 1, 0, -1):
            a, b = ids.get(t[:cut], i), ids.get(t[cut:], i)
            if a < i and b < i and compatible(a, b, left, right, merges):
                left[i], right[i] = a, b
                merges[a, b] = i
                break
    return left, right, merges


def compatible(a: int, b: int, left: list[int], right: list[int], merges: dict[tuple[int, int], int]) -> bool:
    """Whether merging by rank keeps the border between tokens a and b.

    Both tokens are taken apart at the border, the later merge first; a merge
    across the border that ranks before the one just undone would have come
    first and removed the border.
    """
    bound = 1 << 60
    while True:
        across = merges.get((a, b))
        if across is not None and across < bound:
            return False
        # the token made later is undone first; a byte can't be undone, so then it's the other's turn
        undo_a = a > b
        if undo_a and right[a] == a:
            undo_a = False
            if right[b] == b:
                return True
        elif not undo_a and left[b] == b:
            undo_a = True
            if right[a] == a:
                return True
        if undo_a:
            bound, a = a, right[a]
        else:
            bound, b = b + 1, left[b]


class Encoder:
    """One worker's automaton and tables."""

    def __init__(self, tokens: list[bytes], left: list[int], right: list[int], merges: dict[tuple[int, int], int], pattern: str = PATTERN) -> None:
        import ahocorasick
        import regex

        self.tokens, self.left, self.right, self.merges = tokens, left, right, merges
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.length = [len(t) for t in tokens]
        self.find = regex.compile(pattern).findall
        self.between = regex.compile(r"(?<=\p{L}) (?=\p{L})").search if pattern == PATTERN else None
        self.find_latin = re.compile(_LATIN).findall if pattern == PATTERN else self.find
        self.suffixes = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.suffixes.add_word(t.decode("latin-1"), i)
        self.suffixes.make_automaton()
        self.fits: dict[int, bool] = {}
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_length = np.array(self.length, np.int64)
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.forget()

    def forget(self) -> None:
        self.flat, self.used, self.held = np.zeros(1 << 16, np.int32), 0, 0
        self.start, self.count = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64)
        encoder = self

        class Known(dict):
            def __missing__(self, piece: str) -> int:
                self[piece] = k = len(self)
                encoder.held += len(piece)
                encoder.learn(k, encoder.piece(piece.encode()))
                return k

        self.known = Known()

    def learn(self, k: int, ids: list[int]) -> None:
        if k >= len(self.start):
            self.start, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[k], self.count[k] = self.used, len(ids)
        self.used += len(ids)

    def piece(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        if len(self.fits) > CACHE_PAIRS:
            self.fits.clear()
        last = [-1] * (len(piece) + 1)
        length, fits, done = self.length, self.fits, 0
        for end, token in self.suffixes.iter(piece.decode("latin-1")):
            end += 1
            if end == done:
                continue
            before = end - length[token]
            if before:
                prev = last[before]
                key = prev << 20 | token
                ok = fits.get(key)
                if ok is None:
                    fits[key] = ok = compatible(prev, token, self.left, self.right, self.merges)
                if not ok:
                    continue
            last[end] = token
            done = end
        out, at = [], len(piece)
        while at:
            out.append(last[at])
            at -= length[last[at]]
        out.reverse()
        return out

    def encode(self, texts: list[str | None], latin: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's ids begin; latin: no character is above U+023F."""
        find = self.find_latin if latin else self.find
        if len(self.known) > CACHE_PIECES or self.held > CACHE_BYTES:
            self.forget()
        pieces: list[str] = []
        done: list[np.ndarray] = []
        first, n = np.zeros(len(texts) + 1, np.int64), 0
        for i, text in enumerate(texts):
            for part in self.parts(text or ""):
                got = find(part)
                n += len(got)
                pieces += got
                if len(pieces) > 1 << 20:
                    done.append(np.fromiter(map(self.known.__getitem__, pieces), np.int32, len(pieces)))
                    pieces = []
            first[i + 1] = n
        k = np.concatenate([*done, np.fromiter(map(self.known.__getitem__, pieces), np.int32, len(pieces))])
        ids, ends = gathered(self.flat, self.start, self.count, k)
        return ids, ends[first]

    def parts(self, text: str) -> Iterator[str]:
        """The text, a long one in parts that end between two words."""
        at = 0
        while self.between and len(text) - at > PART and (m := self.between(text, at + PART)):
            yield text[at : m.start()]
            at = m.start()
        if at < len(text):
            yield text[at:] if at else text

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids, and where each id's bytes begin."""
        return gathered(self.token_bytes, self.token_start, self.token_length, ids)


def gathered(flat: np.ndarray, start: np.ndarray, count: np.ndarray, which: np.ndarray, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """The parts ``flat[start[w] : start[w] + count[w]]`` of all w one after another, and where each begins; a block of them at a time."""
    ends = np.zeros(len(which) + 1, np.int64)
    np.cumsum(count[which], out=ends[1:])
    out = np.empty(ends[-1], flat.dtype)
    for lo in range(0, len(which), block):
        part = which[lo : lo + block]
        own = ends[lo : lo + len(part) + 1] - ends[lo]
        out[ends[lo] : ends[lo + len(part)]] = flat[spread(start[part], count[part], own)]
    return out, ends


def spread(start: np.ndarray, n: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... n[0] of them, then those of start[1] and so on."""
    return np.repeat(start - ends[:-1], n) + np.arange(ends[-1])


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _encoder(shared: Any) -> Encoder:
    """This worker's encoder for a broadcast vocabulary."""
    mark, pattern, tokens, left, right, merges = shared.value
    if (mark, pattern) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[mark, pattern] = Encoder(tokens, left, right, merges, pattern)
    return _ENCODERS[mark, pattern]


def _shared(df: DataFrame, path: str, pattern: str) -> Any:
    tokens = load(path)
    mark = hashlib.sha256(b"".join(len(t).to_bytes(4, "big") + t for t in tokens)).hexdigest()
    return df.sparkSession.sparkContext.broadcast((mark, pattern, tokens, *splits(tokens)))


def encode(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, n_tokens, token_ids, round_trip`` of every document; round_trip says that decoding gives the text's bytes."""
    shared = _shared(docs, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(shared)
        for batch in batches:
            for lo, hi, buf, _ in ts.slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                texts = part.column("text")
                ids, first = own.encode(texts.to_pylist(), latin=bool(len(buf)) and int(buf.max()) < _BEYOND_LATIN)
                back, at = own.decode(ids)
                same = np.ones(hi - lo, bool)
                if not np.array_equal(back, buf):
                    ends = at[first]
                    same = np.array([back[a:b].tobytes() == (t or "").encode() for a, b, t in zip(ends, ends[1:], texts.to_pylist())], bool)
                null = texts.is_null().to_numpy(zero_copy_only=False)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids, pa.int32()), mask=pa.array(null))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(first)), lists, pa.array(same)], ["doc_id", "n_tokens", "token_ids", "round_trip"])

    schema = docs.select("doc_id").schema.add("n_tokens", "long").add("token_ids", T.ArrayType(T.IntegerType())).add("round_trip", "boolean")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, text`` from ``doc_id, token_ids``; null ids give a null text, and so do ids that aren't in the vocabulary."""
    shared = _shared(encoded, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(shared)
        top = len(own.tokens)
        for batch in batches:
            texts = []
            for ids in batch.column("token_ids"):
                got = np.array(ids.as_py(), dtype=object) if ids.is_valid else None
                known = got is not None and all(i is not None and 0 <= i < top for i in got)
                texts.append(own.decode(got.astype(np.int64))[0].tobytes().decode("utf-8", "replace") if known else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "token_ids").mapInArrow(run, encoded.select("doc_id").schema.add("text", "string"))
