"""Array kernels shared by the text operators.

A record batch is cut into slices of about a megabyte of UTF-8; each slice is
one byte array with document offsets, and every kernel works on the whole slice
at once.  A document is never split between slices, so a slice can be as long as the
longest document; one longer than ``PIECE`` is hashed and cut into tokens piece by piece,
with a token that goes over a cut put together again, so that the working memory is that
of a piece and 16 bytes a token.

Defined results: null texts count as empty; a slice has ``SLICE_ROWS`` documents at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SLICE_ROWS = 1 << 14
#: Bytes of a long text that are worked on at a time.
PIECE = 8 << 20
SPACE, WORD, PUNCT = 0, 1, 2
#: Base of the polynomial hash; odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)

_CLASS = np.full(256, PUNCT, np.uint8)
_CLASS[list(b" \t\n\r\x0b\x0c")] = SPACE
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = WORD
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def slices(column: pa.Array, size: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of each slice."""
    raw, offsets = text_buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        hi = min(hi, n, lo + rows)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def lower(buf: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters, in a copy."""
    out = _LOWER[buf]
    if len(buf) > 1:
        wide = np.flatnonzero(buf[:-1] == 0xC3) + 1
        after = buf[wide]
        out[wide[(after >= 0x80) & (after <= 0x9E) & (after != 0x97)]] += 32
    return out


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, _INVERSE):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for at least n positions."""
    return _powers(max(SLICE_BYTES + 1, 1 << int(n).bit_length()))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of value[s + j] * BASE**j modulo 2**64 of each span [s, e)."""
    n = len(values)
    if n > SLICE_BYTES:
        return _long_span_hashes(values, starts, ends)
    up, down = powers(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * up[:n], out=prefix[1:])
    return (prefix[ends] - prefix[starts]) * down[starts]


def _long_span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = SLICE_BYTES) -> np.ndarray:
    """The same with the prefix sums of one block at a time."""
    up, down = powers(block)
    places = [np.asarray(starts), np.asarray(ends)]
    order = [np.argsort(x, kind="stable") for x in places]
    sums_, scales = [np.zeros(len(x), np.uint64) for x in places], np.zeros(len(starts), np.uint64)
    mask = (1 << 64) - 1
    jump, back = pow(BASE, block, 1 << 64), pow(_INVERSE, block, 1 << 64)
    carry, scale, unscale = 0, 1, 1
    for lo in range(0, len(values) + 1, block):
        part = values[lo : lo + block]
        prefix = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part.astype(np.uint64) * up[: len(part)], out=prefix[1:])
        for x, o, into in zip(places, order, sums_):
            a, b = np.searchsorted(x, [lo, lo + block], sorter=o)
            here = o[a:b]
            into[here] = np.uint64(carry) + np.uint64(scale) * prefix[x[here] - lo]
            if into is sums_[0]:
                scales[here] = np.uint64(unscale) * down[x[here] - lo]
        carry = (carry + scale * int(prefix[-1])) & mask
        scale, unscale = (scale * jump) & mask, (unscale * back) & mask
    return (sums_[1] - sums_[0]) * scales


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def runs(buf: np.ndarray, offsets: np.ndarray, punctuation: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of word bytes (and of punctuation), and where each document's runs begin."""
    kind = _CLASS[buf]
    if not punctuation:
        kind = (kind == WORD).view(np.uint8)
    n = len(buf)
    edge = np.ones(n + 1, bool)
    if n > 1:
        np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
    edge[offsets] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    keep = kind[starts] != SPACE if n else np.zeros(0, bool)
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(starts, offsets)


def tokens(buf: np.ndarray, offsets: np.ndarray, punctuation: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hashes of the lower-cased tokens, and where each document's tokens begin."""
    if len(buf) > PIECE:
        return _long_tokens(buf, offsets, punctuation)
    low = lower(buf)
    starts, ends, first = runs(low, offsets, punctuation)
    return span_hashes(low, starts, ends), first


def _long_tokens(buf: np.ndarray, offsets: np.ndarray, punctuation: bool) -> tuple[np.ndarray, np.ndarray]:
    """The same, a piece at a time."""
    hashes, begins = [], []
    lo, n = 0, len(buf)
    # the token that the piece before ended in: its hash and length
    open_hash, open_size = 0, 0
    while lo < n:
        hi = min(n, lo + PIECE)
        while hi < n and hi > lo + 1 and buf[hi] & 0xC0 == 0x80:
            hi -= 1
        part = lower(buf[lo:hi])
        inner = np.unique(np.concatenate([[0], np.clip(offsets, lo, hi) - lo, [hi - lo]]))
        starts, ends, _ = runs(part, inner, punctuation)
        h = span_hashes(part, starts, ends)
        size = int(ends[-1] - starts[-1]) if len(ends) and ends[-1] == hi - lo else 0
        if open_size and len(starts) and starts[0] == 0 and _CLASS[buf[lo]] == _CLASS[buf[lo - 1]] and lo not in offsets:
            whole = (open_hash + pow(BASE, open_size, 1 << 64) * int(h[0])) & ((1 << 64) - 1)
            hashes[-1][-1] = np.uint64(whole)
            size += open_size if len(starts) == 1 and size else 0
            h, starts = h[1:], starts[1:]
        if len(h):
            hashes.append(h)
            begins.append(starts + lo)
        open_hash, open_size = int(hashes[-1][-1]) if hashes and size else 0, size
        lo = hi
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(begins), offsets)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each document; 0 where it has none."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return total[first[1:]] - total[first[:-1]]
