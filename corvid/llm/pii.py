"""Format-preserving pseudonyms for personal data.

Validated values are permuted within their own format by a keyed Feistel network,
so the same value becomes the same pseudonym in every document and a pseudonym is
again a valid value of that format:

============ ==================================== =====================================
kind         accepted when                        permuted
============ ==================================== =====================================
email        local@domain.tld                     letters and digits of the local part
iban         length and mod-97 hold               account part; check digits follow
date         a calendar date, y-m-d or d/m/y      the day, within 1900-2099 or outside it
ipv4         four numbers up to 255               all 32 bits
ssn          area, group and serial are issued    index among the issued numbers
phone        10 to 15 digits in a phone's shape   digits after the country code
card         13 to 19 digits with a Luhn digit    all but the Luhn digit, which follows
secret       32 to 64 hex digits, both sorts      all digits, base 16
============ ==================================== =====================================

The network works on Z_a x Z_b with a*b just above the size of the format and walks
along its cycle back into the format, so it is a permutation of it and
``reveal_value`` inverts it.  Values that fail validation stay as they are.

A run of digit groups may hold a value beside other numbers (a card and its expiry
date), so a longest match that fails is searched inside: first for cards in the usual
groups, then for a shorter end, then for cards at any group borders, then from the next
group on.
Documents without a digit or an @ aren't searched: no kind can occur in them.

The key is a secret of any length (it is hashed to the network's 64 bytes, so every byte
counts).  It comes with the call or from the session's setting ``spark.corvid.pseudonym.key``;
where there is neither, the application draws one, so values are linked within it and
nobody can invert them afterwards.  None is held in the code.

Defined results: null texts stay null, empty ones empty, with 0 replacements; an empty
table gives no rows.  Very long texts are searched whole.  Where two kinds match from the
same place the first in the table counts, and matches don't overlap: the one that begins
first is replaced.  Repeated rows change alike.  ``pseudonymise`` keeps all columns of its
input, whatever their names; ``report`` reads doc_id and text only.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
import secrets
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from corvid.llm import textscan as ts

#: The session's setting that holds the key.
SETTING = "spark.corvid.pseudonym.key"
ROUNDS = 10
_DRAWN: dict[str, bytes] = {}


def session_key(spark: SparkSession, key: bytes | None = None) -> bytes:
    """The key that counts: the given one, the session's, or the one drawn for this application."""
    if key is None:
        named = spark.conf.get(SETTING, None)
        key = named.encode() if named else _DRAWN.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(64))
    if not key:
        raise ValueError("the key is empty")
    return key


@lru_cache(maxsize=16)
def _network_key(key: bytes) -> bytes:
    return hashlib.blake2b(key).digest()

PATTERN = re.compile(
    r"(?P<email>(?<![\w.%+-])[\w%+-][\w.%+-]*@(?:[\w-]+\.)+[A-Za-z]{2,}(?![\w-]))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<date>(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}(?P<sep>[/.])[0-9]{1,2}(?P=sep)[0-9]{4})(?![\w/-]|\.[0-9]))"
    r"|(?P<ipv4>(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w]|\.[0-9]))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?!\w)"
    r"|(?<![\w+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?!\w)"
    r"|(?<![\w.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\w-]))"
    r"|(?P<card>(?<![\w-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-]))"
    r"|(?P<secret>(?<!\w)(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?!\w))"
    r"|(?P<digits>(?<![\w-])[0-9](?:[ -]?[0-9]){19,}(?![\w-]))"
)
#: Kinds whose match may hold several numbers; digits is nothing itself.
_SEVERAL = ("iban", "phone", "card", "digits")
_CARD_MOST = 2 * 19
_RUN = re.compile(r"[0-9]+(?:[ -][0-9]+)*")
_CARD_GROUPS = re.compile(r"[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1(?:[0-9]{1,4}|[0-9]{4}\1[0-9]{3})|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5}")
_ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7), "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)]
_SORT = {c: a for a in _ALPHABETS for c in a}
_FIRST, _LAST = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
_DATES = dt.date.max.toordinal()


def permute(x: int, size: int, key: bytes, tweak: str, inside: Callable[[int], bool] = lambda _: True, back: bool = False) -> int:
    """The keyed permutation of 0 .. size - 1, or of those of them that are ``inside``; ``back`` inverts it."""
    if size < 2:
        return x
    a = isqrt(size - 1) + 1
    b = -(-size // a)
    while True:
        left, right = x % a, x // a
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            half = right if i % 2 == 0 else left
            f = int.from_bytes(hashlib.blake2b(f"{tweak}|{size}|{i}|{half}".encode(), key=_network_key(key)).digest(), "big")
            if back:
                f = -f
            if i % 2 == 0:
                left = (left + f) % a
            else:
                right = (right + f) % b
        x = right * a + left
        if x < size and inside(x):
            return x


def _characters(text: str, kind: str, key: bytes, back: bool) -> str:
    """Permute the characters of known alphabets, each within its own; the rest stays."""
    value, size = 0, 1
    for c in text:
        if a := _SORT.get(c):
            value, size = value * len(a) + a.index(c), size * len(a)
    value = permute(value, size, key, f"{kind}|{len(text)}", back=back)
    out = []
    for c in reversed(text):
        if a := _SORT.get(c):
            value, at = divmod(value, len(a))
            c = a[at]
        out.append(c)
    return "".join(reversed(out))


def _refill(text: str, digits: str) -> str:
    """The text with its digits replaced in order."""
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in text)


def luhn_digit(digits: str) -> str:
    """The digit that makes digits + digit hold."""
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(digits)))
    return str(-total % 10)


def _mod97(country: str, rest: str, check: str) -> int:
    return int("".join(str(int(c, 36)) for c in rest + country + check)) % 97


def _email(t: str, key: bytes, back: bool) -> str:
    local, at, domain = t.rpartition("@")
    return _characters(local, "email", key, back) + at + domain


def _iban(t: str, key: bytes, back: bool) -> str:
    plain = t.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _mod97(plain[:2], plain[4:], plain[2:4]) != 1:
        return t
    rest = _characters(plain[4:], f"iban{plain[:2]}", key, back)
    new = iter(plain[:2] + f"{98 - _mod97(plain[:2], rest, '00'):02d}" + rest)
    return "".join(c if c == " " else next(new) for c in t)


def _date(t: str, key: bytes, back: bool) -> str:
    sep = next(c for c in t if not c.isdigit())
    parts = [int(x) for x in t.split(sep)]
    month_first = False
    try:
        if sep == "-":
            day = dt.date(*parts)
        else:
            try:
                day = dt.date(parts[2], parts[1], parts[0])
            except ValueError:
                day, month_first = dt.date(parts[2], parts[0], parts[1]), True
    except ValueError:
        return t
    n = day.toordinal()
    near = _FIRST <= n <= _LAST

    def to_date(x: int) -> dt.date:
        return dt.date.fromordinal(x + _FIRST if near else x + 1 if x + 1 < _FIRST else x + 2 + _LAST - _FIRST)

    x = n - _FIRST if near else n - 1 if n < _FIRST else n - 2 - (_LAST - _FIRST)
    size = _LAST - _FIRST + 1 if near else _DATES - (_LAST - _FIRST + 1)
    # a date that only reads as month/day/year must stay one
    new = to_date(permute(x, size, key, "date" + "md" * month_first, (lambda y: to_date(y).day > 12) if month_first else (lambda _: True), back))
    if sep == "-":
        return new.isoformat()
    wide = all(len(p) == 2 for p in t.split(sep)[:2])
    first, second = (new.month, new.day) if month_first else (new.day, new.month)
    return f"{first:02d}{sep}{second:02d}{sep}{new.year:04d}" if wide else f"{first}{sep}{second}{sep}{new.year:04d}"


def _ipv4(t: str, key: bytes, back: bool) -> str:
    parts = [int(x) for x in t.split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in t.split(".")):
        return t
    x = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ipv4", back=back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _ssn(t: str, key: bytes, back: bool) -> str:
    area, group, serial = map(int, t.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return t
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x, serial = divmod(permute(x, 898 * 99 * 9999, key, "ssn", back=back), 9999)
    area, group = divmod(x, 99)
    area += 1
    return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


def _phone(t: str, key: bytes, back: bool) -> str:
    digits = re.sub(r"\D", "", t)
    if not 10 <= len(digits) <= 15:
        return t
    code = len(re.match(r"\+(\d{1,3}(?=[ .(-])|\d{2})", t)[1]) if t[0] == "+" else 0
    rest = digits[code:]
    # ten digits without a code are a number of country 1, and get the pseudonym that they get after +1
    country = digits[:code] or ("1" if len(rest) == 10 else "")
    new = permute(int(rest), 10 ** len(rest), key, f"phone{country}|{len(rest)}", back=back)
    return _refill(t, digits[:code] + f"{new:0{len(rest)}d}")


def _card(t: str, key: bytes, back: bool) -> str:
    digits = re.sub(r"\D", "", t)
    if luhn_digit(digits[:-1]) != digits[-1]:
        return t
    n = len(digits) - 1
    new = f"{permute(int(digits[:-1]), 10**n, key, f'card{n}', back=back):0{n}d}"
    return _refill(t, new + luhn_digit(new))


def _secret(t: str, key: bytes, back: bool) -> str:
    if t.isdigit() or t.isalpha():
        return t
    # a result of digits or letters only would no longer be one
    new = permute(int(t, 16), 16 ** len(t), key, f"secret{len(t)}", lambda x: not (f"{x:0{len(t)}x}".isdigit() or f"{x:0{len(t)}x}".isalpha()), back)
    out = f"{new:0{len(t)}x}"
    return out if t == t.lower() else out.upper()


_KINDS = {"email": _email, "iban": _iban, "date": _date, "ipv4": _ipv4, "ssn": _ssn, "phone": _phone, "card": _card, "secret": _secret, "digits": lambda t, key, back: t}


@lru_cache(maxsize=100_000)
def pseudonym(kind: str, value: str, key: bytes) -> str:
    """The pseudonym of a value, or the value itself if it isn't valid."""
    return _KINDS[kind](value, key, False)


def reveal_value(kind: str, value: str, key: bytes) -> str:
    """The value behind a pseudonym; a date in d/m/y may come back with leading zeros."""
    return _KINDS[kind](value, key, True)


def _cards(text: str, lo: int, hi: int, end: int, usual: bool) -> list[tuple[int, int]]:
    """Where cards are that begin in lo .. hi at a border of digit groups: those in the usual groups, or any that begin at lo or after a hyphen (others are found from the next group on)."""
    out: list[tuple[int, int]] = []
    for run in _RUN.finditer(text, lo, min(end, hi + _CARD_MOST)):
        groups = [g.span() for g in re.finditer("[0-9]+", run[0])]
        spans = [(run.start() + a, run.start() + b) for a, b in groups]
        for i, (start, _) in enumerate(spans):
            if start >= hi:
                break
            before = text[start - 1 : start]
            if out and start < out[-1][1] or before.isalnum() or before == "_" or not usual and start != lo and before != "-":
                continue
            n, ends = 0, []
            for a, stop in spans[i:]:
                n += stop - a
                if n > 19:
                    break
                after = text[stop : stop + 1]
                if n >= 13 and not (after.isalnum() or after == "_"):
                    ends.append(stop)
            for stop in reversed(ends):
                digits = re.sub(r"[ -]", "", text[start:stop])
                if luhn_digit(digits[:-1]) == digits[-1] and (not usual or _CARD_GROUPS.fullmatch(text, start, stop)):
                    out.append((start, stop))
                    break
    return out


def _shorter(m: re.Match[str], key: bytes) -> list[tuple[int, int, str]]:
    """The longest valid beginning of an IBAN's or a phone number's match, if there is one."""
    text, start = m.string, m.start()
    for stop in reversed([g.start() for g in re.finditer("[ .-]", m[0])]):
        part = PATTERN.match(text, start, start + stop)
        if part and part.end() == start + stop and part.lastgroup == m.lastgroup and (new := pseudonym(m.lastgroup, part[0], key)) != part[0]:
            return [(start, part.end(), new)]
    return []


def _found(text: str, lo: int, hi: int, key: bytes) -> Iterator[tuple[int, int, str]]:
    """Start, end and pseudonym of the values between lo and hi."""
    at = lo
    while m := PATTERN.search(text, at, hi):
        kind, (start, at) = m.lastgroup or "digits", m.span()
        if (new := pseudonym(kind, m[0], key)) != m[0]:
            yield start, at, new
            continue
        if kind not in _SEVERAL:
            continue
        held = [(a, b, pseudonym("card", text[a:b], key)) for a, b in _cards(text, start, at, hi, True)]
        held = held or (_shorter(m, key) if kind in ("iban", "phone") else [])
        held = held or [(a, b, pseudonym("card", text[a:b], key)) for a, b in _cards(text, start, at, hi, False)]
        at = start + (not held)
        for a, b, new in held:
            if at < a:
                yield from _found(text, at, a, key)
            yield a, b, new
            at = b


def replace(text: str, key: bytes) -> tuple[str, int]:
    """The text with pseudonyms, and how many."""
    out, at, n = [], 0, 0
    for start, stop, new in _found(text, 0, len(text), key):
        n += new != text[start:stop]
        out += [text[at:start], new]
        at = stop
    return "".join([*out, text[at:]]), n


_MAY = np.zeros(256, np.uint8)
_MAY[[*range(48, 58), ord("@")]] = 1


def replace_column(column: pa.Array, key: bytes) -> tuple[pa.Array, np.ndarray]:
    """The column with pseudonyms, and how many in each row."""
    counts = np.zeros(len(column), np.int64)
    rows, new = [], []
    for lo, hi, buf, offsets in ts.slices(column):
        # a slice of one text may be long
        hits = np.concatenate([[0], np.cumsum(_MAY[buf], dtype=np.int32)])[offsets] if hi - lo > 1 else np.array([0, any(_MAY[buf[at : at + ts.PIECE]].any() for at in range(0, len(buf), ts.PIECE))])
        for i in np.flatnonzero(np.diff(hits)) + lo:
            text, n = replace(column[i].as_py(), key)
            if n:
                counts[i] = n
                rows.append(i)
                new.append(text)
    if rows:
        mask = np.zeros(len(column), bool)
        mask[rows] = True
        column = pc.replace_with_mask(column, pa.array(mask), pa.array(new, column.type))
    return column, counts


def pseudonymise(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """The documents, all columns, with pseudonyms in ``text``."""
    secret = session_key(docs.sparkSession, key)
    at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = replace_column(columns[at], secret)[0]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)


def report(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """``doc_id, text, n_replaced`` of every document."""
    secret = session_key(docs.sparkSession, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, n = replace_column(batch.column("text"), secret)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), text, pa.array(n)], ["doc_id", "text", "n_replaced"])

    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id", "text").schema.add("n_replaced", "long"))
