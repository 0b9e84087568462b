"""Identifiers made from content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    """The 32-bit polynomial hash of base 31 over UTF-16 units, signed, for texts in the basic plane."""
    h = F.aggregate(F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long")), F.lit(0).cast("long"), lambda a, c: F.pmod(a * 31 + c, F.lit(1 << 32).cast("long")))
    return F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)


def legacy_id(text: Column) -> Column:
    """``doc-`` and the hexadecimal of the absolute content hash."""
    return F.concat(F.lit("doc-"), F.lower(F.hex(F.abs(content_hash(text)))))


def content_id(text: Column) -> Column:
    """``doc-`` and the first 32 digits of SHA-256: the default, free of collisions at any size."""
    return F.concat(F.lit("doc-"), F.substring(F.sha2(text, 256), 1, 32))
