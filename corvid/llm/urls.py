"""URL filter: a blocked Bloom filter in front of an exact hash join.

URLs are made canonical by one expression on both sides: without scheme, user, ``www.``,
port, fragment, tracking parameters and the slash at the end; the host in lower case
(path and parameters keep theirs: they may differ by it); the other parameters sorted.
A page is looked up under its canonical URL and under its host with each of the host's
parent domains of two labels or more, so an entry that is a bare host lists everything
below it.

The entries' hashes are held in the filter of :mod:`corvid.llm.bloom`, with
``BITS_PER_KEY`` bits an entry at any length of the list.  Up to ``MAX_BYTES`` it is
broadcast, and pages that no key lets pass go on without a shuffle.  A longer filter stays
a table of its blocks: the pages' keys, as hashes, are joined with their blocks, which
only keys that the list may hold survive.  Either way only these are joined with the list
itself by hash, which removes false positives, and only ``page_id`` and ``url`` are read, once.

Defined results: a null or blank URL has a null canonical URL and isn't listed.  Very
long URLs are treated as any other.  Repeated rows give a row each.  If several entries
match, the longest is reported (they are parts of one host, so none ties).  Null entries
and repeated ones don't count; an empty list lists nothing; an empty table of pages gives
no rows.  Other columns of the tables, of any name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.llm import bloom
from corvid.storage import cut

BITS_PER_KEY = bloom.BITS_PER_KEY
MAX_BYTES = bloom.MAX_BYTES
TRACKING = "(utm_[a-z_]*|ref|gclid|fbclid|msclkid|sessionid|sid)"
#: Words in a host's name by which the query's list of reported URLs is made.
REPORTED_WORDS = "casino|bets|pills|adult|spam|ads-"


def canonical(url: Column) -> Column:
    """The canonical form; null for a null or blank URL."""
    plain = F.regexp_replace(F.regexp_replace(url, r"^\s+|\s+$", ""), "#.*$", "")
    plain = F.regexp_replace(plain, "^([A-Za-z][A-Za-z0-9+.-]*:)?//", "")
    place = F.regexp_replace(plain, r"\?.*$", "")
    host = F.lower(F.regexp_replace(F.regexp_replace(place, "/.*$", ""), "^.*@", ""))
    host = F.regexp_replace(F.regexp_replace(host, ":[0-9]*$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(place, "^[^/]*", ""), "/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(plain, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(f"^(?i){TRACKING}(=|$)"))), "&")
    whole = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(whole != "", whole)


def keys(canonical_url: Column) -> Column:
    """The canonical URL, its host and the host's parent domains; null for a null URL."""
    labels = F.split(F.regexp_replace(canonical_url, "[/?].*$", ""), r"\.")
    n = F.size(labels)
    parents = F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n), "."))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(canonical_url), parents))


def reported_urls(pages: DataFrame) -> DataFrame:
    """``url`` of the pages whose host's name has a reported word: the list that the query filters by."""
    host = F.regexp_extract(F.lower("url"), "^[a-z]+://([^/?#]*)", 1)
    return pages.where(host.rlike(REPORTED_WORDS)).select("url")


def _needed(blocks: int) -> object:
    """For each hash its block in the filter and the bits that must be set there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, words = bloom.bits(batch.column("h").to_numpy(), blocks)
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(block), *(pa.array(words[:, i].view(np.int64)) for i in range(4))], ["h", "block", *(f"need{i}" for i in range(4))])

    return run


def _in_filter_table(hashes: DataFrame, entries: DataFrame, blocks: int) -> DataFrame:
    """Those of the hashes ``h`` (distinct) that a filter which stays a table lets pass."""
    needed = hashes.mapInArrow(_needed(blocks), "h long, block long, need0 long, need1 long, need2 long, need3 long")
    table = bloom.filter_table(entries.select(F.xxhash64("entry")), blocks)
    held = [F.col(w).bitwiseAND(F.col(f"need{i}")) == F.col(f"need{i}") for i, w in enumerate(bloom.WORDS)]
    return needed.join(table, "block").where(held[0] & held[1] & held[2] & held[3]).select("h")


def url_filter(pages: DataFrame, listed: DataFrame, bits_per_key: int = BITS_PER_KEY, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``page_id, url, canonical, listed, entry`` of every page; listed: a table with a column ``url``."""
    entries = cut(listed.select(canonical(F.col("url").cast("string")).alias("entry")).where("entry is not null").distinct(), "url-entries")
    n = entries.count()
    blocks = bloom.blocks_for(n, bits_per_key, None)
    url = F.col("url").cast("string")
    # the canonical form is dear: it is made once
    seen = cut(pages.select("page_id", url.alias("url"), canonical(url).alias("canonical")), "url-canonical")
    small = blocks * 32 <= max_bytes
    if small:
        held = bloom.share(pages.sparkSession, entries.select(F.xxhash64("entry")), n, bits_per_key, None)

        @F.pandas_udf("boolean")
        def may(hashes: pd.Series) -> pd.Series:
            flat, size = (np.concatenate(hashes.to_list()), hashes.map(len).to_numpy()) if len(hashes) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            hit = np.zeros(len(hashes), bool)
            hit[np.repeat(np.arange(len(hashes)), size)[bloom.may_contain(held.value, flat.astype(np.int64))]] = True
            return pd.Series(hit)

        passes = F.col("canonical").isNotNull() & may(F.transform(keys(F.coalesce(F.col("canonical"), F.lit(""))), lambda k: F.xxhash64(k)))
        hits = seen.where(passes)
    else:
        hits = seen.where("canonical is not null")
    keyed = hits.select(F.col("canonical").alias("of"), F.explode(keys(F.col("canonical"))).alias("key")).distinct()
    if not small:
        hashed = keyed.withColumn("h", F.xxhash64("key"))
        keyed = hashed.join(_in_filter_table(hashed.select("h").distinct(), entries, blocks), "h").select("of", "key")
    found = (
        keyed.join(entries, F.col("key") == F.col("entry"))
        .groupBy("of")
        .agg(F.max(F.struct(F.length("entry").alias("n"), "entry")).alias("best"))
        .select("of", F.col("best.entry").alias("entry"))
    )
    rows = hits if small else seen
    joined = rows.join(found, F.col("canonical") == F.col("of"), "left").select("page_id", "url", "canonical", F.col("entry").isNotNull().alias("listed"), "entry")
    if not small:
        return joined
    return joined.unionByName(seen.where(~passes).select("page_id", "url", "canonical", F.lit(False).alias("listed"), F.lit(None).cast("string").alias("entry")))


_CANONICAL_SQL = """
    SELECT page_id, url, plain, regexp_replace(place, '^[^/]*', '') AS path0, list_sort(list_filter(string_split(regexp_extract(plain, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(?i){tracking}(=|$)'))) AS params,
        regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(place, '/.*$', ''), '^.*@', '')), ':[0-9]*$', ''), '^www\\.', '') AS host
    FROM (SELECT *, regexp_replace(plain, '\\?.*$', '') AS place FROM (
        SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(url, '^\\s+|\\s+$', '', 'g'), '#.*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*:)?//', '') AS plain FROM pages))
""".format(tracking=TRACKING)

ORACLE_SQL = f"""
WITH cut AS ({_CANONICAL_SQL}),
seen AS (SELECT page_id, url, host, nullif(host || regexp_replace(path0, '/+$', '') || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END, '') AS canonical FROM cut),
entries AS (SELECT DISTINCT canonical AS entry FROM seen WHERE regexp_matches(regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1), '{REPORTED_WORDS}') AND canonical IS NOT NULL),
keyed AS (SELECT DISTINCT canonical, unnest(list_prepend(canonical, CASE WHEN len(string_split(host, '.')) >= 2 THEN list_transform(range(1, len(string_split(host, '.'))), lambda i: array_to_string(string_split(host, '.')[i:], '.')) ELSE [] END)) AS key FROM seen WHERE canonical IS NOT NULL),
found AS (SELECT canonical, max({{'n': length(entry), 'entry': entry}}).entry AS entry FROM keyed JOIN entries ON key = entry GROUP BY canonical)
SELECT page_id, url, s.canonical, f.entry IS NOT NULL AS listed, f.entry FROM seen s LEFT JOIN found f ON s.canonical = f.canonical
"""
