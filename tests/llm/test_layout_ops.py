"""Packing, URL filter and sharding against plain versions and hard rows."""

from __future__ import annotations

from collections import Counter, defaultdict

import data
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import connect, rows
from pyspark.sql import functions as F

from corvid.llm import bloom, bpe, packing, queries, sharding, spans, urls
from corvid.storage import cut


# --- packing ---
def plain_bins(lengths: list[int], capacity: int) -> list[tuple[int, ...]]:
    """Best-two-fit, one bin at a time, over a plain list."""
    left = sorted(lengths, reverse=True)
    out = []
    while left:
        bin_, gap = [], capacity
        for n in list(left):
            if n <= gap:
                bin_.append(n)
                left.remove(n)
                gap -= n
        if gap:
            room, smallest = gap + bin_[-1], bin_[-1]
            best = max(((left[i] + left[j], left[i], i, j) for i in range(len(left)) for j in range(i + 1, len(left)) if left[i] + left[j] <= room), default=None, key=lambda b: b[:2])
            if best and best[0] > smallest:
                i, j = best[2:]
                pair = [left[i], left[j]]
                for n in pair:
                    left.remove(n)
                left = sorted([*left, smallest], reverse=True)
                bin_[-1:] = pair
        out.append(tuple(sorted(bin_, reverse=True)))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=40), st.integers(30, 60))
def test_plan_is_best_two_fit(lengths, capacity):
    table, bins = packing.plan(Counter(lengths), capacity)
    made = defaultdict(list)
    for n, k in Counter(lengths).items():
        for rank in range(k):
            r = table[n][np.searchsorted(table[n][:, 0], rank, "right") - 1]
            made[int(r[1] + (rank - r[0]) // r[2])].append(n)
    got = [tuple(sorted(made[b], reverse=True)) for b in range(bins)]
    assert got == plain_bins(lengths, capacity)
    assert all(sum(b) <= capacity for b in got)


def check_packed(packed, sizes, capacity):
    """Every token of every document has one place, no bin is overfull, slots are 0, 1, 2 ..."""
    bins, by_doc = defaultdict(list), defaultdict(list)
    for r in packed:
        bins[r["bin_id"]].append(r)
        by_doc[r["doc_id"]].append((r["start"], r["n_tokens"]))
    for b in bins.values():
        assert sum(r["n_tokens"] for r in b) <= capacity and sorted(r["slot"] for r in b) == list(range(len(b)))
    assert sorted(bins) == list(range(len(bins)))
    want = Counter()
    for i, n in sizes:
        for s in range(0, n, capacity):
            want[i, s, min(capacity, n - s)] += 1
    assert Counter((i, s, n) for i, v in by_doc.items() for s, n in v) == want
    return bins


def test_words_of_long_texts_are_counted_by_pieces(monkeypatch):
    import pyarrow as pa
    from corvid.llm import textscan as ts

    texts = [data.prose(1, 40), " two  words ", "", "x" * 90, data.prose(2, 30).replace(" ", "\t ")]
    for piece in (7, 50):
        monkeypatch.setattr(ts, "PIECE", piece)
        for t in texts:
            assert packing.word_counts(pa.array([t])).tolist() == [len(t.split())]


def test_packing_over_a_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sizes = [(r["doc_id"], len(r["text"].split())) for r in df.collect()]
    bins = check_packed(packing.pack(df).collect(), sizes, packing.CAPACITY)
    lengths = [min(packing.CAPACITY, n - s) for _, n in sizes for s in range(0, n, packing.CAPACITY)]
    assert [tuple(sorted((r["n_tokens"] for r in bins[b]), reverse=True)) for b in sorted(bins)] == plain_bins(lengths, packing.CAPACITY)
    assert sum(n for _, n in sizes) / (len(bins) * packing.CAPACITY) > 0.97


def test_packing_by_a_column_and_hard_rows(spark, hard, clashing, none):
    lengths = spark.createDataFrame([(1, 5), (1, 5), (2, None), (3, -1), (None, 25), (4, 0), (5, 10)], "doc_id long, size long")
    check_packed(packing.pack(lengths, 10, "size").collect(), [(1, 5), (1, 5), (None, 25), (5, 10)], 10)
    for df in (hard, clashing):
        check_packed(packing.pack(df, 64).collect(), [(r[0], len((r[1] or "").split())) for r in data.hard_rows()], 64)
    # a shard for every two pieces of a length
    check_packed(packing.pack(spark.range(50).selectExpr("id as doc_id", "5 + id % 3 as size"), 20, "size", shard_rows=2).collect(), [(i, 5 + i % 3) for i in range(50)], 20)
    assert packing.pack(none).count() == 0
    with pytest.raises(ValueError, match="positive"):
        packing.pack(none, 0)


def test_packed_tokens_go_back_to_the_texts(spark, hard, none):
    """From the bins' token ids to every text, exactly; rows that share a doc_id keep their own."""
    packed = packing.pack_tokens(hard, 256)
    tokens = Counter((r["doc_id"], tuple(r["token_ids"] or ())) for r in bpe.encode(hard).collect() if r["n_tokens"])
    got = defaultdict(list)
    for r in packed.collect():
        assert len(r["token_ids"]) == r["n_tokens"]
        got[r["doc_id"], r["piece"]].append(r)
    for (doc, ids), k in tokens.items():
        parts = [[tuple(r["token_ids"]) for r in got[doc, p]].count(ids[p * 256 : (p + 1) * 256]) for p in range(-(-len(ids) // 256))]
        assert min(parts) >= k
    rows = packing.sequences(packed).collect()
    assert sum(len(r["token_ids"]) for r in rows) == sum(len(ids) * k for (_, ids), k in tokens.items()) and max(len(r["token_ids"]) for r in rows) <= 256
    assert packing.pack_tokens(none).count() == 0


# --- URLs ---
@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://www.Example.com:80/a/B/?b=2&a=1&UTM_source=x#top", "example.com/a/B?a=1&b=2"),
        ("https://user@example.com/", "example.com"),
        ("//cdn.example.com/x", "cdn.example.com/x"),
        (" example.com/x?ref=1 ", "example.com/x"),
        ("https://example.com/p?reference=1", "example.com/p?reference=1"),
        ("", None),
        ("  ", None),
        (None, None),
    ],
)
def test_canonical(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(urls.canonical(F.col("u"))).first()[0] == want


def test_keys(spark):
    assert spark.range(1).select(urls.keys(F.lit("a.b.example.com/x"))).first()[0] == ["a.b.example.com/x", "a.b.example.com", "b.example.com", "example.com"]


LISTED = ["http://bad.com/", "https://worse.org/page?x=1&utm_medium=mail", None, "", "http://bad.com", "http://m.bad.com/deep/page"]
PAGES = [(1, "https://www.bad.com/anything"), (2, "http://m.bad.com/deep/page#x"), (3, "http://notbad.com/"), (4, "worse.org/page?x=1"), (5, "http://worse.org/page?x=2"), (6, None), (7, ""), (1, "https://www.bad.com/anything"), (None, "http://x.bad.com")]


@pytest.mark.parametrize("limit", [urls.MAX_BYTES, -1])
@pytest.mark.parametrize("bits", [16, 1])
def test_url_filter(spark, limit, bits):
    """With one bit an entry most probes are false positives, which the join removes; a filter that isn't broadcast stays a table."""
    pages = spark.createDataFrame([(*r, "x") for r in PAGES], "page_id long, url string, entry string")
    got = urls.url_filter(pages, spark.createDataFrame([(u, 1) for u in LISTED], "url string, canonical int"), bits, limit).collect()
    assert Counter((r["page_id"], r["url"], r["entry"]) for r in got) == Counter(
        [(1, PAGES[0][1], "bad.com")] * 2 + [(2, PAGES[1][1], "m.bad.com/deep/page"), (3, PAGES[2][1], None), (4, PAGES[3][1], "worse.org/page?x=1"), (5, PAGES[4][1], None), (6, None, None), (7, "", None), (None, PAGES[8][1], "bad.com")]
    )
    assert all(r["listed"] == (r["entry"] is not None) for r in got)


def test_url_filter_of_nothing(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string")
    assert urls.url_filter(pages, spark.createDataFrame([], "url string")).where("listed").count() == 0
    assert urls.url_filter(spark.createDataFrame([], "page_id long, url string"), pages).count() == 0


def test_bloom_filter_misses_nothing_and_passes_few(spark):
    held = spark.range(20_000).select(F.concat(F.lit("host"), "id", F.lit(".com/")).alias("entry"))
    table = bloom.build(held.select(F.xxhash64("entry")), 20_000)
    hashes = lambda df: np.array([r[0] for r in df.select(F.xxhash64("entry")).collect()])
    assert bloom.may_contain(table, hashes(held)).all()
    others = spark.range(20_000, 60_000).select(F.concat(F.lit("host"), "id", F.lit(".com/")).alias("entry"))
    assert bloom.may_contain(table, hashes(others)).mean() < 0.005


def test_a_bounded_filter_loses_nothing(spark):
    held = spark.range(5000).select(F.xxhash64("id").alias("h"))
    shared = bloom.share(spark, held, 5000, max_bytes=1024)
    assert shared.value.nbytes == 1024
    assert held.where(bloom.probe(shared, F.col("h"))).count() == 5000
    nulls = spark.createDataFrame([(None,), (None,)], "h long")
    assert nulls.where(bloom.probe(shared, F.col("h"))).count() == 0
    nothing = bloom.share(spark, nulls, 0)
    assert held.where(bloom.probe(nothing, F.col("h"))).count() == 0


def test_a_filter_that_stays_a_table_passes_few(spark):
    entries = spark.range(3000).select(F.concat(F.lit("host"), "id", F.lit(".com")).alias("entry"))
    others = spark.range(3000, 9000).select(F.xxhash64(F.concat(F.lit("host"), "id", F.lit(".com"))).alias("h"))
    blocks = bloom.blocks_for(3000, 16, None)
    assert urls._in_filter_table(entries.select(F.xxhash64("entry").alias("h")), entries, blocks).count() == 3000
    assert urls._in_filter_table(others, entries, blocks).count() < 60


def test_urls_are_those_of_the_sql(spark):
    for d in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert rows(queries.op6_urls(spark, d).toPandas()) == rows(connect(d).sql(queries.ORACLE_SQL["op6_urls"]).df())


# --- sharding ---
@settings(max_examples=200, deadline=None)
@given(st.integers(2, 6), st.integers(0, 10**6))
def test_quotas_keep_sizes_within_bounds(n, seed):
    rng = np.random.RandomState(seed)
    sizes = rng.randint(80, 121, n)
    wish = rng.randint(0, 30, (n, n))
    np.fill_diagonal(wish, 0)
    wish = np.minimum(wish, sizes[:, None] // n)
    lo, hi = 90, 110
    x = sharding.quotas(wish, sizes, lo, hi)
    after = sizes + x.sum(axis=0) - x.sum(axis=1)
    assert (x >= 0).all() and (x <= wish).all()
    assert (after <= np.maximum(hi, sizes)).all() and (after >= np.minimum(lo, sizes)).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=8), st.integers(0, 300))
def test_water_level(sizes, more):
    sizes = np.array(sizes)
    level = sharding.water_level(sizes, more)
    assert level.sum() == sizes.sum() + more and (level >= sizes).all()
    raised = level[level > sizes]
    assert not len(raised) or raised.max() - raised.min() <= 1 and (level[level == sizes] >= raised.max() - 1).all()


def linked(seed=0, families=40, size=6):
    return [(f * 100 + k, data.prose(2000 + f, 5) + " " + data.prose(5000 + f * 100 + k, 5)) for f in range(families) for k in range(size)] + [(90_000 + i, data.prose(9000 + i, 5)) for i in range(160)]


def plain_links(docs):
    """Links by runs of sentences, counted in plain Python."""
    runs = defaultdict(set)
    for i, t in docs:
        s = [x.strip() for line in t.split("\n") for x in line.replace(". ", ".\0").split("\0") if x.strip()]
        for a in range(len(s)):
            for e in range(a + spans.SENTENCES, len(s) + 1):
                if sum(len(x.split()) for x in s[a:e]) >= spans.MIN_WORDS:
                    runs[tuple(s[a:e])].add(i)
                    break
    out = Counter()
    for ids in runs.values():
        for i in ids - {min(ids)}:
            out[min(ids), i] += 1
            out[i, min(ids)] += 1
    return out


def plain_round(labels, edges, turn, shards, lo, hi, spark):
    """One round over dictionaries; hashes are the session's, so that the same documents are active."""
    rows_ = spark.createDataFrame([(i,) for i in labels], "doc_id long").select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(turn // 2)), F.lit(2)).alias("a"), F.pmod(F.xxhash64("doc_id", F.lit("bin")), F.lit(sharding.BINS)).alias("b"), F.pmod(F.xxhash64("doc_id", F.lit("lot")), F.lit(1 << 31)).alias("lot")).collect()
    near = defaultdict(Counter)
    for (a, b), w in edges.items():
        near[a][labels[b]] += w
    asked = []
    for r in rows_:
        i = r["doc_id"]
        if r["a"] != turn % 2:
            continue
        votes = near[i]
        votes[labels[i]] += 0
        target = min(votes, key=lambda s: (-votes[s], s))
        gain = votes[target] - votes[labels[i]]
        if gain > 0:
            level = min(sharding.GAIN_LEVELS - 1, int(np.floor(np.log2(gain))))
            asked.append(((sharding.GAIN_LEVELS - 1 - level) * sharding.BINS + r["b"], r["lot"], i, labels[i], target))
    wish = np.zeros((shards, shards), np.int64)
    for *_, a, b in asked:
        wish[a, b] += 1
    sizes = np.bincount(list(labels.values()), minlength=shards)
    allowed = sharding.quotas(wish, sizes, lo, hi)
    moved = 0
    for a in range(shards):
        for b in range(shards):
            mine = [x for x in asked if x[3:] == (a, b)]
            left = allowed[a, b]
            for place, cell in sorted(Counter(p for p, *_ in mine).items()):
                share = min(1.0, left / cell)
                for p, lot, i, _, _ in mine:
                    if p == place and (share == 1 or lot < int((share - 3 * np.sqrt(share * (1 - share) / cell)) * (1 << 31))):
                        labels[i] = b
                        moved += 1
                if share < 1:
                    break
                left -= cell
    return moved


def cut_share(own, edges):
    return sum(w for (a, b), w in edges.items() if own[a] != own[b]) / sum(edges.values())


def test_sharding_is_the_plain_propagation(spark):
    docs, shards, slack = linked(), 8, 0.1
    got = {r["doc_id"]: r["shard"] for r in sharding.shard(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), shards, 7, slack).collect()}
    edges = plain_links(docs)
    nodes = sorted({a for a, _ in edges})
    first = spark.createDataFrame([(i,) for i in nodes], "doc_id long").select("doc_id", sharding._first_shard(shards).alias("s")).collect()
    labels = {r["doc_id"]: r["s"] for r in first}
    start = dict(labels)
    for turn in range(7):
        plain_round(labels, edges, turn, shards, *sharding.limits(len(nodes), len(docs) - len(nodes), shards, slack), spark)
    assert {i: got[i] for i in nodes} == labels
    assert cut_share(got, edges) < 0.5 * cut_share(start, edges)
    sizes = Counter(got.values())
    assert len(got) == len(docs) and max(sizes.values()) - min(sizes.values()) <= max(1, 0.2 * len(docs) / shards)


def test_sharding_converges_and_joins_what_is_linked(spark):
    """100 pairs and 20 groups of 8, with room: all that is linked ends in one shard, in less than the bound of rounds."""
    docs = [(2 * p + k, data.prose(20_000 + p, 5)) for p in range(100) for k in (0, 1)] + [(1000 + g * 8 + k, data.prose(30_000 + g, 5)) for g in range(20) for k in range(8)]
    docs += [(5000 + i, f"plain text {i}") for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["shard"] for r in sharding.shard(df, 8).collect()}
    assert cut_share(got, plain_links(docs)) == 0
    sizes = Counter(got.values())
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 1
    edges = cut(sharding.links(df), "test-links")
    labels = cut(edges.select(F.col("src").alias("doc_id")).distinct().withColumn("shard", sharding._first_shard(8)), "test-labels")
    assert sharding.propagate(labels, edges, 8, sharding.ROUNDS, 0, 126)[1] < sharding.ROUNDS


def test_a_cell_larger_than_its_quota_moves_in_part():
    import pandas as pd

    cells = pd.DataFrame({"shard": [0, 0, 1], "target": [1, 1, 0], "place": [3, 9, 4], "count": [10, 100_000, 2]})
    got = {r[:2]: r[2:] for r in sharding.admitted(cells, np.array([[0, 50_010], [1, 0]]))}
    place, lot = got[0, 1]
    assert place == 9 and 0.48 < lot / sharding._LOT < 0.5
    assert (1, 0) not in got


def test_sharding_stands_hard_rows(hard, clashing, none):
    want = {r[0] for r in data.hard_rows()} - {None}
    for df in (hard, clashing):
        got = sharding.shard(df, 3).collect()
        assert sorted(r["doc_id"] for r in got) == sorted(want)
        assert max(Counter(r["shard"] for r in got).values()) - min(Counter(r["shard"] for r in got).values()) <= 1
    assert sharding.shard(none, 3).count() == 0
    assert {r["shard"] for r in sharding.shard(hard, 1).collect()} == {0}
    with pytest.raises(ValueError, match="a shard"):
        sharding.shard(none, 0)
