"""SimHash, spot signatures and sentence spans against brute force and hard rows."""

from __future__ import annotations

import itertools
from collections import defaultdict

import data
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvid.llm import components, simhash, spans, spotsigs
from corvid.llm import textscan as ts
from corvid.storage import cut

IDS = {r[0] for r in data.hard_rows()} - {None}


def unite(pairs, nodes):
    """Least member of each node's component."""
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def corpus(copies: int = 12):
    """Texts with exact copies, near copies and others."""
    rows = [(i, data.prose(1000 + i, 14 + i % 9, "de" if i % 4 == 0 else "en")) for i in range(80)]
    for g in range(8):
        base = rows[g][1]
        rows += [(200 + g * 20 + k, base if k % 3 == 0 else data.edited(base, g * 50 + k)) for k in range(copies)]
    return rows


# --- components ---
@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components_are_those_of_union_find(spark, pairs):
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = unite(pairs, {x for p in pairs for x in p})
    assert got == {n: r for n, r in want.items() if n != r}


def test_components_of_a_chain_and_nulls(spark):
    pairs = [(i, i + 1) for i in range(200)] + [(None, 3), (4, None), (7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 201)}


# --- SimHash ---
def plain_fingerprint(text: str) -> int | None:
    words = ts.tokens(*ts.text_buffers(pa.array([text])))[0]
    if not len(words):
        return None
    if len(words) < 2:
        return -1
    shingles = words[:-1] * np.uint64(ts.BASE) + words[1:]
    bits = 0
    for w, salt in enumerate(simhash._SALTS):
        votes = np.unpackbits(ts.mix(shingles ^ np.uint64(salt)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)
        for b in range(64):
            bits |= int(votes[b] * 2 > len(shingles)) << (64 * w + b)
    return bits


def test_fingerprints_are_the_plain_ones():
    texts = [data.prose(i, 1 + i % 5) for i in range(20)] + ["", None, "two words", data.prose(99, 9000)]
    words, n = simhash.fingerprints(*ts.text_buffers(pa.array(texts, pa.string())))
    for t, w, k in zip(texts, words, n):
        want = plain_fingerprint(t or "")
        assert k == (0 if want is None else max(1, len(ts.tokens(*ts.text_buffers(pa.array([t])))[0]) - 1))
        if want is not None:
            assert sum(int(x) << (64 * i) for i, x in enumerate(w)) == want


def test_simhash_groups_are_brute_force(spark):
    rows = corpus()
    prints = {i: plain_fingerprint(t) for i, t in rows}
    want = unite([(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= simhash.DISTANCE], prints)
    got = {r["doc_id"]: r for r in simhash.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert {i: r["group_id"] for i, r in got.items()} == want
    assert all(r["keep"] == (r["group_id"] == i) for i, r in got.items())
    assert sum(r["keep"] for r in got.values()) < len(rows) - 80


@pytest.mark.parametrize("list_rows", [simhash.LIST_ROWS, 50])
def test_simhash_recall_at_the_full_distance(spark, list_rows):
    """Random fingerprints with partners at every distance up to the limit, in lists filtered again before or after the shuffle."""
    assert (simhash.depth(30_000, list_rows) > 0) == (list_rows < 60)
    rng = np.random.RandomState(3)
    n = 30_000
    words = rng.randint(0, 1 << 62, (n, 4)).astype(np.uint64) * np.uint64(4) + rng.randint(0, 4, (n, 4)).astype(np.uint64)
    pairs = []
    for i in range(400):
        flip = rng.permutation(256)[: 20 + i * 33 // 400]
        w = words[i].copy()
        for b in flip:
            w[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        words[n - 1 - i] = w
        pairs.append((n - 1 - i, i))
    table = pa.table({"id": np.arange(n)} | {f: words[:, k].view(np.int64) for k, f in enumerate(simhash.WORDS)})
    df = spark.createDataFrame(table.to_pandas()).repartition(4)
    found = {(max(r), min(r)) for r in simhash.links(df, n, list_rows=list_rows).collect()}
    assert len(found & set(pairs)) / len(pairs) >= 0.9
    assert found <= set(pairs)


def test_long_lists_are_searched_whole():
    rng = np.random.RandomState(5)
    base = rng.randint(0, 1 << 62, (1, 4)).astype(np.uint64)
    words = np.repeat(base, 300, axis=0)
    for i in range(300):
        words[i, i % 4] ^= np.uint64(1) << np.uint64(i % 60)
    ids = np.arange(300)
    for leaf in (16, 1000):
        links = np.concatenate(simhash.compare(ids, words, 0, 1, simhash.DISTANCE, leaf))
        assert set(unite(links.tolist(), range(300)).values()) == {0}
    assert set(unite(simhash._stars_in_blocks(words, simhash.DISTANCE).tolist(), range(300)).values()) == {0}


def test_lists_longer_than_planned_lose_no_pair(spark):
    """One repetition of a hot list: every pair at the full distance that the first filter leaves together is found."""
    rng = np.random.RandomState(11)
    n = 6000
    words = rng.randint(0, 1 << 62, (n, 4)).astype(np.uint64) * np.uint64(4) + rng.randint(0, 4, (n, 4)).astype(np.uint64)
    strip = simhash._strip(0, 0)
    rest = np.setdiff1d(np.arange(simhash.BITS), strip)
    for b in strip:
        words[:, b // 64] |= np.uint64(1) << np.uint64(b % 64)
    pairs = []
    for i in range(100):
        words[n - 1 - i] = words[i]
        for b in rng.permutation(rest)[: simhash.DISTANCE]:
            words[n - 1 - i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        pairs.append((n - 1 - i, i))
    table = pa.table({"id": np.arange(n)} | {f: words[:, k].view(np.int64) for k, f in enumerate(simhash.WORDS)})
    # a low recall asks for one repetition
    assert simhash.repetitions(n, recall=0.05) == 1
    found = {(max(r), min(r)) for r in simhash.links(spark.createDataFrame(table.to_pandas()), n, recall=0.05).collect()}
    assert set(pairs) <= found


@pytest.mark.parametrize("op", [simhash, spotsigs])
def test_groups_stand_hard_rows(op, hard, clashing, none):
    for df in (hard, clashing):
        rows = op.groups(df).collect()
        assert {r["doc_id"] for r in rows} == IDS and len(rows) == len(IDS)
        got = {r["doc_id"]: r["group_id"] for r in rows}
        assert got[1] == got[2] == 1 and all(got[i] == i for i in IDS - {1, 2, 3})
    assert op.groups(none).count() == 0


def test_simhash_filter_keeps_rows_and_columns(hard, clashing, none):
    for df in (hard, clashing):
        out = simhash.deduplicate(df)
        assert out.columns == df.columns
        left = [r["doc_id"] for r in out.select("doc_id").collect()]
        assert sorted(i for i in left if i is not None) == sorted(IDS - {2, 3}) and left.count(None) == 2
    assert simhash.deduplicate(none).count() == 0


# --- spot signatures ---
def plain_signatures(text: str) -> frozenset:
    words = (text or "").lower().replace(".", " ").split()
    content = [i for i, w in enumerate(words) if w not in spotsigs.ANCHORS]
    out = set()
    for i, w in enumerate(words):
        if w in spotsigs.ANCHORS:
            after = [c for c in content if c > i][: (spotsigs.CHAIN - 1) * spotsigs.DISTANCE + 1 : spotsigs.DISTANCE]
            if len(after) == spotsigs.CHAIN:
                out.add((w, *(words[c] for c in after)))
    return frozenset(out) if len(out) >= spotsigs.MIN_SIGNATURES or not words else frozenset([tuple(words)])


def test_signatures_are_the_plain_ones():
    texts = [data.prose(i, 1 + i, "de" if i % 2 else "en") for i in range(25)] + ["", "the of", "word"]
    sig, first = spotsigs.signatures(*ts.text_buffers(pa.array(texts)))
    assert np.diff(first).tolist() == [len(plain_signatures(t)) for t in texts]
    hashed, plain = defaultdict(set), defaultdict(set)
    for d, t in enumerate(texts):
        for x in sig[first[d] : first[d + 1]]:
            hashed[int(x)].add(d)
        for x in plain_signatures(t):
            plain[x].add(d)
    assert sorted(map(sorted, hashed.values())) == sorted(map(sorted, plain.values()))


@pytest.mark.parametrize("threshold", [0.4, 0.55, 0.8])
def test_spotsigs_groups_are_brute_force(spark, threshold):
    rows = corpus() + [(900 + i, t) for i, t in enumerate(["", "tiny text", "tiny text", "tiny  TEXT", "other text", None])]
    sets = {i: plain_signatures(t) for i, t in rows if t}
    near = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold]
    want = unite(near, [i for i, _ in rows])
    got = {r["doc_id"]: r["group_id"] for r in spotsigs.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), threshold).collect()}
    assert got == want
    assert len(set(want.values())) < len(rows) - 20


def test_texts_with_few_signatures_are_compared_by_their_sets(spark):
    """Pairs with 3 signatures, with 9 against 10 and with none meet as near copies do; what shares little doesn't."""
    few = "pebble lantern the copper kettle drifts of amber willow hums a marble sparrow glides"
    some = " ".join(f"the first{i} second{i}" for i in range(9))
    bare = [f"entry{i}" for i in range(40)]
    rows = [(1, few), (2, few.replace("pebble", "gravel")), (3, some), (4, some + " the first9 second9"), (5, " ".join(bare)), (6, " ".join(bare[:20] + ["changed"] + bare[21:]))]
    rows += [(7, "the first0 second0 of plain words"), (8, " ".join(bare[:9] + [f"other{i}" for i in range(30)]))]
    got = {r["doc_id"]: r["group_id"] for r in spotsigs.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7, 8: 8}


def test_length_partitions_meet_where_they_must():
    for t in (0.3, 0.55, 0.9):
        edges = spotsigs.bounds(500, t)
        part = lambda n: int(np.searchsorted(edges, n, "right")) - 1
        for b in range(1, 500, 7):
            for a in range(int(np.ceil(t * b - 1e-9)), b + 1):
                assert part(b) - part(a) <= 1
                assert part(a) == part(b) or a >= t * edges[part(b)] - 1e-9


# --- spans ---
def plain_removal(rows, k, least):
    """Every run against all before it, in plain Python."""
    import re

    def cut(text):
        # pieces with the white space after them, blank ones joined to no sentence; long ones by clauses
        marked = re.sub(r"([.!?][!-/:-@\[-`{-~]*) ", "\\1 \0", text.replace("\n", "\n\0"))
        pieces = [c for p in marked.split("\0") for c in (re.sub("([,;:]) ", "\\1 \0", p).split("\0") if len(p.split()) > spans.LONG_WORDS else [p])]
        return [p for p in pieces if p.strip()]

    occurrences = defaultdict(set)
    order = sorted({(i, t) for i, t in rows if i is not None and t is not None}, key=lambda r: (r[0], int(spans.text_marks(*ts.text_buffers(pa.array([r[1]])))[0])))
    places = {}
    for i, t in order:
        s = cut(t)
        places[i, t] = s
        for p in range(len(s)):
            for e in range(p + 1, len(s) + 1):
                run = tuple(x.strip() for x in s[p:e])
                words = sum(len(x.split()) for x in run)
                if words >= least and e - p >= k:
                    occurrences[run].add((i, t, p))
                    break
    gone = defaultdict(set)
    rank = {r: n for n, r in enumerate(order)}
    for run, found in occurrences.items():
        first = min(found, key=lambda f: (rank[f[0], f[1]], f[2]))
        for i, t, p in found - {first}:
            gone[i, t] |= set(range(p, p + len(run)))
    out = []
    for i, t in rows:
        if (i, t) not in places or not gone[i, t]:
            out.append((i, t, 0))
            continue
        left, at = [], 0
        for n, piece in enumerate(places[i, t]):
            where = t.index(piece, at)
            left.append(t[at:where])
            if n not in gone[i, t]:
                left.append(piece)
            at = where + len(piece)
        left.append(t[at:])
        out.append((i, "".join(left), len(gone[i, t])))
    return out


@pytest.mark.parametrize(("k", "least", "filter_bytes"), [(2, 12, 64 << 20), (3, 5, 64 << 20), (1, 8, 64), (2, 30, 64)])
def test_spans_are_brute_force(spark, k, least, filter_bytes):
    """A filter of 64 bytes is full: it passes nearly all, with the same result."""
    rng = np.random.RandomState(k)
    shared = [data.prose(500 + i, 4) if i % 2 else data.prose(500 + i, 6).replace(". ", ", ").replace("\n", " ") for i in range(6)]
    rows = []
    for i in range(60):
        parts = [data.prose(600 + i, 5)]
        for j in rng.permutation(6)[: i % 3]:
            parts.insert(rng.randint(len(parts) + 1), shared[j])
        rows.append((i, (" " if i % 2 else "\n").join(parts)))
    rows += [(60, rows[5][1]), (60, rows[6][1]), (61, rows[7][1]), (61, rows[7][1]), (62, shared[0] + "\n\n \n" + shared[0]), *((70 + i, "A!! B!! C.*** " * 9 + data.prose(40 + i, 2) + "\n" + " ".join(shared[1].replace(".", ",").split()) + '." \n. ?! x') for i in range(3)), (None, shared[0]), (63, None), (64, "")]
    got = spans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), k, least, filter_bytes=filter_bytes).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_removal(rows, k, least)))


def test_long_texts_are_cut_as_short_ones(monkeypatch):
    """Texts longer than a piece have the tokens, runs and fingerprint that they have whole."""
    text = data.prose(1, 60) + " " + "x" * 500 + " éÀÜ,; !!! " + data.prose(2, 40, "de").replace(". ", ", ") + "\n" + "ß" * 333 + " end. of it"
    buf, offsets = ts.text_buffers(pa.array([text]))
    whole = [*ts.tokens(buf, offsets), *ts.tokens(buf, offsets, True), *spans.sentences(buf, offsets), *spans.span_keys(buf, offsets, 2, 30), *simhash.fingerprints(buf, offsets), *spotsigs.signatures(buf, offsets)]
    monkeypatch.setattr(simhash, "_AT_ONCE", 50)
    monkeypatch.setattr(simhash, "_LANE_MAX", 40)
    for piece in (7, 64, 1001):
        monkeypatch.setattr(ts, "PIECE", piece)
        monkeypatch.setattr(spans, "PIECE", piece * 5)
        again = [*ts.tokens(buf, offsets), *ts.tokens(buf, offsets, True), *spans.sentences(buf, offsets), *spans.span_keys(buf, offsets, 2, 30), *simhash.fingerprints(buf, offsets), *spotsigs.signatures(buf, offsets)]
        assert all(np.array_equal(a, b) for a, b in zip(whole, again))
    at = np.array([0, 5, 100, 1500]), np.array([len(buf), 700, 100, 1501])
    for block in (64, 1000):
        assert np.array_equal(ts._long_span_hashes(buf, *at, block), ts.span_hashes(buf, *at))


def test_a_hot_run_and_a_hot_signature_are_no_tasks_own(spark):
    """All of 20 000 documents share a run and signatures: no window, which would gather them, and no list of them in one row."""
    hot = "the old miller of the town sold the last sack of flour to a stranger. the rain came down and the road was lost to all of them that night in the hills. "
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit(hot), F.lit("the w"), "id", F.lit(" x"), "id", F.lit(" and the y"), "id", F.lit(" z"), "id")).toDF("doc_id", "text").repartition(4)
    gone = spans.remove_repeats(df)
    plan = gone._jdf.queryExecution().toString() + spotsigs.shared_sets(df)._jdf.queryExecution().toString() + spans.repeats(df)._jdf.queryExecution().toString()
    assert "Window" not in plan
    assert gone.where("n_removed > 0").count() == 19_999
    assert {r["group_id"] for r in spotsigs.groups(df, 0.5).select("group_id").distinct().collect()} == {0}


@pytest.mark.parametrize("threshold", [0.4, 0.8])
def test_full_filters_lose_no_pair(spark, threshold):
    """Filters of one block hold nearly everything, so sets keep all their signatures in an order of hashes: the groups are the same."""
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    few, all_ = (cut(spotsigs.shared_sets(df, threshold, filter_bytes=b), "test-sets") for b in (spotsigs.FILTER_BYTES, (32, 32)))
    assert all_.selectExpr("sum(size(sigs))").first()[0] > few.selectExpr("sum(size(sigs))").first()[0]
    ids = [i for i, _ in rows]
    groups = [unite(map(tuple, spotsigs.links(x, threshold).collect()), ids) for x in (few, all_)]
    assert groups[0] == groups[1] and len(set(groups[0].values())) < len(ids) - 20


@pytest.mark.parametrize("threshold", [0.4, 0.8])
def test_long_lists_are_compared_in_groups(spark, threshold):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = cut(spotsigs.shared_sets(df, threshold), "test-sets")
    pairs = [{frozenset((r["a"], r["b"])) for r in spotsigs.links(sets, threshold, n).collect()} for n in (1 << 14, 4)]
    ids = [i for i, _ in rows]
    assert unite(map(tuple, pairs[0]), ids) == unite(map(tuple, pairs[1]), ids) and len(pairs[1]) > 20


def test_hot_lists_of_fingerprints_are_dealt(spark):
    """Lists of 40 at most in a task: the groups that brute force finds are still found."""
    rows = corpus()
    prints = simhash.table(spark.createDataFrame(rows, "doc_id long, text string")).where("n_shingles > 0").groupBy(*simhash.WORDS).agg(F.min("doc_id").alias("id"))
    prints = cut(prints, "test-prints")
    n = prints.count()
    ids = [i for i, _ in rows]
    want = unite([tuple(r) for r in simhash.links(prints, n).collect()], ids)
    row, key = simhash.deal(np.array([0, 1, 2]), np.array([5, 9, 5]), np.array([10, 11, 12], np.uint64), np.array([5]), np.array([4]))
    assert len(row) == 9 and (key == 9).sum() == 1 and len(set(key[row == 0]) & set(key[row == 2])) >= 1
    got = unite([tuple(r) for r in simhash.links(prints, n, list_rows=8).collect()], ids)
    assert got == want and len(set(want.values())) < n


def test_planted_passage_goes_from_all_but_the_first(spark):
    passage = data.prose(7, 8)
    assert len(passage.split()) > 50
    rows = [(i, data.prose(800 + i, 6) + " " + passage + " " + data.prose(900 + i, 6)) for i in range(30)]
    clean = [(100 + i, data.prose(850 + i, 10)) for i in range(30)]
    got = {r["doc_id"]: r for r in spans.remove_repeats(spark.createDataFrame(rows + clean, "doc_id long, text string")).collect()}
    assert [i for i in range(30) if passage in got[i]["text"]] == [0]
    core = passage.split(". ")[1]
    assert [i for i in range(30) if core in got[i]["text"]] == [0]
    for i, t in clean + rows[:1]:
        assert got[i]["text"] == t and got[i]["n_removed"] == 0


def test_spans_stand_hard_rows(hard, clashing, none):
    for df in (hard, clashing):
        out = spans.remove_repeats(df, counted="how_many")
        assert out.columns == [*df.columns, "how_many"] and out.count() == len(data.hard_rows())
        assert out.where("doc_id is null and how_many > 0").count() == 0
        assert {r["doc_id"] for r in out.where("how_many > 0").select("doc_id").collect()} <= {2, 3}
        assert out.where("doc_id = 2").select(F.max("text")).first()[0].strip() == ""
    assert spans.remove_repeats(none).count() == 0


def test_spans_are_those_of_the_sql():
    from oracle import connect, rows
    from pyspark.sql import SparkSession

    from corvid.llm import queries

    d = "/root/testdata/sf0.01"
    got = queries.op10_spans(SparkSession.getActiveSession(), d).toPandas()
    assert rows(got) == rows(connect(d).sql(queries.ORACLE_SQL["op10_spans"]).df())
