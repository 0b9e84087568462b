"""Operators against hand-made rows."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvid.operators import batch, cache, chunking, conversation, embedding, index, metrics, prompting, rerank, retrieval


def chunks(spark, content, strategy, **options):
    df = chunking.chunk(spark.createDataFrame([("d", content)], "id string, content string"), strategy, chunking.Chunking(**options))
    return [r["content"] for r in df.orderBy("chunk_index").collect()]


def test_paragraphs_merge_and_overlap(spark):
    assert chunks(spark, "aaaa\n\nbbbb\n \ncccc", "paragraph", size=9, overlap=2) == ["aaaa\n\nbbbb", "bb\n\n\n\ncccc"]
    assert chunks(spark, "aaaa\n\nbbbb", "paragraph", size=5, overlap=0) == ["aaaa", "bbbb"]


def test_fixed_windows(spark):
    assert chunks(spark, "abcdefghij", "fixed", size=4, overlap=1) == ["abcd", "defg", "ghij", "j"]
    assert chunks(spark, "", "fixed") == []


def test_sections_and_hybrid(spark):
    md = "# One\nalpha\n# Two\nbeta"
    assert chunks(spark, md, "section", size=5, overlap=0) == ["alpha", "beta"]
    assert chunks(spark, md, "hybrid", window=50) == ["# One\nalpha", "# Two\nbeta"]
    assert chunks(spark, md, "hierarchical_basic") == ["One\nalpha\n", "Two\nbeta"]


def test_hierarchy_links_to_parents(spark):
    text = "# One\n\n" + "A first sentence here. " * 4 + "\n\nshort"
    rows = chunking.hierarchical(spark.createDataFrame([("d", text)], "id string, content string"), chunking.Chunking(levels=3, window=50, min_size=10)).orderBy("chunk_index").collect()
    by_id = {r["id"]: r for r in rows}
    assert [r["hierarchy_level"] for r in rows][:3] == [0, 1, 2]
    for r in rows:
        assert r["chunk_count"] == len(rows)
        if r["hierarchy_level"]:
            assert by_id[r["parent_chunk_id"]]["hierarchy_level"] == r["hierarchy_level"] - 1


def test_bad_sizes():
    with pytest.raises(ValueError, match="overlap"):
        chunking.Chunking(size=10, overlap=10)
    with pytest.raises(ValueError, match="positive"):
        chunking.Chunking(stride=0)


def test_null_content_and_metadata(spark):
    df = spark.createDataFrame([("a", None, None), ("b", "x", {"k": "v"})], "id string, content string, metadata map<string,string>")
    for strategy in (*chunking.STRATEGIES, "content_aware"):
        rows = chunking.chunk(df, strategy).collect()
        assert [(r["parent_id"], r["content"], r["metadata"], r["chunk_strategy"]) for r in rows] == [("b", "x", {"k": "v"}, strategy)]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 200), min_size=1, max_size=12), st.integers(10, 120), st.integers(0, 40))
def test_best_cuts_are_the_cheapest(gaps, window, least):
    at = np.concatenate([[0], np.cumsum(gaps)])
    cost = lambda a, b: np.inf if b - a < least else (b - a - window) ** 2 if b - a > window else window - (b - a)
    best = min((sum(cost(at[i], at[j]) for i, j in zip(c, c[1:])) for c in _paths(len(at))), default=np.inf)
    got = chunking.best_cuts(at, window, least)
    assert got[-1] == len(at) - 1
    if np.isfinite(best):
        path = [0, *got]
        assert sum(cost(at[i], at[j]) for i, j in zip(path, path[1:])) == best


def _paths(n):
    for bits in range(1 << max(n - 2, 0)):
        yield [0, *(i + 1 for i in range(n - 2) if bits >> i & 1), n - 1]


DOCS = [("doc1", [0.1, 0.2, 0.3], "animals"), ("doc2", [0.4, 0.5, 0.6], "technology"), ("doc3", [0.7, 0.8, 0.9], "technology"), ("zero", [0.0, 0.0, 0.0], "none"), ("null", None, "none")]


@pytest.fixture(scope="module")
def store(spark):
    return spark.createDataFrame(DOCS, "id string, embedding array<float>, category string")


def test_search(spark, store):
    q = spark.createDataFrame([(1, [0.1, 0.2, 0.3])], "query_id long, qvec array<float>")
    rows = retrieval.search(store, q, 2).orderBy("rank").collect()
    assert rows[0]["id"] == "doc1" and rows[0]["score"] == pytest.approx(1.0)
    assert {r["id"] for r in retrieval.search(store, q, 5, where={"category": "technology"}).collect()} == {"doc2", "doc3"}
    assert retrieval.search(store, q, 5).count() == 3
    assert retrieval.search(store, q, 5, above=None).count() == 4
    with pytest.raises(Exception, match="dimensions"):
        retrieval.search(store, spark.createDataFrame([(1, [1.0])], "query_id long, qvec array<float>")).collect()
    with pytest.raises(ValueError, match="unknown metric"):
        retrieval.search(store, q, metric="x")


def test_blocks_do_not_change_results(spark):
    rng = np.random.RandomState(0)
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(60)], "id long, embedding array<double>").repartition(3)
    q = df.select(F.col("id").alias("query_id"), F.col("embedding").alias("qvec"))
    for metric in ("cosine", "dot", "euclidean", "manhattan", "angular", "rbf"):
        got = [{(r[0], r[1], r[2]) for r in retrieval.search(df, q, 4, metric, above=None, block=b, query_bytes=n).collect()} for b in (7, 4096) for n in (0, 1 << 20)]
        assert all(g == got[0] for g in got) and len(got[0]) == 240


def test_ties_go_to_the_least_id(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50)], "id long, embedding array<double>").repartition(5)
    q = spark.createDataFrame([(7, [2.0, 0.0]), (8, None)], "query_id long, qvec array<double>")
    for n in (0, 1 << 20):
        assert [tuple(r) for r in retrieval.search(df, q, 3, block=4, query_bytes=n).orderBy("rank").collect()] == [(7, 1, 0, 1.0), (7, 2, 1, 1.0), (7, 3, 2, 1.0)]


# --- the approximate index ---
@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding", "label")


def recall_of(held, vectors, k=10):
    """Every twentieth row against all: the share of the true nearest that is found, and the queries."""
    q = vectors.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("qvec"))
    true = {(r["query_id"], r["id"]) for r in retrieval.search(vectors, q, k).collect()}
    found = {(r["query_id"], r["id"]) for r in held.search(q, k).collect()}
    assert held.table.count() == vectors.count()
    return len(true & found) / len(true), q


def test_index_recall_over_a_table(vectors):
    """These vectors have hardly any clusters, so many cells must be looked into; the build measures how many."""
    held = index.build(vectors)
    assert recall_of(held, vectors)[0] >= 0.9 and held.probes < len(held.centres)


def test_index_prunes_where_vectors_have_clusters(spark):
    rng = np.random.RandomState(4)
    centres = rng.normal(size=(150, 16))
    x = centres[rng.randint(0, 150, 12_000)] + 0.25 * rng.normal(size=(12_000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(4)
    held = index.build(df, sample=4000)
    recall, q = recall_of(held, df)
    assert recall >= 0.9 and held.compared(q) < 0.1


def test_index_like_a_store(spark, tmp_path):
    """Even rows are of one topic and near one axis; the nearest of a row is itself; filters, changes and a stored index."""
    n = 40
    rows = [(f"doc{i}", [i / n] + [0.5 + i % 3 * 0.1 if i % 2 == 0 else 0.5 - i % 5 * 0.1] * 7, "technology" if i % 2 == 0 else "science") for i in range(n)]
    df = spark.createDataFrame(rows, "id string, embedding array<double>, category string")
    held = index.build(df, cells=6)
    q = spark.createDataFrame([(3, rows[3][1][:1] + [x + 0.001 for x in rows[3][1][1:]])], "query_id long, qvec array<double>")
    assert held.search(q, 1).first()["score"] > 0.9
    every = len(held.centres)
    exact = [tuple(r) for r in retrieval.search(df, q, 5, where={"category": "technology"}).orderBy("rank").collect()]
    assert [tuple(r) for r in held.search(q, 5, where={"category": "technology"}, probes=every).orderBy("rank").collect()] == exact and len(exact) == 5
    more = held.add(spark.createDataFrame([("new", q.first()["qvec"], "science"), ("doc3", [9.0] + [0.0] * 7, "science")], df.schema))
    assert more.search(q, 1).first()["id"] == "new" and more.table.count() == n + 1
    more.save(str(tmp_path / "index"))
    again = index.CellIndex.load(spark, str(tmp_path / "index"))
    assert again.search(q, 1).first()["id"] == "new" and again.probes == more.probes
    assert again.delete(spark.createDataFrame([("new",)], "id string")).search(q, 1).first()["id"] != "new"
    none = index.build(df.where("false"))
    assert none.search(q).count() == 0


def test_index_deals_a_hot_cell(spark, monkeypatch):
    monkeypatch.setattr(index, "BLOCK_ROWS", 8)
    monkeypatch.setattr(index, "BLOCK_QUERIES", 4)
    df = spark.range(100).select(F.concat(F.lit("d"), "id").alias("id"), F.array(F.lit(1.0), F.col("id") / 1000).alias("embedding"))
    q = spark.createDataFrame([(i, [1.0, i / 300]) for i in range(30)], "query_id long, qvec array<double>")
    got = index.build(df, cells=1).search(q, 3).orderBy("query_id", "rank").collect()
    assert got == retrieval.search(df, q, 3).orderBy("query_id", "rank").collect() and len(got) == 90


def test_changes(spark, store):
    new = spark.createDataFrame([("doc1", [1.0], "a", 1), ("doc1", [2.0], "b", 2), ("doc9", [3.0], "c", 1)], "id string, embedding array<float>, category string, seq int")
    rows = {r["id"]: r["category"] for r in retrieval.upsert(store, new).collect()}
    assert rows["doc1"] == "b" and rows["doc9"] == "c" and len(rows) == 6
    left = retrieval.delete(store, spark.createDataFrame([("doc1",), ("none",)], "id string"))
    assert left.count() == 4 and retrieval.clear(store).count() == 0
    assert retrieval.size(store).first()["n"] == 5
    assert 0 < retrieval.fail_at(spark.range(1000), "id", 0.3).where("not ok").count() < 1000


CANDIDATES = [(1, "doc1", 0.9939, [0.9, 0.1, 0.0]), (1, "doc2", 0.9113, [0.7, 0.3, 0.1]), (1, "doc3", 0.8018, [0.6, 0.4, 0.2]), (1, "doc4", 0.1078, [0.1, 0.2, 0.9])]


@pytest.fixture(scope="module")
def candidates(spark):
    return spark.createDataFrame(CANDIDATES, "query_id long, id string, score double, embedding array<float>")


def test_mmr(candidates):
    rows = rerank.mmr(candidates, 3, 0.1).orderBy("rank").collect()
    assert [r["id"] for r in rows][:2] == ["doc1", "doc4"]
    assert {r["id"] for r in rows} <= {c[1] for c in CANDIDATES}
    assert rerank.mmr_by_score(candidates, 10).count() == 4


def test_boost_and_ensemble(spark, candidates):
    df = spark.createDataFrame([(1, "a", 0.7, {"important": "true"}), (1, "b", 0.8, {"important": "false"}), (1, "c", 0.6, {})], "query_id long, id string, score double, metadata map<string,string>")
    assert [(r["id"], round(r["score"], 6)) for r in rerank.boost(df, {"important": 1.5}).orderBy("rank").collect()] == [("b", 1.2), ("a", 1.05), ("c", 0.6)]
    one = spark.createDataFrame([(1, "doc3", 0.9), (1, "doc1", 0.8), (1, "doc2", 0.7)], "query_id long, id string, score double")
    two = spark.createDataFrame([(1, "doc2", 0.9), (1, "doc1", 0.8), (1, "doc3", 0.5)], "query_id long, id string, score double")
    got = {r["id"]: round(r["score"], 6) for r in rerank.ensemble(candidates, [(one, 1.0), (two, 1.0)]).collect()}
    assert got == {"doc1": 0.8, "doc2": 0.8, "doc3": 0.7, "doc4": 0.0}
    assert rerank.ensemble(candidates, []).count() == 4
    with pytest.raises(ValueError, match="unknown strategy"):
        rerank.rerank(candidates, "x")
    assert [rerank.rerank(candidates, s, 2).count() for s in ("none", "mmr", "cross_encoder", "ensemble", "hierarchical", "mmr_by_score")] == [2] * 6


def test_prompts(spark):
    hits = spark.createDataFrame([(1, 2, "b", 0.85, "two", "s", {"source": "test"}), (1, 1, "a", 0.95, "one", "s", {"source": "test"})], "query_id long, rank int, id string, score double, content string, source string, metadata map<string,string>")
    assert prompting.contexts(hits, None).first()["context"] == "one\n\ntwo"
    got = prompting.formatted_contexts(hits, prompting.PromptOptions(scores=True)).first()["context"]
    assert got == "Document 1 [Similarity: 0.95]\nsource: test\none\n\nDocument 2 [Similarity: 0.85]\nsource: test\ntwo"
    s = prompting.summaries(hits).first()
    assert (s["top_id"], s["sources"], s["n_docs"]) == ("a", "s", 2)
    out = hits.select(prompting.prompt(F.lit("c {question}"), F.lit("q"), "{context} {question}").alias("p")).first()["p"]
    assert out == "c q q"


def test_generate_keeps_failed_rows(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "query_id long, prompt string")

    def broken(prompts, options):
        raise RuntimeError("down")

    rows = prompting.generate(df, broken).collect()
    assert len(rows) == 2 and all(not r["ok"] and "down" in r["error"] for r in rows)
    assert sorted(r["answer"] for r in prompting.generate(df, lambda p, o: [x.upper() for x in p]).collect()) == ["X", "Y"]
    short = prompting.generate(df, options=prompting.GenerationOptions(max_tokens=10, temperature=0.1)).orderBy("query_id").first()["answer"]
    assert short == "[short and factual] Mock answer: x..."


def test_conversations(spark, tmp_path):
    t = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "Hello"), (1, 2, "assistant", "Hi"), (1, 3, "user", "How are you?"), (2, 0, "assistant", "x")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["history"], r["question"]) for r in conversation.histories(t, system=False).collect()}
    assert got == {1: ("user: Hello\n\nassistant: Hi", "How are you?"), 2: ("assistant: x", None)}
    more = conversation.add_messages(t, spark.createDataFrame([(1, "user", "b", 2), (1, "user", "a", 1), (3, "user", "c", 1)], "conv_id long, role string, text string, seq int"))
    assert {(r["conv_id"], r["turn"], r["text"]) for r in more.where("turn > 3 or conv_id = 3").collect()} == {(1, 4, "a"), (1, 5, "b"), (3, 0, "c")}
    conversation.save(t, str(tmp_path / "c"))
    assert conversation.load(spark, str(tmp_path / "c")).count() == 5
    assert spark.range(2).select(conversation.new_id().alias("x")).distinct().count() == 2


def test_timers(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("t", float(v), t0, v) for v in (100, 200, 300, 400, 500)] + [("h", float(v), t0, v) for v in range(1, 101)], "name string, value double, ts timestamp, event_id int")
    got = {r["name"]: r.asDict() for r in metrics.timers(df).collect()}
    assert [got["t"][k] for k in ("n", "min", "max", "mean", "p50", "p90", "p95", "p99")] == [5, 100, 500, 300, 300, 400, 400, 400]
    assert [got["h"][k] for k in ("p50", "p90", "p95")] == [50, 90, 95]
    assert "p50=50.000" in {r["name"]: r["line"] for r in metrics.report(metrics.timers(df)).collect()}["h"]
    assert {r["name"]: r["last"] for r in metrics.gauges(df).collect()} == {"t": 500.0, "h": 100.0}


def test_registry():
    m = metrics.Metrics()
    m.count("a")
    m.gauge("g", 2.5)
    with pytest.raises(ZeroDivisionError), m.time("t"):
        1 / 0  # noqa: B018
    assert m.counts["a"] == 1 and m.stats("t")["count"] == 1 and m.stats("none") is None
    assert "a: 1" in m.report()
    m.reset()
    assert not m.counts


def test_observed(spark):
    df, held = metrics.observed(spark.range(10), "n10", n=F.count(F.lit(1)))
    df.collect()
    assert held.get["n"] == 10


def test_cache(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "id long, content string")
    empty = spark.createDataFrame([], "key string, embedding array<float>")
    rows, new = cache.embed_cached(texts.where("content is not null"), empty, embedding.HashingEmbedder(8), 8)
    assert new.count() == 2 and rows.where("embedding is null").count() == 0 and rows.count() == 3
    again, none = cache.embed_cached(texts.where("content is not null"), new, embedding.HashingEmbedder(8), 8)
    assert none.count() == 0 and again.count() == 3
    assert cache.hits(texts, new).first().asDict() == {"hits": 3, "misses": 1, "hit_rate": 0.75}
    levels = cache.read_through([new.limit(1), new], new.select("key"))
    assert levels.where("embedding is null").count() == 0 and levels.count() == 2
    stats = spark.createDataFrame([(0, 5, 5), (1, 2, 3)], "level int, hits long, misses long")
    assert cache.level_stats(stats).first().asDict() == {"hits": 7, "misses": 3, "hit_rate": 0.7}
    seen = spark.createDataFrame([(str(i), dt.datetime(2024, 1, i + 1), i) for i in range(5)], "key string, ts timestamp, event_id int")
    assert {r["key"] for r in cache.retained(seen, 3).collect()} == {"2", "3", "4"}


def test_lru_and_layers():
    lru = cache.LruCache(2)
    lru.put_all({"a": 1, "b": 2})
    assert lru.get("a") == 1
    lru.put("c", 3)
    assert "b" not in lru and lru.get_all(["a", "b", "c"]) == {"a": 1, "c": 3}
    assert (lru.stats.hits, lru.stats.misses, lru.stats.hit_rate) == (3, 1, 0.75)
    small, large = cache.LruCache(1), cache.LruCache(10)
    both = cache.LayeredCache(small, large)
    both.put("x", 1)
    both.put("y", 2)
    assert "x" not in small and both.get("x") == 1 and "x" in small and both.get("z") is None
    assert (both.stats.hits, both.stats.misses) == (1, 1)
    both.clear()
    assert len(small) == len(large) == 0 and both.stats.hit_rate == 0.0
    with pytest.raises(ValueError, match="an entry"):
        cache.LruCache(0)


def test_table_cache_embeds_each_text_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def embedder(texts):
        calls.add(len(texts))
        return [[1.0, 0.0]] * len(texts)

    held = cache.TableCache(spark, str(tmp_path / "cache"))
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, content string")
    for _ in range(2):
        out = held.embedded(texts, embedder, 2)
        assert out.count() == 3 and out.where("embedding is null").count() == 0
    assert calls.value == 2 and (held.stats.hits, held.stats.misses) == (2, 2)
    held.clear()
    assert held.table().count() == 0


def test_promotion(spark):
    level = lambda keys: spark.createDataFrame([(k, [1.0]) for k in keys], "key string, embedding array<float>")
    first, second = cache.promote([level("ab"), level("bc")], spark.createDataFrame([("c",), ("b",), ("z",)], "key string"))
    assert sorted(r["key"] for r in first.collect()) == ["a", "b", "c"] and sorted(r["key"] for r in second.collect()) == ["b", "c"]


def test_semantic_chunks(spark):
    cats, ships = "cats purr and cats sleep", "ships sail and ships sink"
    text = "\n\n".join([cats, cats + " too", ships, " ", ships + " too"])
    assert chunks(spark, text, "semantic") == ["\n\n".join([cats, cats + " too"]), "\n\n".join([ships, ships + " too"])]
    assert chunks(spark, text, "semantic", window=20)[0] == cats[:20]
    # no bound, or one paragraph: windows of the whole text
    assert chunks(spark, "\n\n".join([cats, cats]), "semantic", window=30) == [("\n\n".join([cats, cats]))[i : i + 30] for i in (0, 30)]
    assert chunks(spark, cats, "semantic") == [cats] and chunks(spark, "", "semantic") == []
    seen = chunking.chunk(spark.createDataFrame([(1, text, {"a": "b"})], "id long, content string, metadata map<string,string>"), "semantic", embed=lambda u: u.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)))).collect()
    assert [r["content"] for r in seen] == [text] and seen[0]["metadata"] == {"a": "b"}


def test_merging_units_is_the_plain_fold(spark):
    """The fold over lengths gives what joining texts one by one gives."""
    rng = np.random.RandomState(1)
    for size, overlap in ((9, 2), (9, 0), (30, 12), (5, 4)):
        units = ["".join(rng.choice(list("abc"), rng.randint(1, 12))) for _ in range(40)]
        done, now = [], ""
        for u in units:
            if now and len(now) + len(u) > size:
                done.append(now)
                now = now[-overlap:] + "\n\n" if overlap else ""
            now = now + ("\n\n" if now else "") + u
        done.append(now)
        df = spark.createDataFrame([(units,), ([],)], "u array<string>")
        assert [r[0] for r in df.select(chunking.merge_units(F.col("u"), size, overlap)).collect()] == [done, []]


def test_hashing_embedding_forms_agree(spark):
    df = spark.createDataFrame([(1, "Spark joins tables. Spark!"), (2, "")], "id long, content string")
    dense = {r["id"]: r["v"] for r in df.select("id", embedding.hashing_embedding(F.col("content"), 16).alias("v")).collect()}
    assert dense[1] == pytest.approx(embedding.HashingEmbedder(16)(["Spark joins tables. Spark!"])[0])
    assert dense[2] == [0.0] * 16
    with pytest.raises(Exception, match="provider gave"):
        embedding.embed(df, lambda t: [[0.0]] * len(t), 2).collect()


def test_batches(spark):
    rows = batch.batch_ids(spark.range(1, 48).withColumnRenamed("id", "k").repartition(3), "k", 20).orderBy("k").collect()
    assert [(r["batch"], r["place"]) for r in rows] == [(i // 20, i % 20) for i in range(47)]


def test_process(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(10)], "id long, v string").coalesce(1)

    def f(values):
        if "5" in values:
            raise batch.EmbeddingError("bad")
        return [v * 2 for v in values]

    rows = batch.process(df, f, "v", size=2, retry=batch.Retry(attempts=2, first=0.0)).collect()
    assert len(rows) == 10 and sorted(r["v"] for r in rows if not r["ok"]) == ["4", "5"]
    assert {r["error_type"] for r in rows} == {None, "embedding"}


def test_process_in_time(spark):
    import time

    def slow(values):
        time.sleep(2.0 if "1" in values else 0.0)
        return values

    df = spark.createDataFrame([(str(i),) for i in range(3)], "v string").coalesce(1)
    rows = {r["v"]: r for r in batch.process(df, slow, "v", size=1, retry=batch.Retry(1), timeout=0.5).collect()}
    assert rows["1"]["error_type"] == "timeout" and not rows["1"]["ok"] and rows["0"]["ok"] and rows["2"]["ok"]
    with pytest.raises(batch.TimedOut):
        batch.in_time(lambda: time.sleep(1), 0.05)


def test_items_have_outcomes_of_their_own(spark):
    def f(value):
        if value == "5":
            raise batch.EmbeddingError("bad")
        return value * 2

    df = spark.createDataFrame([(i, str(i)) for i in range(12)], "id long, v string").repartition(2)
    for concurrency in (1, 4, batch.AdaptiveConcurrency()):
        rows = {r["id"]: r for r in batch.process_items(df, f, "v", size=5, retry=batch.Retry(2, 0.0), concurrency=concurrency).collect()}
        assert len(rows) == 12 and all(r["ok"] and r["result"] == r["v"] * 2 and r["attempts"] == 1 for i, r in rows.items() if i != 5)
        assert (rows[5]["ok"], rows[5]["error_type"], rows[5]["attempts"], rows[5]["result"]) == (False, "embedding", 2, None)


def test_only_failed_rows_run_again(spark):
    calls = spark.sparkContext.accumulator(0)

    def f(value):
        calls.add(1)
        if value == "x":
            raise ValueError("x")
        return value

    df = spark.createDataFrame([("x",), ("y",), ("z",)], "v string").coalesce(1)
    done = batch.retry_failed(batch.process_items(df, f, "v", retry=batch.Retry(1)), lambda d: batch.process_items(d, lambda v: v + "!", "v", retry=batch.Retry(1)))
    assert sorted((r["v"], r["result"], r["ok"]) for r in done.collect()) == [("x", "x!", True), ("y", "y", True), ("z", "z", True)] and calls.value == 3


def test_concurrency_adapts():
    c = batch.AdaptiveConcurrency(4, 1, 16)
    assert [c.record(10, 0), c.record(10, 0), c.record(5, 5), c.record(0, 10)] == [6, 9, 9, 5]
    for _ in range(9):
        c.record(0, 10)
    assert c.now == 1
    for _ in range(20):
        c.record(10, 0)
    assert c.now == 16
    with pytest.raises(ValueError, match="least"):
        batch.AdaptiveConcurrency(0)


def test_a_rate_is_the_jobs(spark):
    """Two tasks share a rate: 4 calls at 240 a minute take them 2 x 0.5 s and not 2 x 0.25 s."""
    import time

    df = spark.createDataFrame([(str(i),) for i in range(4)], "v string")
    began = time.monotonic()
    assert batch.process(df, lambda values: values, "v", size=1, per_minute=240, tasks=1).count() == 4
    assert time.monotonic() - began >= 0.75
    assert batch.process(df, lambda values: values, "v", per_minute=6000, tasks=3).rdd.getNumPartitions() == 3


def test_breaker_states_are_the_plain_replay(spark):
    """Against a replay written out: two failures open, a minute later one more failure opens again and two successes close."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    got = {r["user_id"]: (r["state"], r["opened"], r["skipped"]) for r in batch.breaker_states(events.withColumn("failed", F.col("event_type") == "error"), "user_id", ["ts", "event_id"], "failed", failures=2).collect()}
    want = {}
    rows = sorted(events.select("user_id", "ts", "event_id", "event_type").collect(), key=lambda r: (r["user_id"], r["ts"], r["event_id"]))
    for user in {r["user_id"] for r in rows}:
        state, bad, good, since, opened, skipped = "closed", 0, 0, None, 0, 0
        for r in (r for r in rows if r["user_id"] == user):
            if state == "open":
                if (r["ts"] - since).total_seconds() < 60:
                    skipped += 1
                    continue
                state, good = "half_open", 0
            if r["event_type"] == "error":
                bad += 1
                if state == "half_open" or bad >= 2:
                    state, since, opened = "open", r["ts"], opened + 1
            elif state == "half_open":
                good += 1
                if good == 2:
                    state, bad = "closed", 0
            else:
                bad = 0
        want[user] = (state, opened, skipped)
    assert got == want and len({s for s, *_ in want.values()}) > 1


def test_retry_fallback_limit():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ValueError
        return "ok"

    pauses = []
    assert batch.with_retry(flaky, sleep=pauses.append) == "ok" and len(pauses) == 2 and pauses[1] > pauses[0]
    with pytest.raises(ValueError):
        batch.with_retry(lambda: (_ for _ in ()).throw(ValueError()), batch.Retry(attempts=2), sleep=pauses.append)
    assert batch.with_fallback(lambda: 1 / 0, lambda e: type(e).__name__) == "ZeroDivisionError"
    now = [0.0]
    limiter = batch.RateLimiter(60, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(10):
        limiter.wait()
    assert now[0] == pytest.approx(9.0)


def test_breaker():
    now = [0.0]
    b = batch.CircuitBreaker(failures=2, reset=10, successes=2, clock=lambda: now[0])
    b.record(False)
    b.record(True)
    b.record(False)
    assert b.state == "closed"
    b.record(False)
    assert b.state == "open" and not b.allows()
    with pytest.raises(batch.BreakerOpen):
        b.call(lambda: 1)
    now[0] = 11
    assert b.allows() and b.state == "half_open"
    b.record(True)
    b.record(True)
    assert b.state == "closed"
    c = batch.CircuitBreaker(failures=2, cumulative=True)
    for ok in (False, True, False):
        c.record(ok)
    assert c.state == "open"


def test_semantic_chunks_need_no_shuffle_and_are_those_of_embedded_paragraphs(spark):
    """The cosines of a document's own paragraphs are computed where it is; every batch begins anew with each document."""
    cats, ships = "cats purr and sleep " * 9, "ships sail the sea " * 9
    texts = ["\n\n".join(x) for x in ([cats, cats, ships], [cats], [], ["...", "!", cats], ["ÄÖ " + ships, ships.upper(), "", "  ", cats], [cats] * 40 + [ships] * 40, ["x", ships, "x"] * 30)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 3)] + [(99, None)], "id long, content string").coalesce(1)
    own = chunking.chunk(df, "semantic", chunking.Chunking(window=300))
    assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString()
    by_rows = chunking.chunk(df, "semantic", chunking.Chunking(window=300), embed=lambda u: embedding.embed(u, embedding.HashingEmbedder(64), 64))
    assert sorted(map(str, own.collect())) == sorted(map(str, by_rows.collect())) and own.count() > 100


def test_ensemble_joins_nothing_and_adds_no_candidates(spark):
    """A pair that only a reranker has is none; one without a score of any keeps 0."""
    df = lambda rows: spark.createDataFrame(rows, "query_id long, id long, score double")
    got = rerank.ensemble(df([(1, 1, 0.9), (1, 2, 0.8)]), [(df([(1, 1, 0.6), (1, 7, 0.9)]), 2.0), (df([(2, 1, 0.9)]), 1.0)])
    assert [(r["query_id"], r["id"], round(r["score"], 6), r["rank"]) for r in got.orderBy("rank").collect()] == [(1, 1, 0.4, 1), (1, 2, 0.0, 2)]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_mmr_moves_vectors_in_their_own_type(spark):
    df = spark.createDataFrame([(1, i, 0.9 - i / 10, [1.0, i / 3]) for i in range(4)], "query_id long, id long, score double, embedding array<float>")
    got = rerank.mmr(df, 3, 0.5)
    assert "as array<double>" not in got._jdf.queryExecution().optimizedPlan().toString()
    same = rerank.mmr(df.withColumn("embedding", F.col("embedding").cast("array<double>")), 3, 0.5)
    assert got.collect() == same.collect() and got.count() == 3
