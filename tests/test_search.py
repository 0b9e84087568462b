"""Search whose tasks have a bounded part of both tables, against all pairs in plain numpy."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvid.operators import index, retrieval


def brute(metric, q, v, ids, k, above=None):
    got, out = np.round(retrieval.scores(metric, q, v), 12), {}
    for i in range(len(q)):
        order = [j for j in np.lexsort((ids, -got[i])) if above is None or got[i, j] > above][:k]
        out[i] = [(ids[j], round(float(got[i, j]), 6)) for j in order]
    return {i: x for i, x in out.items() if x}


def by_query(rows):
    out = {}
    for query, id_, score in rows:
        out.setdefault(query, []).append((id_, round(score, 6)))
    return {q: sorted(x, key=lambda y: (-y[1], y[0])) for q, x in out.items()}


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean", "rbf", "manhattan"])
@pytest.mark.parametrize("scale", [1e-3, 1.0, 30.0, 1e25])
def test_best_is_that_of_all_pairs(metric, scale):
    """Copies, near copies, zeros and numbers that single precision can't hold, in small parts."""
    if metric == "dot" and scale > 1:
        pytest.skip("products so large round by more than 12 places")
    r = np.random.RandomState(3)
    v = r.randn(600, 16) * scale
    v[100:200], v[5], v[300:400] = v[0], 0, v[200:300] * (1 + 1e-9)
    q, ids = np.vstack([v[:30], r.randn(10, 16) * scale, np.zeros((1, 16)), v[300:305]]), r.permutation(600)
    for above in (None, 0.0):
        best = retrieval.Best(metric, q, 4, None, above, 64)
        for lo in range(0, 600, 150):
            best.add(pa.array(ids[lo : lo + 150]), v[lo : lo + 150])
        rows = best.rows(pa.array(np.arange(len(q))))
        want = brute(metric, q, v, ids, 4, above)
        assert by_query(zip(*(c.to_pylist() for c in rows.columns)) if rows else []) == {i: sorted(x, key=lambda y: (-y[1], y[0])) for i, x in want.items()}


def test_distances_are_computed_for_a_few_pairs_only(monkeypatch):
    """Nothing computes all differences of a block of queries and a block of vectors."""
    seen = []
    each = retrieval._each
    monkeypatch.setattr(retrieval, "_each", lambda m, q, v: seen.append(len(q)) or each(m, q, v))
    monkeypatch.setattr(retrieval, "scores", None)
    x = np.random.RandomState(0).randn(6000, 32).astype(np.float32)
    best = retrieval.Best("euclidean", x[:300], 5, None, 0.0, 1000)
    best.add(pa.array(np.arange(6000)), x)
    assert best.rows(pa.array(np.arange(300))).num_rows == 1500 and sum(seen) < 300 * 6000 / 20


def test_a_task_keeps_few_pairs_a_query():
    """Every part is better than the one before, so each pair is among the best when it comes."""
    q, most = np.ones((200, 2)), 0
    best = retrieval.Best("dot", q, 50, None, None, 500)
    for n in range(60):
        best.add(pa.array(np.arange(n * 500, n * 500 + 500)), np.arange(n * 500, n * 500 + 500, dtype=float)[:, None] * np.ones((1, 2)))
        most = max(most, best.n)
    assert most <= max(4 * 50 * 200, 1 << 16) + 500 * 200
    assert set(best.rows(pa.array(np.arange(200))).column(1).to_pylist()) == set(range(60 * 500 - 50, 60 * 500))


def test_a_slice_of_the_queries_is_merged_at_a_time(monkeypatch):
    """What is sorted at once doesn't grow with a task's queries; the best are those of all pairs."""
    sizes, pc = [], retrieval.pc
    monkeypatch.setattr(retrieval, "pc", SimpleNamespace(array_sort_indices=lambda x, **o: sizes.append(len(x)) or pc.array_sort_indices(x, **o)))
    best = retrieval.Best("dot", np.ones((8000, 2)), 20, None, None, 100)
    for n in range(10):
        best.add(pa.array(np.arange(n * 100, n * 100 + 100)), np.arange(n * 100, n * 100 + 100, dtype=float)[:, None] * np.ones((1, 2)))
    rows = best.rows(pa.array(np.arange(8000)))
    assert max(sizes) <= 4 * 20 * 2048 + 512 * 100
    assert rows.num_rows == 8000 * 20 and set(rows.column(1).to_pylist()) == set(range(980, 1000))


def test_pairs_are_looked_up_only_where_they_are_few(monkeypatch):
    """Half of the first pairs are above 0: the k-th product of a part tells which of them count before any is looked up."""
    seen, places = [], retrieval._places
    monkeypatch.setattr(retrieval, "_places", lambda m: seen.append(int(np.count_nonzero(m))) or places(m))
    x = np.random.RandomState(1).randn(4000, 32)
    best = retrieval.Best("cosine", x[:1000], 5, None, 0.0, 1000)
    best.add(pa.array(np.arange(4000)), x)
    want = brute("cosine", x[:1000], x, np.arange(4000), 5, 0.0)
    assert max(seen) <= 4 * 5 * 512
    got = by_query(zip(*(c.to_pylist() for c in best.rows(pa.array(np.arange(1000))).columns)))
    assert got == {i: sorted(y, key=lambda z: (-z[1], z[0])) for i, y in want.items()}


def test_the_last_round_of_tasks_is_nearly_full():
    """Groups are never fewer than their memory asks for; less than a part's tasks are missing in the last round."""
    for slots in (1, 2, 4, 8, 12, 48):
        for least in range(1, 120):
            groups, parts = retrieval._dealt(least, slots)
            assert groups >= least and groups * parts >= 2 * slots - parts and -(groups * parts) % slots < parts


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "manhattan"])
def test_some_rows_of_several_slices(monkeypatch, metric):
    monkeypatch.setattr(retrieval, "SLICE", 7)
    r = np.random.RandomState(5)
    v, ids, some = r.randn(400, 8), r.permutation(400), np.array([0, 6, 7, 20, 33, 34, 48])
    v[90:120] = v[3]
    best = retrieval.Best(metric, v[:50], 4, None, 0.0, 64)
    for lo in range(0, 400, 100):
        best.add(pa.array(ids[lo : lo + 100]), v[lo : lo + 100], some)
    want = brute(metric, v[some], v, ids, 4, 0.0)
    got = by_query(zip(*(c.to_pylist() for c in best.rows(pa.array(np.arange(50))).columns)))
    assert got == {int(some[i]): sorted(x, key=lambda y: (-y[1], y[0])) for i, x in want.items()}


@pytest.fixture
def words(spark):
    r = np.random.RandomState(7)
    v = r.randn(300, 8).astype(np.float32)
    v[50:80] = v[10]
    names = [f"d{i:03d}" for i in r.permutation(300)]
    df = spark.createDataFrame([(n, x.tolist(), i % 3) for i, (n, x) in enumerate(zip(names, v))], "id string, embedding array<float>, label int")
    return df, v, names


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_groups_of_queries_and_parts_of_the_store_lose_nothing(spark, words, monkeypatch, metric):
    df, v, names = words
    monkeypatch.setattr(retrieval, "GROUP_BYTES", 1 << 13)
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v[:60])] + [(99, None)], "query_id long, qvec array<float>")
    found = retrieval.search(df, q, 5, metric, query_bytes=0, where={"label": [0, 1]})
    assert "collect_list" not in found._jdf.queryExecution().toString() and "CartesianProduct" not in found._jdf.queryExecution().toString()
    kept = [i for i in range(300) if i % 3 < 2]
    want = brute(metric, v[:60].astype(float), v[kept].astype(float), np.array(names)[kept], 5, 0.0)
    assert by_query((r["query_id"], r["id"], r["score"]) for r in found.collect()) == {i: sorted(x, key=lambda y: (-y[1], y[0])) for i, x in want.items()}


def test_queries_with_many_best_are_not_held(spark, words):
    """What a task keeps counts as well as the queries' numbers."""
    df, v, _ = words
    q = df.select(F.col("id").alias("query_id"), F.col("embedding").alias("qvec"))
    plan = lambda k: retrieval.search(df, q, k, query_bytes=1 << 16)._jdf.queryExecution().toString()
    assert "task" not in plan(1) and "task" in plan(100)


def test_the_index_gathers_no_cell_and_sends_a_query_once_a_part(spark, words, monkeypatch):
    """A row of a task is a vector, never a list of a cell's rows or queries; all cells give exact search, in groups as held."""
    df, _, _ = words
    q = df.select(F.col("id").alias("query_id"), F.col("embedding").alias("qvec"))
    built = index.build(df, k=5, cells=12)
    exact = {(r[0], r[1], r[2]) for r in retrieval.search(df, q, 5).collect()}
    for most in (1 << 15, 40):
        monkeypatch.setattr(index, "BLOCK_QUERIES", most)
        assert "collect_list" not in built.search(q, 5)._jdf.queryExecution().toString()
        assert {(r[0], r[1], r[2]) for r in built.search(q, 5, probes=12).collect()} == exact
        near = {(r["query_id"], r["id"]) for r in built.search(q, 5).collect()}
        true = {(r["query_id"], r["id"]) for r in retrieval.search(df, q, 5).collect()}
        assert len(near & true) / len(true) >= 0.9
