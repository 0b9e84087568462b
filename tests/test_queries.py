"""Every registered query of the engine gives the rows of its SQL."""

from __future__ import annotations

import pytest
from oracle import connect, rows

from corvid import queries


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_rows_are_those_of_the_sql(spark, sf_dir, con, name):
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_approximate_search_recalls_the_exact_one(spark, sf_dir):
    from corvid.operators import retrieval

    got = queries.QUERIES["topk_approximate"](spark, sf_dir).toPandas()
    exact = retrieval.search(*queries._store(spark, sf_dir), k=10).toPandas()
    near, want = set(zip(got.query_id, got.id)), set(zip(exact.query_id, exact.id))
    assert len(near & want) / len(want) >= 0.9


def test_content_aware_chunks_are_the_text(spark, sf_dir):
    from pyspark.sql import functions as F

    from corvid.operators import chunking

    docs = queries._markdown(spark, sf_dir)
    chunks = chunking.chunk(docs, "content_aware").groupBy("parent_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), "").alias("back"))
    assert docs.join(chunks, docs["id"] == chunks["parent_id"], "left").where("not (content <=> back) and content <> ''").count() == 0


def test_breaker_trace_has_every_user(spark, sf_dir):
    got = queries.QUERIES["breaker_trace"](spark, sf_dir)
    assert got.count() == spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().count()


def test_questions_are_searched_once(spark, sf_dir):
    plan = queries.QUERIES["ask_end_to_end"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow run") == 1
