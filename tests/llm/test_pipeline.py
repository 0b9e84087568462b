"""The pipeline, stage by stage, and the registered queries."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline as P
import data
import pytest
from pyspark.sql import functions as F
from test_layout_ops import check_packed

import __spark_entry__ as entry
from corvid.llm import bpe, langid, packing, pii, queries, simhash, spans
from corvid.storage import cut

TEN = [f"op{n}_" for n in range(1, 11)]


def test_ten_operators_and_the_pipeline_are_registered():
    found = entry.queries()
    assert [sum(q.startswith(n) for q in found) for n in TEN] == [1] * 10 and "pipeline" in found
    assert set(entry.oracle_sql()) <= set(found)
    assert [n for n, _ in P.STAGES] == ["language ID", "SimHash near-dedup", "substring dedup", "PII", "best-fit packing"]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_query_gives_a_row_for_each_document(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    key = "page_id" if name == "op6_urls" else "doc_id"
    table = spark.read.parquet(f"{sf_dir}/{'pages' if name == 'op6_urls' else 'documents'}.parquet")
    assert {r[0] for r in df.select(key).collect()} == {r[0] for r in table.select(key).collect()}


def stages(spark, docs):
    out = [docs]
    for name, f in P.STAGES:
        out.append(cut(f(spark, out[-1], ""), f"test-{name.replace(' ', '-')}"))
    return out


def test_each_stage_does_its_work(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    raw, known, single, cleaned, private, packed = stages(spark, docs)
    rows = [{r["doc_id"]: r for r in x.collect()} for x in (raw, known, single, cleaned, private)]
    assert all(x.columns == docs.columns and x.dtypes == docs.dtypes for x in (known, single, cleaned, private))
    assert set(rows[1]) == {r["doc_id"] for r in langid.identify(raw).where("accepted").collect()}
    assert set(rows[2]) == {r["doc_id"] for r in simhash.groups(known).where("keep").collect()}
    assert 0 < len(rows[2]) < len(rows[1])
    from test_dedup_ops import plain_removal

    want = {i: (t, n) for i, t, n in plain_removal([(i, r["text"]) for i, r in rows[2].items()], spans.SENTENCES, spans.MIN_WORDS)}
    assert {i: r["text"] for i, r in rows[3].items()} == {i: t for i, (t, n) in want.items() if not (n and not t.strip())}
    assert any(n for _, n in want.values())
    assert {i: r["text"] for i, r in rows[4].items()} == {i: pii.replace(r["text"], pii.session_key(spark))[0] for i, r in rows[3].items()}
    assert all(r["n_chars"] == len(r["text"]) for r in rows[4].values())
    ids = {r["doc_id"]: r["token_ids"] for r in bpe.encode(private).collect()}
    check_packed(packed.collect(), [(i, len(t)) for i, t in ids.items()], packing.CAPACITY)
    assert all(r["token_ids"] == ids[r["doc_id"]][r["start"] : r["start"] + r["n_tokens"]] for r in packed.collect())
    back = bpe.decode(packed.where("piece = 0").join(packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n = 1"), "doc_id"))
    assert {r["doc_id"]: r["text"] for r in back.collect()}.items() <= {i: r["text"] for i, r in rows[4].items()}.items()
    rest = lambda x: Counter((r["bin_id"], r["slot"], r["doc_id"], r["piece"], r["n_tokens"], tuple(r["token_ids"])) for r in x.collect())
    assert rest(P.run(spark, d)) == rest(packed)


def test_a_run_leaves_only_its_result(spark, sf_dir, tmp_path):
    """All that the stages write on their way is deleted."""
    import os

    from corvid import storage

    storage.clear(spark)
    shared = storage.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(shared))
    out = P.run(spark, sf_dir)
    assert {x.rsplit("-", 1)[0] for x in set(os.listdir(shared)) - before} == {"pipeline-4"}
    assert out.count() > 0
    assert storage.clear(spark) == 1 and set(os.listdir(shared)) == before


@pytest.mark.parametrize("kind", ["hard", "empty", "extra"])
def test_stages_stand_hard_rows(spark, kind):
    docs = {"hard": data.hard, "empty": data.empty, "extra": lambda s: data.hard(s).selectExpr("1 as a", "*", "2 as `__copy`", "3 as c0", "4 as n", "5 as shard")}[kind](spark)
    got = stages(spark, docs)
    assert all(x.columns == docs.columns for x in got[:-1])
    if kind == "empty":
        assert [x.count() for x in got] == [0] * 6
        return
    ids = [[r["doc_id"] for r in x.select("doc_id").collect()] for x in got]
    # no letters: 4, 5, 6, 8 and a null text; unknown: 10
    assert not {4, 5, 6, 8} & set(ids[1]) and {1, 2, 3, 11, 12, 13} <= set(ids[1])
    assert 1 in ids[2] and not {2, 3} & set(ids[2])
    assert {1, 11, 12, 13} <= set(ids[5])


def test_clean_documents_pass_unchanged(spark):
    labelled = [(i, data.prose(3000 + i, 14, "de" if i % 2 else "en"), "de" if i % 2 else "en", "s", 0) for i in range(60)]
    docs = spark.createDataFrame(labelled, data.SCHEMA)
    private = stages(spark, docs)[4]
    assert {r["doc_id"]: r["text"] for r in private.collect()} == {r[0]: r[1] for r in labelled}
