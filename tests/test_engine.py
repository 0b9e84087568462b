"""Sources, extraction, streaming index, SQL functions and the engine."""

from __future__ import annotations

import io

import pytest
from pyspark.sql import functions as F

from corvid.operators import chunking
from corvid.operators.batch import EmbeddingError, GenerationError, Retry
from corvid.operators.embedding import HashingEmbedder, embed
from corvid.operators.prompting import GenerationOptions
from corvid.plans import sqlapi
from corvid.plans.config import QueryOptions, Settings
from corvid.plans.engine import Engine, robust, standard
from corvid.plans.log import AllOf, console, to_file
from corvid.sources import extract, files
from corvid.sources.providers import FeatureEmbedder, LanguageModel, ListEmbedder, blocks_model, search_collection
from corvid.streaming.indexing import index_folder

MD = "---\ntitle: A title\nauthor: Someone\ndate: 2024-01-02\nempty:\n---\n# Head\n\nBody text."
HTML = "<html><head><title>Page</title><meta name='author' content='Someone'><style>p {}</style></head><body><h1>Head</h1><p>Body &amp; <b>strong</b></p><script>var x = 1;</script><!-- no --></body></html>"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text(MD)
    (tmp_path / "b.html").write_text(HTML)
    (tmp_path / "sub" / "c.TXT").write_text("Plain text.")
    (tmp_path / "sub" / "d.pdf").write_bytes(b"%PDF-1.4")
    return str(tmp_path)


def test_read_folder(spark, folder):
    got = {r["id"]: r for r in files.read_folder(spark, folder).collect()}
    assert set(got) == {"a.md", "b.html", "c.TXT", "d.pdf"}
    assert got["a.md"]["content"] == "# Head\n\nBody text." and got["a.md"]["metadata"]["author"] == "Someone" and "empty" not in got["a.md"]["metadata"]
    assert got["b.html"]["content"] == "PageHeadBody & strong" and got["b.html"]["metadata"]["title"] == "Page" and got["b.html"]["metadata"]["author"] == "Someone"
    assert got["c.TXT"]["content"] == "Plain text." and got["c.TXT"]["metadata"]["size"] == "11" and got["c.TXT"]["metadata"]["source"] == "file"
    assert got["d.pdf"]["content"] is None and got["d.pdf"]["metadata"]["format"] == "pdf"
    assert {r["id"] for r in files.read_folder(spark, folder, extensions=["txt", ".md"]).collect()} == {"a.md", "c.TXT"}
    assert {r["id"] for r in files.read_folder(spark, folder, recursive=False, extensions=["txt", "md"]).collect()} == {"a.md"}
    assert files.read_file(spark, f"{folder}/a.md").first()["format"] == "markdown"


def test_html_block_spacing(spark):
    assert spark.range(1).select(extract.html_text(F.lit("<p>a</p><p>b</p>"), True)).first()[0] == "a b"


def test_metadata(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"},), (None,)], "metadata map<string,string>")
    assert [r["metadata"] for r in extract.with_metadata(df, b="3", c="4").collect()] == [{"a": "1", "b": "3", "c": "4"}, {"b": "3", "c": "4"}]


def test_csv_products(spark, tmp_path):
    (tmp_path / "p.csv").write_text("product_id,name,description,category,price\n1,Book,Good,Books,9.5\n2,Pen,Blue,Office,\n3\n")
    got = {r["id"]: r for r in files.read_csv_products(spark, str(tmp_path / "p.csv")).collect()}
    assert got["1"]["content"] == "Book\nGood\nCategory: Books\nPrice: 9.50" and got["2"]["metadata"]["price"] == "0.0" and "3" not in got


def test_fetch_and_writers(spark, tmp_path):
    def get(url):
        if "bad" in url:
            raise OSError("no route")
        return "text/html", HTML

    rows = {r["url"]: r for r in files.fetch(spark.createDataFrame([("http://a",), ("http://bad",)], "url string"), get).collect()}
    assert rows["http://a"]["mime"] == "text/html" and "no route" in rows["http://bad"]["error"]
    out = str(tmp_path / "sent")

    def send(batch, out=out):
        import os
        import uuid

        os.makedirs(out, exist_ok=True)
        with open(f"{out}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(len(batch)))

    files.write_batches(spark.range(25).coalesce(1), send, 10)
    import os

    assert sorted(int(open(f"{out}/{n}").read()) for n in os.listdir(out)) == [5, 10, 10]
    row = {"id": 1, "content": "x", "metadata": {"a": "b"}, "embedding": [1.0]}
    assert files.hash_commands([row]) == [("doc:1", {"id": "1", "content": "x", "metadata": '{"a": "b"}'})]
    assert files.collection_payload([row]) == {"ids": ["1"], "embeddings": [[1.0]], "metadatas": [{"a": "b"}], "documents": ["x"]}


def test_streaming_index_reads_each_file_once(spark, folder, tmp_path_factory):
    store, checkpoint = (str(tmp_path_factory.mktemp(n)) for n in ("store", "checkpoint"))
    for _ in range(2):
        index_folder(spark, folder, store, checkpoint, extensions=["txt", "md"]).awaitTermination(120)
        assert sorted(r["parent_id"] for r in spark.read.parquet(store).collect()) == ["a.md", "c.TXT"]
    with open(f"{folder}/new.txt", "w") as f:
        f.write("More.")
    index_folder(spark, folder, store, checkpoint, extensions=["txt", "md"]).awaitTermination(120)
    assert spark.read.parquet(store).count() == 3


def test_streaming_index_tells_progress_and_failure(spark, folder, tmp_path_factory):
    store, checkpoint = (str(tmp_path_factory.mktemp(n)) for n in ("store", "checkpoint"))
    seen, broken = [], []

    def fail_once(chunks, number):
        if not broken:
            raise OSError("full")

    q = index_folder(spark, folder, store, checkpoint, extensions=["txt", "md"], then=fail_once, failed=lambda n, e: broken.append((n, str(e))))
    with pytest.raises(Exception, match="full"):
        q.awaitTermination(120)
    index_folder(spark, folder, store, checkpoint, extensions=["txt", "md"], then=fail_once, progress=lambda *n: seen.append(n)).awaitTermination(120)
    assert broken == [(0, "full")] and seen == [(0, 2, 2)] and spark.read.parquet(store).count() == 2


def test_chunks_of_files(spark, folder):
    rows = files.read_chunks(spark, folder, "fixed", chunking.Chunking(size=8, overlap=0)).collect()
    assert {r["parent_id"] for r in rows} == {"a.md", "b.html", "c.TXT"} and all(len(r["content"]) <= 8 and r["metadata"]["relative_path"] for r in rows)


def test_outcomes(spark, engine):
    assert engine.outcome(engine.ask, "Which language is it?").ok
    lost = Engine(spark).outcome(Engine(spark).ask, "x")
    assert not lost.ok and lost.value is None and "nothing is indexed" in str(lost.error)


def test_sql_functions(spark):
    assert "vec_cosine" in sqlapi.register(spark)
    got = spark.sql("SELECT vec_dot(array(1D, 2D), array(3D, 4D)) d, vec_cosine(array(1D, 0D), array(0D, 0D)) c, vec_distance(array(0D), array(2D)) e, clean_whitespace('  a \n b ') w, strip_tags('<b>x</b>') s, chunk_windows('abcde', 3, 2) k").first()
    assert tuple(got) == (11.0, 0.0, 2.0, "a b", "x", ["abc", "cde", "e"])


TEXTS = [("doc1", "Scala is a language for the virtual machine."), ("doc2", "Java is a language, too, and an island."), ("doc3", "Neural networks learn from examples.")]


@pytest.fixture
def engine(spark):
    e = Engine(spark, Settings().with_retrieval(limit=2))
    status = e.index(spark.createDataFrame([(i, t, {"topic": "ai" if i == "doc3" else "programming", "source": i}) for i, t in TEXTS], "id string, content string, metadata map<string,string>")).collect()
    assert len(status) == 3 and all(r["ok"] and r["n_chunks"] == 1 for r in status)
    return e


def test_engine_answers(spark, engine):
    questions = spark.createDataFrame([(1, "Which language is for the virtual machine?"), (2, "What do neural networks learn from?")], "query_id long, question string")
    hits = {(r["query_id"], r["rank"]): r["parent_id"] for r in engine.retrieve(questions).collect()}
    assert hits[1, 1] == "doc1" and hits[2, 1] == "doc3"
    got = {r["query_id"]: r for r in engine.query(questions).collect()}
    assert got[1]["n_docs"] == 2 and got[1]["ok"] and got[1]["context_length"] > 0 and not got[1]["reranked"]
    only = engine.query(questions, QueryOptions(where={"topic": "programming"}, limit=1, rerank=True))
    assert {(r["n_docs"], r["reranked"]) for r in only.collect()} == {(1, True)}
    assert {r["parent_id"] for r in engine.retrieve(questions, QueryOptions(where={"topic": "programming"})).collect()} <= {"doc1", "doc2"}
    assert "context" in engine.ask("Which language is it?")


def test_engine_updates_and_deletes(spark, engine, tmp_path):
    engine.index_text([("doc1", "Scala is an island near a harbour.")])
    assert engine.store.count() == 3
    engine.delete(spark.createDataFrame([("doc1",)], "id string"))
    assert engine.store.count() == 2
    engine.save(str(tmp_path / "store"))
    assert Engine(spark).load(str(tmp_path / "store")).store.count() == 2
    engine.clear()
    with pytest.raises(ValueError, match="nothing is indexed"):
        engine.retrieve(spark.createDataFrame([(1, "x")], "query_id long, question string"))


def test_engine_indexes_folders_and_pages(spark, folder):
    e = Engine(spark, Settings().with_indexing(chunking=chunking.Chunking(size=10, overlap=0)))
    status = {r["id"]: r for r in e.index_folder(folder).collect()}
    assert status["a.md"]["n_chunks"] == 2 and not status["d.pdf"]["ok"]
    e.index_pages(spark.createDataFrame([("http://a/x", HTML)], "url string, html string"))
    assert "http://a/x" in {r["parent_id"] for r in e.store.collect()}


def test_each_text_is_embedded_once(spark):
    """Ten texts and three questions are thirteen calls, however often results are used."""
    calls = spark.sparkContext.accumulator(0)

    def embedder(texts):
        calls.add(len(texts))
        return HashingEmbedder(16)(texts)

    e = Engine(spark, embedder=embedder, dim=16)
    docs = spark.createDataFrame([(str(i), f"text number {i} of a few") for i in range(10)], "id string, content string")
    e.index(docs).collect()
    e.store.count()
    answers = e.query(spark.createDataFrame([(i, f"which text is {i}?") for i in range(3)], "query_id long, question string"))
    answers.collect()
    assert answers.count() == 3 and calls.value == 13
    assert {r["question_dimensions"] for r in answers.collect()} == {16}


def test_engine_compacts_and_forgets(spark):
    from corvid import storage

    e = Engine(spark)
    for i in range(20):
        e.index_text([(str(i), f"text {i}"), ("same", f"version {i}")])
    rows = {r["parent_id"]: r["content"] for r in e.store.collect()}
    assert len(rows) == 21 and rows["same"] == "version 19"
    assert e.store._jdf.queryExecution().toString().count("Relation") < 60
    e.index_text([("same", None)])
    assert e.store.where("parent_id = 'same'").count() == 0
    e.forget()
    assert not storage._MADE


def test_engine_indexes_urls(spark):
    def get(url):
        if "bad" in url:
            raise OSError("no route")
        return {"a": ("text/html", HTML), "b": ("text/plain", "Plain <b>text</b>"), "c": ("application/pdf", "%PDF")}[url[-1]]

    e = Engine(spark)
    got = {r["id"]: r for r in e.index_urls(spark.createDataFrame([(f"http://x/{u}",) for u in ("a", "b", "c", "bad")], "url string"), get).collect()}
    assert {k[-1]: (r["ok"], r["error"] is None) for k, r in got.items()} == {"a": (True, True), "b": (True, True), "c": (False, True), "d": (False, False)}
    rows = {r["parent_id"]: r for r in e.store.collect()}
    assert rows["http://x/a"]["content"] == "PageHeadBody & strong" and rows["http://x/a"]["metadata"]["author"] == "Someone" and rows["http://x/b"]["content"] == "Plain <b>text</b>"


def test_relative_paths(spark, folder):
    got = {r["id"]: r["metadata"]["relative_path"] for root in (folder, f"file:{folder}", f"file://{folder}/") for r in files.read_folder(spark, root).collect()}
    assert got == {"a.md": "a.md", "b.html": "b.html", "c.TXT": "sub/c.TXT", "d.pdf": "sub/d.pdf"}


def test_engine_in_threads_and_factories(spark, engine):
    assert "context" in engine.submit(engine.ask, "Which language is it?").result(120)
    assert not standard(spark).settings.retrieval.reranking and robust(spark).settings.retrieval.reranking


def test_semantic_strategy_embeds_paragraphs(spark):
    e = Engine(spark, Settings().with_indexing(strategy="semantic"))
    e.index_text([("d", "cats purr and cats sleep\n\ncats purr and cats sleep too\n\nships sail far\n\nships sail far too")])
    assert e.store.count() == 2


def test_resilient_engine_takes_its_second_ways(spark, tmp_path):
    def down(*_):
        raise ConnectionError("down")

    questions = spark.createDataFrame([(1, "Which language is it?")], "query_id long, question string")
    docs = spark.createDataFrame(TEXTS, "id string, content string")
    path, shown = str(tmp_path / "log"), io.StringIO()
    e = robust(spark, embedder=down, second_embedder=HashingEmbedder(64), provider=down, second_provider=lambda prompts, options: ["second"] * len(prompts), log=AllOf(to_file(path), console("error", shown)))
    assert e.index(docs).where("ok").count() == 3
    r = e.query(questions).first()
    assert r["ok"] and r["answer"] == "second" and r["n_docs"] > 0 and r["reranked"]
    assert e.measures.counts["embedding_failures"] == 1 and e.measures.counts["generation_failures"] == 1 and e.measures.counts["questions"] == 1
    lines = open(path).read()
    assert "WARNING embedding failed" in lines and "WARNING generation failed" in lines and not shown.getvalue()
    alone = robust(spark, embedder=down, log=console("error", shown))
    assert not alone.index(docs).where("ok").count() and "ERROR embedding failed" in shown.getvalue()
    r = alone.query(questions).first()
    assert not r["ok"] and r["answer"] == "The documents could not be searched."
    backed = robust(spark, embedder=HashingEmbedder(64), second_store=e.store)
    assert backed.query(questions).first()["n_docs"] > 0


# --- providers ---
def test_embedding_services(spark):
    sent = []

    def list_service(path, payload):
        sent.append(payload)
        return {"data": [{"index": i, "embedding": [float(i + 1), 0.0]} for i in reversed(range(len(payload["input"])))]}

    assert ListEmbedder(list_service, "m", 2)(["a", "b"]) == [[1.0, 0.0], [1.0, 0.0]] and sent[0] == {"model": "m", "input": ["a", "b"]}
    sizes = []

    def feature_service(path, payload):
        sizes.append(len(payload["inputs"]))
        return [[0.0, 2.0]] * len(payload["inputs"])

    assert FeatureEmbedder(feature_service, "m", 2)(["x"] * 19) == [[0.0, 1.0]] * 19 and sizes == [8, 8, 3]
    with pytest.raises(EmbeddingError, match="gave"):
        FeatureEmbedder(feature_service, "m", 3)(["x"])
    with pytest.raises(EmbeddingError, match="without vectors"):
        ListEmbedder(lambda *_: {}, "m", 2)(["x"])
    df = spark.createDataFrame([(1, "a"), (2, " ")], "id long, content string")
    service = FeatureEmbedder(lambda path, payload: [[3.0, 4.0]] * len(payload["inputs"]), "m", 2)
    assert {r["id"]: [round(x, 3) for x in r["embedding"]] for r in embed(df, service, 2).collect()} == {1: [0.6, 0.8], 2: [0.0, 0.0]}


def test_language_models():
    tries = []

    def service(path, payload):
        tries.append((path, payload))
        if len(tries) == 1:
            raise OSError("busy")
        return {"choices": [{"message": {"content": "chat"}}]} if "completions" in path else {"content": [{"type": "text", "text": "in "}, {"type": "other"}, {"type": "text", "text": "blocks"}]}

    o = GenerationOptions(max_tokens=5, stop=("x",))
    fast = {"per_minute": None, "retry": Retry(3, 0.0)}
    assert LanguageModel(service, "m", system="s", **fast)(["p"], o) == ["chat"] and len(tries) == 2
    assert tries[1][1]["messages"] == [{"role": "system", "content": "s"}, {"role": "user", "content": "p"}] and tries[1][1]["stop"] == ["x"] and tries[1][1]["max_tokens"] == 5
    assert blocks_model(service, "m", system="s", **fast)(["p"], o) == ["in blocks"] and tries[2][0] == "/v1/messages" and tries[2][1]["system"] == "s"
    with pytest.raises(GenerationError, match="without text"):
        LanguageModel(lambda *_: {"choices": []}, "m", **fast)(["p"], o)


def test_search_of_a_collection(spark):
    def service(path, payload):
        if payload["query_embeddings"][0][0] > 5:
            raise OSError("no route")
        n = len(payload["query_embeddings"])
        return {"ids": [["a", "b"]] * n, "distances": [[0.5, 0.25]] * n, "documents": [["A", "B"]] * n, "metadatas": [[None, {"k": payload["where"]["t"]}]] * n}

    q = spark.createDataFrame([(1, [1.0]), (2, [9.0]), (3, None)], "query_id long, qvec array<double>").coalesce(1)
    rows = sorted(map(tuple, search_collection(q, service, "docs", 2, {"t": "x"}, size=1, retry=Retry(1)).collect()), key=str)
    assert rows[:2] == [(1, 1, "b", 0.75, "B", '{"k": "x"}', None), (1, 2, "a", 0.5, "A", "{}", None)]
    assert rows[2][0] == 2 and rows[2][2] is None and "no route" in rows[2][6] and len(rows) == 3


def test_failed_provider_is_a_row(spark, engine):
    def down(prompts, options):
        raise ConnectionError("down")

    engine.provider = down
    r = engine.query(spark.createDataFrame([(1, "x language")], "query_id long, question string")).first()
    assert not r["ok"] and "down" in r["error"] and r["answer"] == "No answer could be generated."
