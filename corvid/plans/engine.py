"""The engine: index tables of documents, answer tables of questions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any, Generic, TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.functions.ids import content_id
from corvid.functions.text import clean
from corvid.operators import cache, chunking, embedding, metrics, prompting, rerank, retrieval
from corvid.operators.batch import EmbeddingError, EngineError, GenerationError, StoreError, error_answer
from corvid.plans.config import QueryOptions, Settings
from corvid.plans.log import AllOf, Log
from corvid.sources import files
from corvid.storage import clear, cut, scratch

R = TypeVar("R")


@dataclass(frozen=True)
class Outcome(Generic[R]):
    value: R | None
    error: Exception | None

    @property
    def ok(self) -> bool:
        return self.error is None


#: Calls of ``index`` and ``delete`` after which the store is written as one table.
COMPACT = 8


class Engine:
    """Holds a store of chunks with embeddings.

    ``index`` embeds and writes its chunks at once, and questions are embedded once a
    call, so nothing is embedded again when a result is used again.  What is written goes
    to the shared folder (:mod:`corvid.storage`) until ``save``; ``forget`` deletes it.

    ``embedder(texts)`` gives vectors of ``dim``; the default hashes tokens.
    ``provider(prompts, options)`` gives answers; without one a mock answers.
    """

    def __init__(self, spark: SparkSession, settings: Settings = Settings(), embedder: embedding.Embed | None = None, dim: int = 64, provider: prompting.Provider | None = None, store: DataFrame | None = None) -> None:
        self.spark, self.settings, self.dim, self.provider = spark, settings, dim, provider
        self.embedder = embedder or embedding.HashingEmbedder(dim)
        self.store, self._changes = store, 0

    def _changed(self, store: DataFrame) -> None:
        """The store's plan grows with each change; every few it is written as one table."""
        self._changes += 1
        if self._changes >= COMPACT:
            store, self._changes = cut(store, "store"), 0
        self.store = store

    def _embed(self, df: DataFrame) -> DataFrame:
        if not self.settings.cache:
            return embedding.embed(df, self.embedder, self.dim)
        known = self.store.select(cache.key_of(F.col("content")).alias("key"), "embedding").dropDuplicates(["key"]) if self.store is not None else self.spark.createDataFrame([], "key string, embedding array<float>")
        return cache.embed_cached(df, known, self.embedder, self.dim)[0]

    def chunks(self, docs: DataFrame, preprocess: bool | None = None) -> DataFrame:
        """Chunks of ``id, content[, metadata]``; a null id is made from the content."""
        i = self.settings.indexing
        content = clean(F.col("content"), i.cleaning) if (i.preprocess if preprocess is None else preprocess) else F.col("content")
        meta = F.col("metadata") if "metadata" in docs.columns else F.lit(None).cast("map<string,string>")
        named = docs.select(F.coalesce(F.col("id").cast("string"), content_id(F.col("content"))).alias("id"), content.alias("content"), meta.alias("metadata"))
        return chunking.chunk(named, i.strategy, i.chunking, lambda units: embedding.embed(units, self.embedder, self.dim))

    def index(self, docs: DataFrame, preprocess: bool | None = None) -> DataFrame:
        """Adds documents to the store, in place of all chunks of those with the same id; returns ``id, n_chunks, ok`` of each."""
        with scratch(self.spark) as keep:
            new = keep(cut(self._embed(self.chunks(docs, preprocess)).dropDuplicates(["id"]), "chunks"))
        ids = docs.select(F.coalesce(F.col("id").cast("string"), content_id(F.col("content"))).alias("id")).distinct()
        if self.store is None:
            self.store = new
        else:
            self._changed(retrieval.delete(self.store, ids.select(F.col("id").alias("parent_id")), "parent_id").unionByName(new))
        counts = new.groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("n_chunks"))
        return ids.join(counts, "id", "left").select("id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.col("n_chunks").isNotNull().alias("ok"))

    def index_text(self, texts: Sequence[tuple[str | None, str]]) -> DataFrame:
        return self.index(self.spark.createDataFrame(list(texts), "id string, content string"))

    def index_folder(self, path: str, recursive: bool = True, extensions: Sequence[str] | None = None) -> DataFrame:
        """Files keep their line structure: the cleaning is for texts."""
        return self.index(files.read_folder(self.spark, path, recursive, extensions).select("id", "content", "metadata"), preprocess=False)

    def index_pages(self, pages: DataFrame) -> DataFrame:
        return self.index(files.read_pages(pages), preprocess=False)

    def index_urls(self, urls: DataFrame, get: Callable[[str], tuple[str, str]]) -> DataFrame:
        """The pages behind ``url``, extracted by MIME type; ``get(url)`` gives type and text. ``id, n_chunks, ok, error`` of each."""
        got = cut(files.fetch_documents(urls, get), "fetched")
        status = self.index(got.select("id", "content", "metadata"), preprocess=False)
        return status.join(got.select("id", "error"), "id")

    def delete(self, ids: DataFrame) -> None:
        if self.store is not None:
            self._changed(retrieval.delete(self.store, cut(ids.select(F.col("id").alias("parent_id")), "deleted"), "parent_id"))

    def clear(self) -> None:
        self.store = None

    def save(self, path: str) -> None:
        if self.store is None:
            raise ValueError("nothing is indexed")
        self.store.write.mode("overwrite").parquet(path)
        self.store, self._changes = self.spark.read.parquet(path), 0

    def forget(self) -> None:
        """Without the store and the tables behind it."""
        self.store = None
        clear(self.spark)

    def load(self, path: str) -> Engine:
        self.store = self.spark.read.parquet(path)
        return self

    def retrieve(self, questions: DataFrame, options: QueryOptions = QueryOptions()) -> DataFrame:
        """``query_id, rank, id, score, content[, metadata]`` for ``query_id, question``."""
        if self.store is None:
            raise ValueError("nothing is indexed")
        r = self.settings.retrieval
        limit = options.limit or r.limit
        asked = cut(embedding.embed(questions.select("query_id", "question"), self.embedder, self.dim, "question").select("query_id", F.col("embedding").alias("qvec")), "questions")
        again = r.reranking if options.rerank is None else options.rerank
        got = retrieval.search(self.store, asked, limit * (r.over_fetch if again else 1), r.metric, r.min_score, 0.0, options.where)
        if again:
            strategy = options.strategy or r.strategy
            candidates = got.join(self.store.select("id", "embedding"), "id")
            got = rerank.rerank(candidates, strategy, limit, **({"weight": options.weight} if strategy in ("mmr", "mmr_by_score", "ensemble", "hierarchical") else {})).select("query_id", "rank", "id", "score")
        kept = [c for c in ("parent_id", "metadata") if c in self.store.columns]
        return got.join(self.store.select("id", "content", *kept), "id")

    def query(self, questions: DataFrame, options: QueryOptions = QueryOptions()) -> DataFrame:
        """``query_id, question, answer, ok, error, n_docs, avg_score, context_length, reranked, question_dimensions``, a row a question."""
        g = self.settings.generation
        hits = cut(self.retrieve(questions, options), "hits")
        if "metadata" in hits.columns:
            hits = hits.withColumns({k: F.try_element_at("metadata", F.lit(k)) for k in ("source", "date")})
        contexts = prompting.contexts(hits, g.metadata_template if options.metadata else None)
        scores = hits.groupBy("query_id").agg(F.avg("score").alias("avg_score"))
        ready = questions.select("query_id", "question").join(contexts, "query_id", "left").join(scores, "query_id", "left")
        ready = ready.withColumn("context", F.coalesce("context", F.lit(""))).withColumn("prompt", prompting.prompt(F.col("context"), F.col("question"), g.prompt))
        answered = self._answers(ready, options.generation or g.options)
        again = self.settings.retrieval.reranking if options.rerank is None else options.rerank
        return ready.join(answered, "query_id").select(
            "query_id", "question", F.coalesce("answer", error_answer(F.lit("generation"))).alias("answer"), "ok", "error",
            F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("avg_score", F.lit(0.0)).alias("avg_score"), F.length("context").cast("long").alias("context_length"), F.lit(again).alias("reranked"), F.lit(self.dim).alias("question_dimensions"),
        )

    def _answers(self, ready: DataFrame, options: prompting.GenerationOptions) -> DataFrame:
        """``query_id, answer, ok, error``; a provider is asked once."""
        answered = prompting.generate(ready, self.provider, options, self.settings.retry.attempts)
        return answered if self.provider is None else cut(answered, "answers")

    def submit(self, call: Callable[..., R], *args: Any, **values: Any) -> Future[R]:
        """A call of this engine in a thread of its own, such as ``submit(engine.ask, question)``."""
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(call, *args, **values)
        finally:
            pool.shutdown(wait=False)

    def outcome(self, call: Callable[..., R], *args: Any, **values: Any) -> Outcome[R]:
        """A call's value or its error, never an exception, as ``outcome(engine.ask, question)``."""
        try:
            return Outcome(call(*args, **values), None)
        except Exception as e:  # noqa: BLE001 - becomes a value
            return Outcome(None, e)

    def ask(self, question: str, **options: Any) -> str:
        """One question, one answer."""
        row = self.query(self.spark.createDataFrame([(0, question)], "query_id long, question string"), QueryOptions(**options)).first()
        return row["answer"] if row else ""


class ResilientEngine(Engine):
    """An engine whose steps have a second way, and which answers with rows, not errors.

    If embedding fails the second embedder is asked (of the same ``dim``; the store must be
    searchable with its vectors), if the search fails the second store, if rows get no
    answer the second provider.  What fails without one is a row whose answer says so.
    Every step is timed and counted, and its failures are logged.
    """

    def __init__(
        self, spark: SparkSession, settings: Settings = Settings(), *args: Any, second_embedder: embedding.Embed | None = None, second_store: DataFrame | None = None, second_provider: prompting.Provider | None = None, log: Log | None = None,
        measures: metrics.Metrics | None = None, **values: Any,
    ) -> None:
        super().__init__(spark, settings, *args, **values)
        self.second_embedder, self.second_store, self.second_provider = second_embedder, second_store, second_provider
        self.log, self.measures = log or AllOf(), measures or metrics.Metrics()

    def _step(self, kind: type[EngineError], calls: Sequence[Callable[[], R]]) -> R:
        """The result of the first call that doesn't fail."""
        for i, call in enumerate(calls):
            try:
                with self.measures.time(kind.kind):
                    return call()
            except Exception as e:  # noqa: BLE001 - the next way's turn
                self.measures.count(f"{kind.kind}_failures")
                self.log.write("error" if i + 1 == len(calls) else "warning", f"{kind.kind} failed", way=i + 1, reason=str(e).split("\n")[0][:200])
                failure = e
        raise kind(str(failure).split("\n")[0]) from failure

    def _with(self, embedder: embedding.Embed, call: Callable[[], R]) -> Callable[[], R]:
        def run() -> R:
            own, self.embedder = self.embedder, embedder
            try:
                return call()
            finally:
                self.embedder = own

        return run

    def index(self, docs: DataFrame, preprocess: bool | None = None) -> DataFrame:
        """As :meth:`Engine.index`; if no embedder works, rows that aren't ok."""
        plain = super().index
        ways = [e for e in (self.embedder, self.second_embedder) if e is not None]
        try:
            return self._step(EmbeddingError, [self._with(e, lambda: plain(docs, preprocess)) for e in ways])
        except EmbeddingError:
            ids = docs.select(F.coalesce(F.col("id").cast("string"), content_id(F.col("content"))).alias("id")).distinct()
            return ids.select("id", F.lit(0).cast("long").alias("n_chunks"), F.lit(False).alias("ok"))

    def retrieve(self, questions: DataFrame, options: QueryOptions = QueryOptions()) -> DataFrame:
        plain = super().retrieve

        def searched(store: DataFrame | None) -> DataFrame:
            own, self.store = self.store, store
            try:
                return cut(plain(questions, options), "hits")
            finally:
                self.store = own

        stores = [self.store, *([self.second_store] if self.second_store is not None else [])]
        ways = [self._with(e, lambda s=s: searched(s)) for s in stores for e in (self.embedder, self.second_embedder) if e is not None]
        return self._step(StoreError, ways)

    def query(self, questions: DataFrame, options: QueryOptions = QueryOptions()) -> DataFrame:
        self.measures.count("questions", questions.count())
        try:
            return super().query(questions, options)
        except EngineError as e:
            return questions.select(
                "query_id", "question", error_answer(F.lit(e.kind)).alias("answer"), F.lit(False).alias("ok"), F.lit(str(e)).alias("error"), F.lit(0).cast("long").alias("n_docs"), F.lit(0.0).alias("avg_score"), F.lit(0).cast("long").alias("context_length"),
                F.lit(False).alias("reranked"), F.lit(self.dim).alias("question_dimensions"),
            )

    def _answers(self, ready: DataFrame, options: prompting.GenerationOptions) -> DataFrame:
        first = cut(self._step(GenerationError, [lambda: super(ResilientEngine, self)._answers(ready, options)]), "answers")
        failed = first.where("not ok")
        n = failed.count()
        if not n:
            return first
        self.measures.count("generation_failures", n)
        self.log.write("warning", "generation failed", rows=n)
        if self.second_provider is None:
            return first
        again = prompting.generate(ready.join(failed.select("query_id"), "query_id", "left_semi"), self.second_provider, options, self.settings.retry.attempts)
        return first.where("ok").unionByName(cut(again, "answers"))


def standard(spark: SparkSession, **values: Any) -> Engine:
    """An engine with the usual settings: paragraphs, cosine, a cache."""
    return Engine(spark, Settings(), **values)


def robust(spark: SparkSession, **values: Any) -> ResilientEngine:
    """One that reranks, tries again and falls back."""
    return ResilientEngine(spark, Settings().with_retrieval(reranking=True), **values)
