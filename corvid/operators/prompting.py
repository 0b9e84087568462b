"""Context, prompt, mock answer and response summary as column expressions and aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METADATA_TEMPLATE = "Source: {source}\nDate: {date}"
PROMPT = "Use this context.\n\n{context}\n\nAsked: {question}\nAnswer:"
TEMPLATES = {
    "qa": "Context:\n\n{context}\n\nAnswer from the context alone: {question}\n\nIf it isn't there, say that you don't know.",
    "summarize": "Summarize these documents:\n\n{context}\n\nFocus: {question}",
    "concise": "Context:\n{context}\n\nAnswer in one sentence: {question}",
    "detailed": "Documents:\n{context}\n\nAsked: {question}\n\nAnswer in detail, and cite the documents by number.",
    "chat": "Context:\n{context}\n\n{history}\n\nuser: {question}\nassistant:",
}


@dataclass(frozen=True)
class PromptOptions:
    metadata: bool = True
    scores: bool = False
    numbers: bool = True
    max_documents: int = 5
    keys: tuple[str, ...] = ()
    separator: str = "\n\n"
    metadata_separator: str = ": "


@dataclass(frozen=True)
class GenerationOptions:
    max_tokens: int = 1024
    temperature: float = 0.7
    top_p: float = 0.95
    stop: tuple[str, ...] = ()


def fill_template(template: str, fields: dict[str, Column]) -> Column:
    """``{key}`` replaced for the given keys, what is left in braces removed, trimmed."""
    out = F.lit(template)
    for k, c in fields.items():
        out = F.replace(out, F.lit("{" + k + "}"), F.coalesce(c.cast("string"), F.lit("")))
    return F.regexp_replace(F.regexp_replace(out, r"\{[^}]+\}", ""), r"^\s+|\s+$", "")


def in_order(rank: str, *columns: str) -> Column:
    """Aggregate: the rows' structs in the order of rank."""
    return F.sort_array(F.collect_list(F.struct(rank, *columns)))


def contexts(hits: DataFrame, template: str | None = METADATA_TEMPLATE, fields: Sequence[str] = ("source", "date"), scores: bool = False) -> DataFrame:
    """``query_id, context, n_docs`` and with scores ``avg_score`` from ``query_id, rank, content``, the metadata columns and ``score``."""
    text = F.col("content")
    if template is not None:
        meta = fill_template(template, {k: F.col(k) for k in fields if k in hits.columns})
        text = F.when(meta != "", F.concat(meta, F.lit("\n\n"), text)).otherwise(text)
    own = ["score"] if scores else []
    mean = [F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg_score")] if scores else []
    rows = hits.select("query_id", "rank", *own, text.alias("part")).groupBy("query_id").agg(in_order("rank", "part").alias("r"), *mean)
    return rows.select("query_id", F.array_join(F.transform("r", lambda x: x["part"]), "\n\n").alias("context"), F.size("r").cast("long").alias("n_docs"), *(["avg_score"] if scores else []))


def prompt(context: Column, question: Column, template: str = PROMPT, history: Column | None = None) -> Column:
    """The context goes in first, then history and question, so a context may hold their places."""
    out = F.replace(F.lit(template), F.lit("{context}"), context)
    out = F.replace(out, F.lit("{history}"), F.lit("") if history is None else history)
    return F.replace(out, F.lit("{question}"), question)


def formatted_contexts(hits: DataFrame, options: PromptOptions = PromptOptions()) -> DataFrame:
    """``query_id, context``: numbered documents with scores and metadata lines; metadata is a map column."""
    part = F.col("content")
    if options.metadata and "metadata" in hits.columns:
        entries = F.map_entries("metadata")
        if options.keys:
            entries = F.filter(entries, lambda e: e["key"].isin(*options.keys))
        lines = F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat(e["key"], F.lit(options.metadata_separator), e["value"])), "\n")
        part = F.when(F.coalesce(lines, F.lit("")) != "", F.concat(lines, F.lit("\n"), part)).otherwise(part)
    header = []
    if options.numbers:
        header.append(F.concat(F.lit("Document "), F.col("rank").cast("string")))
    if options.scores:
        header.append(F.format_string("[Similarity: %.2f]", F.col("score")))
    if header:
        part = F.concat(F.concat_ws(" ", *header), F.lit("\n"), part)
    rows = hits.where(F.col("rank") <= options.max_documents).select("query_id", "rank", part.alias("part")).groupBy("query_id").agg(in_order("rank", "part").alias("r"))
    return rows.select("query_id", F.array_join(F.transform("r", lambda x: x["part"]), options.separator).alias("context"))


def mock_answer(text: Column, prefix: str = "Mock answer:", options: GenerationOptions | None = None) -> Column:
    """A repeatable answer: the prompt's beginning, or its first two long lines if it speaks of a context."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(x) > 30)
    quoted = F.array_join(F.transform(F.slice(lines, 1, 2), F.trim), " ")
    cut = F.when(F.length(quoted) > 100, F.concat(F.substring(quoted, 1, 100), F.lit("..."))).otherwise(quoted)
    plain = F.concat(F.lit(f"{prefix} "), F.substring(text, 1, 50), F.lit("..."))
    out = F.when(F.lower(text).contains("context"), F.concat(F.lit("From the context: "), cut)).otherwise(plain)
    if options is not None:
        length = "short" if options.max_tokens < 100 else "detailed"
        manner = "factual" if options.temperature < 0.5 else "creative"
        out = F.concat(F.lit(f"[{length} and {manner}] "), out)
    return out


Provider = Callable[[list[str], GenerationOptions], list[str]]


def generate(prompts: DataFrame, provider: Provider | None = None, options: GenerationOptions = GenerationOptions(), attempts: int = 3) -> DataFrame:
    """``query_id, answer, ok, error``: a provider is called once a batch; without one the mock answers.

    A batch that fails after its attempts gives rows with the error, and the job goes on.
    """
    if provider is None:
        return prompts.select("query_id", mock_answer(F.col("prompt"), options=options).alias("answer"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, error = None, ""
            for _ in range(attempts):
                try:
                    out = provider(batch["prompt"].tolist(), options)
                    break
                except Exception as e:  # noqa: BLE001 - what a provider raises is its own affair
                    error = f"{type(e).__name__}: {e}"
            yield pd.DataFrame({"query_id": batch["query_id"], "answer": out if out is not None else None, "ok": out is not None, "error": None if out is not None else error})

    schema = prompts.select("query_id").schema.add("answer", "string").add("ok", "boolean").add("error", "string")
    return prompts.select("query_id", "prompt").mapInPandas(run, schema)


def summaries(hits: DataFrame) -> DataFrame:
    """``query_id, n_docs, top_id, avg_score, sources``: sources are distinct, in the order of rank."""
    rows = hits.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_docs"), F.min_by("id", F.struct(-F.col("score"), F.col("rank"))).alias("top_id"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg_score"), in_order("rank", "source").alias("r")
    )
    return rows.select("query_id", "n_docs", "top_id", "avg_score", F.array_join(F.array_distinct(F.filter(F.transform("r", lambda x: x["source"]), lambda s: s.isNotNull())), ", ").alias("sources"))
