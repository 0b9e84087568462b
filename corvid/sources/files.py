"""Files, folders, CSV and pages as tables of documents; writers for stores outside."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.operators.chunking import Chunking, chunk
from corvid.sources import extract as X


def _documents(files: DataFrame, extensions: Sequence[str] | None, root: str | None = None) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    if extensions:
        low = F.lower(name)
        wanted = F.lit(False)
        for e in extensions:
            wanted = wanted | low.endswith("." + e.lower().lstrip("."))
        files = files.where(wanted)
    folder = F.regexp_replace("path", "/[^/]*$", "")
    entries = [
        F.lit("source"), F.lit("file"), F.lit("filename"), name, F.lit("last_modified"), F.unix_millis("modificationTime").cast("string"), F.lit("size"), F.col("length").cast("string"), F.lit("filepath"), F.col("path"), F.lit("directory"), folder,
    ]
    if root is not None:
        # paths come with a scheme, which the root need not have
        top = _plain_path(root).rstrip("/") + "/"
        plain = F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*(?=/))?/*", "/")
        entries += [F.lit("relative_path"), F.when(plain.startswith(top), F.substr(plain, F.lit(len(top) + 1))).otherwise(name)]
    meta = F.create_map(*entries)
    rows = files.select(name.alias("name"), F.col("content").cast("string").alias("text"), meta.alias("metadata"))
    return X.extract(rows)


def _plain_path(path: str) -> str:
    """Absolute and without scheme and host."""
    if re.match("[A-Za-z][A-Za-z0-9+.-]*:/", path):
        return "/" + re.sub("^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*(?=/))?/*", "", path)
    return os.path.abspath(path)


def read_folder(spark: SparkSession, path: str, recursive: bool = True, extensions: Sequence[str] | None = None) -> DataFrame:
    """``id, content, format, metadata`` of the files below a folder, read in parallel."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return _documents(files, extensions, path)


def read_file(spark: SparkSession, path: str) -> DataFrame:
    return _documents(spark.read.format("binaryFile").load(path), None)


def read_chunks(spark: SparkSession, path: str, strategy: str = "paragraph", options: Chunking = Chunking()) -> DataFrame:
    """The chunks of a file, or of the files below a folder, with the files' metadata."""
    return chunk(read_folder(spark, path), strategy, options)


def stream_folder(spark: SparkSession, path: str, recursive: bool = True, extensions: Sequence[str] | None = None, files_a_batch: int | None = None) -> DataFrame:
    """The same as a stream of the files that come in."""
    reader = spark.readStream.format("binaryFile")
    if files_a_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    files = reader.schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return _documents(files, extensions, path)


def from_values(spark: SparkSession, rows: Iterable[tuple[str, str]]) -> DataFrame:
    """Documents that the caller holds, as (id, content)."""
    return spark.createDataFrame(list(rows), "id string, content string")


def read_pages(pages: DataFrame) -> DataFrame:
    """``id, content, metadata`` of fetched pages (``url, html``)."""
    own = X.html_metadata(F.col("html"))
    meta = X.merge_metadata(F.create_map(F.lit("source"), F.col("url"), F.lit("content_type"), F.lit("text/html")), own)
    return pages.select(F.col("url").alias("id"), X.html_text(F.col("html")).alias("content"), meta.alias("metadata"))


def fetch(urls: DataFrame, get: Callable[[str], tuple[str, str]]) -> DataFrame:
    """``url, mime, body, error``: get(url) gives MIME type and text; a failure is a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple[Any, ...]] = []
            for url in pdf["url"]:
                try:
                    out.append((url, *get(url), None))
                except Exception as e:  # noqa: BLE001 - becomes a row
                    out.append((url, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["url", "mime", "body", "error"])

    return urls.select("url").mapInPandas(run, "url string, mime string, body string, error string")


def fetch_documents(urls: DataFrame, get: Callable[[str], tuple[str, str]]) -> DataFrame:
    """``id, content, metadata, error`` of the pages behind ``url``, each extracted by its MIME type.

    A page that can't be had has null content and the error; a type without a reader
    (PDF) has null content.
    """
    return page_documents(fetch(urls, get))


def page_documents(got: DataFrame) -> DataFrame:
    """The same from ``url, mime, body, error``."""
    kind = X.format_of_mime(F.col("mime"))
    base = F.create_map(F.lit("source"), F.col("url"), F.lit("content_type"), F.coalesce("mime", F.lit("")))
    meta = F.when(kind == "html", X.merge_metadata(base, X.html_metadata(F.col("body")))).otherwise(base)
    content = F.when(kind == "html", X.html_text(F.col("body"))).when(kind == "text", F.col("body"))
    return got.select(F.col("url").alias("id"), F.when(F.col("error").isNull(), content).alias("content"), meta.alias("metadata"), "error")


def read_csv_products(spark: SparkSession, path: str) -> DataFrame:
    """``id, content, metadata`` of a product file with a header; a missing price is 0."""
    schema = "product_id string, name string, description string, category string, price double"
    return products(spark.read.option("header", True).option("mode", "DROPMALFORMED").schema(schema).csv(path))


def products(df: DataFrame) -> DataFrame:
    price: Column = F.coalesce("price", F.lit(0.0))
    content = F.concat_ws("\n", F.col("name"), F.col("description"), F.concat(F.lit("Category: "), F.col("category")), F.format_string("Price: %.2f", price))
    return df.where("product_id is not null and name is not null").select(F.col("product_id").cast("string").alias("id"), content.alias("content"), F.create_map(F.lit("category"), F.col("category"), F.lit("price"), price.cast("string")).alias("metadata"))


def write_batches(df: DataFrame, send: Callable[[list[dict[str, Any]]], None], size: int = 100) -> None:
    """Rows to a service, ``size`` at a time in each task; a task that is run again sends again, so ids must make it idempotent."""

    def run(rows: Iterator[Any]) -> None:
        batch: list[dict[str, Any]] = []
        for r in rows:
            batch.append(r.asDict(recursive=True))
            if len(batch) == size:
                send(batch)
                batch = []
        if batch:
            send(batch)

    df.foreachPartition(run)


def hash_commands(rows: list[dict[str, Any]]) -> list[tuple[str, dict[str, str]]]:
    """Key and fields of each row for a key-value store of hashes."""
    return [(f"doc:{r['id']}", {"id": str(r["id"]), "content": r.get("content") or "", "metadata": json.dumps(r.get("metadata") or {})}) for r in rows]


def collection_payload(rows: list[dict[str, Any]]) -> dict[str, list[Any]]:
    """A batch in the columnar form that collection services take."""
    return {"ids": [str(r["id"]) for r in rows], "embeddings": [list(r["embedding"]) for r in rows], "metadatas": [r.get("metadata") or {} for r in rows], "documents": [r.get("content") or "" for r in rows]}
