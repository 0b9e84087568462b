"""Five stages from raw documents to packed training sequences.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet
and read again as the next one's ``docs``.  All but the last return the columns of
``documents`` they were given, in the same order.

1. language ID: documents that no language claims go.
2. near copies: of each group the document with the least doc_id stays.
3. repeated passages: sentences covered by a non-first repeated span go; so does a
   document of which nothing is left.
4. personal data: replaced by pseudonyms of the same format, under the key of the
   session's setting ``spark.corvid.pseudonym.key`` (without it one drawn by the
   application).
5. packing: the byte-pair tokens of every remaining text get their places in training
   sequences, and come with them: the rows of one bin_id, in the order of slot, are the
   ids of one sequence.

Defined results: rows with a null or letterless text go in the first stage; rows with a
null doc_id are never near copies or repeats, and are packed.  Of rows that share a
doc_id and a text, all stay or go.  Very long texts are worked off whole.  An empty table
gives no rows.  Columns besides ``doc_id``, ``text``, ``lang`` and ``n_chars`` are passed
on, whatever their names.

What a stage writes on its way is deleted when its result is written, and a stage's
result when the next one's is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm import langid, packing, pii, simhash, spans
from corvid.storage import cut, drop, scratch

_COUNT = "__n_removed"


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text, where there is such a column."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    removed = spans.remove_repeats(docs, counted=_COUNT)
    emptied: Column = (F.col(_COUNT) > 0) & ~F.col("text").rlike(r"\S")
    return _recounted(removed.where(~emptied).drop(_COUNT))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(pii.pseudonymise(docs))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_tokens(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("SimHash near-dedup", near_copies),
    ("substring dedup", passages),
    ("PII", personal_data),
    ("best-fit packing", sequences),
]

#: Ridge regression, fingerprints and a keyed permutation aren't SQL; tests/llm compares with a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        with scratch(spark) as keep:
            done = keep(cut(stage(spark, docs, sf_dir), f"pipeline-{i}"))
        if i:
            drop(docs)
        docs = done
    return docs
