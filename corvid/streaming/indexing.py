"""Incremental indexing: new files become chunks in a Parquet store, each file once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvid.operators.chunking import Chunking, chunk
from corvid.sources import files


def index_folder(
    spark: SparkSession, path: str, store: str, checkpoint: str, strategy: str = "paragraph", options: Chunking = Chunking(), extensions: Sequence[str] | None = None, then: Callable[[DataFrame, int], None] | None = None,
    progress: Callable[[int, int, int], None] | None = None, failed: Callable[[int, Exception], None] | None = None, files_a_batch: int | None = None,
) -> StreamingQuery:
    """Works off what is there and ends; the checkpoint remembers which files are done.

    Each batch is written to a folder of its own, over what an earlier try of it left,
    so a repeated batch changes nothing.  ``then`` gets a batch's chunks, ``progress`` its
    number with the files and chunks in it, ``failed`` its number and error before the
    query ends with it; the next start takes that batch up again.
    """

    def save(batch: DataFrame, number: int) -> None:
        try:
            at = f"{store}/batch={number}"
            chunk(batch, strategy, options).write.mode("overwrite").parquet(at)
            chunks = spark.read.parquet(at)
            if then:
                then(chunks, number)
            if progress:
                n = chunks.agg(F.count_distinct("parent_id"), F.count(F.lit(1))).first()
                progress(number, int(n[0]), int(n[1]))
        except Exception as e:
            if failed:
                failed(number, e)
            raise

    found = files.stream_folder(spark, path, extensions=extensions, files_a_batch=files_a_batch)
    return found.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(save).start()
