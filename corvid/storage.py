"""Where intermediate tables go.

Lineage is cut by writing Parquet into the folder all executors share, so a
lost executor costs a re-read and nothing else.  The folder is the session's
``spark.checkpoint.dir``.  Only a local master, as in tests, may fall back to a
temporary folder of this machine.

A frame that is returned lazily reads its tables later, so they can't go with the call
that made them.  :func:`scratch` deletes what was made inside it once its result is
written; :func:`clear` deletes all that is left.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Folders that :func:`cut` wrote in this process and that aren't deleted yet.
_MADE: dict[str, None] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    set_already = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_already.isDefined():
        return str(set_already.get()).rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="corvid-")
    spark.sparkContext.setCheckpointDir(own)
    return "file://" + own


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, without its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE[path] = None
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _folders(df: DataFrame) -> set[str]:
    return {f.rsplit("/", 1)[0] for f in df.inputFiles()}


def drop(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`cut`."""
    for path in _folders(df):
        _delete(df.sparkSession, path)
        own = path.rsplit("/", 1)[1]
        for made in [m for m in _MADE if m.rsplit("/", 1)[1] == own]:
            del _MADE[made]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at the end what :func:`cut` wrote inside, but for the tables that were given to the function it yields."""
    before, kept = set(_MADE), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.update(p.rsplit("/", 1)[1] for p in _folders(df))
        return df

    try:
        yield keep
    finally:
        for path in [m for m in _MADE if m not in before and m.rsplit("/", 1)[1] not in kept]:
            _delete(spark, path)
            del _MADE[path]


def clear(spark: SparkSession) -> int:
    """Delete all tables that :func:`cut` left in this process; frames that still read them fail afterwards. Returns how many."""
    n = len(_MADE)
    for path in list(_MADE):
        _delete(spark, path)
        del _MADE[path]
    return n
