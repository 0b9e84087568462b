"""Conversations as a long table ``conv_id, turn, role, text``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def new_id() -> Column:
    return F.concat(F.lit("conv-"), F.uuid())


def add_messages(table: DataFrame, messages: DataFrame) -> DataFrame:
    """``conv_id, role, text`` (and ``seq`` for their order) go after the last turn of their conversation; a new conversation begins at 0."""
    last = table.groupBy("conv_id").agg(F.max("turn").alias("__last"))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("seq"))
    numbered = messages.withColumn("__nth", nth).join(last, "conv_id", "left")
    return table.unionByName(numbered.select("conv_id", (F.coalesce("__last", F.lit(-1)) + F.col("__nth")).cast(table.schema["turn"].dataType).alias("turn"), "role", "text"))


def get(table: DataFrame, ids: DataFrame) -> DataFrame:
    """The messages of those conversations."""
    return table.join(ids.select("conv_id").distinct(), "conv_id", "left_semi")


def get_or_create(table: DataFrame, ids: DataFrame, greeting: str | None = None) -> DataFrame:
    """The messages of those conversations; one that isn't there begins with a message of the system, if a greeting is given.

    A null id asks for a new conversation of its own, where ids are text.
    """
    wanted = ids.select("conv_id")
    if dict(wanted.dtypes)["conv_id"] == "string":
        wanted = wanted.select(F.coalesce("conv_id", new_id()).alias("conv_id"))
    known = get(table, wanted.where("conv_id is not null")).select("conv_id", "turn", "role", "text")
    if greeting is None:
        return known
    new = wanted.where("conv_id is not null").distinct().join(table.select("conv_id").distinct(), "conv_id", "left_anti")
    return known.unionByName(new.select("conv_id", F.lit(0).cast(table.schema["turn"].dataType).alias("turn"), F.lit("system").alias("role"), F.lit(greeting).alias("text")))


def last_messages(table: DataFrame, n: int = 10, system: bool = True) -> DataFrame:
    """The last n turns of each conversation; without ``system`` those messages don't count."""
    rows = table if system else table.where("lower(role) <> 'system'")
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return rows.withColumn("__back", F.row_number().over(w)).where(F.col("__back") <= n).drop("__back")


def histories(table: DataFrame, n: int = 10, system: bool = True) -> DataFrame:
    """``conv_id, history, question``: a last message of the user is the question and leaves the history."""
    got = last_messages(table, n, system).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.lower("role").alias("role"), "text"))).alias("m"))
    asks = F.element_at("m", -1)["role"] == "user"
    kept = F.when(asks, F.slice("m", 1, F.size("m") - 1)).otherwise(F.col("m"))
    line = F.transform(kept, lambda x: F.concat(x["role"], F.lit(": "), x["text"]))
    return got.select("conv_id", F.array_join(line, "\n\n").alias("history"), F.when(asks, F.element_at("m", -1)["text"]).alias("question"))


def documents_of(links: DataFrame) -> DataFrame:
    """``conv_id, document_ids``: the distinct documents of each conversation, in order."""
    return links.groupBy("conv_id").agg(F.array_sort(F.collect_set("doc_id")).alias("document_ids"))


def save(table: DataFrame, path: str) -> None:
    """JSON lines, a folder a conversation."""
    table.write.mode("overwrite").partitionBy("conv_id").json(path)


def load(spark: SparkSession, path: str, schema: str = "turn long, role string, text string, conv_id long") -> DataFrame:
    return spark.read.schema(schema).json(path)
