"""Conversation stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from agrispark import schemas
from agrispark.operators.sequences import with_position_in_key
from agrispark.sources.commits import commit, committed, is_committed, write_batch


def read_conversations(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """JSON files as (conv_id, turn, role, text): one conversation or an array of them each, or one on every line."""
    raw = spark.read.schema(schemas.CONVERSATION_JSON).option("multiLine", not lines).json(path)
    return raw.select(
        F.col("conversation_id").alias("conv_id"), F.posexplode("messages").alias("turn", "message")
    ).select("conv_id", F.col("turn").cast("long").alias("turn"), "message.role", F.col("message.content").alias("text"))


def append_turns(existing: DataFrame, new: DataFrame, order: str, bucket: Column | None = None) -> DataFrame:
    """New messages numbered after the last stored turn of their conversation.

    ``new`` carries conv_id, role, text and a numeric ordering column; only the increment is numbered and returned,
    ready to be appended to the stored table. A busy conversation is numbered in buckets of the ordering column.
    """
    last = existing.groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    bucket = F.floor(F.col(order) / 4096).cast("long") if bucket is None else bucket
    numbered = with_position_in_key(new, ["conv_id"], [order], bucket)
    return numbered.join(last, "conv_id", "left").select(
        "conv_id", (F.coalesce("last_turn", F.lit(-1)) + 1 + F.col("seq")).cast("long").alias("turn"), "role", "text"
    )


def write_conversations(turns: DataFrame, path: str) -> None:
    """Conversations as JSON, one on every line: a row is no larger than its conversation, whatever the table's size."""
    messages = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    whole = turns.groupBy("conv_id").agg(messages.alias("messages")).select(F.col("conv_id").cast("string").alias("conversation_id"), "messages")
    whole.write.mode("overwrite").json(path)


def read_turns(spark: SparkSession, path: str, conv_type: str = "long") -> DataFrame:
    """(conv_id, turn, role, text) of all committed batches."""
    return committed(spark, path, "turns", f"conv_id {conv_type}, turn long, role string, text string, batch long").drop("batch")


def store_turns(spark: SparkSession, new: DataFrame, path: str, order: str, batch: int) -> None:
    """New messages numbered after the stored ones, as one batch of the stored table.

    A batch that is stored already changes nothing, and one that failed is numbered and written anew.
    """
    if is_committed(spark, path, batch):
        return
    kind = new.schema["conv_id"].dataType.simpleString()
    counted = Observation()
    write_batch(append_turns(read_turns(spark, path, kind), new, order).observe(counted, F.count(F.lit(1)).alias("rows")), path, "turns", batch)
    commit(spark, path, batch, counted.get["rows"])
