"""Turn pairing and the save trigger over message rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.functions.ordered import next_value, running_sum

SAVE_INTERVAL = 15
TURN_BLOCK = 4096


def turn_pairs(messages: DataFrame) -> DataFrame:
    """Each user turn with the assistant turn that directly follows it, if any.

    Turns are cut into blocks, so a conversation of any length is spread over tasks.
    """
    block = F.floor(F.col("turn") / TURN_BLOCK)
    packed = messages.withColumn("_message", F.struct("role", "text"))
    following = next_value(packed, ["conv_id"], ["turn"], block, "_message", "_following")
    answer = F.when(F.col("_following.role") == "assistant", F.col("_following.text"))
    return following.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("question"), answer.alias("answer")
    )


def save_triggers(events: DataFrame, keys: list[str], order: list[str], block: Column, interval: int = SAVE_INTERVAL) -> DataFrame:
    """Rows at which ``interval`` user messages have passed since the last save of their session."""
    counted = running_sum(events, keys, order, block, F.lit(1), "messages")
    return counted.where(F.col("messages") % interval == 0)
