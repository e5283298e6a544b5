"""Save trigger over a stream of user messages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairnlake.operators.sessions import SAVE_INTERVAL


def save_triggers(messages: DataFrame, interval: int = SAVE_INTERVAL) -> DataFrame:
    """Emit ``(session, messages)`` whenever ``interval`` more user messages have arrived.

    The state is two numbers per session: messages seen and messages at the last save.
    Only a session key and a count travel to the state, and a group is read in chunks.
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, saved = state.get if state.exists else (0, 0)
        for batch in batches:
            seen += int(batch["n"].sum())
        due = []
        while seen - saved >= interval:
            saved += interval
            due.append(saved)
        state.update((seen, saved))
        yield pd.DataFrame({"session": [key[0]] * len(due), "messages": pd.Series(due, dtype="int64")})

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.groupby("session").size().reset_index(name="n")

    # Counting before the shuffle leaves one row per session and Arrow batch.
    counted = messages.select(F.col("session").cast("string").alias("session")).mapInPandas(
        combine, "session string, n long"
    )
    return counted.groupBy("session").applyInPandasWithState(
        advance, "session string, messages long", "seen long, saved long", "append", GroupStateTimeout.NoTimeout
    )
