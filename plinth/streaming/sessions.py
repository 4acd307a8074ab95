"""Summaries of sessions, kept up to date by a stream of what happens to them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Events: a turn (with its number, role and text), a rename (text is the new title) or a delete; seq orders those of a session in a batch.
EVENT = "session_id long, seq long, kind string, turn long, role string, text string"
SUMMARY = "session_id long, n_turns long, n_user long, n_chars long, title string, deleted boolean"
_STATE = "n_turns long, n_user long, n_chars long, first_user long, title string, renamed string"


def _updated(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A session's summary after a batch of its events; what is kept of it is six values, however long it grows."""
    n, user, chars, first, title, renamed = state.get if state.exists else (0, 0, 0, None, None, None)
    gone = False
    events = pd.concat(list(batches)).sort_values("seq", kind="stable")
    for kind, turn, role, text in events[["kind", "turn", "role", "text"]].itertuples(index=False):
        text = None if pd.isna(text) else text
        if kind == "delete":
            n, user, chars, first, title, renamed, gone = 0, 0, 0, None, None, None, True
        elif kind == "rename":
            renamed = text
        elif kind == "turn":
            n, chars, gone = n + 1, chars + len(text or ""), False
            if role == "user":
                user += 1
                if first is None or turn < first:
                    first, title = int(turn), text[:40] if text is not None else None
        else:
            raise ValueError(f"unknown kind of event: {kind}")
    if gone:
        state.remove()
    else:
        state.update((n, user, chars, first, title, renamed))
    yield pd.DataFrame([(key[0], n, user, chars, renamed if renamed is not None else title, gone)], columns=["session_id", "n_turns", "n_user", "n_chars", "title", "deleted"])


def summaries(events: DataFrame) -> DataFrame:
    """A stream of changed summaries (SUMMARY) from a stream of events (EVENT): each batch gives a row for each session it touches."""
    return events.groupBy("session_id").applyInPandasWithState(_updated, SUMMARY, _STATE, "update", GroupStateTimeout.NoTimeout)


def run(spark: SparkSession, events: DataFrame, folder: str) -> DataFrame:
    """Runs the stream to the end of what is there and returns the summary of every session that isn't deleted.

    State and progress are kept in the folder, so a later run goes on with what came since. Each batch's rows are written under its number:
    a batch that is repeated after a failure replaces itself, and of a session the last batch counts.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/summaries/batch={number}")

    query = summaries(events).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(f"{SUMMARY}, batch long").option("basePath", f"{folder}/summaries").parquet(f"{folder}/summaries/*")
    last = rows.groupBy("session_id").agg(F.max_by(F.struct("n_turns", "n_user", "n_chars", "title", "deleted"), "batch").alias("x")).select("session_id", "x.*")
    return last.where(~F.col("deleted")).drop("deleted")
