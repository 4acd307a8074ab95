"""Sessions and traces. Turns are (session_id, turn, role, text); traces (trace_id, operation, status, started_at)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.operators.numbering import numbered


def summarize(turns: DataFrame) -> DataFrame:
    """For each session: turns, user turns, characters, first words of the first user turn as its title; and where turns have a status or
    sources (an array), failed turns and different sources."""
    title = F.min_by(F.substring("text", 1, 40), F.when(F.col("role") == "user", F.col("turn")))
    more = [F.count_if(F.col("status") == "failed").alias("n_failed")] if "status" in turns.columns else []
    if "sources" in turns.columns:
        more.append(F.size(F.array_distinct(F.flatten(F.collect_list(F.coalesce("sources", F.array().cast("array<string>")))))).alias("n_sources"))
    return turns.groupBy("session_id").agg(
        F.count("*").alias("n_turns"), F.count_if(F.col("role") == "user").alias("n_user"), F.sum(F.length("text")).alias("n_chars"), title.alias("title"), *more
    )


def append(turns: DataFrame, new: DataFrame) -> DataFrame:
    """turns and new ones (session_id, ...), numbered on from each session's last turn in the order of their own numbers."""
    last = turns.groupBy("session_id").agg(F.max("turn").alias("last"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("turn"))
    rows = new.withColumn("place", place).join(last, "session_id", "left")
    return turns.unionByName(rows.withColumn("turn", (F.coalesce("last", F.lit(-1)) + F.col("place")).cast(turns.schema["turn"].dataType)).drop("place", "last"), allowMissingColumns=True)


def changed(sessions: DataFrame, session_id, **values) -> DataFrame:
    """sessions with other values in columns of one: a title, pinned, starred. An empty title is refused."""
    if not str(values.get("title", "-")).strip():
        raise ValueError("a session needs a title")
    return sessions.withColumns({c: F.when(F.col("session_id") == session_id, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def without(rows: DataFrame, session_id) -> DataFrame:
    """Sessions, or turns, without those of one session."""
    return rows.where(F.col("session_id") != session_id)


def branch(turns: DataFrame, last_turn: int) -> DataFrame:
    """The turns up to and with ``last_turn``, under a new session id."""
    name = F.concat(F.col("session_id").cast("string"), F.lit(f"-branch-{last_turn}"))
    return turns.where(F.col("turn") <= last_turn).withColumn("session_id", name)


def search(turns: DataFrame, word: str) -> DataFrame:
    """Sessions that have the word, in any case, in a turn, in its sources where there are any, or in their title; and in how many turns."""
    sought = F.lit(word.lower())
    hit = F.contains(F.lower("text"), sought)
    if "sources" in turns.columns:
        hit = hit | F.exists(F.coalesce("sources", F.array().cast("array<string>")), lambda s: F.contains(F.lower(s), sought))
    title = F.min_by(F.substring("text", 1, 40), F.when(F.col("role") == "user", F.col("turn"))) if "role" in turns.columns else F.lit("")
    rows = turns.groupBy("session_id").agg(F.count_if(hit).alias("n_matches"), title.alias("title"))
    return rows.where((F.col("n_matches") > 0) | F.contains(F.lower("title"), sought)).select("session_id", "n_matches")


def newest(traces: DataFrame, limit: int) -> DataFrame:
    """The latest traces; ids break ties."""
    return traces.orderBy(F.desc("started_at"), F.desc("trace_id")).limit(max(limit, 0))


def export(turns: DataFrame) -> DataFrame:
    """session_id and the session as Markdown."""
    part: Column = F.concat(F.lit("## "), F.col("role"), F.lit("\n\n"), F.col("text"))
    parts = F.sort_array(F.collect_list(F.struct("turn", part.alias("part"))))
    return turns.groupBy("session_id").agg(F.array_join(F.transform(parts, lambda x: x["part"]), "\n\n").alias("markdown"))


def migrate(records: DataFrame, current: int = 2) -> DataFrame:
    """Records with ``schema_version`` raised to the current one; none counts as 0, a newer or negative one is an error."""
    version = F.coalesce(F.col("schema_version"), F.lit(0))
    bad = (version < 0) | (version > current)
    return records.withColumn("schema_version", F.when(bad, F.raise_error(F.lit("unknown schema version")).cast("int")).otherwise(F.lit(current)))


def listed(sessions: DataFrame) -> DataFrame:
    """Sessions (session_id, title, pinned, starred, updated_at) with their place: pinned, then starred, then newest, then by title.

    The place is worked out in ranges, so no task sees all sessions.
    """
    rows = sessions.withColumns({"a": (~F.col("pinned")).cast("int"), "b": (~F.col("starred")).cast("int"), "c": -F.unix_micros(F.col("updated_at").cast("timestamp")), "d": F.lower("title")})
    return numbered(rows, "a", "b", "c", "d", "session_id", name="place").drop("a", "b", "c", "d")


def filtered(sessions: DataFrame, kind: str) -> DataFrame:
    """recent (all), pinned, starred, failed (a failed turn) or has-sources (a turn with sources)."""
    conditions = {"recent": F.lit(True), "pinned": F.col("pinned"), "starred": F.col("starred"), "failed": F.col("n_failed") > 0, "has-sources": F.col("n_sources") > 0}
    if kind not in conditions:
        raise ValueError(f"filter must be one of {', '.join(conditions)}")
    return sessions.where(conditions[kind])


def trace(spark: SparkSession, operation: str, started_at: str, finished_at: str, status: str = "success", **details) -> DataFrame:
    """One trace: an id made of its operation and start, the times, the status, and what else is known as text."""
    row = (f"{operation}-{re.sub('[^0-9]', '', started_at)}", operation, status, started_at, finished_at, {k: str(v) for k, v in details.items()})
    return spark.createDataFrame([row], "trace_id string, operation string, status string, started_at string, finished_at string, details map<string,string>")


def traced(results: DataFrame, operation: str, *by: str) -> DataFrame:
    """Traces of what a run gave, one for each of its keys: how many results, how many chunks, the best score."""
    rows = results.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("c"), F.max("score").alias("s"))
    key = F.concat_ws("-", *(F.col(c).cast("string") for c in by))
    details = F.create_map(F.lit("n_results"), F.col("n").cast("string"), F.lit("n_chunks"), F.col("c").cast("string"), F.lit("best_score"), F.round("s", 6).cast("string"))
    return rows.select(F.concat(F.lit(f"{operation}-"), key).alias("trace_id"), F.lit(operation).alias("operation"), F.lit("success").alias("status"), details.alias("details"))
