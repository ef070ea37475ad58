"""Tool attempts and their completions as both arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _timed(calls: DataFrame, time: str) -> DataFrame:
    """Calls with an id; their time, which a watermark needs as an instant, is read in the session's zone."""
    return calls.where("tool_use_id is not null").withColumn(time, F.col(time).cast("timestamp"))


def paired_calls(
    attempts: DataFrame, completions: DataFrame, within: str = "1 hour", late: str = "10 minutes"
) -> DataFrame:
    """Attempts with their completion, and those that got none in time.

    ``attempts`` has ``session, tool_use_id, attempted_at`` and more, ``completions`` ``session, tool_use_id,
    completed_at, duration_ms``; an id is used once in a session within the time a call may take.  A completion
    belongs to the attempt of its id at most ``within`` before it.  Both sides may come ``late`` by their own time; an
    attempt is given out at once with its completion, or without one as soon as none can come any more, and the
    state of both sides goes at that point.  On a batch the same join gives the same rows, and the open attempts too.
    """
    begun = _timed(attempts, "attempted_at").withWatermark("attempted_at", late)
    done = _timed(completions, "completed_at").withWatermark("completed_at", late).select(
        F.col("session").alias("_session"), F.col("tool_use_id").alias("_id"), "completed_at", "duration_ms"
    )
    meets = (
        (F.col("session") == F.col("_session")) & (F.col("tool_use_id") == F.col("_id"))
        & F.expr(f"completed_at >= attempted_at AND completed_at <= attempted_at + INTERVAL {within}")
    )
    joined = begun.join(done, meets, "left_outer")
    return joined.withColumn("completed", F.col("completed_at").isNotNull()).drop("_session", "_id")
