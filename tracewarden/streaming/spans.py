"""Stretches of activity per session, closed by a pause."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def activity_spans(activity: DataFrame, pause: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """``session, first_ts, last_ts, events, stops`` of rows that follow each other within ``pause``.

    ``activity`` has ``session, ts, kind``.  On a stream a stretch is given out, and its state goes, when the watermark
    has passed its end; rows that come later than ``late`` are left out and counted by the query (``late_rows``).
    """
    timed = activity.where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("session", F.session_window("ts", pause).alias("stretch")).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("kind") == "stop").alias("stops"),
    ).drop("stretch")


def late_rows(query: StreamingQuery) -> int:
    """Rows that the query's stateful steps have left out so far because they came too late."""
    return sum(op["numRowsDroppedByWatermark"] for step in query.recentProgress for op in step["stateOperators"])
