"""Edited-file sets: which files a session changed between two stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .ordered import DEFAULT_CHUNK, running_count


def with_epochs(activity: DataFrame, chunk: int = DEFAULT_CHUNK, parts: int | None = None) -> DataFrame:
    """Number the stretches between stops; a stop closes the one it ends.

    ``activity`` has ``session, seq, kind, path`` with kind edit or stop; ``parts`` tasks put it in order.
    """
    acts = activity.where(F.col("kind").isin("edit", "stop"))
    return running_count(acts, "session", "seq", F.col("kind") == "stop", "epoch", chunk, parts)


def edited_set(epochs: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct edited paths per session and epoch with their first edit.

    All are kept.  With a ``limit``, which sets of a fixed size need, each set
    holds the first ``limit`` paths with their ``position``, and ``n_dropped``
    says how many it left out.
    """
    firsts = (
        epochs.where((F.col("kind") == "edit") & F.col("path").isNotNull())
        .groupBy("session", "epoch", "path")
        .agg(F.min("seq").alias("first_seq"))
    )
    if limit is None:
        return firsts
    group = Window.partitionBy("session", "epoch")
    rank = F.row_number().over(group.orderBy("first_seq"))
    dropped = F.greatest(F.count(F.lit(1)).over(group) - limit, F.lit(0))
    return firsts.withColumns({"position": rank, "n_dropped": dropped}).where(F.col("position") <= limit)
