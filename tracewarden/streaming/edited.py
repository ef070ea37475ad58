"""Edited-file sets over a stream, given out at each stop.

Two forms with the same results.  ``keyed_stop_sets`` keeps the set in keyed
state and answers with the lowest delay; one session is one key.
``StopSetWriter`` runs the batch operators on each micro-batch and keeps the open
sets in a table of runs, so that one session with a large share of the rows is
still spread over many tasks and a batch costs what it changes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.edited import edited_set, with_epochs
from ..operators.ordered import DEFAULT_CHUNK
from ..sources.folders import exists, remove

STOP_SET_SCHEMA = "session bigint, seq bigint, first_seq bigint, path string"
_STATE_SCHEMA = "paths array<string>, firsts array<bigint>"
_ACTS = "session bigint, seq bigint, kind string, path string"
_OPEN_SET_SCHEMA = "session bigint, path string, first_seq bigint"
_RUN_SCHEMA = "folder string, level int, first bigint, last bigint"


def _advance(
    key: tuple, frames: Iterable[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    """Apply one session's rows of a batch to its set; emit the set at each stop."""
    known = dict(zip(*state.get, strict=True)) if state.exists else {}
    parts = [frame[(frame["kind"] == "stop") | frame["path"].notna()] for frame in frames]
    rows = pd.concat(parts).sort_values("seq", kind="stable")
    for seq, kind, path in zip(rows["seq"], rows["kind"], rows["path"], strict=True):
        if kind != "stop":
            known.setdefault(path, seq)
            continue
        if known:
            yield pd.DataFrame(
                {"session": key[0], "seq": seq, "first_seq": list(known.values()), "path": list(known)}
            )
        known = {}
    if known:
        state.update((list(known), list(known.values())))
    elif state.exists:
        state.remove()


def keyed_stop_sets(activity: DataFrame) -> DataFrame:
    """``session, seq, first_seq, path`` per stop, from keyed state.

    The state of a session is its open set, and it goes with the stop.  A
    session's rows of one trigger are ordered in one worker: where a session can
    send more than that holds, use ``StopSetWriter``.
    """
    acts = activity.where(F.col("kind").isin("edit", "stop")).select(
        "session", "seq", "kind", "path"
    )
    return acts.groupBy("session").applyInPandasWithState(
        _advance, STOP_SET_SCHEMA, _STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout
    )


@dataclass(frozen=True)
class Run:
    """A written part of the open sets: what the batches from first to last left."""

    folder: str
    level: int
    first: int
    last: int


class OpenSets:
    """Open sets as a table of runs: a batch appends what it changed, and runs of one level merge to the next.

    A run's rows are edits (``session, path, first_seq``) that its own batches did not close, and one row without a path
    for each session that they closed: it takes back what older runs hold.  n batches leave at most log2(n) + 1
    runs and every row is written again at most as often.  The runs after a batch are listed in a folder of that batch;
    those of the last two batches are kept, so that a batch can be repeated, and all older folders go.
    """

    def __init__(self, folder: str):
        self.folder = folder

    def _listed(self, spark: SparkSession, batch_id: int) -> list[Run]:
        if batch_id < 0:
            return []
        rows = spark.read.schema(_RUN_SCHEMA).json(f"{self.folder}/listed/batch_id={batch_id}").collect()  # log2(n) rows
        return sorted((Run(r["folder"], r["level"], r["first"], r["last"]) for r in rows), key=lambda r: r.last)

    @staticmethod
    def _rows(spark: SparkSession, runs: list[Run]) -> DataFrame:
        """Edits of the runs that no later run of them took back, and the sessions that were closed."""
        if not runs:
            return spark.createDataFrame([], f"{_OPEN_SET_SCHEMA}, run bigint")
        parts = [spark.read.schema(_OPEN_SET_SCHEMA).parquet(r.folder).withColumn("run", F.lit(r.last).cast("long")) for r in runs]
        return reduce(DataFrame.unionByName, parts)

    @staticmethod
    def _alive(rows: DataFrame) -> DataFrame:
        closed = rows.where("path is null").groupBy("session").agg(F.max("run").alias("closed"))
        left = rows.where("path is not null").join(closed, "session", "left").where("closed is null or run >= closed")
        return left.groupBy("session", "path").agg(F.min("first_seq").alias("first_seq"))

    def of_sessions(self, sessions: DataFrame, before: int) -> DataFrame:
        """``session, path, first_seq``: the open sets of some sessions before a batch."""
        spark = sessions.sparkSession
        rows = self._rows(spark, self._listed(spark, before - 1))
        return self._alive(rows.join(sessions, "session", "left_semi"))

    def append(self, edits: DataFrame, closed: DataFrame, batch_id: int) -> None:
        """Add the run of a batch and merge runs of one level; a repeated batch replaces what it wrote."""
        spark = edits.sparkSession
        before = self._listed(spark, batch_id - 1)
        gone = closed.select("session", F.lit(None).cast("string").alias("path"), F.lit(None).cast("bigint").alias("first_seq"))
        new = Run(f"{self.folder}/runs/{batch_id}-0", 0, batch_id, batch_id)
        edits.select("session", "path", "first_seq").unionByName(gone).write.mode("overwrite").parquet(new.folder)
        runs = [*before, new]
        while len(runs) > 1 and runs[-1].level == runs[-2].level:
            older, newer = runs[-2:]
            merged = Run(f"{self.folder}/runs/{batch_id}-{newer.level + 1}", newer.level + 1, older.first, newer.last)
            rows = self._rows(spark, [older, newer])
            left = self._alive(rows)
            if len(runs) > 2:  # older runs may still hold what these sessions closed
                closings = rows.where("path is null").select("session").distinct()
                left = left.unionByName(closings, allowMissingColumns=True)
            left.write.mode("overwrite").parquet(merged.folder)
            runs = [*runs[:-2], merged]
        listed = [(r.folder, r.level, r.first, r.last) for r in runs]
        spark.createDataFrame(listed, _RUN_SCHEMA).coalesce(1).write.mode("overwrite").json(
            f"{self.folder}/listed/batch_id={batch_id}"
        )
        written = {f"{self.folder}/runs/{batch_id}-{level}" for level in range(new.level, runs[-1].level)}
        # What the batch before needs stays for its repetition.
        for folder in (written - {r.folder for r in before}) | self._unlisted(spark, batch_id, before):
            remove(spark, folder)

    def _unlisted(self, spark: SparkSession, batch_id: int, before: list[Run]) -> set[str]:
        """Folders that only batches before the last one needed."""
        if batch_id < 2 or not exists(spark, f"{self.folder}/listed/batch_id={batch_id - 2}"):
            return set()
        kept = {r.folder for r in before}
        old = {r.folder for r in self._listed(spark, batch_id - 2)} - kept
        return old | {f"{self.folder}/listed/batch_id={batch_id - 2}"}


class StopSetWriter:
    """``foreachBatch`` function: closed sets to ``out``, open sets to a table of runs below ``state``.

    Only sessions that stop in a batch have their open sets read, and a batch writes what it changed.  Everything is
    written per batch id by overwrite, so a batch can be repeated at any time.
    """

    def __init__(self, out: str, state: str, chunk: int = DEFAULT_CHUNK):
        self.out, self.state, self.chunk, self.open = out, state, chunk, OpenSets(state)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, work = batch.sparkSession, f"{self.state}/work"
        rows = batch.where(F.col("kind").isin("edit", "stop")).select("session", "seq", "kind", "path")
        with_epochs(rows, self.chunk).write.mode("overwrite").parquet(work)
        epochs = spark.read.schema(f"{_ACTS}, epoch bigint").parquet(work)
        sets = edited_set(epochs)
        stops = epochs.where(F.col("kind") == "stop").select("session", "epoch", "seq")
        closing = stops.select("session").distinct()
        # A session's first stop closes what stands open, too.
        open_sets = self.open.of_sessions(closing, batch_id).withColumn("epoch", F.lit(0).cast("bigint"))
        whole = sets.unionByName(open_sets).groupBy("session", "epoch", "path").agg(F.min("first_seq").alias("first_seq"))
        closed = whole.join(stops, ["session", "epoch"]).select("session", "seq", "first_seq", "path")
        closed.write.mode("overwrite").parquet(f"{self.out}/batch_id={batch_id}")
        self.open.append(sets.join(stops, ["session", "epoch"], "left_anti"), closing, batch_id)
