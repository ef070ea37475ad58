"""Sink for decisions: the answer in the shape of each dialect, plus exit code."""

from __future__ import annotations

from pyspark.sql import DataFrame

DECISION_COLUMNS = [
    "event_uid", "dialect", "event_name", "action", "context", "message", "response", "exit_code",
    "n_findings",
]


def write_decisions(decisions: DataFrame, path: str, fmt: str = "parquet") -> None:
    (
        decisions.select(*DECISION_COLUMNS)
        .write.mode("append")
        .partitionBy("dialect")
        .format(fmt)
        .save(path)
    )
