"""Streams equal batches; registered queries equal their check SQL."""

import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tracewarden.operators.edited import edited_set, with_epochs
from tracewarden.streaming import edited as edited_streams

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

from compare import check_engine, compare  # noqa: E402

from tracewarden.plans.checks import CHECKS  # noqa: E402
from tracewarden.plans.registry import QUERIES  # noqa: E402

SF_DIR = os.environ.get("TESTDATA", "/root/testdata") + "/sf0.001"
SCHEMA = "session string, seq bigint, kind string, path string"


def _write(spark, folder, number, rows):
    spark.createDataFrame(rows, SCHEMA.replace("session string", "session bigint")).coalesce(1).write.mode(
        "append"
    ).parquet(f"{folder}/part={number}")


VECTOR = [
    [(1, 1, "edit", "a.py"), (1, 2, "edit", "b.py"), (2, 1, "edit", "c.py")],
    [(1, 3, "edit", "a.py"), (3, 1, "edit", "x")] + [(3, n, "edit", f"f{n}") for n in range(2, 502)],
    [(1, 4, "stop", None), (1, 5, "stop", None), (3, 600, "stop", None)],
    [(1, 6, "edit", "d.py"), (1, 7, "edit", "a.py"), (1, 8, "stop", None)],
]


def _stream(spark, folder):
    return (
        spark.readStream.schema("session bigint, seq bigint, kind string, path string")
        .option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    )


def _sets(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["first_seq"]):
        out.setdefault((r["session"], r["seq"]), []).append(r["path"])
    return out


@pytest.fixture
def activity(spark, tmp_path):
    folder = str(tmp_path / "in")
    for number, rows in enumerate(VECTOR):
        _write(spark, folder, number, rows)
    return folder


def _expected(spark):
    rows = [r for part in VECTOR for r in part]
    frame = spark.createDataFrame(rows, "session bigint, seq bigint, kind string, path string")
    epochs = with_epochs(frame, 100)
    stops = epochs.where("kind = 'stop'").select("session", "epoch", "seq")
    return _sets(edited_set(epochs).join(stops, ["session", "epoch"]).collect())


def test_batch_vector(spark):
    sets = _expected(spark)
    assert sets[(1, 4)] == ["a.py", "b.py"] and (1, 5) not in sets
    assert sets[(1, 8)] == ["d.py", "a.py"]
    assert len(sets[(3, 600)]) == 501 and sets[(3, 600)][0] == "x"


def test_state_table_stream_equals_batch(spark, tmp_path, activity):
    writer = edited_streams.StopSetWriter(str(tmp_path / "out"), str(tmp_path / "open"), 100)
    query = (
        _stream(spark, activity).writeStream.foreachBatch(writer)
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = _sets(spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == _expected(spark)


def test_keyed_stream_equals_batch(spark, tmp_path, activity):
    query = (
        edited_streams.keyed_stop_sets(_stream(spark, activity)).writeStream.format("parquet")
        .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = _sets(spark.read.schema(edited_streams.STOP_SET_SCHEMA).parquet(str(tmp_path / "out")).collect())
    assert got == _expected(spark)


def test_repeated_batch_replaces_itself(spark, tmp_path):
    writer = edited_streams.StopSetWriter(str(tmp_path / "out"), str(tmp_path / "open"), 100)
    frames = [
        spark.createDataFrame(rows, "session bigint, seq bigint, kind string, path string") for rows in VECTOR
    ]
    for number in (0, 1, 1, 2, 2, 3):
        writer(frames[number], number)
    got = _sets(spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == _expected(spark)


@pytest.fixture(scope="module")
def checks():
    return check_engine(SF_DIR)


@pytest.mark.parametrize(
    "name",
    [
        "pii_findings", "contains_pii", "secret_findings", "validate_tool_input", "mcp_param_scan",
        "read_paths_tokens", "shell_read_secret_join", "claude_pre_tool", "cursor_after_edit",
        "openclaw_before_tool", "malformed_split", "vulnerability_rollup", "cursor_stop", "traces_flat",
        "range_positions", "trace_roundtrip", "decision_stream", "trace_stream", "flow_edges", "file_coverage",
    ],
)
def test_query_equals_check(spark, checks, name):
    good, note = compare(spark, checks, SF_DIR, name)
    assert good, note


def test_every_query_has_a_check():
    import __spark_entry__ as entry

    assert set(QUERIES) == set(CHECKS) and len(QUERIES) >= 80
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_hot_path_join_keeps_every_read(spark):
    from tracewarden.operators.lineage import findings_of_reads

    reads = spark.range(3000).select(
        F.col("id").alias("event_uid"), F.when(F.col("id") % 3 > 0, "/hot").otherwise("/cold").alias("path")
    )
    hits = spark.createDataFrame([("/hot", 2, ["- x (/hot)"])], "path string, n_findings int, lines array<string>")
    found = findings_of_reads(reads, hits, "event_uid")
    assert found.count() == 2000 and found.agg(F.sum("file_n")).first()[0] == 4000


@pytest.mark.parametrize("name", ["plain_log_edited_set", "plain_log_stop_status"])
def test_plain_log_lines_are_parsed_once(spark, name):
    """The acts are written aside: no later step parses the lines again."""
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "hook_event_name" not in plan
