"""Raw lines of a log go through the sources to edited sets, traces and streams as they are."""

import json

from pyspark.sql import functions as F

from tracewarden.operators import edited, trace
from tracewarden.sources import hook_events
from tracewarden.sources.traces import read_traces
from tracewarden.streaming import decisions

LINES = [
    {"hook_event_name": "afterFileEdit", "session_id": "s", "seq": 1, "timestamp": "2024-03-01T00:00:01Z", "file_path": "/w/a.py"},
    {"hook_event_name": "afterFileEdit", "session_id": "s", "seq": 2, "timestamp": "2024-03-01T00:00:02Z", "file_path": "/w/a.py"},
    {"hook_event_name": "afterFileEdit", "conversation_id": "c", "timestamp": "2024-03-01T00:00:03Z", "file_path": "/w/b.py"},
    {"hook_event_name": "stop", "session_id": "s", "seq": 3, "timestamp": "2024-03-01T00:00:04Z"},
    {"hook_event_name": "preCompact", "session_id": "s", "seq": 4},
]


def _log(tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "a.jsonl").write_text("".join(json.dumps(x) + "\n" for x in LINES), encoding="utf-8")
    return str(folder)


def test_log_to_edited_set(spark, tmp_path):
    good, _ = hook_events.split_malformed(hook_events.read_hook_events(spark, _log(tmp_path), "cursor"))
    rows = {r["event_name"] if "event_name" in r else r["hook_event_name"]: r for r in good.collect()}
    assert rows["preCompact"]["received_at"] is not None  # the time of the file
    assert good.select("event_uid").distinct().count() == len(LINES)
    acts = trace.edited_files(good)
    sets = edited.edited_set(edited.with_epochs(acts, 100))
    got = sorted((r["session"], r["path"]) for r in sets.collect())
    assert got == [("c", "/w/b.py"), ("s", "/w/a.py")]


def test_log_to_trace_stream(spark, tmp_path):
    events = hook_events.stream_hook_events(spark, _log(tmp_path), "cursor", str(tmp_path / "numbers"))
    writer = decisions.trace_stream(events, None, str(tmp_path / "out"), str(tmp_path / "cp"), F.lit("/w"))
    writer.trigger(availableNow=True).start().awaitTermination()
    made = read_traces(spark, str(tmp_path / "out"))
    paths = sorted(r["path"] for r in made.select(F.col("files")[0]["path"].alias("path")).collect())
    assert paths == [".context-compactions", "a.py", "a.py", "b.py"]


def test_trace_stream_carries_no_texts(spark, tmp_path):
    """Texts that a trace only counts are gone before repeated events are looked for."""
    events = hook_events.stream_hook_events(spark, _log(tmp_path), "cursor", str(tmp_path / "numbers"))
    writer = decisions.trace_stream(events, None, str(tmp_path / "out"), str(tmp_path / "cp"), F.lit("/w"), compression="gzip")
    assert not {"content", "prompt", "stdout", "tool_result", "text"} & set(trace.unplaced_rows(events).columns)
    writer.trigger(availableNow=True).start().awaitTermination()
    assert list((tmp_path / "out").rglob("*.json.gz")) and read_traces(spark, str(tmp_path / "out")).count() == 4
