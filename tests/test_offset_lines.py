"""Lines are told apart by their place, whatever the ranges, and streams resume at offsets."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tracewarden.operators import edited, trace
from tracewarden.sources import hook_events, offset_lines

LINES = ["plain", "", "plain", "héllo wörld 日本", "x" * 300, "plain", "{\"a\": 1}", "last, without a line feed"]


def _rows(frame):
    rows = frame.select("file", "file_no", "start", "line").collect()
    return sorted((os.path.basename(r["file"]), r["file_no"], r["start"], r["line"]) for r in rows)


@pytest.mark.parametrize("size", [1, 2, 7, 64, 301, 10_000])
def test_every_line_once_for_any_range(spark, tmp_path, size):
    offset_lines.register(spark)
    body = "\n".join(LINES).encode()
    (tmp_path / "b.log").write_bytes(body)
    (tmp_path / "a.log").write_bytes(b"\n\nplain\nbad \xff byte\n")
    (tmp_path / "_numbers").write_text("hidden")
    (tmp_path / "empty.log").write_bytes(b"")
    expected, at = [], 0
    for line in LINES:
        expected.append(("b.log", 1, at, line))
        at += len(line.encode()) + 1
    expected += [("a.log", 0, 0, ""), ("a.log", 0, 1, ""), ("a.log", 0, 2, "plain"), ("a.log", 0, 8, "bad � byte")]
    frame = spark.read.format("offset_lines").option("rangeBytes", str(size)).load(str(tmp_path))
    if size < 7:  # one task a byte would only be slow
        files = offset_lines.list_files(str(tmp_path))
        got = [
            (os.path.basename(r.file), r.file_no, start, line.decode("utf-8", "replace"))
            for no, f in enumerate(files) for r in offset_lines.cut_ranges(f, no, 0, f.size, size) for start, line in offset_lines.lines_of(r)
        ]
        assert sorted(got) == sorted(expected)
    else:
        assert _rows(frame) == sorted(expected)


def _run(spark, folder, tmp_path):
    stream = (
        spark.readStream.format("offset_lines").option("rangeBytes", "20").option("numbers", str(tmp_path / "numbers")).load(str(folder))
    )
    query = (
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return _rows(spark.read.schema(offset_lines.SCHEMA).parquet(str(tmp_path / "out")))


def test_stream_resumes_at_offsets(spark, tmp_path):
    offset_lines.register(spark)
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "m.log").write_text("one\ntwo\nunfini", encoding="utf-8")
    assert _run(spark, folder, tmp_path) == [("m.log", 0, 0, "one"), ("m.log", 0, 4, "two")]
    with open(folder / "m.log", "a", encoding="utf-8") as log:
        log.write("shed\ntwo\n")
    (folder / "a.log").write_text("early name\n", encoding="utf-8")  # a new file keeps no old number
    whole = [("a.log", 1, 0, "early name"), ("m.log", 0, 0, "one"), ("m.log", 0, 4, "two"), ("m.log", 0, 8, "unfinished"), ("m.log", 0, 19, "two")]
    assert _run(spark, folder, tmp_path) == whole
    assert _run(spark, folder, tmp_path) == whole  # nothing new, nothing twice


def test_log_without_numbers_and_times(spark, tmp_path):
    """Equal lines are two events, and edits and stops keep the order of the log."""
    edit = {"hook_event_name": "afterFileEdit", "session_id": "s", "file_path": "/w/a.py"}
    stop = {"hook_event_name": "stop", "session_id": "s"}
    lines = [edit, edit, stop, {**edit, "file_path": "/w/b.py"}, edit, stop, edit]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines), encoding="utf-8")
    good, _ = hook_events.split_malformed(hook_events.read_hook_events(spark, str(tmp_path / "log"), "cursor", rangeBytes="50"))
    assert good.select("event_uid").distinct().count() == len(lines)
    epochs = edited.with_epochs(trace.edited_files(good), 100)
    sets = edited.edited_set(epochs).orderBy("epoch", "first_seq").collect()
    assert [(r["epoch"], r["path"]) for r in sets] == [(0, "/w/a.py"), (1, "/w/b.py"), (1, "/w/a.py"), (2, "/w/a.py")]


def test_only_some_fields_are_read(spark):
    lines = spark.createDataFrame([('{"hook_event_name":"stop","command":"x","duration":2}',), ('{"a":1} {}',), ("null",), (" ",)], "raw string")
    parsed = hook_events.parse_hook_events(lines, "cursor", only=["duration"])
    assert "command" not in parsed.columns and {"duration", "session", "seq", "received_at"} <= set(parsed.columns)
    assert sorted(r[0] for r in parsed.select("parse_status").collect()) == ["blank", "malformed", "malformed", "ok"]
    assert parsed.where(F.col("parse_status") == "ok").first()["duration"] == 2.0
