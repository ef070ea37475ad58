"""Edited sets, stop scans, traces, reports and sources."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tracewarden.functions import audit, rules
from tracewarden.operators import analytics, edited, ordered, stopscan, trace
from tracewarden.plans import registry
from tracewarden.sources import files as file_source, hook_events, scan_reports, traces
from tracewarden.sources.decisions import DECISION_COLUMNS, write_decisions

T = F.col("t")


def _activity(spark, count=4000, hot=0.6, seed=3):
    """Random activity with one hot session."""
    rng = random.Random(seed)
    rows = []
    for seq in range(count):
        session = 1 if rng.random() < hot else rng.randint(2, 9)
        kind = rng.choices(["edit", "stop", "failure"], [8, 1, 2])[0]
        rows.append((session, seq, kind, f"/w/{rng.randint(0, 40)}.txt"))
    return rows, spark.createDataFrame(rows, "session bigint, seq bigint, kind string, path string")


def _model_sets(rows, limit):
    open_sets, epochs, sets = {}, {}, {}
    for session, seq, kind, path in rows:
        epoch = epochs.setdefault(session, 0)
        paths = open_sets.setdefault(session, [])
        if kind == "stop":
            sets[(session, epoch)] = paths
            epochs[session] += 1
            open_sets[session] = []
        elif kind == "edit" and path not in paths and len(paths) < limit:
            paths.append(path)
    sets.update({(s, epochs[s]): p for s, p in open_sets.items()})
    return {key: paths for key, paths in sets.items() if paths}


def test_edited_set_keeps_every_path_and_counts_what_a_limit_drops(spark):
    rows = [(1, i, "edit", f"p{i}") for i in range(2_000)] + [(1, 2_000, "edit", None)]
    frame = spark.createDataFrame(rows, "session bigint, seq bigint, kind string, path string")
    epochs = edited.with_epochs(frame, 64)
    assert edited.edited_set(epochs).count() == 2_000
    cut = edited.edited_set(epochs, 500).collect()
    assert len(cut) == 500 and {r["n_dropped"] for r in cut} == {1_500}


@pytest.mark.parametrize("chunk,limit", [(37, 500), (10_000, 5)])
def test_edited_set_with_hot_session(spark, chunk, limit):
    rows, frame = _activity(spark)
    got = {}
    made = edited.edited_set(edited.with_epochs(frame.repartition(5), chunk), limit)
    for r in made.orderBy("position").collect():
        got.setdefault((r["session"], r["epoch"]), []).append(r["path"])
    assert got == _model_sets(rows, limit)


def test_next_value_crosses_chunks(spark):
    rows, frame = _activity(spark, 1500)
    want, last = {}, {}
    for session, seq, kind, _ in rows:
        if session in last:
            want[last[session]] = kind
        last[session] = seq
    out = ordered.next_value(frame.repartition(7), "session", "seq", "kind", "after", 11).collect()
    assert {r["seq"]: r["after"] for r in out if r["after"]} == want


def test_partition_count_does_not_matter(spark):
    _, frame = _activity(spark, 800)
    flows = [
        {tuple(r) for r in analytics.flow_edges(frame.repartition(n), 50).collect()} for n in (1, 8)
    ]
    assert flows[0] == flows[1]


def test_file_coverage_merges_ranges(spark):
    rng = random.Random(5)
    rows = [("f", a, a + rng.randint(0, 6)) for a in (rng.randint(1, 60) for _ in range(60))]
    frame = spark.createDataFrame(rows, "path string, start_line int, end_line int")
    got = analytics.file_coverage(frame).collect()[0]
    lines = {n for _, a, b in rows for n in range(a, b + 1)}
    assert (got["edits"], got["lines_covered"]) == (60, len(lines))


RESULTS = [
    {"check_id": "r1", "path": "/tmp/s/a.py", "start": {"line": 3}, "end": {"line": 5},
     "message": "m", "extra": {"severity": "ERROR"}},
    {"path": {"value": "/tmp/s/a.py"}, "line": 7},
    {"target": {"path": "b.py"}, "line": 2, "end_line": 9},
    {"path": "/tmp/s/unknown.py"},
    None,
]


def _stops(spark, rows):
    return spark.createDataFrame(
        rows,
        "session bigint, epoch bigint, seq bigint, report string, return_code int, error_text string, "
        "stop_hook_active boolean, scanner_path string, conversation_id string, generation_id string, "
        "workspace_root string",
    ).withColumns({
        "event_uid": F.concat(F.lit("s"), F.col("session").cast("string")), "dialect": F.lit("cursor"),
        "received_at": F.lit(None).cast("timestamp"), "model": F.lit("gpt-4"), "transcript_path": F.lit("/t"),
    })


def _edited(spark, rows):
    return spark.createDataFrame(
        rows, "session bigint, epoch bigint, path string, first_seq bigint, position int"
    )


def test_stop_scan_end_to_end(spark):
    report = json.dumps({"results": RESULTS}, separators=(",", ":"))
    rest = (False, "/bin/s", "c", None, "/w")
    stops = _stops(spark, [
        (1, 0, 5, report, 0, "", *rest), (2, 0, 5, report, 0, "", True, *rest[1:]),
        (3, 0, 5, "{", 0, "", *rest), (4, 0, 5, "", 2, "x" * 600, *rest),
        (5, 0, 5, "{}", 0, "", *rest), (6, 0, 5, report, 0, "", *rest), (7, 0, 5, report, 0, "", *rest),
    ])
    sets = [(s, 0, p, i, i) for s in (1, 2, 3, 4, 5) for i, p in enumerate(["d/a.py", "/w/x/a.py", "/w/b.py"], 1)]
    in_set = _edited(spark, sets + [(6, 0, "/gone.py", 1, 1)])
    files = spark.createDataFrame([("/w/d/a.py", ""), ("/w/b.py", "")], "path string, content string")
    in_set = stopscan.with_existing(in_set, files, F.lit("/w"))
    summary = stopscan.stop_summary(stops, in_set).orderBy("session")
    got = summary.collect()
    assert [r["status"] for r in got] == [
        "vulnerabilities_found", "vulnerabilities_found", "parse_error", "scan_failed",
        "no_vulnerabilities", "no_valid_files", "no_files_to_scan",
    ]
    assert [(r["total_vulnerabilities"], r["files_scanned"], r["n_valid"]) for r in got[:2]] == [(5, 3, 2)] * 2

    claude = [r["response"] for r in stopscan.stop_responses(summary, "claude").orderBy("session").collect()]
    assert json.loads(claude[0])["decision"] == "block"
    assert json.loads(claude[0])["reason"].startswith("Found 5 security finding(s). Review the findings")
    assert json.loads(claude[1]) == {
        "systemMessage": "Found 5 security finding(s). Stop hook already active, allowing stop."
    }
    assert json.loads(claude[3])["systemMessage"] == (
        "Semgrep scan encountered errors: " + "x" * 500 + " (semgrep: /bin/s)"
    )
    assert claude[2] is None and claude[4:] == [None, None, None]
    cursor = [json.loads(r["response"]) for r in stopscan.stop_responses(summary, "cursor").orderBy("session").collect()]
    assert cursor[4] == {"followup_message": None} and "r1" in cursor[0]["followup_message"]

    found = summary.where("session = 1")
    results = stopscan.result_fields(scan_reports.explode_results(found, stopscan.STOP_KEY))
    attributed = stopscan.attribute_results(results, in_set)
    lists = stopscan.vulnerability_lists(attributed)
    rows = trace.vulnerability_traces(lists, summary, "cursor")
    made = {r["path"]: r for r in rows.collect()}
    assert {(r["event_uid"], r["model_id"], r["url"]) for r in made.values()} == {
        ("s1|d/a.py", "openai/gpt-4", "file:///t"), ("s1|/w/b.py", "openai/gpt-4", "file:///t")}
    assert trace.build_traces(rows.unionByName(trace.stop_traces(summary, "cursor")), F.lit("/w")).select("id").distinct().count() == 9
    assert set(made) == {"d/a.py", "/w/b.py"}
    first = json.loads(made["d/a.py"]["metadata"])
    assert first["vulnerability_count"] == 2
    assert first["vulnerabilities"][0] == {"rule_id": "r1", "message": "m", "severity": "ERROR"}
    assert [tuple(r) for r in made["d/a.py"]["ranges"]] == [(3, 5), (7, 7)]
    assert [tuple(r) for r in made["/w/b.py"]["ranges"]] == [(2, 9)]
    stops = [json.loads(r["metadata"]) for r in trace.stop_traces(summary, "cursor").orderBy("session").collect()]
    assert stops[3]["error"] == "x" * 600 and stops[3]["semgrep_path"] == "/bin/s"
    assert stops[2]["error"] == trace.PARSE_ERROR
    stop = stops[0]
    assert stop == {
        "event": "stop_hook_executed", "tool": rules.PRODUCER, "conversation_id": "c",
        "status": "vulnerabilities_found", "total_vulnerabilities": 5, "files_scanned": 3, "workspace_root": "/w",
    }


def test_relative_path_without_base_is_missing(spark):
    in_set = _edited(spark, [(1, 0, "a.py", 1, 1)])
    files = spark.createDataFrame([("/a.py", ""), ("a.py", "")], "path string, content string")
    assert stopscan.valid_files(in_set, files, F.lit("")).count() == 0


def test_odd_results_end_no_job(spark):
    rows = ['{"path":"{x}","line":"abc"}', '{"path":{"value":"v"},"line":3.5}', '{"path":"p","line":99999999999}',
            '{"target":{"path":"t"},"start":{"line":4},"end":{"line":"7"}}', '{"path":"[a]","path":"b"}', '{"path":5}']
    frame = spark.createDataFrame([(r,) for r in rows], "r string").coalesce(1)
    out = frame.select(stopscan.result_path(F.col("r")), stopscan.result_range(F.col("r"))).collect()
    assert [(p, tuple(span)) for p, span in out][:4] == [("{x}", (1, 1)), ("v", (3, 3)), ("p", (1, 1)), ("t", (4, 1))]
    assert out[4][0] in ("b", "[a]") and out[5][0] is None


def test_range_positions(spark):
    rows = [
        ([("", "b\nc", None), ("", "", None), ("", "zz", None), ("", "x", (4, 6)), ("", "a\nb\nc", (0, 3))], "a\nb\nc\n"),
        ([("", "b\nc", None)], None), ([("", "q", None)], ""), (None, "x"),
    ]
    schema = (
        "edits array<struct<old_string:string,new_string:string,"
        "range:struct<start_line_number:int,end_line_number:int>>>, content string"
    )
    frame = spark.createDataFrame(rows, schema)
    made = frame.select(
        audit.ranges_or_default(audit.range_positions(F.col("edits"), F.col("content"))).alias("r")
    ).collect()
    assert [[tuple(x) for x in r["r"]] for r in made] == [
        [(2, 3), (1, 1), (4, 6), (1, 3)], [(1, 2)], [(1, 1)], [(1, 1)],
    ]


def test_model_ids_and_followups(apply):
    assert apply(audit.normalize_model_id(T), "claude-x", "gpt-4", "o1", "o3-m", "gemini-p", "a/b", "z", "", None) == [
        "anthropic/claude-x", "openai/gpt-4", "openai/o1", "openai/o3-m", "google/gemini-p", "a/b", "z", None, None,
    ]
    assert apply(audit.is_security_followup(T), "Fix the VULNERABILITY", "hello", None) == [True, False, False]


def _trace_events(spark, dialect, *documents):
    lines = spark.createDataFrame(
        [(str(i), datetime(2024, 1, 2, 3, 4, 5), json.dumps(d)) for i, d in enumerate(documents)],
        "event_uid string, received_at timestamp, raw string",
    )
    return hook_events.split_malformed(hook_events.parse_hook_events(lines, dialect))[0]


def test_cursor_traces(spark):
    events = _trace_events(
        spark, "cursor",
        {"hook_event_name": "afterFileEdit", "file_path": "/w/a.py", "model": "gpt-4", "transcript_path": "/t",
         "conversation_id": "c", "edits": [{"new_string": "two"}]},
        {"hook_event_name": "afterTabFileEdit", "file_path": "/w/a.py", "transcript_path": "/t", "edits": [{"new_string": "two\n"}]},
        {"hook_event_name": "beforeSubmitPrompt", "prompt": "a Semgrep scan 😀", "attachments": [{"p": 1}]},
        {"hook_event_name": "postToolUse", "tool_name": "Read", "tool_input": {"file_path": "x"}, "duration": 12.0, "cwd": "/w"},
        {"hook_event_name": "preCompact", "trigger": "auto", "context_tokens": 7, "is_first_compaction": True},
        {"hook_event_name": "beforeReadFile", "file_path": "/w/a.py"},
        {"hook_event_name": "postToolUseFailure", "tool_name": "Bash", "is_interrupt": False, "duration": 1.5},
        {"hook_event_name": "afterFileEdit"},
        {"hook_event_name": "stop"},
    )
    files = spark.createDataFrame([("/w/a.py", "one\ntwo\n")], "path string, content string")
    flat = trace.trace_rows(events, files)
    rows = {int(r["event_uid"]): r for r in flat.collect()}
    assert sorted(rows) == [0, 1, 2, 3, 4, 5, 6]
    meta = {k: json.loads(r["metadata"]) for k, r in rows.items()}
    assert [tuple(x) for x in rows[0]["ranges"]] == [(2, 2)] and rows[0]["url"] == "file:///t"
    assert [tuple(x) for x in rows[1]["ranges"]] == [(1, 2)] and rows[1]["url"] is None
    assert meta[0] == {"conversation_id": "c"} and rows[0]["model_id"] == "openai/gpt-4"
    assert rows[2]["contributor_type"] == "ai"
    assert meta[2] == {
        "event": "prompt_submission_attempt", "prompt_length": 17, "has_attachments": True,
        "attachment_count": 1, "source": rules.PRODUCER, "source_hook": "stop",
    }
    assert rows[3]["path"] == "x" and meta[3]["duration_ms"] == 12 and meta[3]["cwd"] == "/w"
    assert meta[4] == {"event": "context_compaction", "trigger": "auto", "context_tokens": 7, "is_first_compaction": True}
    assert meta[5] == {"event": "file_read_attempt", "file_path": "/w/a.py", "has_attachments": False, "attachments": []}
    assert meta[6] == {"event": "tool_use_failure", "tool_name": "Bash", "duration_ms": 1.5, "is_interrupt": False}


def test_trace_log_round_trip(spark, tmp_path):
    events = _trace_events(
        spark, "claude", {"hook_event_name": "PreToolUse", "tool_name": "Bash", "tool_input": {"b": 1, "a": "x"}},
    )
    built = trace.build_traces(trace.trace_rows(events), F.lit("/w"), F.lit("abc"))
    path = str(tmp_path / "log")
    traces.write_traces(built, path)
    log = traces.read_traces(spark, path)
    assert log.columns == [*traces.TRACE_COLUMNS, traces.DATE_COLUMN]
    back = log.select(*traces.TRACE_COLUMNS).collect()
    assert [tuple(r) for r in back] == [tuple(r) for r in built.collect()]
    row = back[0]
    assert row["files"][0]["path"] == ".tool-usage" and row["vcs"]["revision"] == "abc"
    assert json.loads(row["metadata"])["tool_input"] == {"b": 1, "a": "x"}
    assert list(tmp_path.glob("log/trace_date=2024-01-02/*.json"))


def test_compressed_trace_log_holds_the_same_records(spark, tmp_path):
    rows = [{"hook_event_name": "PreToolUse", "tool_name": "Bash", "tool_input": {"command": f"ls {i}"}} for i in range(400)]
    built = trace.build_traces(trace.trace_rows(_trace_events(spark, "claude", *rows)), F.lit("/w")).coalesce(1)
    folders = {codec: str(tmp_path / codec) for codec in ("none", "gzip")}
    for codec, folder in folders.items():
        traces.write_traces(built, folder, compression=codec)
    back = {c: sorted(map(tuple, traces.read_traces(spark, f).select("id", "timestamp", "metadata").collect())) for c, f in folders.items()}
    assert len(back["gzip"]) == 400 and back["gzip"] == back["none"]
    size = {c: sum(p.stat().st_size for p in (tmp_path / c).rglob("part-*")) for c in folders}
    assert size["gzip"] * 4 < size["none"]


def test_edited_files_of_events(spark):
    claude = _trace_events(
        spark, "claude",
        {"hook_event_name": "PostToolUse", "tool_name": "Write", "tool_input": {"file_path": "a"}},
        {"hook_event_name": "PostToolUse", "tool_name": "Edit", "tool_input": {}},
        {"hook_event_name": "PostToolUse", "tool_name": "Read", "tool_input": {"file_path": "b"}},
        {"hook_event_name": "Stop"},
    ).withColumn("session", F.lit("s")).withColumn("seq", F.col("event_uid").cast("int"))
    rows = trace.edited_files(claude).orderBy("seq").collect()
    assert [(r["kind"], r["path"]) for r in rows] == [("edit", "a"), ("edit", ".unknown"), ("stop", None)]
    cursor = _trace_events(
        spark, "cursor",
        {"hook_event_name": "postToolUse", "tool_name": "Edit", "tool_input": {}},
        {"hook_event_name": "afterTabFileEdit", "file_path": "c"},
        {"hook_event_name": "stop"},
    ).withColumn("session", F.lit("s")).withColumn("seq", F.col("event_uid").cast("int"))
    rows = trace.edited_files(cursor).orderBy("seq").collect()
    assert [(r["kind"], r["path"]) for r in rows] == [("edit", "c"), ("stop", None)]


def test_sources_from_disk(spark, tmp_path):
    (tmp_path / "tree" / "sub").mkdir(parents=True)
    (tmp_path / "tree" / "a.txt").write_text("héllo\n", encoding="utf-8")
    (tmp_path / "tree" / "sub" / "b.txt").write_bytes(b"two\xff")
    found = {r["path"]: r["content"] for r in file_source.read_files(spark, str(tmp_path / "tree")).collect()}
    assert found == {str(tmp_path / "tree/a.txt"): "héllo\n", str(tmp_path / "tree/sub/b.txt"): "two\ufffd"}

    (tmp_path / "events").mkdir()
    (tmp_path / "events" / "e.jsonl").write_text('{"hook_event_name":"stop"}\n\nnope\n', encoding="utf-8")
    parsed = hook_events.read_hook_events(spark, str(tmp_path / "events"), "cursor")
    assert sorted(r["parse_status"] for r in parsed.collect()) == ["blank", "malformed", "ok"]

    (tmp_path / "reports").mkdir()
    (tmp_path / "reports" / "r.json").write_text('{"results":[{"line":1},\n null]}', encoding="utf-8")
    reports = scan_reports.parse_reports(scan_reports.read_scan_reports(spark, str(tmp_path / "reports")))
    results = scan_reports.explode_results(reports, ["report_status"]).orderBy("ordinal").collect()
    assert [(r["report_status"], r["result"]) for r in results] == [("ok", '{"line":1}'), ("ok", None)]

    row = spark.createDataFrame([("u", "cursor", "x", "allow", "c", "m", "{}", 0, 0)], DECISION_COLUMNS)
    write_decisions(row, str(tmp_path / "out"))
    write_decisions(row, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_log_epochs_parse_the_lines_once(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1, 0, i), i % 2, ("click", "view", "purchase")[i % 3], 1.0) for i in range(12)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(
        str(tmp_path / "events.parquet")
    )
    epochs = registry._log_epochs(spark, str(tmp_path))
    assert "from_json" not in epochs._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["session"], r["seq"]): r["epoch"] for r in epochs.collect()}
    assert got == {(str(i % 2), i): sum(j % 2 == i % 2 and j % 3 == 2 for j in range(i)) for i in range(12)}


def test_epochs_are_the_same_in_any_number_of_tasks(spark):
    rows = [(f"s{i % 3}", i, "stop" if i % 5 == 0 else "edit", f"f{i % 4}") for i in range(200)]
    frame = spark.createDataFrame(rows, "session string, seq long, kind string, path string")
    brute = {(s, i): sum(t == s and j < i and k == "stop" for t, j, k, _ in rows) for s, i, _, _ in rows}
    for parts in (None, 1, 7):
        epochs = edited.with_epochs(frame, 16, parts)
        assert {(r["session"], r["seq"]): r["epoch"] for r in epochs.collect()} == brute
    # The window and the join with the counts of the chunks share one order of the rows.
    plan = edited.with_epochs(frame, 16, 7)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [sum(_flag") == 1 and plan.index("Join") < plan.index("Window [sum(_flag")
