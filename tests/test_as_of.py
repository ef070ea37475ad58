"""Events are judged by what files held at their time, in batches and streams; verdicts stay single in plans."""

import json

from pyspark.sql import functions as F

from tracewarden.operators.decide import decide, secret_detections
from tracewarden.operators.detect import scan_files, scan_versions
from tracewarden.sources import hook_events
from tracewarden.sources.committed import CommittedTable
from tracewarden.streaming.decisions import decision_stream

SECRET = "token = '" + "0123456789abcdef" * 2 + "'"
VERSIONS = [
    ("/w/a.py", "2024-01-01 00:00:00", "clean"), ("/w/a.py", "2024-01-02 00:00:00", SECRET), ("/w/a.py", "2024-01-03 00:00:00", "clean again"),
    ("/w/b.py", "2024-01-02 00:00:00", SECRET),
]
READS = [
    ("/w/a.py", "2024-01-01T12:00:00Z"), ("/w/a.py", "2024-01-02T00:00:00Z"), ("/w/a.py", "2024-01-02T23:59:59Z"), ("/w/a.py", "2024-01-03T00:00:00Z"),
    ("/w/b.py", "2024-01-01T00:00:00Z"), ("/w/b.py", "2024-01-09T00:00:00Z"), ("/w/c.py", "2024-01-09T00:00:00Z"),
]
BLOCKED = [1, 2, 5]


def _lines():
    return [
        json.dumps({"hook_event_name": "beforeShellExecution", "session_id": "s", "timestamp": at, "command": f"cat {path}", "cwd": "/w"})
        for path, at in READS
    ]


def _versions(spark):
    rows = spark.createDataFrame(VERSIONS, "path string, at string, content string")
    return scan_versions(rows.select("path", F.to_timestamp("at").alias("valid_from"), "content"))


def _blocked(decisions):
    rows = decisions.join(decisions.sparkSession.createDataFrame(enumerate(_lines()), "n int, raw string").select(
        "n", F.sha2("raw", 256).alias("event_uid")), "event_uid")
    return sorted(r["n"] for r in rows.where("action = 'block'").collect())


def test_a_changed_file_gives_two_verdicts_in_batch_and_stream(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    hits = _versions(spark)
    hits.write.parquet(str(tmp_path / "hits"))
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text("\n".join(_lines()) + "\n", encoding="utf-8")
    named = lambda frame: hook_events.split_malformed(frame)[0].withColumn("event_uid", F.sha2("raw", 256))
    batch = decide(named(hook_events.read_hook_events(spark, str(tmp_path / "log"), "cursor")), None, file_hits=hits)
    assert _blocked(batch) == BLOCKED
    events = named(hook_events.stream_hook_events(spark, str(tmp_path / "log"), "cursor", str(tmp_path / "numbers")))
    writer = decision_stream(events, spark.read.parquet(str(tmp_path / "hits")), str(tmp_path / "out"), str(tmp_path / "cp"))
    writer.trigger(availableNow=True).start().awaitTermination()
    assert _blocked(CommittedTable(spark, str(tmp_path / "out")).read()) == BLOCKED


def test_verdicts_are_not_copied_into_filters(spark):
    """The filter of the detection log reads a finished verdict: the plan holds its expressions once."""
    lines = spark.createDataFrame([(x,) for x in _lines()], "raw string")
    events = hook_events.split_malformed(hook_events.parse_hook_events(lines, "cursor"))[0].withColumn("event_uid", F.sha2("raw", 256))
    files = spark.createDataFrame([("/w/a.py", SECRET)], "path string, content string")
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        for hits in (None, scan_files(files)):
            log = secret_detections(decide(events, files, file_hits=hits))
            plan = log._jdf.queryExecution().optimizedPlan().toString()
            assert plan.count("secret_detected_in_mcp_command") <= 2
            assert plan.count("Recursive delete wildcard") <= 4
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
