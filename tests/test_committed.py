"""Readers of a committed table see whole batches; streams join and close in time."""

import threading

import pytest
from pyspark.sql import functions as F

from tracewarden.sources import folders
from tracewarden.sources.committed import CommittedTable
from tracewarden.streaming import pairs, spans


def _batch(spark, number, rows=20):
    return spark.range(rows).select(F.lit(number).alias("batch"), "id")


def _seen(table):
    return {r["batch"]: r["count"] for r in table.read().groupBy("batch").count().collect()}


def test_batches_are_seen_whole(spark, tmp_path):
    table = CommittedTable(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        table.read()
    table.append(_batch(spark, 0), 0)
    _batch(spark, 1).write.parquet(str(tmp_path / "t/data/1-abandoned"))  # an attempt that never committed
    assert _seen(table) == {0: 20}
    table.append(_batch(spark, 1, 30), 1)
    table.append(_batch(spark, 1, 25), 1)  # repeated: replaces
    assert _seen(table) == {0: 20, 1: 25}
    held = table.read()  # a reader in the middle of a rewrite
    table.append(_batch(spark, 2), 2)
    assert table.compact(files=1)
    table.clean(keep_versions=3)
    assert {r["batch"]: r["count"] for r in held.groupBy("batch").count().collect()} == {0: 20, 1: 25}
    assert _seen(table) == {0: 20, 1: 25, 2: 20}
    table.clean(keep_versions=1)
    assert len(folders.names(spark, str(tmp_path / "t/data"))) == 2 and _seen(table) == {0: 20, 1: 25, 2: 20}
    table.append(_batch(spark, 2, 5), 2)  # the last batch can still be repeated
    assert _seen(table)[2] == 5
    with pytest.raises(ValueError):
        table.append(_batch(spark, 0), 0)


def test_writers_at_once_lose_nothing(spark, tmp_path):
    folder = str(tmp_path / "t")
    work = [threading.Thread(target=lambda n=n: CommittedTable(spark, folder).append(_batch(spark, n), n)) for n in range(6)]
    for thread in work:
        thread.start()
    for thread in work:
        thread.join()
    assert _seen(CommittedTable(spark, folder)) == dict.fromkeys(range(6), 20)


def test_put_if_absent(spark, tmp_path):
    file = str(tmp_path / "a/b")
    assert folders.put_if_absent(spark, file, "é one") and not folders.put_if_absent(spark, file, "two")
    assert folders.read_text(spark, file) == "é one" and folders.names(spark, str(tmp_path / "a")) == ["b"]


CALLS = [  # minutes: id, attempted, completed
    ("a", 0, 5), ("b", 1, None), ("c", 2, 40), ("d", 60, 61), ("e", 100, None), (None, 3, 4),
]


def _at(minute):
    return F.expr(f"TIMESTAMP '2024-01-01 00:00:00' + INTERVAL {minute} MINUTES")


def _frames(spark, calls):
    rows = [(1, i, a, c) for i, a, c in calls]
    frame = spark.createDataFrame(rows, "session long, tool_use_id string, a int, c int")
    time = "TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, {0}, 0)"
    begun = frame.selectExpr("session", "tool_use_id", f"{time.format('a')} AS attempted_at")
    done = frame.where("c is not null").selectExpr("session", "tool_use_id", f"{time.format('c')} AS completed_at", "double(c) AS duration_ms")
    return begun, done


def test_pairs_as_a_stream(spark, tmp_path):
    begun, done = _frames(spark, CALLS)
    begun.coalesce(1).write.parquet(str(tmp_path / "begun"))
    done.coalesce(1).write.parquet(str(tmp_path / "done"))
    read = lambda name, like: spark.readStream.schema(like.schema).parquet(str(tmp_path / name))
    joined = pairs.paired_calls(read("begun", begun), read("done", done), "30 minutes", "10 minutes")
    query = (
        joined.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = {r["tool_use_id"]: r["completed"] for r in spark.read.schema(joined.schema).parquet(str(tmp_path / "out")).collect()}
    # c's completion came too late; e is still open when the log ends.
    assert got == {"a": True, "b": False, "c": False, "d": True}
    batch = {r["tool_use_id"]: r["completed"] for r in pairs.paired_calls(begun, done, "30 minutes").collect()}
    assert batch == got | {"e": False}


def test_spans_and_late_rows(spark, tmp_path):
    parts = [[(1, 0, "edit"), (1, 20, "stop"), (1, 100, "edit"), (2, 5, "edit")], [(2, 200, "edit")], [(1, 3, "edit"), (2, 210, "edit")], [(3, 500, "edit")]]
    time = "TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, m, 0) AS ts"
    for number, rows in enumerate(parts):
        frame = spark.createDataFrame(rows, "session long, m int, kind string").selectExpr("session", time, "kind")
        frame.coalesce(1).write.parquet(str(tmp_path / f"in/part={number}"))
    stream = (
        spark.readStream.schema("session long, ts timestamp, kind string").option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    )
    made = spans.activity_spans(stream, "30 minutes", "10 minutes")
    query = (
        made.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = spark.read.schema(made.schema).parquet(str(tmp_path / "out")).collect()
    got = sorted((r["session"], r["events"], r["stops"]) for r in rows)
    assert got == [(1, 1, 0), (1, 2, 1), (2, 1, 0), (2, 2, 0)]
    assert spans.late_rows(query) == 1
