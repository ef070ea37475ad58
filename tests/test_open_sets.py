"""Open sets as runs: a batch costs what it changes, merges are geometric, old folders go."""

import os
import random

from tracewarden.operators.edited import edited_set, with_epochs
from tracewarden.streaming.edited import OpenSets, StopSetWriter

SCHEMA = "session bigint, seq bigint, kind string, path string"


def _batches(count, seed=3):
    rnd, seq, out = random.Random(seed), 0, []
    for _ in range(count):
        rows = []
        for _ in range(rnd.randrange(0, 9)):
            seq += 1
            session = rnd.choice([1, 1, 1, 2, 3, 4])
            stop = rnd.random() < 0.15
            rows.append((session, seq, "stop" if stop else "edit", None if stop else f"f{rnd.randrange(6)}"))
        out.append(rows)
    return out


def _sets(rows):
    return sorted((r["session"], r["seq"], r["first_seq"], r["path"]) for r in rows)


def _expected(spark, batches):
    frame = spark.createDataFrame([r for b in batches for r in b], SCHEMA)
    epochs = with_epochs(frame, 100)
    stops = epochs.where("kind = 'stop'").select("session", "epoch", "seq")
    return _sets(edited_set(epochs).join(stops, ["session", "epoch"]).collect())


def _rows_in(spark, folder):
    return spark.read.parquet(folder).count()


def test_stream_of_batches_equals_one_batch(spark, tmp_path):
    batches = _batches(9)
    writer = StopSetWriter(str(tmp_path / "out"), str(tmp_path / "open"), 100)
    for number, rows in enumerate(batches):
        for _ in range(2 if number in (2, 7) else 1):  # a batch that is repeated
            writer(spark.createDataFrame(rows, SCHEMA), number)
    assert _sets(spark.read.parquet(str(tmp_path / "out")).collect()) == _expected(spark, batches)


def test_cost_of_fifty_batches_is_flat(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        rnd, model = random.Random(1), {}
        sets = OpenSets(str(tmp_path / "open"))
        changed = written = 0
        for number in range(50):
            stopped = {s for s in range(4) if rnd.random() < 0.1}
            edits = [(rnd.randrange(4), f"f{rnd.randrange(6)}", number * 10 + i) for i in range(3)]
            model = {k: v for k, v in model.items() if k[0] not in stopped}
            for session, path, seq in edits:
                model.setdefault((session, path), seq)
            before = set(os.listdir(tmp_path / "open/runs")) if number else set()
            sets.append(
                spark.createDataFrame(edits, "session bigint, path string, first_seq bigint"),
                spark.createDataFrame([(s,) for s in stopped], "session bigint"), number,
            )
            runs = set(os.listdir(tmp_path / "open/runs"))
            written += sum(_rows_in(spark, str(tmp_path / "open/runs" / r)) for r in runs - before)
            changed += len(edits) + len(stopped)
            assert len(runs) <= 2 * 7 and len(os.listdir(tmp_path / "open/listed")) <= 2  # log2(50) + 1 runs of two batches
        everyone = spark.createDataFrame([(s,) for s in range(4)], "session bigint")
        assert {(r["session"], r["path"]): r["first_seq"] for r in sets.of_sessions(everyone, 50).collect()} == model
        assert written <= changed * 7  # a row is written again once a level
        assert runs == {os.path.basename(r.folder) for n in (48, 49) for r in sets._listed(spark, n)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_a_batch_reads_only_sessions_that_stop(spark, tmp_path):
    writer = StopSetWriter(str(tmp_path / "out"), str(tmp_path / "open"), 100)
    writer(spark.createDataFrame([(1, 1, "edit", "a"), (2, 2, "edit", "b"), (2, 3, "edit", "c")], SCHEMA), 0)
    some = spark.createDataFrame([(2,)], "session bigint")
    assert sorted(r["path"] for r in writer.open.of_sessions(some, 1).collect()) == ["b", "c"]
    writer(spark.createDataFrame([(2, 4, "stop", None), (2, 5, "edit", "d")], SCHEMA), 1)
    assert sorted(r["path"] for r in writer.open.of_sessions(some, 2).collect()) == ["d"]
    assert _rows_in(spark, str(tmp_path / "open/runs/1-1")) == 2  # merged with the run before, nothing older to take back
