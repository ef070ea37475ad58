"""Reports that spread a hot file or tool over many tasks equal plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tracewarden.operators import analytics
from tracewarden.operators.asof import versions_at
from tracewarden.operators.ordered import running_max


def _ranges(seed, count, lines):
    rnd = random.Random(seed)
    out = []
    for i in range(count):
        start = rnd.randrange(1, lines)
        out.append((rnd.choice(["/hot", "/hot", "/hot", "/b"]), start, start + rnd.choice([0, 1, 3, 40, 200]), f"s{rnd.randrange(4)}", rnd.choice(["ai", "human"]), i))
    return out


SCHEMA = "path string, start_line int, end_line int, session string, contributor string, seq long"


@pytest.mark.parametrize("chunk", [1, 7, 10_000])
def test_coverage_in_chunks(spark, chunk):
    rows = _ranges(1, 300, 600)
    got = {r["path"]: (r["edits"], r["lines_covered"]) for r in analytics.file_coverage(spark.createDataFrame(rows, SCHEMA), chunk).collect()}
    for path in ("/hot", "/b"):
        mine = [r for r in rows if r[0] == path]
        assert got[path] == (len(mine), len({n for r in mine for n in range(r[1], r[2] + 1)}))


@pytest.mark.parametrize("band", [1, 5, 256])
def test_last_writer_of_every_line(spark, band):
    rows = _ranges(2, 200, 300) + [("/b", 9, 8, "s0", "ai", 999)]  # an empty range
    owner = {}
    for path, low, high, session, kind, _ in sorted(rows, key=lambda r: r[5]):
        owner.update({(path, n): (session, kind) for n in range(low, high + 1)})
    frame = spark.createDataFrame(rows, SCHEMA)
    painted = {}
    for r in analytics.line_owners(frame, ["session", "contributor"], "seq", band).collect():
        for n in range(r["start_line"], r["end_line"] + 1):
            assert (r["path"], n) not in painted
            painted[(r["path"], n)] = (r["session"], r["contributor"])
    assert painted == owner
    shares = analytics.ownership(frame, ["session", "contributor"], "seq", band).collect()
    assert sum(r["lines"] for r in shares) == len(owner)
    assert sum(r["share"] for r in shares if r["path"] == "/hot") == pytest.approx(1)


def test_running_max_over_chunks(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice("ab"), i, rnd.randrange(100)) for i in range(200)]
    frame = spark.createDataFrame(rows, "k string, at long, v int")
    for own in (False, True):
        got = {r["at"]: r["top"] for r in running_max(frame, "k", "at", F.col("v"), "top", 7, own).collect()}
        for k, at, v in rows:
            seen = [w for j, b, w in rows if j == k and (b < at or (own and b == at))]
            assert got[at] == (max(seen) if seen else None)


@pytest.mark.parametrize("few", [1, 10_000])
def test_exact_percentiles(spark, monkeypatch, few):
    monkeypatch.setattr(analytics, "FEW", few)
    monkeypatch.setattr(analytics, "BUCKETS", 256)
    rnd = random.Random(few)
    values = {
        "even": [float(i) for i in range(500)], "same": [2.5] * 400, "one": [7.0], "wide": [rnd.choice([-1, 1]) * 10 ** rnd.uniform(-300, 300) for _ in range(300)],
        "ties": [float(rnd.randrange(4)) for _ in range(300)], "edge": [-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324],
    }
    rows = [(k, v) for k, own in values.items() for v in own] + [("even", None), ("even", float("nan")), (None, 3.0), ("empty", None)]
    shares = [0.0, 0.01, 0.5, 0.95, 1.0]
    out = analytics.exact_percentiles(spark.createDataFrame(rows, "tool string, ms double"), "tool", "ms", shares).collect()
    got = {(r["tool"], r["share"]): (r["n"], r["value"]) for r in out if r["tool"] is not None}
    expected = {(k, s): (len(own), sorted(own)[max(math.ceil(s * len(own)), 1) - 1]) for k, own in values.items() for s in shares}
    assert got == expected


def test_sketches_of_days_merge(spark):
    rows = [(f"2024-01-{1 + i % 3:02d}", "r", "l", f"v{i % 5000}", f"f{i % 100}") for i in range(20_000)]
    daily = analytics.daily_findings(spark.createDataFrame(rows, "day string, rule_id string, label string, value_sha256 string, path string"))
    assert daily.count() == 3
    whole = analytics.findings_over_days(daily).where("level = 7").first()
    assert whole["findings"] == 20_000 and whole["distinct_files"] == 100
    assert abs(whole["distinct_values"] - 5000) < 0.05 * 5000


@pytest.mark.parametrize("span", [1, 3, 10**9])
def test_versions_at_the_time_of_a_read(spark, span):
    rnd = random.Random(8)
    base = 1_700_000_000_000_000
    versions = [(rnd.choice(["/a", "/b"]), base + rnd.randrange(50), i) for i in range(20)] + [("/c", base + 100, 99)]
    reads = [(i, rnd.choice(["/a", "/b", "/c", "/d"]), base + rnd.randrange(60)) for i in range(100)]
    made = lambda rows, schema: spark.createDataFrame(rows, schema)
    v = made(versions, "path string, t long, n int").selectExpr("path", "timestamp_micros(t) AS valid_from", "n")
    r = made(reads, "id int, path string, t long").selectExpr("id", "path", "timestamp_micros(t) AS at")
    got = {x["id"]: x["n"] for x in versions_at(r, v, span).collect()}
    assert len(got) == len(reads)
    for i, path, at in reads:
        known = [(t, n) for p, t, n in versions if p == path and t <= at]
        assert got[i] == (max(known)[1] if known else None)
