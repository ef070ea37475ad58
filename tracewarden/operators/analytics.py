"""Reports over the audit trail: tools, failures, contributors, flow, sessions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.session import stored
from .ordered import DEFAULT_CHUNK, next_value, running_max


def tool_pairs(attempts: DataFrame, completions: DataFrame) -> DataFrame:
    """Attempts with their completion; those without one were blocked or failed.

    Both have ``session, tool_use_id, seq``.  The n-th attempt of an id in a
    session belongs to its n-th completion, so an id that is used again pairs
    one to one.
    """
    key = ["session", "tool_use_id"]
    order = Window.partitionBy(*key).orderBy("seq")
    done = completions.where(F.col("tool_use_id").isNotNull()).select(
        *key, F.row_number().over(order).alias("occurrence"), "duration_ms", F.lit(True).alias("completed")
    )
    # Attempts without an id match nothing; kept out of the join, they cannot
    # all end up in one task.
    nameless = F.col("tool_use_id").isNull()
    numbered = attempts.where(~nameless).withColumn("occurrence", F.row_number().over(order))
    paired = numbered.join(done, [*key, "occurrence"], "left").unionByName(
        attempts.where(nameless), allowMissingColumns=True
    )
    return paired.withColumn("completed", F.coalesce("completed", F.lit(False))).drop("occurrence")


def failure_hotspots(failures: DataFrame, top: int | None = None) -> DataFrame:
    """Failures per tool and type with subtotals; NULL stands for all.

    With ``top``, only the pairs that fail most often, by count and name.
    """
    counted = failures.rollup("tool_name", "failure_type").agg(
        F.count(F.lit(1)).alias("failures"),
        F.grouping_id().cast("int").alias("level"),
    )
    if top is None:
        return counted
    order = [F.col("failures").desc(), F.col("tool_name"), F.col("failure_type")]
    return counted.where(F.col("level") == 0).orderBy(*order).limit(top)


def contributor_share(traces: DataFrame) -> DataFrame:
    """Human, agent and other records per session and path."""
    kinds = ["human", "ai", "mixed", "unknown"]
    return traces.groupBy("session", "path").pivot("contributor_type", kinds).agg(F.count(F.lit(1))).na.fill(0, kinds)


def flow_edges(activity: DataFrame, chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """How often one kind of event follows another within a session."""
    linked = next_value(activity, "session", "seq", "kind", "next_kind", chunk)
    return (
        linked.where(F.col("next_kind").isNotNull())
        .groupBy("kind", "next_kind")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def duration_percentiles(durations: DataFrame, accuracy: int = 100_000) -> DataFrame:
    """Median and tail of a duration per tool, approximate by rank.

    A bounded sketch, merged map-side, so a hot tool is neither gathered nor
    sorted in one task.  A rank is off by at most one ``accuracy``-th of the
    group's rows, whatever their number.
    """
    def at(share: float) -> Column:
        return F.percentile_approx("duration_ms", share, accuracy)

    return durations.groupBy("tool_name").agg(
        F.count("duration_ms").alias("calls"),
        at(0.5).alias("p50"),
        at(0.95).alias("p95"),
        F.max("duration_ms").alias("longest"),
    )


def session_spans(activity: DataFrame) -> DataFrame:
    """First and last time, rows and stops per session, by partial aggregation."""
    return activity.groupBy("session").agg(
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("kind") == "stop").alias("stops"),
        F.min(F.when(F.col("kind") == "start", F.col("ts"))).alias("first_start"),
    )


def findings_cube(findings: DataFrame) -> DataFrame:
    """Finding counts by rule and source with all subtotals."""
    return findings.cube("rule_id", "src").agg(
        F.count(F.lit(1)).alias("findings"),
        F.grouping_id().cast("int").alias("level"),
    )


#: Lines of a chunk in which the ranges of a file are merged.
LINES = 10_000


def file_coverage(ranges: DataFrame, chunk: int = LINES) -> DataFrame:
    """Edits and distinct lines covered per file.

    ``ranges`` has ``path, start_line, end_line``.  Of ranges with one start only
    the longest matters, so even a hot file brings no more rows to the interval
    merge than it has lines; they are merged chunk by chunk of lines, and what
    reaches across is carried.
    """
    distinct = ranges.groupBy("path", "start_line").agg(
        F.max("end_line").alias("end_line"), F.count(F.lit(1)).alias("n")
    )
    # Written aside: several steps put them in order, and the ranges are made once.
    distinct = stored(distinct, "coverage-starts")
    merged = running_max(distinct, "path", "start_line", F.col("end_line"), "_reached", chunk)
    fresh = merged.withColumn(
        "_new",
        F.greatest(
            F.lit(0), F.col("end_line") - F.greatest(F.col("start_line") - 1, F.coalesce("_reached", F.lit(0)))
        ),
    )
    return fresh.groupBy("path").agg(
        F.sum("n").alias("edits"), F.sum("_new").alias("lines_covered")
    )


#: Lines of a file that are painted together.
BAND = 256


def line_owners(ranges: DataFrame, writer: list[str], order: str, band: int = BAND) -> DataFrame:
    """Who wrote each line last: ``path, start_line, end_line`` and the writer's columns.

    ``ranges`` has ``path, start_line, end_line``, the columns of ``writer`` and ``order``; of equal order the larger
    writer wins.  Ranges are cut at bands of lines, and of equal parts only the last is kept, so a band has a bounded
    number of parts however often its file is edited.  The bounds of a band's parts cut it into segments that a part
    covers wholly or not at all.
    """
    first, last = F.expr(f"(start_line - 1) div {band}"), F.expr(f"(end_line - 1) div {band}")
    low, high = F.col("_band") * band + 1, (F.col("_band") + 1) * band
    by = F.struct(F.col(order).alias("at"), F.struct(*writer).alias("writer"))
    cut = ranges.where("end_line >= start_line").withColumn("_band", F.explode(F.sequence(first, last)))
    parts = cut.groupBy(
        "path", "_band", F.greatest("start_line", low).alias("low"), F.least("end_line", high).alias("high")
    ).agg(F.max(by).alias("by"))
    bounds = parts.select("path", "_band", F.explode(F.array("low", F.col("high") + 1)).alias("start_line")).distinct()
    ahead = F.lead("start_line").over(Window.partitionBy("path", "_band").orderBy("start_line"))
    segments = bounds.withColumn("end_line", ahead - 1).where("end_line is not null")
    inside = (F.col("low") <= F.col("start_line")) & (F.col("high") >= F.col("end_line"))
    painted = segments.join(parts, ["path", "_band"]).where(inside).groupBy("path", "_band", "start_line", "end_line")
    return painted.agg(F.max("by").alias("by")).select("path", "start_line", "end_line", "by.writer.*")


def ownership(ranges: DataFrame, writer: list[str], order: str, band: int = BAND) -> DataFrame:
    """Lines per path and writer, each line counted for its last writer, with their share of the path's known lines."""
    owned = line_owners(ranges, writer, order, band).withColumn("n", F.col("end_line") - F.col("start_line") + 1)
    lines = owned.groupBy("path", *writer).agg(F.sum("n").alias("lines"))
    known = lines.groupBy("path").agg(F.sum("lines").alias("_known"))
    return lines.join(known, "path").withColumn("share", F.col("lines") / F.col("_known")).drop("_known")


#: Buckets of a round of the exact selection, and rows of a bucket that are put in order at last.
BUCKETS, FEW = 4_096, 10_000


def _between(value: Column, low: Column, high: Column) -> Column:
    """How far a value lies from low to high, 0 to 1; halved where the distance has no number."""
    half = high / 2 - low / 2
    return F.when(half > 1e-300, F.try_divide(value / 2 - low / 2, half)).otherwise(F.try_divide(value - low, high - low))


def _magnitude(value: Column) -> Column:
    """A rising function of a number that follows its exponent."""
    size = F.log2(F.when(value != 0, F.abs(value))) + 1_100
    return F.coalesce(F.signum(value) * size, F.lit(0.0))


def exact_percentiles(rows: DataFrame, key: str, value: str, shares: list[float]) -> DataFrame:
    """``key, share, n, value``: the value at rank ceil(share * n) of every key, exact.

    The range of each key is counted in buckets, by magnitude first and evenly then, and only the bucket that holds the
    rank is looked at in the next round, until it holds few rows or one value: nothing is sorted or gathered but
    those.  A number has no more than some 60 bits, so there are few rounds.  NULL, NaN and infinite values are left out; a
    share of 0 is the smallest value.
    """
    clean = rows.select(F.col(key).alias("key"), F.col(value).cast("double").alias("value"))
    clean = stored(clean.where("abs(value) < double('infinity')"), "percentile-values")
    sizes = clean.groupBy("key").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    rank = F.greatest(F.ceil(F.col("share") * F.col("n")), F.lit(1)).cast("long")
    wanted = sizes.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("rank", rank)
    open_ = stored(wanted.select("key", "share", "n", "rank", "low", "high", F.col("n").alias("held")), "percentile-ranks")
    done: list[DataFrame] = []
    many = (F.col("held") > FEW) & (F.col("low") < F.col("high"))
    even = _between(F.col("value"), F.col("low"), F.col("high"))
    part = F.coalesce(_between(*map(_magnitude, map(F.col, ("value", "low", "high")))), even)
    while not open_.where(many).isEmpty():
        done.append(open_.where(~many))
        at = open_.where(many)
        bucket = F.least(F.floor(part * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
        part = even
        inside = clean.join(at, "key").where("value between low and high")
        counted = inside.withColumn("bucket", bucket).groupBy("key", "share", "n", "rank", "bucket").agg(
            F.count("*").alias("held"), F.min("value").alias("low"), F.max("value").alias("high")
        )
        upto = F.sum("held").over(Window.partitionBy("key", "share").orderBy("bucket"))
        held = counted.withColumn("upto", upto).where("rank <= upto and rank > upto - held")
        left = held.select("key", "share", "n", (F.col("rank") - F.col("upto") + F.col("held")).alias("rank"), "low", "high", "held")
        open_ = stored(left, "percentile-ranks")
    done.append(open_)
    final = reduce(DataFrame.unionByName, done)
    few = clean.join(final, "key").where("value between low and high")
    # One value, or at most FEW rows for a key and share.
    same = final.where("low = high").select("key", "share", "n", F.col("low").alias("value"))
    order = Window.partitionBy("key", "share").orderBy("value")
    picked = few.where("low < high").withColumn("at", F.row_number().over(order)).where("at = rank")
    out = same.unionByName(picked.select("key", "share", "n", "value"))
    return out.withColumnRenamed("key", key)


#: log2 of the slots of a stored sketch: about 1.6 % standard error.
SKETCH_BITS = 12


def daily_findings(findings: DataFrame) -> DataFrame:
    """One mergeable row per day, rule and label: findings, and sketches of distinct values and files.

    ``findings`` has ``day, rule_id, label, value_sha256, path``.  Days can be stored as they come and merged later.
    """
    return findings.groupBy("day", "rule_id", "label").agg(
        F.count(F.lit(1)).alias("findings"),
        F.hll_sketch_agg("value_sha256", SKETCH_BITS).alias("values"),
        F.hll_sketch_agg("path", SKETCH_BITS).alias("files"),
    )


def findings_over_days(daily: DataFrame) -> DataFrame:
    """Totals over every set of rule, label and day, from daily rows of any number of days.

    Counts of distinct values and files are estimates that sketches of the parts give as well as one of the whole.
    """
    return daily.cube("day", "rule_id", "label").agg(
        F.sum("findings").alias("findings"),
        F.hll_sketch_estimate(F.hll_union_agg("values")).alias("distinct_values"),
        F.hll_sketch_estimate(F.hll_union_agg("files")).alias("distinct_files"),
        F.grouping_id().cast("int").alias("level"),
    )
