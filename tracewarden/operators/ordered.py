"""Ordered per-key work that never puts one key into one task.

A session can hold a third of all rows, so a plain window over a session would
sort them in a single task.  Rows are cut into chunks of the order column
instead: a window inside ``(key, chunk)`` does the fine work, and one small row
per chunk carries what crosses chunk borders.  Chunks are grouped in turn, so
that their rows are never one window either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

DEFAULT_CHUNK = 250_000
#: Chunks of one group.
GROUP = 4_096
_CHUNK, _GROUP = "_chunk", "_group"


def _with_chunk(rows: DataFrame, order: str, chunk: int) -> DataFrame:
    return rows.withColumn(_CHUNK, F.floor(F.col(order) / chunk))


def _group() -> Column:
    return F.floor(F.col(_CHUNK) / GROUP)


def running_count(
    rows: DataFrame, key: str, order: str, flag: Column, name: str, chunk: int = DEFAULT_CHUNK,
    parts: int | None = None,
) -> DataFrame:
    """Add how many rows of the same key with ``flag`` come strictly before.

    The rows are read three times: those that are costly to make are better written aside first.  ``parts`` is the number
    of tasks that put them in order, else Spark's own.
    """
    cut = _with_chunk(rows, order, chunk).withColumn("_flag", flag.cast("bigint"))
    totals = cut.groupBy(key, _CHUNK).agg(F.sum("_flag").alias("_total")).withColumn(_GROUP, _group())

    def earlier(*by: str, order_by: str) -> Column:
        ordered = Window.partitionBy(*by).orderBy(order_by)
        return F.coalesce(F.sum("_total").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    groups = totals.groupBy(key, _GROUP).agg(F.sum("_total").alias("_total"))
    groups = groups.select(key, _GROUP, earlier(key, order_by=_GROUP).alias("_groups"))
    chunks = totals.select(key, _GROUP, _CHUNK, earlier(key, _GROUP, order_by=_CHUNK).alias("_chunks"))
    before = chunks.join(groups, [key, _GROUP]).select(
        key, _CHUNK, (F.col("_groups") + F.col("_chunks")).alias("_before")
    )
    inside = Window.partitionBy(key, _CHUNK).orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    if parts is not None:
        cut, before = (side.repartition(parts, key, _CHUNK) for side in (cut, before))
    # Counted before the join, whose order the window's sort serves too: the rows of a task are sorted once.
    counted = cut.withColumn("_inside", F.coalesce(F.sum("_flag").over(inside), F.lit(0)))
    count = F.col("_before") + F.col("_inside")
    return counted.join(before, [key, _CHUNK]).withColumn(name, count).drop(_CHUNK, "_flag", "_before", "_inside")


def running_max(
    rows: DataFrame, key: str, order: str, value: Column, name: str, chunk: int = DEFAULT_CHUNK, own: bool = False
) -> DataFrame:
    """Add the largest value of the same key's rows before, and with ``own`` of the row itself; NULL if there is none.

    Any ordered type will do: with structs that begin with a time it is the last value before.
    """
    cut = _with_chunk(rows, order, chunk).withColumn("_value", value)
    tops = cut.groupBy(key, _CHUNK).agg(F.max("_value").alias("_top")).withColumn(_GROUP, _group())

    def earlier(*by: str, order_by: str) -> Column:
        return F.max("_top").over(Window.partitionBy(*by).orderBy(order_by).rowsBetween(Window.unboundedPreceding, -1))

    groups = tops.groupBy(key, _GROUP).agg(F.max("_top").alias("_top"))
    groups = groups.select(key, _GROUP, earlier(key, order_by=_GROUP).alias("_groups"))
    chunks = tops.select(key, _GROUP, _CHUNK, earlier(key, _GROUP, order_by=_CHUNK).alias("_chunks"))
    before = chunks.join(groups, [key, _GROUP]).select(key, _CHUNK, F.greatest("_groups", "_chunks").alias("_before"))
    inside = Window.partitionBy(key, _CHUNK).orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    best = F.greatest("_before", F.max("_value").over(inside))
    return cut.join(before, [key, _CHUNK]).withColumn(name, best).drop(_CHUNK, "_value", "_before")


def next_value(
    rows: DataFrame, key: str, order: str, value: str, name: str, chunk: int = DEFAULT_CHUNK
) -> DataFrame:
    """Add the value of the following row of the same key, NULL at the end."""
    cut = _with_chunk(rows, order, chunk)
    firsts = cut.groupBy(key, _CHUNK).agg(F.min_by(F.struct(value), order).alias("_first"))
    firsts = firsts.withColumn(_GROUP, _group())
    groups = firsts.groupBy(key, _GROUP).agg(F.min_by("_first", _CHUNK).alias("_first"))
    next_group = F.lead("_first").over(Window.partitionBy(key).orderBy(_GROUP))
    next_chunk = F.lead("_first").over(Window.partitionBy(key, _GROUP).orderBy(_CHUNK))
    following = (
        firsts.select(key, _GROUP, _CHUNK, next_chunk.alias("_after"))
        .join(groups.select(key, _GROUP, next_group.alias("_later")), [key, _GROUP])
        .select(key, _CHUNK, F.coalesce("_after", "_later").alias("_after"))
    )
    inside = Window.partitionBy(key, _CHUNK).orderBy(order)
    after = F.coalesce(F.lead(F.struct(value)).over(inside), F.col("_after"))
    return cut.join(following, [key, _CHUNK]).withColumn(name, after[value]).drop(_CHUNK, "_after")
