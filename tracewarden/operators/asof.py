"""What was known at the time of an event."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.session import stored
from .ordered import running_max

#: Microseconds of a chunk in which a path's events and versions are put in order.
SPAN = 86_400 * 1_000_000


def versions_at(reads: DataFrame, versions: DataFrame, span: int = SPAN) -> DataFrame:
    """Each read with the last version of its path at its time: the columns of both, null without one.

    ``reads`` has ``path, at`` and more, ``versions`` ``path, valid_from`` and more; a version holds until the next one
    of its path, and from its own microsecond on.  Of versions of one time the largest by its other columns counts.
    Reads and versions of a path are put in order in chunks of time, with the last version before carried from chunk to
    chunk, so a path that a third of all events read is many tasks.
    """
    micros = F.unix_micros("at")
    known = [c for c in versions.columns if c != "path"]
    asked = [c for c in reads.columns if c != "path"]
    version = versions.select(
        "path", F.unix_micros("valid_from").alias("_at"), F.struct(F.col("valid_from"), *[c for c in known if c != "valid_from"]).alias("_known"),
        F.lit(0).alias("_kind"),
    )
    read = reads.select("path", micros.alias("_at"), F.struct(*asked).alias("_asked"), F.lit(1).alias("_kind"))
    both = version.unionByName(read, allowMissingColumns=True)
    # At one microsecond versions stand before reads.
    # Written aside: several steps put them in order, and reads and versions are made once.
    placed = stored(both.withColumn("_order", F.col("_at") * 2 + F.col("_kind")), "as-of")
    last = running_max(placed, "path", "_order", F.col("_known"), "_last", 2 * span)
    return last.where("_kind = 1").select("path", "_asked.*", *[F.col(f"_last.{c}").alias(c) for c in known])
