"""Command-to-file lineage: which events read which files, and what is in them.

candidates (narrow) -> join thin file rows on path -> group by event.  A path
can be hot (one file read by a third of all events): the join is a plain
equi-join, whose event side Spark splits at run time by its measured size.
Nothing is broadcast by hint; Spark's own size checks decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths, shell

def explode_paths(events: DataFrame, keys: list[str], candidates: Column) -> DataFrame:
    """``keys``, ``ordinal`` and one resolved path per row; first of equals kept."""
    return events.select(
        *keys, F.posexplode_outer(F.array_distinct(candidates)).alias("ordinal", "path")
    ).where(F.col("path").isNotNull())


def resolved_candidates(command: Column, base: Column, home: Column) -> Column:
    """Resolved paths a command may read, in order."""
    return paths.resolve_candidates(shell.read_candidates(command), base, home)


def shell_read_paths(
    commands: DataFrame, files: DataFrame, key: str, home: Column, default_dir: Column,
) -> DataFrame:
    """Files each command reads: ``key, ordinal, path`` for paths in the manifest."""
    base = paths.base_dir(F.col("cwd"), F.col("workspace_roots"), default_dir)
    wanted = explode_paths(
        commands, [key], resolved_candidates(F.col("command"), base, home)
    )
    return wanted.join(files.select("path"), "path", "left_semi")


def findings_of_reads(reads: DataFrame, file_hits: DataFrame, key: str) -> DataFrame:
    """``key, file_n, file_lines``: findings in the files an event reads.

    ``reads`` has ``key, path``.  A group is one event, bounded by its command.
    """
    return summed_findings(reads.join(file_hits, "path"), key)


def summed_findings(joined: DataFrame, key: str) -> DataFrame:
    """The same from ``key, path, n_findings, lines`` of the files that were read."""
    # A set, so that an event delivered twice counts its files once.
    per_event = joined.groupBy(key).agg(
        F.collect_set(F.struct("path", "n_findings", "lines")).alias("found")
    )
    return per_event.select(
        key,
        F.expr("aggregate(found, 0, (a, f) -> a + f.n_findings)").alias("file_n"),
        F.expr("array_sort(array_distinct(flatten(found.lines)))").alias("file_lines"),
    )
