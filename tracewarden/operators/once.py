"""Columns that are computed once per row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F


def made_once(rows: DataFrame, keep: list[str], made: Mapping[str, Column]) -> DataFrame:
    """The kept columns and the made ones, which leave a generator.

    The optimiser copies an expression into every later use and pushes filters on it down to the scan; behind a
    generator neither happens, so costly or large expressions stay single and plans stay small.
    """
    one = F.struct(*[value.alias(name) for name, value in made.items()])
    # Made in a projection, which is compiled; a generator would interpret it.
    return rows.select(*keep, one.alias("_one")).select(*keep, F.inline_outer(F.array("_one")))
