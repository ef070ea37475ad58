"""File contents by path: ``files(path, content)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Read a directory tree, one row per file, contents as text.

    Bytes that are not UTF-8 become replacement characters.
    """
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(path)
    )
    return found.select(
        F.regexp_replace("path", r"^file:(?://)?(?=/)", "").alias("path"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
    )
