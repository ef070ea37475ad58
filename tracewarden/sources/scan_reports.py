"""Static-analysis reports: one JSON document ``{"results": [...]}`` per scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_scan_reports(spark: SparkSession, path: str) -> DataFrame:
    """One row per report file: ``report_path, report``."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("report_path"), F.col("value").alias("report")
    )


def parse_reports(reports: DataFrame, report: str = "report") -> DataFrame:
    """Add ``report_status`` (ok or parse_error) and ``results`` (JSON texts).

    A report without results has an empty list; a result that is null stays in
    the list, as it counts in the total.
    """
    doc = F.col(report)
    parsed = F.from_json(F.get_json_object(doc, "$.results"), "array<string>")
    valid = F.try_parse_json(doc).isNotNull()
    return reports.withColumn(
        "report_status", F.when(F.coalesce(valid, F.lit(False)), "ok").otherwise("parse_error")
    ).withColumn("results", F.coalesce(parsed, F.array().cast("array<string>")))


def explode_results(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per result with its 0-based place in the report."""
    return parsed.select(*keys, F.posexplode_outer("results").alias("ordinal", "result")).where(
        F.col("ordinal").isNotNull()
    )
