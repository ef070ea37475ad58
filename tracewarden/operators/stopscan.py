"""Stop scans: analyser findings rolled up to the files edited since the last stop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import audit, paths, rules
from ..functions.text import json_object_sql, json_value_sql, quoted, truthy, utf16_left
from ..sources.scan_reports import parse_reports

STOP_KEY = ["session", "epoch"]


def result_path(result: Column) -> Column:
    """``path`` as text, else ``path.value``, else ``target.path``."""
    return F.coalesce(
        truthy(json_string(result, "path")),
        truthy(F.get_json_object(result, "$.path.value")),
        truthy(F.get_json_object(result, "$.target.path")),
    )


def json_string(document: Column, name: str) -> Column:
    """A top-level field if it is a JSON string, whatever it begins with."""
    value = F.get_json_object(document, f"$.{name}")
    parsed = F.try_parse_json(document)
    # A document no variant can hold (a repeated key): objects and lists read as JSON.
    looks = F.json_object_keys(value).isNull() & F.json_array_length(value).isNull()
    typed = F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant")) == "STRING"
    return F.when(F.coalesce(typed, parsed.isNull() & looks), value)


def result_range(result: Column) -> Column:
    """``struct<start_line, end_line>``: nested lines, else flat ones, else 1.

    Only JSON numbers are lines; one beyond the range of lines counts as absent.
    """
    parsed = F.try_parse_json(result)

    def number(name: str) -> Column:
        typed = F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant"))
        value = F.floor(F.get_json_object(result, f"$.{name}").try_cast("double")).try_cast("int")
        return F.when(F.coalesce(typed, F.lit("")) != "STRING", value)

    return F.struct(
        F.coalesce(number("start.line"), number("line"), F.lit(1)).alias("start_line"),
        F.coalesce(number("end.line"), number("end_line"), number("line"), F.lit(1)).alias(
            "end_line"
        ),
    )


def result_fields(results: DataFrame) -> DataFrame:
    """Typed columns of exploded results: path, lines, rule, message, severity."""
    result = F.col("result")
    span = result_range(result)
    return results.withColumns(
        {
            "result_path": result_path(result),
            "start_line": span["start_line"],
            "end_line": span["end_line"],
            "rule_id": F.coalesce(F.get_json_object(result, "$.check_id"), F.lit("")),
            "finding": F.coalesce(F.get_json_object(result, "$.message"), F.lit("")),
            "severity": F.coalesce(F.get_json_object(result, "$.extra.severity"), F.lit("")),
        }
    )


def with_existing(edited: DataFrame, files: DataFrame, base: Column) -> DataFrame:
    """Edited files with ``is_valid``: whether they exist; relative ones resolve against the base.

    A relative path without a base cannot be read and counts as missing.
    """
    resolved = F.when(F.startswith("path", F.lit("/")), F.col("path")).when(
        F.coalesce(base, F.lit("")) != "", paths.resolve_against(base, F.col("path"))
    )
    known = files.select(F.col("path").alias("resolved_path"), F.lit(True).alias("is_valid")).distinct()
    located = edited.withColumn("resolved_path", resolved).join(known, "resolved_path", "left")
    return located.withColumn("is_valid", F.coalesce("is_valid", F.lit(False)))


def valid_files(edited: DataFrame, files: DataFrame, base: Column) -> DataFrame:
    """The edited files that exist."""
    return with_existing(edited, files, base).where("is_valid").drop("is_valid")


def attribute_results(results: DataFrame, edited: DataFrame) -> DataFrame:
    """Attach results to the first edited file with the same base name.

    Results without one are left out.  The edited side has one row per base
    name and stop, so a file with very many results is split by AQE, not
    gathered.
    """
    first = (
        edited.withColumn("name", paths.basename(F.col("path")))
        .groupBy(*STOP_KEY, "name")
        .agg(F.min_by("path", "first_seq").alias("file"))
    )
    named = results.withColumn("name", paths.basename(F.col("result_path")))
    return named.where(F.col("result_path").isNotNull()).join(first, [*STOP_KEY, "name"]).drop("name")


def vulnerability_rollup(attributed: DataFrame) -> DataFrame:
    """Counts per stop and file; partial aggregation does most of the work."""
    return attributed.groupBy(*STOP_KEY, "file").agg(
        F.count(F.lit(1)).alias("vulnerability_count"),
        F.min("start_line").alias("first_line"),
        F.max("end_line").alias("last_line"),
        F.countDistinct("rule_id").alias("rules"),
        F.max("severity").alias("top_severity"),
    )


def vulnerability_lists(attributed: DataFrame) -> DataFrame:
    """Ranges and findings per stop and file as ordered arrays.

    A group holds results of one report, which came in as a single row.
    """
    item = F.struct(
        "ordinal",
        F.struct("start_line", "end_line").alias("span"),
        F.struct("rule_id", F.col("finding").alias("message"), "severity").alias("detail"),
    )
    grouped = attributed.groupBy(*STOP_KEY, "file").agg(
        F.array_sort(F.collect_list(item)).alias("items")
    )
    return grouped.select(
        *STOP_KEY,
        "file",
        F.size("items").alias("vulnerability_count"),
        F.transform("items", lambda i: i["span"]).cast(audit.RANGES).alias("ranges"),
        F.transform("items", lambda i: i["detail"]).alias("vulnerabilities"),
    )


def stop_summary(stops: DataFrame, edited: DataFrame) -> DataFrame:
    """One row per stop: counts, status and totals.

    ``stops`` has ``session, epoch, seq, report, return_code, error_text``,
    ``edited`` is a result of ``with_existing``.  Files scanned is the size of
    the edited set, whether or not all were found.
    """
    counts = edited.groupBy(*STOP_KEY).agg(
        F.count(F.lit(1)).alias("n_edited"), F.count_if(F.col("is_valid")).alias("n_valid")
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_edited", "n_valid")}
    parsed = parse_reports(stops).join(counts, STOP_KEY, "left").withColumns(zero)
    status = (
        F.when(F.col("n_edited") == 0, "no_files_to_scan")
        .when(F.col("n_valid") == 0, "no_valid_files")
        .when(F.col("return_code") != 0, "scan_failed")
        .when(F.col("report_status") != "ok", "parse_error")
        .when(F.size("results") > 0, "vulnerabilities_found")
        .otherwise("no_vulnerabilities")
    )
    found = F.col("status") == "vulnerabilities_found"
    return parsed.withColumn("status", status).withColumns(
        {
            "total_vulnerabilities": F.when(found, F.size("results")),
            "files_scanned": F.when(
                found | (F.col("status") == "no_vulnerabilities"), F.col("n_edited")
            ),
        }
    )


def error_text() -> Column:
    return F.coalesce(truthy(F.col("error_text")), F.lit(f"Unknown {rules.SCANNER} error"))


def stop_responses(
    summary: DataFrame, dialect: str, shown: int | None = rules.ERROR_TEXT_LIMIT
) -> DataFrame:
    """Answer to the stop event.  ``summary`` has ``stop_hook_active`` too.

    The answer shows the first ``shown`` units of an error; traces hold the whole.
    """
    error = error_text() if shown is None else utf16_left(error_text(), shown)
    count = "concat('Found ', size(results), ' security finding(s)')"
    listing = (
        f"concat({count}, '. Review the findings and address any security issues. [', "
        "concat_ws(',', results), ']')"
    )
    failed = (
        f"concat('{rules.SCANNER.capitalize()} scan encountered errors: ', _error, ' ({rules.SCANNER}: ', "
        "coalesce(scanner_path, ''), ')')"
    )
    allowing = f"concat({count}, '. Stop hook already active, allowing stop.')"
    active = "coalesce(stop_hook_active, false)"
    text = (
        f"CASE status WHEN 'scan_failed' THEN {failed} WHEN 'vulnerabilities_found' THEN "
        + (listing if dialect == "cursor" else f"if({active}, {allowing}, {listing})")
        + " END"
    )
    told = summary.withColumn("_error", error).withColumn("_text", F.expr(text)).drop("_error")
    text_json = json_value_sql("_text")
    if dialect == "cursor":
        response = json_object_sql([("followup_message", f"coalesce({text_json}, 'null')")])
    else:
        blocks = json_object_sql([("decision", quoted('"block"')), ("reason", text_json)])
        tells = json_object_sql([("systemMessage", text_json)])
        response = (
            f"CASE WHEN status = 'vulnerabilities_found' AND NOT {active} THEN {blocks} "
            f"WHEN _text IS NOT NULL THEN {tells} END"
        )
    return told.withColumn("response", F.expr(response)).drop("_text")
