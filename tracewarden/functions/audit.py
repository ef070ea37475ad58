"""Fields of an audit trace: model id, tool, contributor, edited line ranges."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import rules
from .text import let, let_sql

RANGES = "array<struct<start_line:int,end_line:int>>"


def normalize_model_id(model: Column) -> Column:
    """``provider/model`` for known prefixes; empty is NULL."""
    chain = F.when(F.contains(model, F.lit("/")), model)
    for prefix, provider in rules.MODEL_PROVIDERS:
        chain = chain.when(
            F.startswith(model, F.lit(prefix)), F.concat(F.lit(provider + "/"), model)
        )
    return F.when(model != "", chain.otherwise(model))


def tool_info(dialect: Column, tool_version: Column) -> Column:
    """``struct<name, version>`` of the agent that sent the event."""
    own = F.struct(
        F.lit(rules.PRODUCER).alias("name"), F.lit(rules.PRODUCER_VERSION).alias("version")
    )
    cursor = F.struct(F.lit("cursor").alias("name"), tool_version.alias("version"))
    claude = F.struct(F.lit("claude-code").alias("name"), F.lit(None).cast("string").alias("version"))
    known = (dialect == "cursor") & (F.coalesce(tool_version, F.lit("")) != "")
    return F.when(known, cursor).when(dialect == "claude", claude).otherwise(own)


def is_security_followup(prompt: Column) -> Column:
    """A prompt that quotes the scan's own follow-up message."""
    lowered = F.lower(prompt)
    hit = F.lit(False)
    for phrase in rules.FOLLOWUP_PHRASES:
        hit = hit | F.contains(lowered, F.lit(phrase))
    return F.coalesce(hit, F.lit(False))


def _lines(text: str) -> str:
    return f"(length({text}) - length(replace({text}, '\\n', '')) + 1)"


_EXPLICIT = (
    "coalesce(e.range.start_line_number, 0) <> 0 AND coalesce(e.range.end_line_number, 0) <> 0"
)
_FOUND_LINE = let_sql(
    "CASE WHEN coalesce(b.content, '') <> '' THEN instr(b.content, e.new_string) END", "at",
    f"CASE WHEN at > 0 THEN {_lines('substring(b.content, 1, at - 1)')} ELSE 1 END",
)
_POSITION = (
    f"CASE WHEN {_EXPLICIT} THEN named_struct('start_line', e.range.start_line_number, "
    "'end_line', e.range.end_line_number) ELSE "
    + let_sql(
        _FOUND_LINE, "line",
        f"named_struct('start_line', line, 'end_line', line + {_lines('e.new_string')} - 1)",
    )
    + " END"
)


def range_positions(edits: Column, content: Column) -> Column:
    """Line ranges of the non-empty replacements of an edit list.

    An explicit range wins; else the first place the new text stands in the
    content; else the top of the file.
    """
    both = F.struct(edits.alias("edits"), content.alias("content"))
    kept = "filter(b.edits, e -> coalesce(e.new_string, '') <> '')"
    return let(both, f"b -> cast(transform({kept}, e -> {_POSITION}) AS {RANGES})")


def has_range(edit: Column) -> Column:
    """Whether an edit brings its own range."""
    ends = (edit["range"]["start_line_number"], edit["range"]["end_line_number"])
    return (F.coalesce(ends[0], F.lit(0)) != 0) & (F.coalesce(ends[1], F.lit(0)) != 0)


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def ranges_or_default(ranges: Column) -> Column:
    """``[{1, 1}]`` when there are no ranges."""
    top = F.array(F.struct(F.lit(1).alias("start_line"), F.lit(1).alias("end_line"))).cast(RANGES)
    return F.when(F.size(F.coalesce(ranges, F.array().cast(RANGES))) > 0, ranges).otherwise(top)
