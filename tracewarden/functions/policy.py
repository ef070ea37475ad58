"""Policy verdicts for commands, paths and tool inputs.

A verdict is ``struct<is_safe, severity, reason>``.  The first rule that
matches decides, so each validator is one lazily evaluated ``CASE`` over
constants, written as SQL text.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import rules
from .paths import normalize_path
from .text import let, let_sql, match_sql, or_empty, quoted, words_sql

VERDICT = "struct<is_safe:boolean,severity:string,reason:string>"


def _verdict(severity: str, reason: str) -> str:
    """A constant verdict as SQL."""
    safe = "false" if severity == "block" else "true"
    return (
        f"named_struct('is_safe', {safe}, 'severity', {quoted(severity)}, 'reason', {quoted(reason)})"
    )


_OK = _verdict("ok", "")


def ok() -> Column:
    return F.expr(_OK)


_DANGEROUS = list(zip(rules.DANGEROUS_PATTERNS, rules.DANGEROUS_WORDS, strict=True))
_SENSITIVE = list(zip(rules.SENSITIVE_PATTERNS, rules.SENSITIVE_WORDS, strict=True))


def _tests(table: list, text: str = "t", low: str = "low") -> list[tuple[int, str, str]]:
    """``(rule number, reason, SQL test)`` of each rule.

    A substring search rules out nearly every rule before its regex is run.
    """
    return [
        (number, why, f"{words_sql(low, words)} AND {match_sql(text, pattern)}")
        for number, ((pattern, why), words) in enumerate(table, 1)
    ]


def _branches(table: list, severity: str, prefix: str = "") -> list[str]:
    """One WHEN per rule: the first that matches gives its constant verdict."""
    return [f"WHEN {test} THEN {_verdict(severity, prefix + why)}" for _, why, test in _tests(table)]


def _judge(text: Column, branches: list[str], default: str = "NULL") -> Column:
    """A CASE over the text ``t`` and its lowered form ``low``, each made once."""
    case = f"CASE {' '.join(branches)} ELSE {default} END"
    return let(text, f"t -> {let_sql('lower(t)', 'low', case)}")


def _reason_sql(text: str) -> str:
    """Reason of the first dangerous rule, else NULL."""
    chain = " ".join(f"WHEN {test} THEN {quoted(why)}" for _, why, test in _tests(_DANGEROUS))
    return let_sql(text, "t", let_sql("lower(t)", "low", f"CASE {chain} END"))


def _all_hits(text: Column, table: list) -> Column:
    rows = [
        f"named_struct('rule_no', {number}, 'reason', {quoted(why)}, 'hit', {test})"
        for number, why, test in _tests(table)
    ]
    every = f"array({', '.join(rows)})"
    return let(text, f"t -> {let_sql('lower(t)', 'low', f'filter({every}, r -> r.hit)')}")


def dangerous_hits(text: Column) -> Column:
    """Every dangerous rule that matches: ``array<struct<rule_no, reason, hit>>``."""
    return _all_hits(text, _DANGEROUS)


def sensitive_hits(text: Column) -> Column:
    return _all_hits(text, _SENSITIVE)


def validate_command(command: Column) -> Column:
    return _judge(command, _branches(_DANGEROUS, "block") + _branches(_SENSITIVE, "warn"), _OK)


def _prefix_branches(message: str) -> list[str]:
    return [
        f"WHEN startswith(t, {quoted(p)}) THEN {_verdict('block', message + p)}"
        for p in rules.PROTECTED_PREFIXES
    ]


def _file_branches(message: str) -> list[str]:
    return [
        f"WHEN t = {quoted(p)} THEN {_verdict('block', message + p)}"
        for p in rules.PROTECTED_READ_FILES
    ]


def _judge_path(path: Column, branches: list[str]) -> Column:
    given = or_empty(path)
    judged = _judge(normalize_path(given), branches + _branches(_SENSITIVE, "warn"), _OK)
    return F.when(given == "", ok()).otherwise(judged)


def validate_file_write(path: Column) -> Column:
    return _judge_path(path, _prefix_branches("Write to protected path: "))


def validate_file_read(path: Column) -> Column:
    return _judge_path(
        path,
        _file_branches("Read of protected system file: ")
        + _prefix_branches("Read from protected system path: "),
    )


def is_mcp_tool(tool: Column) -> Column:
    return F.contains(F.lower(tool), F.lit("mcp"))


def task_prompt_verdict(prompt: Column) -> Column:
    """Warning for a dangerous pattern in a delegated prompt, else NULL."""
    return _judge(prompt, _branches(_DANGEROUS, "warn", "Prompt contains pattern: "))


# Integer-like keys come first in numeric order, others in document order.
_IS_INT = quoted(r"^(?:0|[1-9][0-9]{0,9})\z")
_INT_KEY = (
    f"CASE WHEN e.key RLIKE {_IS_INT} AND try_cast(e.key AS bigint) < 4294967295 "
    "THEN try_cast(e.key AS bigint) END"
)
# ``map<string,string>`` gives every value as text, strings without quotes, however
# often a key repeats; a variant tells the types, but is NULL for a document with a
# repeated nested key.  Then only text that reads as JSON and does not stand in the
# document as a string counts as an object or a list.
_IS_JSON = "(json_object_keys(e.value) IS NOT NULL OR json_array_length(e.value) IS NOT NULL)"
_AS_STRING = "substring(to_json(array(e.value)), 2, length(to_json(array(e.value))) - 2)"
_IS_STRING = (
    "CASE WHEN b.types IS NOT NULL THEN schema_of_variant(b.types[i].value) = 'STRING' "
    f"ELSE e.value IS NOT NULL AND (NOT ({_IS_JSON}) OR contains(b.doc, {_AS_STRING})) END"
)
_PARAM = (
    f"(e, i) -> named_struct('key', e.key, 'at', i, 'reason', CASE WHEN {_IS_STRING} "
    f"THEN {_reason_sql('e.value')} END)"
)
# A repeated key keeps its first place and its last value.
_RANKED = (
    f"(f, l) -> named_struct('named', ({_INT_KEY}) IS NULL, "
    f"'rank', coalesce({_INT_KEY}, cast(f.at AS bigint)), 'key', f.key, 'reason', l.reason)"
).replace("e.key", "f.key")


def mcp_param_hits(tool_input: Column) -> Column:
    """``array<struct<named, rank, key, reason>>`` of top-level strings that hit.

    In a document with a repeated nested key no types are known; there a nested
    value whose text also stands in the document as a string is taken for one
    and scanned: the doubt falls on the side of a hit.
    """
    both = F.struct(
        tool_input.alias("doc"),
        F.map_entries(F.from_json(tool_input, "map<string,string>")).alias("texts"),
        F.map_entries(F.from_json(tool_input, "map<string,variant>")).alias("types"),
    )
    ordered = let(both, f"b -> array_sort(transform(b.texts, {_PARAM}))")
    params = let(
        ordered,
        "s -> zip_with(filter(s, (e, i) -> i = 0 OR get(s, i - 1).key <> e.key), "
        f"filter(s, (e, i) -> coalesce(get(s, i + 1).key <> e.key, true)), {_RANKED})",
    )
    return F.call_function("filter", params, F.expr("r -> r.reason IS NOT NULL"))


# Without an escape every string stands in the document as it is, and so do the words that a rule needs.
_MAY_HIT = "contains(d, '\\\\') OR " + let_sql(
    "lower(d)", "low", " OR ".join(f"({words_sql('low', words)})" for words in rules.DANGEROUS_WORDS)
)


def mcp_verdict(tool_input: Column) -> Column:
    """Block for the first string parameter with a dangerous pattern, else NULL."""
    verdict = let(
        F.array_min(mcp_param_hits(tool_input)),
        "f -> CASE WHEN f IS NOT NULL THEN named_struct('is_safe', false, 'severity', 'block', "
        "'reason', concat('Dangerous pattern in ', f.key, ': ', f.reason)) END",
    )
    return F.when(let(tool_input, f"d -> {_MAY_HIT}"), verdict)


def json_field(document: Column, name: str) -> Column:
    return F.get_json_object(document, f"$.{name}")


def validate_tool_input(tool: Column, tool_input: Column, command: Column | None = None) -> Column:
    """Dispatch on the (case-sensitive) tool name.

    ``command`` overrides the command field of the input.
    """
    if command is None:
        command = or_empty(json_field(tool_input, "command"))
    read_path = F.coalesce(json_field(tool_input, "file_path"), json_field(tool_input, "target_file"))
    by_tool = (
        F.when(tool.isin(rules.COMMAND_TOOLS), validate_command(command))
        .when(tool.isin(rules.WRITE_TOOLS), validate_file_write(json_field(tool_input, "file_path")))
        .when(tool.isin(rules.READ_TOOLS), validate_file_read(read_path))
        .when(tool == "Task", task_prompt_verdict(or_empty(json_field(tool_input, "prompt"))))
        .when(is_mcp_tool(tool), mcp_verdict(tool_input))
    )
    return F.coalesce(by_tool, ok())
