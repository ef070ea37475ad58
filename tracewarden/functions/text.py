"""Text semantics shared by every detector.

The rule patterns are written for an engine with ASCII word boundaries, a
Unicode-aware ``\\s`` and a ``.`` that stops at four line terminators.  Java's
regex differs on all three, so ``java_pattern`` spells them out.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

SPACE_CHARS = (
    r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
)
SPACE = f"[{SPACE_CHARS}]"
NOT_SPACE = f"[^{SPACE_CHARS}]"
LINE_CHAR = r"[^\n\r\u2028\u2029]"
WORD_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"

_ATOM = re.compile(r"\\.|\[(?:\\.|[^\]\\])*\]|\.", re.S)


def _java_atom(match: re.Match) -> str:
    atom = match.group()
    if atom == r"\b":
        return WORD_EDGE
    if atom == r"\s":
        return SPACE
    if atom == r"\S":
        return NOT_SPACE
    if atom == ".":
        return LINE_CHAR
    if atom.startswith("["):
        return atom.replace(r"\s", SPACE_CHARS)
    return atom


def java_pattern(pattern: str, ignore_case: bool = False) -> str:
    """The Java spelling of a rule pattern."""
    return ("(?i)" if ignore_case else "") + _ATOM.sub(_java_atom, pattern)


def let(value: Column, lambda_sql: str) -> Column:
    """Apply a SQL lambda such as ``x -> x + 1`` to a value computed once.

    Expressions that name their input several times would otherwise grow the
    plan exponentially, and long rule chains are much faster to parse as SQL
    than to put together call by call.
    """
    return F.get(F.call_function("transform", F.array(value), F.expr(lambda_sql)), F.lit(0))


def let_sql(value: str, name: str, body: str) -> str:
    """The same inside SQL text."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def words_sql(low: str, alternatives: list[list[str]]) -> str:
    """Test that all words of one of the alternatives are in the (lowered) text."""
    tests = [
        " AND ".join(f"contains({low}, {quoted(word)})" for word in words) for words in alternatives
    ]
    return tests[0] if len(tests) == 1 else "(" + " OR ".join(tests) + ")"


def line_pattern(pattern: str) -> str:
    """A pattern like ``A.*B.*C`` that reads each line once, for yes / no tests.

    The first A of a line and the first B after it are the best ones to take, so
    nothing is gained by trying others.  That holds when A and B stay on their
    line; other patterns are only respelled.
    """
    *heads, tail = pattern.split(".*")
    if not heads or "(?!" in pattern or any(r"\s" in head for head in heads):
        return java_pattern(pattern, True)
    first = "".join(f"(?>{LINE_CHAR}*?{java_pattern(head)})" for head in heads)
    return f"(?i)(?<!{LINE_CHAR}){first}{LINE_CHAR}*{java_pattern(tail)}"


def match_sql(text: str, pattern: str) -> str:
    """Case-insensitive test of a rule pattern."""
    return f"{text} RLIKE {quoted(line_pattern(pattern))}"


def extract_all(text: Column, java_regex: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(java_regex), F.lit(group))


def has_text(text: Column) -> Column:
    """True when something other than white space is left after a trim."""
    return F.coalesce(text.rlike(NOT_SPACE), F.lit(False))


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def utf16_left(text: Column, units: int) -> Column:
    """First ``units`` UTF-16 code units; a half surrogate pair is dropped.

    Each character outside the basic plane gets a private-use mark in front, so
    that it counts for two, and the marks go away after the cut.
    """
    mark = "\uE000"
    wide = r"([\x{10000}-\x{10FFFF}])"
    cut = F.replace(
        F.left(F.regexp_replace(text, wide, mark + "$1"), F.lit(units)), F.lit(mark), F.lit("")
    )
    return F.when(text.rlike(wide), cut).otherwise(F.left(text, F.lit(units)))


def unescape_html(text: Column) -> Column:
    """Undo the five entities markup needs, ``&amp;`` last."""
    out = text
    for entity, char in (
        ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"),
    ):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


# SQL builders: they take and return SQL text.


def has_text_sql(text: str) -> str:
    return f"coalesce({text} RLIKE {quoted(NOT_SPACE)}, false)"


def json_field_sql(document: str, name: str) -> str:
    return f"get_json_object({document}, '$.{name}')"


def in_sql(value: str, names: Iterable[str]) -> str:
    return f"{value} IN ({', '.join(quoted(n) for n in names)})"


def json_value_sql(value: str) -> str:
    """A scalar as JSON text; NULL stays NULL."""
    boxed = let_sql(f"to_json(array({value}))", "j", "substring(j, 2, length(j) - 2)")
    return f"CASE WHEN {value} IS NOT NULL THEN {boxed} END"


def json_number_sql(value: str) -> str:
    """A number as JSON text without a trailing ``.0``."""
    return (
        f"CASE WHEN {value} = floor({value}) AND abs({value}) < 1e15 "
        f"THEN cast(cast({value} AS bigint) AS string) ELSE cast({value} AS string) END"
    )


def json_object_sql(fields: Iterable[tuple[str, str]]) -> str:
    """JSON object text from ``(key, JSON text)`` pairs, in order, NULLs left out."""
    parts = [f"concat({quoted(chr(34) + key + chr(34) + ':')}, {value})" for key, value in fields]
    return f"concat('{{', concat_ws(',', {', '.join(parts)}), '}}')"


def or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def truthy(value: Column) -> Column:
    """NULL for the empty string, else the value."""
    return F.nullif(value, F.lit(""))
