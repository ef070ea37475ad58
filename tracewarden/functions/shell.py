"""Which paths does a shell command read?  Two readings, both as expressions."""

from __future__ import annotations

from pyspark.sql import Column

from . import rules
from .paths import BARE_LIKE, PATH_LIKE, STRIPPED
from .text import NOT_SPACE, SPACE_CHARS, java_pattern, let, let_sql, quoted

_STRINGS = "array<string>"

# One match per word or operator.  Possessive loops keep long words off the
# regex stack.
_WORD = (
    r"(?:'[^']*+(?:'|\z)|\"(?:[^\"\\]++|\\.|\\\z)*+(?:\"|\z)|\\.|\\\z"
    rf"|[^{SPACE_CHARS}'\"|&;<>\\]++)++"
)
_LEXER = rf"(?s){_WORD}|\|\|?|&&?|;|<<?|>>?"
_PIECE = r"(?s)'[^']*+(?:'|\z)|\"(?:[^\"\\]++|\\.|\\\z)*+(?:\"|\z)|\\.|\\\z|[^'\"\\]++"



_SINGLE_MARKS = r"^'|'\z"
_DOUBLE_BODY = r"(?s)^\"((?:[^\"\\]++|\\.|\\\z)*+)"
_ESCAPED = r"(?s)\\(.)"
_QUOTING = r"['\"\\]"


def _plain_sql(x: str) -> str:
    """A piece of a word with its quoting removed."""
    return (
        f"CASE WHEN startswith({x}, {quoted(chr(39))}) THEN regexp_replace({x}, {quoted(_SINGLE_MARKS)}, '') "
        f"WHEN startswith({x}, {quoted(chr(34))}) THEN "
        f"regexp_replace(regexp_extract({x}, {quoted(_DOUBLE_BODY)}, 1), {quoted(_ESCAPED)}, '$1') "
        f"WHEN {x} RLIKE {quoted('^' + _ESCAPED)} THEN substr({x}, 2) ELSE {x} END"
    )


_WORDS = f"regexp_extract_all(t, {quoted(_LEXER)}, 0)"
_PIECES = f"regexp_extract_all(w, {quoted(_PIECE)}, 0)"
_TOKENS = (
    f"filter(transform({_WORDS}, w -> CASE WHEN w RLIKE {quoted(_QUOTING)} "
    f"THEN array_join(transform({_PIECES}, x -> {_plain_sql('x')}), '') ELSE w END), w -> w <> '')"
)


def _in(names: list[str]) -> str:
    return f"IN ({', '.join(quoted(n) for n in names)})"


def _state(reading: str, operand: str, out: str = "acc.out") -> str:
    return f"named_struct('reading', {reading}, 'operand', {operand}, 'out', {out})"


_GROWN = f"CASE WHEN {PATH_LIKE} THEN array_append(acc.out, c) ELSE acc.out END"
_WALK = (
    f"array_distinct(aggregate(k, {_state('false', 'false', f'cast(array() AS {_STRINGS})')}, (acc, c) -> CASE "
    f"WHEN acc.operand THEN {_state('true', 'false', _GROWN)} "
    f"WHEN c {_in(rules.SEPARATOR_TOKENS)} THEN {_state('false', 'false')} "
    f"WHEN NOT acc.reading THEN {_state(f'lower(c) {_in(rules.READ_COMMANDS)}', 'false')} "
    f"WHEN c {_in(rules.REDIRECT_TOKENS)} THEN {_state('true', 'true')} "
    f"ELSE {_state('true', 'false', _GROWN)} END, acc -> acc.out))"
)
_PATHS, _NAMES = (
    quoted(java_pattern(p)) for p in (rules.PATH_PATTERN, rules.BARE_FILE_PATTERN)
)
# A path holds a slash, a file name a point; where they are not in the text their regex is not run.
_FOUND = ", ".join(
    f"CASE WHEN contains(t, '{mark}') THEN regexp_extract_all(t, {pattern}, 0) ELSE cast(array() AS {_STRINGS}) END"
    for mark, pattern in (("/", _PATHS), (".", _NAMES))
)
_BY_REGEX = (
    f"filter(array_distinct(transform(concat({_FOUND}), c -> {STRIPPED})), c -> {PATH_LIKE} OR {BARE_LIKE})"
)
# Texts without quoting are cut at white space and operators only, so a read command stands between them as it is.
_EDGE = rf"[^{SPACE_CHARS}|&;<>]"
_READS = rf"(?<!{_EDGE})(?:{'|'.join(rules.READ_COMMANDS)})(?!{_EDGE})"
_MAY_READ = f"(t RLIKE {quoted(_QUOTING)} OR lower(t) RLIKE {quoted(_READS)})"
_MAY_NAME = "(contains(t, '/') OR contains(t, '.') OR contains(t, '~'))"


def shell_tokens(command: Column) -> Column:
    """Words with quoting removed, and operators, in order."""
    return let(command, f"t -> {_TOKENS}")


def paths_by_tokens(tokens: Column) -> Column:
    """Path-like words after a read command, up to the next separator."""
    return let(tokens, f"k -> {_WALK}")


def paths_by_regex(command: Column) -> Column:
    """Anything in the raw string that looks like a path or a file name."""
    return let(command, f"t -> {_BY_REGEX}")


def read_candidates(command: Column) -> Column:
    """Both readings, first seen first, duplicates removed."""
    empty = f"cast(array() AS {_STRINGS})"
    tokens = f"CASE WHEN {_MAY_READ} THEN {let_sql(_TOKENS, 'k', _WALK)} ELSE {empty} END"
    both = f"array_union({tokens}, {_BY_REGEX})"
    return let(
        command, f"t -> CASE WHEN {_MAY_NAME} AND t RLIKE {quoted(NOT_SPACE)} THEN {both} ELSE {empty} END"
    )
