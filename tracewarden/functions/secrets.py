"""Secret detection in text, masking, and the message shown for findings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import rules
from .text import java_pattern, let, let_sql, quoted, words_sql

FINDING = (
    "struct<rule_id:string,label:string,ordinal:int,line:int,start:int,"
    "masked:string,value_sha256:string>"
)
FINDINGS = f"array<{FINDING}>"


def mask(value: Column) -> Column:
    return F.concat(F.left(value, F.lit(4)), F.lit("****"))


def _found_sql(rule: tuple) -> str:
    """Every match of one rule in ``t``; texts without its literals skip the regex."""
    _, pattern, ignore_case, literals = rule
    gate = words_sql("lower(t)" if ignore_case else "t", [[word] for word in literals])
    regex = quoted(java_pattern(pattern, ignore_case))
    return f"CASE WHEN {gate} THEN regexp_extract_all(t, {regex}, 0) END"


# Match texts ``m`` become findings with 1-based start and line.  The pieces
# between the matches carry both forward, so the text is read once more and no
# oftener.  Appending copies a list, so findings are put together block by
# block: the work follows the number of matches.
_BLOCK = 64
_NEWLINES = "length({0}) - length(replace({0}, '\\n', ''))"
_ITEM = (
    "cast(named_struct('rule_id', {rule}, 'label', l, 'ordinal', acc.n + 1, "
    f"'line', acc.line + {_NEWLINES.format('x.p')}, 'start', acc.pos + length(x.p), "
    f"'masked', concat(left(x.v, 4), '****'), 'value_sha256', sha2(x.v, 256)) AS {FINDING})"
)
_STEP = (
    "named_struct('pos', acc.pos + length(x.p) + length(x.v), "
    f"'line', acc.line + {_NEWLINES.format('x.p')} + {_NEWLINES.format('x.v')}, "
    f"'n', acc.n + 1, 'out', array_append(acc.out, {_ITEM}))"
)


def _located_sql(rule: tuple) -> str:
    regex = quoted(java_pattern(rule[1], rule[2]))
    pairs = (
        f"zip_with(m, slice(split(t, {regex}, -1), 1, size(m)), (v, p) -> named_struct('v', v, 'p', p))"
    )
    step = _STEP.replace("{rule}", quoted(rule[0]))
    empty = f"named_struct('pos', w.pos, 'line', w.line, 'n', w.n, 'out', cast(array() AS {FINDINGS}))"
    block = f"aggregate(slice(q, i * {_BLOCK} + 1, {_BLOCK}), {empty}, (acc, x) -> {step})"
    joined = let_sql(
        block, "r", "named_struct('pos', r.pos, 'line', r.line, 'n', r.n, 'out', array_append(w.out, r.out))"
    )
    first = f"named_struct('pos', 1, 'line', 1, 'n', 0, 'out', cast(array() AS array<{FINDINGS}>))"
    blocks = f"sequence(0, cast((size(q) - 1) div {_BLOCK} AS int))"
    walked = let_sql(pairs, "q", f"aggregate({blocks}, {first}, (w, i) -> {joined}, w -> flatten(w.out))")
    return let_sql(_found_sql(rule), "m", f"CASE WHEN size(m) > 0 THEN {walked} END")


def scan_text(text: Column, label: Column) -> Column:
    """Findings of every rule in ``text`` as an array, rule by rule."""
    empty = f"cast(array() AS {FINDINGS})"
    parts = [f"coalesce({_located_sql(rule)}, {empty})" for rule in rules.SECRET_RULES]
    both = F.struct(text.alias("t"), label.alias("l"))
    body = let_sql("b.t", "t", let_sql("b.l", "l", f"concat({', '.join(parts)})"))
    return let(both, f"b -> {body}")


_HIT = "struct<rule_id:string,n:int>"


def _count_sql(rule: tuple) -> str:
    """Number of matches of one rule in ``t``, whose lowered form is ``low``."""
    _, pattern, ignore_case, literals = rule
    gate = words_sql("low" if ignore_case else "t", [[word] for word in literals])
    regex = quoted(java_pattern(pattern, ignore_case))
    return f"CASE WHEN {gate} THEN size(regexp_extract_all(t, {regex}, 0)) ELSE 0 END"


_HITS = "filter(array({}), h -> h.n > 0)".format(
    ", ".join(f"named_struct('rule_id', {quoted(rule[0])}, 'n', {_count_sql(rule)})" for rule in rules.SECRET_RULES)
)
# Literals of all rules: nearly every text has none of them and is done with.
_ANY = "({})".format(
    " OR ".join(words_sql("low" if rule[2] else "t", [[word] for word in rule[3]]) for rule in rules.SECRET_RULES)
)
_GATED = let_sql("lower(t)", "low", f"CASE WHEN {_ANY} THEN {_HITS} ELSE cast(array() AS array<{_HIT}>) END")


def hits_sql(text: str) -> str:
    return let_sql(text, "t", _GATED)


def rule_hits(text: Column) -> Column:
    """Light form for decisions: ``array<struct<rule_id, n>>`` of rules that hit."""
    return let(text, f"t -> {_GATED}")


def lines_sql(hits: str, label: str) -> str:
    return f"transform({hits}, h -> concat('- ', h.rule_id, ' (', {label}, ')'))"


def finding_lines(hits: Column, label: Column) -> Column:
    """One masked line per rule that hit, for the message of a decision."""
    both = F.struct(hits.alias("hits"), label.alias("label"))
    return let(both, f"b -> {lines_sql('b.hits', 'b.label')}")


def finding_count(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0), lambda a, h: a + h["n"])


def findings_message(heading: Column, lines: Column) -> Column:
    """Heading, then the distinct lines in order."""
    return F.concat_ws("\n", heading, F.array_sort(F.array_distinct(lines)))
