"""Check SQL: the registered queries again, as plain SQL for another engine.

The statements share the rule data and the derived views with the queries, and
nothing else: patterns run in a linear-time regex engine, tokens are walked with
window functions, path folding is a list reduction.
"""

from __future__ import annotations

from ..functions import rules
from ..operators.trace import PARSE_ERROR
from .branches import BRANCHES, branch_sql
from .registry import DECISIONS, DEFAULT_DIR, DIALECTS, HOME, PAIR_LATE, PAIR_WITHIN, PAUSE, PROJECT, SPAN_LATE
from .views import view_sql

CHECKS: dict[str, str] = {}

# The look-ahead of the last command rule has no counterpart; per line, all up
# to the last "where" is dropped before the rest of the rule is tried.
_LOOKAHEAD = r"(?!.*\bwhere\b)"


def lit(text: str) -> str:
    """A string literal; line breaks become chr(10)."""
    parts = ["'" + part.replace("'", "''") + "'" for part in text.split("\n")]
    return "(" + " || chr(10) || ".join(parts) + ")" if len(parts) > 1 else parts[0]


def _v(name: str) -> str:
    return f"({view_sql(name)}) {name}"


def _b(name: str) -> str:
    return f"({branch_sql(name)}) {name}"


# --- expressions ----------------------------------------------------------------


def rule_test(text: str, pattern: str) -> str:
    if pattern.endswith(_LOOKAHEAD):
        text = f"regexp_replace({text}, '(?i).*\\bwhere\\b', '', 'g')"
        pattern = pattern.removesuffix(_LOOKAHEAD)
    return f"regexp_matches({text}, {lit('(?i)' + pattern)})"


def first_reason(text: str, table: list[tuple[str, str]], default: str = "NULL") -> str:
    branches = " ".join(f"WHEN {rule_test(text, p)} THEN {lit(why)}" for p, why in table)
    return f"CASE {branches} ELSE {default} END"


def dangerous(text: str) -> str:
    return first_reason(text, rules.DANGEROUS_PATTERNS)


def sensitive(text: str) -> str:
    return first_reason(text, rules.SENSITIVE_PATTERNS)


def normalized(path: str) -> str:
    folded = (
        f"list_reduce(list_transform(list_filter(string_split({path}, '/'), lambda s: s <> '' AND s <> '.'), "
        "lambda s: [s]), lambda a, s: CASE WHEN s[1] <> '..' THEN list_concat(a, s) "
        "WHEN len(a) > 0 AND a[len(a)] <> '..' THEN a[1:len(a) - 1] "
        f"WHEN starts_with({path}, '/') THEN a ELSE list_concat(a, s) END, CAST([] AS VARCHAR[]))"
    )
    body = f"coalesce(array_to_string({folded}, '/'), '')"
    tail = f"CASE WHEN ends_with({path}, '/') THEN '/' ELSE '' END"
    return (
        f"CASE WHEN {path} = '' THEN '.' "
        f"WHEN starts_with({path}, '/') AND {body} = '' THEN '/' "
        f"WHEN starts_with({path}, '/') THEN '/' || {body} || {tail} "
        f"WHEN {body} = '' THEN '.' || {tail} ELSE {body} || {tail} END"
    )


def resolved_sql(path: str, base: str, source: str, keep: str, name: str = "resolved") -> str:
    """Subquery adding the candidate path resolved against a base directory."""
    home = f"CASE WHEN {path} = '~' THEN {lit(HOME)} WHEN starts_with({path}, '~/') " \
           f"THEN {lit(HOME + '/')} || substr({path}, 3) ELSE {path} END"
    return (
        f"SELECT {keep}, CASE WHEN starts_with(given, '/') AND NOT at_home THEN given "
        f"WHEN clean <> '/' AND ends_with(clean, '/') AND NOT at_home THEN clean[:-2] ELSE clean END AS {name} "
        f"FROM (SELECT *, {normalized('joined')} AS clean FROM (SELECT *, CASE WHEN starts_with(given, '/') "
        f"THEN given ELSE base || '/' || given END AS joined FROM (SELECT *, {home} AS given, "
        f"starts_with({path}, '~/') AS at_home, {base} AS base FROM ({source}) q0) q1) q2) q3"
    )


def luhn(value: str) -> str:
    digits = f"regexp_replace({value}, '[^0-9]', '', 'g')"
    doubled = (
        f"list_transform(string_split(reverse({digits}), ''), lambda c, i: CASE WHEN i % 2 = 0 THEN "
        "(CAST(c AS INT) * 2) // 10 + (CAST(c AS INT) * 2) % 10 ELSE CAST(c AS INT) END)"
    )
    return f"(length({digits}) BETWEEN 13 AND 19 AND list_sum({doubled}) % 10 = 0)"


def pii_list(kind: str, text: str) -> str:
    pattern = {
        "ssn": rules.SSN_PATTERN, "email": rules.EMAIL_PATTERN, "phone": rules.PHONE_PATTERN,
        "card": rules.CARD_PATTERN,
    }[kind]
    found = f"regexp_extract_all({text}, {lit(pattern)})"
    return f"list_filter({found}, lambda v: {luhn('v')})" if kind == "card" else found


def any_pii(text: str) -> str:
    return "(" + " OR ".join(
        f"len({pii_list(k, text)}) > 0" for k in ("ssn", "email", "phone", "card")
    ) + ")"


def _secret_re(rule: tuple) -> str:
    return lit(("(?i)" if rule[2] else "") + rule[1])


def secret_count(text: str) -> str:
    counts = [f"len(regexp_extract_all({text}, {_secret_re(r)}))" for r in rules.SECRET_RULES]
    return "CAST(coalesce(" + " + ".join(counts) + ", 0) AS INT)"


def secret_lines(text: str, label: str) -> str:
    lines = [
        f"CASE WHEN regexp_matches({text}, {_secret_re(r)}) THEN {lit('- ' + r[0] + ' (')} || {label} || ')' END"
        for r in rules.SECRET_RULES
    ]
    return f"list_filter([{', '.join(lines)}], lambda x: x IS NOT NULL)"


def message(heading: str, lines: str, suffix: str = "") -> str:
    end = f" || {lit(suffix)}" if suffix else ""
    return f"{lit(heading)} || chr(10) || array_to_string(list_sort(list_distinct({lines})), chr(10)){end}"


def js(value: str) -> str:
    return f"CAST(to_json({value}) AS VARCHAR)"


def js_field(key: str, value: str) -> str:
    """``,"key":value`` or nothing when the JSON text is NULL."""
    return f"coalesce({lit(',' + chr(34) + key + chr(34) + ':')} || ({value}), '')"


def js_object(fields: list[tuple[str, str]]) -> str:
    joined = " || ".join(js_field(k, v) for k, v in fields)
    return f"'{{' || substr({joined}, 2) || '}}'"


def js_num(value: str) -> str:
    return f"CASE WHEN {value} = floor({value}) THEN CAST(CAST({value} AS BIGINT) AS VARCHAR) ELSE CAST({value} AS VARCHAR) END"


def ji(name: str) -> str:
    return f"json_extract_string(tool_input, '$.{name}')"


# --- detectors --------------------------------------------------------------------


def _list_rows(values: str, name: str, keys: str, source: str) -> str:
    return (
        f"SELECT {keys}, unnest(vals) AS {name}, CAST(generate_subscripts(vals, 1) - 1 AS INT) AS ordinal "
        f"FROM (SELECT {keys}, {values} AS vals FROM {source}) x"
    )


for _kind in ("ssn", "email", "phone", "card"):
    CHECKS[f"pii_{_kind}"] = _list_rows(pii_list(_kind, "text"), "value", "src, row_id", _v("texts"))

_cards = _list_rows(
    f"regexp_extract_all(text, {lit(rules.CARD_PATTERN)})", "candidate", "src, row_id", _v("texts")
)
CHECKS["luhn_valid"] = f"SELECT *, {luhn('candidate')} AS valid FROM ({_cards}) y"

_typed = ", ".join(
    f"list_transform({pii_list(k, 'text')}, lambda w: {{'type': 'pii_{name}', 'value': w}})"
    for k, name in (("ssn", "ssn"), ("email", "email"), ("phone", "phone"), ("card", "credit_card"))
)
_pii = (
    f"SELECT src, row_id, ordinal, f.type AS type, f.value AS value FROM "
    f"({_list_rows(f'flatten([{_typed}])', 'f', 'src, row_id', _v('texts'))}) z"
)
CHECKS["pii_findings"] = _pii
CHECKS["contains_pii"] = f"SELECT src, row_id, {any_pii('text')} AS has_pii FROM {_v('texts')}"
CHECKS["redacted_findings"] = (
    "SELECT src, row_id, ordinal, type, left(value, 4) || '****' AS masked, "
    f"sha256(value) AS value_sha256 FROM ({_pii}) r"
)


def _unescaped(text: str) -> str:
    for entity, char in (("&quot;", '"'), ("&#39;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{char}')"
    return text


_readable = (
    f"SELECT src, row_id, label, CASE WHEN src = 'pages' THEN {_unescaped('text')} ELSE text END AS text "
    f"FROM {_v('texts')}"
)


def located(source: str, keys: str) -> str:
    """All findings with place and line; starts come from the pieces between matches."""
    parts = []
    for rule in rules.SECRET_RULES:
        parts.append(
            f"SELECT {keys}, '{rule[0]}' AS rule_id, label, text, i AS ordinal, m[i] AS value, "
            "CAST(1 + list_sum(list_transform(p[1:i], lambda s: length(s))) "
            "+ coalesce(list_sum(list_transform(m[1:i - 1], lambda s: length(s))), 0) AS INT) AS start "
            f"FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT {keys}, label, text, "
            f"regexp_extract_all(text, {_secret_re(rule)}) AS m, "
            f"string_split_regex(text, {_secret_re(rule)}) AS p FROM ({source}) s0) s1) s2"
        )
    both = " UNION ALL ".join(parts)
    return (
        f"SELECT {keys}, rule_id, label, CAST(ordinal AS INT) AS ordinal, "
        "CAST(1 + length(text[1:start - 1]) - length(replace(text[1:start - 1], chr(10), '')) AS INT) AS line, "
        f"start, left(value, 4) || '****' AS masked, sha256(value) AS value_sha256 FROM ({both}) f"
    )


CHECKS["secret_findings"] = located(_readable, "src, row_id")
_file_findings = located(f"SELECT path, path AS label, content AS text FROM {_v('files')}", "path")
_read_targets = resolved_sql(
    "file_path", "cwd",
    f"SELECT event_id, file_path, cwd FROM {_v('tool_calls')} WHERE tool_name IN "
    f"({', '.join(lit(t) for t in rules.SECRET_READ_TOOLS)}) AND file_path <> ''",
    "event_id", "path",
)
CHECKS["secret_findings_files"] = (
    "SELECT event_id, r.path AS path, rule_id, ordinal, line, start, masked "
    f"FROM ({_read_targets}) r JOIN ({_file_findings}) f ON r.path = f.path"
)
CHECKS["findings_message"] = (
    f"SELECT src, row_id, {message('SECRET DETECTED', 'lines')} AS message, n_findings FROM "
    f"(SELECT src, row_id, {secret_lines('text', 'label')} AS lines, {secret_count('text')} AS n_findings "
    f"FROM ({_readable}) t) u WHERE n_findings > 0"
)
CHECKS["params_scan"] = (
    f"SELECT event_id, {secret_count('tool_input')} AS n_findings, {any_pii('tool_input')} AS has_pii "
    f"FROM {_v('tool_calls')}"
)

# --- policy -----------------------------------------------------------------------


def _all_hits(table: list[tuple[str, str]]) -> str:
    parts = [
        f"SELECT src, row_id, {n} AS rule_no, {lit(why)} AS reason FROM t WHERE {rule_test('text', p)}"
        for n, (p, why) in enumerate(table, 1)
    ]
    return f"WITH t AS (SELECT * FROM {_v('texts')}) " + " UNION ALL ".join(parts)


CHECKS["dangerous_hits"] = _all_hits(rules.DANGEROUS_PATTERNS)
CHECKS["sensitive_hits"] = _all_hits(rules.SENSITIVE_PATTERNS)


def _verdict(block: str, warn: str, source: str, keys: str) -> str:
    """Block reason first, then warning reason."""
    return (
        f"SELECT {keys}, b IS NULL AS is_safe, CASE WHEN b IS NOT NULL THEN 'block' "
        "WHEN w IS NOT NULL THEN 'warn' ELSE 'ok' END AS severity, coalesce(b, w, '') AS reason "
        f"FROM (SELECT {keys}, {block} AS b, {warn} AS w FROM {source}) v"
    )


CHECKS["validate_command"] = _verdict(
    dangerous("text"), sensitive("text"), _v("texts"), "src, row_id"
)
_command_verdicts = _verdict(
    dangerous("command"), sensitive("command"), _v("tool_calls"), "event_id"
)
CHECKS["validate_command_counts"] = (
    f"SELECT severity, reason, count(*) AS n FROM ({_command_verdicts}) c GROUP BY ALL"
)
_base_name = "regexp_extract(file_path, '([^/]*)/*$', 1)"
CHECKS["normalize_path"] = (
    f"SELECT event_id, {normalized('file_path')} AS normalized, {_base_name} AS base_name "
    f"FROM {_v('tool_calls')}"
)
_clean = f"(SELECT *, {normalized('file_path')} AS clean FROM {_v('tool_calls')}) k"


def _prefix_case(words: str) -> str:
    tests = " ".join(
        f"WHEN starts_with(clean, {lit(p)}) THEN {lit(words + p)}" for p in rules.PROTECTED_PREFIXES
    )
    return f"CASE {tests} END"


_protected = "clean IN (" + ", ".join(lit(p) for p in rules.PROTECTED_READ_FILES) + ")"
CHECKS["protected_paths"] = (
    f"SELECT event_id, {_prefix_case('')} AS write_prefix, {_protected} AS protected_file FROM {_clean}"
)
_write_block = f"CASE WHEN file_path <> '' THEN {_prefix_case('Write to protected path: ')} END"
_read_block = (
    f"CASE WHEN file_path = '' THEN NULL WHEN {_protected} THEN 'Read of protected system file: ' || clean "
    f"ELSE {_prefix_case('Read from protected system path: ')} END"
)
_path_warn = f"CASE WHEN file_path <> '' THEN {sensitive('clean')} END"
CHECKS["validate_file_write"] = _verdict(_write_block, _path_warn, _clean, "event_id")
CHECKS["validate_file_read"] = _verdict(_read_block, _path_warn, _clean, "event_id")


def _in(column: str, names: list[str]) -> str:
    return f"{column} IN ({', '.join(lit(n) for n in names)})"


def _mcp_hits(source: str, key: str) -> str:
    """Dangerous string parameters with their rank: integer keys first."""
    return (
        f"SELECT {key}, key, reason, row_number() OVER (PARTITION BY {key} ORDER BY "
        "CASE WHEN regexp_full_match(key, '0|[1-9][0-9]*') THEN 0 ELSE 1 END, "
        "CASE WHEN regexp_full_match(key, '0|[1-9][0-9]*') THEN CAST(key AS BIGINT) ELSE pos END) AS rank "
        f"FROM (SELECT {key}, key, pos, {dangerous('v')} AS reason FROM (SELECT {key}, j.key AS key, "
        "j.rowid AS pos, j.atom->>'$' AS v, j.type AS kind FROM "
        f"({source}) c, json_each(c.tool_input) j) e WHERE kind = 'VARCHAR') h WHERE reason IS NOT NULL"
    )


CHECKS["mcp_param_scan"] = (
    f"SELECT event_id, key, reason FROM ({_mcp_hits('SELECT event_id, tool_input FROM ' + _v('tool_calls'), 'event_id')}) m"
)
CHECKS["task_prompt_warn"] = (
    "SELECT event_id, CASE WHEN r IS NOT NULL THEN 'warn' END AS severity, "
    f"'Prompt contains pattern: ' || r AS reason FROM (SELECT event_id, {dangerous('command')} AS r "
    f"FROM {_v('tool_calls')}) q"
)


def tool_verdict(source: str, key: str) -> str:
    """Rows ``key, b, w`` (block and warning reason) for ``key, tool_name, tool_input`` rows."""
    mcp = _mcp_hits(f"SELECT * FROM ({source}) s WHERE lower(tool_name) LIKE '%mcp%'", key)
    fields = (
        f"SELECT *, coalesce({ji('command')}, '') AS cmd, {ji('prompt')} AS ask, "
        f"coalesce(CASE WHEN {_in('tool_name', rules.READ_TOOLS)} THEN coalesce({ji('file_path')}, {ji('target_file')}) "
        f"ELSE {ji('file_path')} END, '') AS file_path FROM ({source}) s"
    )
    shell, write, read = (
        _in("tool_name", names) for names in (rules.COMMAND_TOOLS, rules.WRITE_TOOLS, rules.READ_TOOLS)
    )
    return (
        f"SELECT c.{key}, CASE WHEN {shell} THEN {dangerous('cmd')} WHEN {write} THEN {_write_block} "
        f"WHEN {read} THEN {_read_block} WHEN h.reason IS NOT NULL THEN "
        "'Dangerous pattern in ' || h.key || ': ' || h.reason END AS b, "
        f"CASE WHEN {shell} THEN {sensitive('cmd')} WHEN {write} OR {read} THEN {_path_warn} "
        f"WHEN tool_name = 'Task' THEN 'Prompt contains pattern: ' || {dangerous('ask')} END AS w "
        f"FROM (SELECT *, {normalized('file_path')} AS clean FROM ({fields}) f) c "
        f"LEFT JOIN (SELECT * FROM ({mcp}) m WHERE rank = 1) h ON h.{key} = c.{key}"
    )


_calls = f"SELECT event_id, tool_name, tool_input FROM {_v('tool_calls')}"
CHECKS["validate_tool_input"] = (
    "SELECT t.event_id, t.tool_name, b IS NULL AS is_safe, CASE WHEN b IS NOT NULL THEN 'block' "
    "WHEN w IS NOT NULL THEN 'warn' ELSE 'ok' END AS severity, coalesce(b, w, '') AS reason "
    f"FROM ({_calls}) t JOIN ({tool_verdict(_calls, 'event_id')}) v ON v.event_id = t.event_id"
)

# --- lineage ----------------------------------------------------------------------

_LEX = r"""(?:'[^']*(?:'|\z)|"(?:[^"\\]|\\.|\\\z)*(?:"|\z)|\\.|\\\z|[^\s'"|&;<>\\])+|\|\|?|&&?|;|<<?|>>?"""
_PIECE = r"""'[^']*(?:'|\z)|"(?:[^"\\]|\\.|\\\z)*(?:"|\z)|\\.|\\\z|[^'"\\]+"""


def tokens(command: str) -> str:
    piece = (
        "CASE WHEN starts_with(x, '''') THEN replace(x, '''', '') "
        "WHEN starts_with(x, '\"') THEN regexp_replace(regexp_extract(x, '^\"((?:[^\"\\\\]|\\\\.)*)', 1, 's'), "
        "'\\\\(.)', '\\1', 'gs') WHEN starts_with(x, chr(92)) AND length(x) > 1 THEN substr(x, 2) ELSE x END"
    )
    return (
        f"list_filter(list_transform(regexp_extract_all({command}, {lit(_LEX)}, 0, 's'), lambda t: "
        f"array_to_string(list_transform(regexp_extract_all(t, {lit(_PIECE)}, 0, 's'), lambda x: {piece}), '')), "
        "lambda y: y <> '')"
    )


def path_like(token: str) -> str:
    return (
        f"({token} <> '' AND NOT starts_with({token}, '-') AND NOT regexp_matches({token}, '[*?\\[]') "
        f"AND regexp_matches({token}, '/|^[.~]'))"
    )


def bare_like(token: str) -> str:
    return f"(regexp_full_match({token}, '[A-Za-z0-9._-]+') AND NOT starts_with({token}, '-') AND contains({token}, '.') AND length({token}) <= 255)"


def stripped(raw: str) -> str:
    return f"rtrim(ltrim(trim({raw}), {lit(rules.STRIP_LEADING)}), {lit(rules.STRIP_TRAILING)})"


CHECKS["shell_tokens"] = _list_rows(tokens("command"), "token", "event_id", _v("tool_calls"))
CHECKS["token_predicates"] = (
    f"SELECT event_id, ordinal, {path_like('token')} AS is_path, {bare_like('token')} AS is_bare_file, "
    f"regexp_matches(token, {lit(rules.ENV_ASSIGNMENT_PATTERN)}) AS is_env, "
    f"CASE WHEN token = '~' THEN {lit(HOME)} WHEN starts_with(token, '~/') THEN {lit(HOME + '/')} || substr(token, 3) "
    f"ELSE token END AS expanded, {stripped('token')} AS stripped FROM ({CHECKS['shell_tokens']}) t"
)


def regex_candidates(source: str, key: str) -> str:
    both = (
        f"list_concat(regexp_extract_all(command, {lit(rules.PATH_PATTERN)}), "
        f"regexp_extract_all(command, {lit(rules.BARE_FILE_PATTERN)}))"
    )
    return (
        f"SELECT DISTINCT {key}, candidate FROM (SELECT {key}, {stripped('raw')} AS candidate FROM "
        f"(SELECT {key}, unnest({both}) AS raw FROM ({source}) s) r) c "
        f"WHERE {path_like('candidate')} OR {bare_like('candidate')}"
    )


def token_candidates(source: str, key: str) -> str:
    """Window walk: the first read command of a segment opens it."""
    sep = _in("token", rules.SEPARATOR_TOKENS)
    rows = _list_rows(tokens("command"), "token", key, f"({source}) s")
    return (
        f"SELECT DISTINCT {key}, token AS candidate FROM (SELECT *, min(CASE WHEN NOT {sep} AND "
        f"{_in('lower(token)', rules.READ_COMMANDS)} THEN ordinal END) OVER (PARTITION BY {key}, segment) AS opened "
        f"FROM (SELECT *, sum(CASE WHEN {sep} THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY ordinal) AS segment "
        f"FROM ({rows}) t) g) o WHERE ordinal > opened AND {path_like('token')}"
    )


_cmds = f"SELECT event_id, command, cwd FROM {_v('tool_calls')}"
CHECKS["read_paths_regex"] = regex_candidates(_cmds, "event_id")
CHECKS["read_paths_tokens"] = token_candidates(_cmds, "event_id")


def read_paths(source: str, key: str) -> str:
    """Distinct resolved paths of ``key, command, cwd`` rows (cwd is the base)."""
    both = f"{token_candidates(source, key)} UNION {regex_candidates(source, key)}"
    based = f"SELECT b.*, s.cwd FROM ({both}) b JOIN ({source}) s ON s.{key} = b.{key}"
    return f"SELECT DISTINCT * FROM ({resolved_sql('candidate', 'cwd', based, key, 'path')}) d"


CHECKS["shell_read_paths"] = (
    f"SELECT event_id, path FROM ({read_paths(_cmds, 'event_id')}) r WHERE path IN "
    f"(SELECT path FROM {_v('files')})"
)
_file_calls = f"SELECT event_id, file_path, cwd FROM {_v('tool_calls')}"
CHECKS["resolve_path"] = (
    f"SELECT a.event_id, a.resolved, b.joined FROM "
    f"({resolved_sql('file_path', 'cwd', _file_calls, 'event_id')}) a JOIN "
    "(SELECT event_id, CASE WHEN clean <> '/' AND ends_with(clean, '/') THEN clean[:-2] ELSE clean END AS joined "
    f"FROM (SELECT event_id, {normalized('j')} AS clean FROM (SELECT *, CASE WHEN starts_with(file_path, '/') "
    f"THEN file_path ELSE cwd || '/' || file_path END AS j FROM ({_file_calls}) x) y) z) b ON a.event_id = b.event_id"
)
CHECKS["path_escape_flag"] = (
    "SELECT event_id, CASE WHEN file_path IN ('', '.') OR regexp_full_match(file_path, '/+') THEN false "
    "WHEN starts_with(file_path, '/') THEN true ELSE NOT (rtrim(clean, '/') = cwd OR starts_with(clean, cwd || '/')) END AS escapes "
    f"FROM (SELECT *, {normalized('j')} AS clean FROM (SELECT *, cwd || '/' || file_path AS j FROM ({_file_calls}) x) y) z"
)
_file_hits = (
    f"SELECT * FROM (SELECT path, {secret_count('content')} AS n_findings, {secret_lines('content', 'path')} AS lines "
    f"FROM {_v('files')}) fh WHERE n_findings > 0"
)


def file_sums(reads: str, key: str, more: str = "") -> str:
    return (
        f"SELECT {key}, CAST(sum(n_findings) AS INT) AS file_n, flatten(list(lines)) AS file_lines "
        f"FROM ({reads}) r JOIN ({more or _file_hits}) h ON h.path = r.path"
        + (" AND r.at >= h.valid_from AND (h.valid_to IS NULL OR r.at < h.valid_to)" if more else "")
        + f" GROUP BY {key}"
    )


CHECKS["shell_read_secret_join"] = (
    f"SELECT event_id, file_n, {message('SECRET DETECTED (file read blocked)', 'file_lines')} AS message "
    f"FROM ({file_sums(read_paths(_cmds, 'event_id'), 'event_id')}) s"
)

# --- decisions ----------------------------------------------------------------------


def _decision(source: str, action: str, context: str, msg: str, response: str, exit_code: str, n: str) -> str:
    return (
        f"SELECT event_uid, event_name, action, context, message, {response} AS response, "
        f"CAST({exit_code} AS INT) AS exit_code, n_findings FROM (SELECT *, {action} AS action, "
        f"{context} AS context, {msg} AS message, CAST({n} AS INT) AS n_findings FROM ({source}) d0) d1"
    )


def _secret_check(source: str, heading: str, context: str, response: str, code: int, other: str,
                  suffix: str = "") -> str:
    """Decision of an event that is only searched for secrets (columns n, lines)."""
    return _decision(
        source, f"CASE WHEN n > 0 THEN 'block' ELSE '{other}' END",
        f"CASE WHEN n > 0 THEN '{context}' END",
        f"CASE WHEN n > 0 THEN {message(heading, 'lines', suffix)} END", response,
        f"CASE WHEN n > 0 THEN {code} ELSE 0 END", "n",
    )


def _scanned(source: str, *texts: tuple[str, str]) -> str:
    """Add n and lines over labelled texts."""
    counts = " + ".join(f"coalesce({secret_count(t)}, 0)" for t, _ in texts)
    lines = ", ".join(f"coalesce({secret_lines(t, label)}, [])" for t, label in texts)
    return f"SELECT *, {counts} AS n, flatten([{lines}]) AS lines FROM ({source}) sc"


def _union(names: list[str], column: str) -> str:
    return " UNION ALL ".join(
        f"SELECT event_uid, event_name, {column.format(name=n)} FROM {_b(n)}" for n in names
    )


def _claude_block(event: str) -> str:
    return (
        "CASE WHEN action = 'block' THEN '{\"decision\":\"block\",\"reason\":' || " + js("message")
        + " || ',\"hookSpecificOutput\":{\"hookEventName\":\"" + event
        + "\",\"additionalContext\":' || " + js("message") + " || '}}' END"
    )


def _cursor(kind: str) -> str:
    tail = js_field("userMessage", js("shown"))
    if kind == "continue":
        return "'{\"continue\":' || CASE WHEN action = 'block' THEN 'false' ELSE 'true' END || " + tail + " || '}'"
    if kind == "message":
        return "'{' || " + f"coalesce('\"message\":' || {js('message')}, '')" + " || '}'"
    return (
        "'{\"" + kind + "\":' || CASE WHEN action = 'block' THEN '\"deny\"' ELSE '\"allow\"' END || "
        + tail + " || '}'"
    )


def _plain(response: str) -> str:
    return response.replace("shown", "message")


_user = "(SELECT event_uid, event_name, user_prompt AS text FROM " + _b("claude_prompt") + \
    " UNION ALL SELECT event_uid, event_name, prompt FROM " + _b("claude_paste") + ")"
CHECKS["claude_prompt"] = _secret_check(
    _scanned(f"SELECT * FROM {_user} u", ("text", "'[prompt]'")),
    "SECRET DETECTED (submission blocked)", "secret_detected_in_prompt",
    _claude_block("UserPromptSubmit"), 0, "none",
)
_outputs = (
    "SELECT event_uid, event_name, tool_response AS text, CASE WHEN tool_name = 'Bash' THEN "
    f"coalesce({ji('command')}, '') ELSE '' END AS cmd FROM {_b('claude_post_tool')} UNION ALL "
    f"SELECT event_uid, event_name, tool_result, '' FROM {_b('claude_output')}"
)
CHECKS["claude_post_tool"] = _secret_check(
    _scanned(_outputs, ("text", "'[tool output]'"), ("cmd", "'[shell command]'")),
    "SECRET DETECTED in recent output", "secret_detected_in_output",
    _claude_block("PostToolUse"), 0, "none",
)
CHECKS["claude_lifecycle"] = (
    "SELECT event_uid, event_name, 'none' AS action, CAST(NULL AS VARCHAR) AS context, "
    "CAST(NULL AS VARCHAR) AS message, CAST(NULL AS VARCHAR) AS response, 0 AS exit_code, 0 AS n_findings "
    f"FROM {_b('claude_lifecycle')}"
)
_prompts = _union(["cursor_prompt", "cursor_paste"], "prompt AS text")
CHECKS["cursor_prompt"] = _secret_check(
    _scanned(_prompts, ("text", "'[prompt]'")), "SECRET DETECTED (submission blocked)",
    "secret_detected_in_prompt", _plain(_cursor("continue")), 2, "allow",
)
CHECKS["cursor_mcp"] = _secret_check(
    _scanned(f"SELECT * FROM {_b('cursor_mcp')}", ("command", "'[mcp command]'")),
    "SECRET DETECTED (MCP execution blocked)", "secret_detected_in_mcp_command",
    _plain(_cursor("permission")), 2, "allow",
)
CHECKS["cursor_after_shell"] = _secret_check(
    _scanned(f"SELECT * FROM {_b('cursor_after_shell')}", ("stdout", "'[shell stdout]'"),
             ("stderr", "'[shell stderr]'")),
    "SECRET DETECTED in recent output", "secret_detected_in_output", _cursor("message"), 2, "allow",
    "\nBe careful with this sensitive data!",
)
CHECKS["cursor_after_mcp"] = _secret_check(
    _scanned(f"SELECT * FROM {_b('cursor_after_mcp')}", ("stdout", "'[mcp stdout]'"),
             ("text", "'[mcp output]'"), ("message", "'[mcp output]'")).replace(
        "SELECT *, ", "SELECT event_uid, event_name, ", 1),
    "SECRET DETECTED in recent output", "secret_detected_in_output", _cursor("message"), 2, "allow",
    "\nBe careful with this sensitive data!",
)


def _with_file_sums(own: str, reads: str, versions: str = "") -> str:
    return (
        "SELECT o.*, coalesce(s.file_n, 0) AS file_n, coalesce(s.file_lines, []) AS file_lines "
        f"FROM ({own}) o LEFT JOIN ({file_sums(reads, 'event_uid', versions)}) s ON s.event_uid = o.event_uid"
    )


def _added(source: str) -> str:
    return (
        "SELECT event_uid, event_name, n + file_n AS n, list_concat(lines, file_lines) AS lines "
        f"FROM ({source}) a"
    )


_read = f"SELECT *, {lit(DEFAULT_DIR)} AS base FROM {_b('cursor_before_read')}"
CHECKS["cursor_before_read"] = _secret_check(
    _added(_with_file_sums(
        _scanned(_read, ("content", "file_path")),
        f"SELECT event_uid, file_path AS path FROM ({_read}) rr WHERE trim(content) = ''",
    )),
    "SECRET DETECTED (file read blocked)", "secret_detected_before_read",
    _plain(_cursor("permission")), 2, "allow",
)
_edit = f"SELECT * FROM {_b('cursor_after_edit')}"
CHECKS["cursor_after_edit"] = _secret_check(
    _added(_with_file_sums(
        _scanned(_edit, ("new_string", "file_path")),
        f"SELECT event_uid, file_path AS path FROM ({_edit}) rr",
    )),
    "SECRET DETECTED in file edit", "secret_detected_after_edit", _cursor("message"), 2, "allow",
)
_SHOWN = (
    "(CASE WHEN context IS NULL AND action = 'block' THEN 'BLOCKED: ' || message "
    "WHEN action = 'warn' THEN 'WARNING: ' || message ELSE message END)"
)
_cursor_pre = f"SELECT event_uid, event_name, tool_name, tool_input FROM {_b('cursor_pre_tool')}"
_cursor_judged = (
    f"SELECT t.*, b, w FROM ({_cursor_pre}) t JOIN ({tool_verdict(_cursor_pre, 'event_uid')}) v "
    "ON v.event_uid = t.event_uid"
)
_policy_action = "CASE WHEN b IS NOT NULL THEN 'block' WHEN w IS NOT NULL THEN 'warn' ELSE 'allow' END"
CHECKS["cursor_pre_tool"] = _decision(
    _cursor_judged, _policy_action, "CAST(NULL AS VARCHAR)", "tool_name || ' - ' || coalesce(b, w)",
    _cursor("decision").replace("shown", _SHOWN), "CASE action WHEN 'block' THEN 2 ELSE 0 END", "0",
)
_shell = (
    "SELECT event_uid, event_name, command, coalesce(nullif(trim(cwd), ''), workspace_root) AS cwd "
    f"FROM {_b('cursor_before_shell')}"
)


def _shell_decision(reads: str, versions: str = "") -> str:
    judged = (
        "SELECT event_uid, event_name, b, w, n + file_n AS n, list_concat(lines, file_lines) AS lines FROM "
        "(" + _with_file_sums(
            f"SELECT *, {dangerous('command')} AS b, {sensitive('command')} AS w FROM "
            f"({_scanned(_shell, ('command', lit('[shell command]')))}) z",
            reads, versions,
        ) + ") y"
    )
    return _decision(
        judged, f"CASE WHEN n > 0 THEN 'block' ELSE {_policy_action} END",
        "CASE WHEN n > 0 THEN 'secret_detected_before_read' END",
        f"CASE WHEN n > 0 THEN {message('SECRET DETECTED (file read blocked)', 'lines')} ELSE coalesce(b, w) END",
        _cursor("permission").replace("shown", _SHOWN), "CASE action WHEN 'block' THEN 2 ELSE 0 END", "n",
    )


_shell_reads = read_paths(_shell, "event_uid")
CHECKS["cursor_before_shell"] = _shell_decision(_shell_reads)
_version_hits = (
    f"SELECT * FROM (SELECT path, valid_from, lead(valid_from) OVER (PARTITION BY path ORDER BY valid_from) AS valid_to, "
    f"{secret_count('content')} AS n_findings, {secret_lines('content', 'path')} AS lines FROM {_v('file_versions')}) vh "
    "WHERE n_findings > 0"
)
CHECKS["decisions_as_of"] = _shell_decision(
    f"SELECT p.event_uid, p.path, b.received_at AS at FROM ({_shell_reads}) p JOIN (SELECT event_uid, received_at FROM "
    f"{_b('cursor_before_shell')}) b ON b.event_uid = p.event_uid",
    _version_hits,
)
_pre = f"SELECT event_uid, event_name, tool_name, tool_input FROM {_b('cursor_pre_tool')}"
_cursor_judged = (
    f"SELECT t.*, b, w FROM ({_cursor_pre}) t JOIN ({tool_verdict(_cursor_pre, 'event_uid')}) v "
    "ON v.event_uid = t.event_uid"
)
_policy_action = "CASE WHEN b IS NOT NULL THEN 'block' WHEN w IS NOT NULL THEN 'warn' ELSE 'allow' END"
CHECKS["cursor_pre_tool"] = _decision(
    _cursor_judged, _policy_action, "CAST(NULL AS VARCHAR)", "tool_name || ' - ' || coalesce(b, w)",
    _cursor("decision").replace("shown", _SHOWN), "CASE action WHEN 'block' THEN 2 ELSE 0 END", "0",
)
_shell = (
    "SELECT event_uid, event_name, command, coalesce(nullif(trim(cwd), ''), workspace_root) AS cwd "
    f"FROM {_b('cursor_before_shell')}"
)
_shell_all = (
    "SELECT event_uid, event_name, b, w, n + file_n AS n, list_concat(lines, file_lines) AS lines FROM "
    "(" + _with_file_sums(
        f"SELECT *, {dangerous('command')} AS b, {sensitive('command')} AS w FROM "
        f"({_scanned(_shell, ('command', lit('[shell command]')))}) z",
        read_paths(_shell, "event_uid"),
    ) + ") y"
)
CHECKS["cursor_before_shell"] = _decision(
    _shell_all, f"CASE WHEN n > 0 THEN 'block' ELSE {_policy_action} END",
    "CASE WHEN n > 0 THEN 'secret_detected_before_read' END",
    f"CASE WHEN n > 0 THEN {message('SECRET DETECTED (file read blocked)', 'lines')} ELSE coalesce(b, w) END",
    _cursor("permission").replace("shown", _SHOWN), "CASE action WHEN 'block' THEN 2 ELSE 0 END", "n",
)
_pre = f"SELECT event_uid, event_name, tool_name, tool_input, cwd FROM {_b('claude_pre_tool')}"
_pre_reads = (
    read_paths(
        f"SELECT event_uid, coalesce({ji('command')}, '') AS command, cwd FROM ({_pre}) p "
        f"WHERE {_in('tool_name', rules.SECRET_COMMAND_TOOLS)}", "event_uid")
    + " UNION ALL "
    + resolved_sql(
        "target", "cwd",
        f"SELECT event_uid, coalesce({ji('file_path')}, {ji('target_file')}) AS target, cwd FROM ({_pre}) p "
        f"WHERE {_in('tool_name', rules.SECRET_READ_TOOLS)} AND coalesce({ji('file_path')}, {ji('target_file')}) <> ''",
        "event_uid", "path")
)
_pre_cmd = (
    f"SELECT *, CASE WHEN {_in('tool_name', rules.SECRET_COMMAND_TOOLS)} THEN coalesce({ji('command')}, '') "
    f"ELSE '' END AS cmd FROM ({_pre}) p"
)
_pre_all = (
    "SELECT f.*, b, w FROM (" + _with_file_sums(
        _scanned(_pre_cmd, ("cmd", "'[shell command]'")), _pre_reads)
    + f") f JOIN ({tool_verdict(_pre, 'event_uid')}) v ON v.event_uid = f.event_uid"
)
_pre_response = (
    "'{\"hookSpecificOutput\":{\"hookEventName\":\"PreToolUse\",\"permissionDecision\":' || "
    "CASE action WHEN 'block' THEN '\"deny\"' ELSE '\"allow\"' END || "
    + js_field("permissionDecisionReason", js("message")) + " || '}' || "
    + js_field("systemMessage", js(_SHOWN)) + " || '}'"
)
CHECKS["claude_pre_tool"] = _decision(
    _pre_all,
    "CASE WHEN b IS NOT NULL OR n > 0 OR file_n > 0 THEN 'block' WHEN w IS NOT NULL THEN 'warn' ELSE 'allow' END",
    "CASE WHEN b IS NOT NULL THEN NULL WHEN n > 0 THEN 'secret_detected_in_command' "
    "WHEN file_n > 0 THEN 'secret_detected_before_read' END",
    f"CASE WHEN b IS NOT NULL THEN b WHEN n > 0 THEN {message('SECRET DETECTED (command execution blocked)', 'lines')} "
    f"WHEN file_n > 0 THEN {message('SECRET DETECTED (file read blocked)', 'file_lines')} ELSE w END",
    _pre_response, "0", "CASE WHEN b IS NOT NULL THEN 0 WHEN n > 0 THEN n ELSE file_n END",
)
_plug = f"SELECT event_uid, event_name, tool_name, tool_input FROM {_b('openclaw_before_tool')}"
_plug_shell = _in("tool_name", rules.OPENCLAW_COMMAND_TOOLS)
_plug_cmd = f"CASE WHEN {_plug_shell} THEN coalesce({ji('command')}, {ji('cmd')}, '') ELSE '' END"
_plug_target = f"coalesce(nullif({ji('file_path')}, ''), nullif({ji('path')}, ''), nullif({ji('target_file')}, ''))"
_plug_reads = (
    read_paths(
        f"SELECT event_uid, {_plug_cmd} AS command, coalesce({ji('cwd')}, {lit(DEFAULT_DIR)}) AS cwd FROM ({_plug}) p "
        f"WHERE {_plug_shell}", "event_uid")
    + " UNION ALL "
    + resolved_sql(
        "target", lit(DEFAULT_DIR),
        f"SELECT event_uid, {_plug_target} AS target FROM ({_plug}) p "
        f"WHERE {_in('tool_name', rules.OPENCLAW_READ_TOOLS)} AND {_plug_target} IS NOT NULL",
        "event_uid", "path")
)
_plug_all = (
    "SELECT f.*, CASE WHEN f.cmd <> '' THEN f.cmd_block ELSE v.b END AS b FROM (" + _with_file_sums(
        f"SELECT *, {secret_count('tool_input')} AS pn, {dangerous('cmd')} AS cmd_block, "
        f"cmd <> '' AND {any_pii('cmd')} AS cmd_pii, {any_pii('tool_input')} AS param_pii FROM "
        f"({_scanned(f'SELECT *, {_plug_cmd} AS cmd FROM ({_plug}) p', ('cmd', lit('[shell command]')))}) z",
        _plug_reads)
    + f") f JOIN ({tool_verdict(_plug, 'event_uid')}) v ON v.event_uid = f.event_uid"
)


def _plug_case(pick: dict[str, str], default: str) -> str:
    tests = {
        "policy": "b IS NOT NULL", "command": "n > 0", "command_pii": "cmd_pii", "file": "file_n > 0",
        "params": "pn > 0", "params_pii": "param_pii",
    }
    return "CASE " + " ".join(f"WHEN {t} THEN {pick[k]}" for k, t in tests.items()) + f" ELSE {default} END"


def _plug_decision() -> str:
    names = ["policy", "command", "command_pii", "file", "params", "params_pii"]
    null = "CAST(NULL AS VARCHAR)"
    return _decision(
        _plug_all, _plug_case({k: "'block'" for k in names}, "'none'"),
        _plug_case({
            "policy": null, "command": "'secret_detected_in_command'", "command_pii": null,
            "file": "'secret_detected_before_read'", "params": "'secret_detected_in_params'",
            "params_pii": null}, null),
        _plug_case({
            "policy": "b", "command": "'Secret detected in command'",
            "command_pii": "'PII detected in command'", "file": "'Secret detected in file read'",
            "params": "'Secret detected in tool parameters'",
            "params_pii": "'PII detected in tool parameters'"}, null),
        "CASE WHEN action = 'block' THEN '{\"block\":true,\"blockReason\":' || " + js("message") + " || '}' END",
        "0",
        _plug_case({"policy": "0", "command": "n", "command_pii": "0", "file": "file_n",
                    "params": "pn", "params_pii": "0"}, "0"),
    )


CHECKS["openclaw_before_tool"] = _plug_decision()
CHECKS["cursor_default"] = " UNION ALL ".join(
    "SELECT event_uid, event_name, 'allow' AS action, CAST(NULL AS VARCHAR) AS context, "
    "CAST(NULL AS VARCHAR) AS message, '{\"permission\":\"allow\"}' AS response, 0 AS exit_code, "
    f"0 AS n_findings FROM {_b(n)}" for n in DECISIONS["cursor_default"]
)


def _decided(names, columns: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{BRANCHES[DECISIONS[n][0]].dialect}' AS dialect, {columns} FROM ({CHECKS[n]}) x_{n}"
        for n in names
    )


CHECKS["decisions"] = (
    "SELECT dialect, event_name, action, context, count(*) AS events, CAST(sum(n_findings) AS BIGINT) AS findings "
    f"FROM ({_decided(DECISIONS, 'event_name, action, context, n_findings')}) d GROUP BY ALL"
)
CHECKS["secret_detection_log"] = (
    "SELECT event_uid, event_name, context, CASE WHEN dialect = 'openclaw' THEN "
    f"{lit(rules.PRODUCER + '-openclaw')} END AS tool_label, n_findings FROM ("
    + _decided(DECISIONS, "event_uid, event_name, context, n_findings")
    + ") l WHERE context IS NOT NULL"
)
_raw_status = (
    "SELECT event_id, raw, CASE WHEN trim(raw) = '' THEN 'blank' WHEN json_valid(raw) AND starts_with(trim(raw), '{') "
    f"THEN 'ok' ELSE 'malformed' END AS parse_status FROM {_v('raw_lines')}"
)
CHECKS["malformed_split"] = (
    "SELECT event_id, dialect, parse_status, CASE WHEN dialect = 'cursor' THEN '{\"permission\":\"allow\"}' END AS response, "
    f"0 AS exit_code FROM ({_raw_status}) r, (VALUES ('claude'), ('cursor'), ('openclaw')) d(dialect) WHERE parse_status <> 'ok'"
)
_plugin = "dialect = 'openclaw'"
CHECKS["read_hook_events"] = (
    f"SELECT event_id, dialect, CASE WHEN {_plugin} THEN 'before_tool_call' ELSE coalesce(raw->>'$.hook_event_name', '') END "
    f"AS hook_event_name, CASE WHEN {_plugin} THEN raw->>'$.toolName' ELSE raw->>'$.tool_name' END AS tool_name, "
    f"CASE WHEN {_plugin} THEN coalesce(CAST(json_extract(raw, '$.params') AS VARCHAR), '{{}}') "
    "ELSE CAST(json_extract(raw, '$.tool_input') AS VARCHAR) END AS tool_input, CAST(raw->>'$.duration' AS DOUBLE) AS duration "
    f"FROM ({_raw_status}) r, (VALUES ('claude'), ('cursor'), ('openclaw')) d(dialect) WHERE parse_status = 'ok'"
)

# --- edited files and stop scans ------------------------------------------------------

_epochs = (
    "SELECT session, seq, kind, path, CAST(coalesce(sum(CASE WHEN kind = 'stop' THEN 1 ELSE 0 END) OVER "
    "(PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS epoch "
    f"FROM {_v('activity')} WHERE kind IN ('edit', 'stop')"
)
CHECKS["edited_epochs"] = f"SELECT session, seq, kind, epoch FROM ({_epochs}) e"
_set = (
    f"SELECT session, epoch, path, min(seq) AS first_seq FROM ({_epochs}) e WHERE kind = 'edit' AND path IS NOT NULL "
    "GROUP BY session, epoch, path"
)
CHECKS["edited_set"] = _set
CHECKS["valid_files"] = (
    f"SELECT session, epoch, path, first_seq FROM ({_set}) s WHERE path IN (SELECT path FROM {_v('workspace')})"
)
_report = (
    "SELECT session, seq, ts, report, return_code, error_text, stop_hook_active, "
    "CASE WHEN json_valid(report) AND report <> '' THEN 'ok' ELSE 'parse_error' END AS report_status, "
    "CASE WHEN json_valid(report) AND report <> '' THEN coalesce(CAST(json_extract(report, '$.results[*]') AS VARCHAR[]), []) ELSE [] END AS results "
    f"FROM {_v('stop_reports')}"
)
_results = (
    "SELECT session, seq, report_status, CAST(generate_subscripts(results, 1) - 1 AS INT) AS ordinal, "
    f"unnest(results) AS result FROM ({_report}) r"
)
CHECKS["scan_results"] = _results


def _line(name: str) -> str:
    number = f"json_type(result, '{name}') IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT', 'UHUGEINT')"
    return f"CASE WHEN {number} THEN try_cast(floor(try_cast(result->>'{name}' AS DOUBLE)) AS INT) END"


_result_fields = (
    "coalesce(CASE WHEN json_type(result, '$.path') = 'VARCHAR' THEN result->>'$.path' END, result->>'$.path.value', "
    "result->>'$.target.path') AS result_path, "
    + f"CAST(coalesce({_line('$.start.line')}, {_line('$.line')}, 1) AS INT) AS start_line, "
    f"CAST(coalesce({_line('$.end.line')}, {_line('$.end_line')}, {_line('$.line')}, 1) AS INT) AS end_line, "
    "coalesce(result->>'$.check_id', '') AS rule_id, coalesce(result->>'$.message', '') AS finding, "
    "coalesce(result->>'$.extra.severity', '') AS severity"
)
CHECKS["result_paths"] = f"SELECT session, seq, ordinal, {_result_fields} FROM ({_results}) r"
_summary = (
    "SELECT r.*, e.epoch, coalesce(c.n_edited, 0) AS n_edited, coalesce(c.n_valid, 0) AS n_valid, "
    "CASE WHEN coalesce(c.n_edited, 0) = 0 THEN 'no_files_to_scan' WHEN coalesce(c.n_valid, 0) = 0 THEN 'no_valid_files' "
    "WHEN return_code <> 0 THEN 'scan_failed' WHEN report_status <> 'ok' THEN 'parse_error' "
    "WHEN len(results) > 0 THEN 'vulnerabilities_found' ELSE 'no_vulnerabilities' END AS status "
    f"FROM ({_report}) r JOIN ({_epochs}) e ON e.session = r.session AND e.seq = r.seq "
    "LEFT JOIN (SELECT session, epoch, count(*) AS n_edited, count(CASE WHEN path IN (SELECT path FROM "
    f"{_v('workspace')}) THEN 1 END) AS n_valid FROM ({_set}) s GROUP BY session, epoch) c "
    "ON c.session = e.session AND c.epoch = e.epoch"
)
CHECKS["stop_status"] = f"SELECT session, epoch, status, n_edited, n_valid FROM ({_summary}) s"
CHECKS["stop_totals"] = (
    "SELECT status, count(*) AS stops, CAST(sum(CASE WHEN status = 'vulnerabilities_found' THEN len(results) END) AS BIGINT) "
    "AS total_vulnerabilities, CAST(sum(CASE WHEN status IN ('vulnerabilities_found', 'no_vulnerabilities') THEN n_edited END) "
    f"AS BIGINT) AS files_scanned FROM ({_summary}) s GROUP BY status"
)
_first_names = (
    "SELECT session, epoch, regexp_extract(path, '[^/]*$') AS name, arg_min(path, first_seq) AS file "
    f"FROM ({_set}) s GROUP BY ALL"
)
_attr = (
    f"SELECT x.*, f.file FROM (SELECT session, epoch, ordinal, {_result_fields} FROM (SELECT session, epoch, "
    "CAST(generate_subscripts(results, 1) - 1 AS INT) AS ordinal, unnest(results) AS result FROM "
    f"({_summary}) s WHERE status = 'vulnerabilities_found') u) x JOIN ({_first_names}) f ON f.session = x.session "
    "AND f.epoch = x.epoch AND f.name = regexp_extract(x.result_path, '[^/]*$')"
)
CHECKS["attributed_results"] = f"SELECT session, epoch, file, ordinal, rule_id FROM ({_attr}) a"
CHECKS["vulnerability_rollup"] = (
    "SELECT session, epoch, file, count(*) AS vulnerability_count, min(start_line) AS first_line, max(end_line) AS last_line, "
    f"count(DISTINCT rule_id) AS rules, max(severity) AS top_severity FROM ({_attr}) a GROUP BY session, epoch, file"
)
_vuln_item = (
    "'{\"rule_id\":' || " + js("rule_id") + " || ',\"message\":' || " + js("finding")
    + " || ',\"severity\":' || " + js("severity") + " || '}'"
)
_IDS = [
    ("conversation_id", js("'c' || session")), ("generation_id", "CASE WHEN seq % 3 = 0 THEN '\"g\"' END"),
]
_STOP_COLUMNS = (
    "session, epoch, {dialect} AS dialect, {uid} AS event_uid, {path} AS path, 'openai/gpt-4' AS model_id, "
    "CASE WHEN seq % 2 = 0 THEN 'file:///t/log.jsonl' END AS url, {metadata} AS metadata"
)
_vuln_grouped = (
    "SELECT a.session, a.epoch, s.seq, s.ts, file, string_agg(start_line || '-' || end_line, ';' ORDER BY ordinal) AS spans, "
    f"count(*) AS n, string_agg({_vuln_item}, ',' ORDER BY ordinal) AS items FROM ({_attr}) a JOIN ({_summary}) s "
    "ON s.session = a.session AND s.epoch = a.epoch GROUP BY ALL"
)


def _vuln_rows(dialect: str, more: str) -> str:
    listed = [("vulnerabilities", "'[' || items || ']'")] if dialect == "cursor" else []
    metadata = js_object([
        ("event", lit('"vulnerability_detected"')), ("tool", lit(f'"{rules.PRODUCER}"')),
        ("scanner", lit(f'"{rules.SCANNER}"')), *_IDS, ("vulnerability_count", "CAST(n AS VARCHAR)"), *listed,
    ])
    columns = _STOP_COLUMNS.format(
        dialect=lit(dialect), uid="'stop-' || session || '-' || seq || '|' || file", path="file", metadata=metadata)
    return f"SELECT {columns}, {more} FROM ({_vuln_grouped}) g"


CHECKS["vulnerability_traces"] = " UNION ALL ".join(_vuln_rows(d, "spans") for d in DIALECTS)
_count_text = "'Found ' || len(results) || ' security finding(s)'"
_listing = (
    _count_text + " || '. Review the findings and address any security issues. [' || array_to_string(results, ',') || ']'"
)
_failed = (
    "'Semgrep scan encountered errors: ' || left(coalesce(nullif(error_text, ''), 'Unknown semgrep error'), 500) || "
    "' (semgrep: /usr/local/bin/scanner)'"
)
CHECKS["cursor_stop"] = (
    "SELECT session, epoch, '{\"followup_message\":' || coalesce(" + js(
        f"CASE status WHEN 'scan_failed' THEN {_failed} WHEN 'vulnerabilities_found' THEN {_listing} END")
    + f", 'null') || '}}' AS response FROM ({_summary}) s"
)
CHECKS["claude_stop"] = (
    "SELECT session, epoch, CASE WHEN status = 'scan_failed' THEN '{\"systemMessage\":' || " + js(_failed)
    + " || '}' WHEN status = 'vulnerabilities_found' AND NOT stop_hook_active THEN '{\"decision\":\"block\",\"reason\":' || "
    + js(_listing) + " || '}' WHEN status = 'vulnerabilities_found' THEN '{\"systemMessage\":' || "
    + js(_count_text + " || '. Stop hook already active, allowing stop.'")
    + f" || '}}' END AS response FROM ({_summary}) s"
)


def _stop_rows(dialect: str, more: str = "") -> str:
    finished = "status IN ('vulnerabilities_found', 'no_vulnerabilities')"
    root = [("workspace_root", f"CASE WHEN {finished} THEN {lit(chr(34) + PROJECT + chr(34))} END")] if dialect == "cursor" else []
    shown = "coalesce(nullif(error_text, ''), 'Unknown semgrep error')"
    metadata = js_object([
        ("event", lit('"stop_hook_executed"')), ("tool", lit(f'"{rules.PRODUCER}"')), *_IDS, ("status", js("status")),
        ("error", f"CASE status WHEN 'scan_failed' THEN {js(shown)} WHEN 'parse_error' THEN {lit(chr(34) + PARSE_ERROR + chr(34))} END"),
        ("semgrep_path", "CASE WHEN status = 'scan_failed' THEN '\"/usr/local/bin/scanner\"' END"),
        ("total_vulnerabilities", "CASE WHEN status = 'vulnerabilities_found' THEN CAST(len(results) AS VARCHAR) END"),
        ("files_scanned", f"CASE WHEN {finished} THEN CAST(n_edited AS VARCHAR) END"), *root,
    ])
    columns = _STOP_COLUMNS.format(
        dialect=lit(dialect), uid="'stop-' || session || '-' || seq", path="'.stop-hooks'", metadata=metadata)
    return f"SELECT {columns}{more} FROM ({_summary}) s"


CHECKS["stop_traces"] = " UNION ALL ".join(_stop_rows(d) for d in DIALECTS)

CHECKS["log_edited_set"] = f"SELECT CAST(session AS VARCHAR) AS session, epoch, path, first_seq FROM ({_set}) s"
CHECKS["log_stop_status"] = (
    f"SELECT CAST(session AS VARCHAR) AS session, epoch, status, n_edited, n_valid FROM ({CHECKS['stop_status']}) s"
)
CHECKS["log_traces"] = (
    "SELECT 'log-' || seq AS event_uid, CASE kind WHEN 'edit' THEN 'afterFileEdit' ELSE 'preCompact' END AS event_name, "
    "CASE kind WHEN 'edit' THEN path ELSE '.context-compactions' END AS path, 'openai/gpt-4' AS model_id, "
    "CASE kind WHEN 'edit' THEN '{}' ELSE '{\"event\":\"context_compaction\",\"trigger\":\"auto\",\"message_count\":7}' END "
    "AS metadata, CASE WHEN kind = 'edit' AND seq % 9 > 0 THEN (seq % 9) || '-' || (seq % 9 + 2) ELSE '1-1' END AS spans, "
    "strftime(TIMESTAMP '2024-03-01 00:00:00' + to_seconds(seq % 60), '%Y-%m-%d %H:%M:%S') AS received "
    f"FROM {_v('activity')} WHERE kind <> 'stop'"
)

CHECKS["plain_log_traces"] = f"SELECT event_name, path, model_id, metadata, spans FROM ({CHECKS['log_traces']}) p"
CHECKS["plain_log_edited_set"] = (
    "SELECT CAST(session AS VARCHAR) AS session, epoch, path, CAST(row_number() OVER (PARTITION BY session, epoch "
    f"ORDER BY first_seq) AS INT) AS position FROM ({_set}) s"
)
CHECKS["plain_log_stop_status"] = CHECKS["log_stop_status"]

# --- traces -----------------------------------------------------------------------------


def model_id(model: str) -> str:
    known = " ".join(
        f"WHEN starts_with({model}, '{p}') THEN '{provider}/' || {model}"
        for p, provider in rules.MODEL_PROVIDERS
    )
    return f"CASE WHEN {model} = '' THEN NULL WHEN contains({model}, '/') THEN {model} {known} ELSE {model} END"


def _has(name: str, column: str) -> str:
    return column if column in BRANCHES[name].columns else "NULL"


_TOOL_META = [("tool_name", js("tool_name")), ("tool_use_id", js("tool_use_id"))]
_DUR = ("duration_ms", js_num("duration"))
_EDIT_TOOL, _SHELL_TOOL, _READ_TOOL = (
    _in("tool_name", t) for t in (rules.WRITE_TOOLS, rules.COMMAND_TOOLS, rules.READ_TOOLS)
)
_POST_PATH = (
    f"CASE WHEN {_EDIT_TOOL} THEN coalesce({ji('file_path')}, '.unknown') WHEN {_SHELL_TOOL} THEN '.shell-history' "
    f"WHEN {_READ_TOOL} THEN coalesce({ji('file_path')}, '.file-reads') ELSE '.tool-usage' END"
)
_POST_COMMAND = ("command", f"CASE WHEN {_SHELL_TOOL} THEN {js(ji('command'))} END")
_KNOWN_TOOL = f"({_EDIT_TOOL} OR {_SHELL_TOOL} OR {_READ_TOOL})"


def _event(name: str) -> tuple[str, str]:
    return ("event", lit(f'"{name}"'))


_FOLLOWUP = "(" + " OR ".join(f"contains(lower(prompt), {lit(p)})" for p in rules.FOLLOWUP_PHRASES) + ")"
def _prompt_meta(attached: str) -> str:
    return js_object([
        _event("prompt_submission_attempt"), ("prompt_length", "CAST(length(prompt) AS VARCHAR)"),
        ("has_attachments", f"CASE WHEN {attached} THEN 'true' ELSE 'false' END"),
        ("attachment_count", f"CASE WHEN {attached} THEN '1' ELSE '0' END"),
        ("source", f"CASE WHEN {_FOLLOWUP} THEN {lit(chr(34) + rules.PRODUCER + chr(34))} END"),
        ("source_hook", f"CASE WHEN {_FOLLOWUP} THEN '\"stop\"' END"),
    ])


_ATTACHED = "attachment IS NOT NULL"
_CONV = [("conversation_id", js("conversation_id")), ("generation_id", js("generation_id"))]
_ATTEMPT = [
    _event("tool_use_attempt"), *_TOOL_META, ("tool_input", "tool_input"), ("cwd", js("cwd")),
]
_TEXT_LEN = ("text_length", "CAST(length(text) AS VARCHAR)")

# branch -> (path, contributor, linked, metadata)
_TRACES: dict[str, tuple[str, str, str]] = {
    "claude_pre_tool": ("'.tool-usage'", "'ai'", js_object(_ATTEMPT)),
    "claude_post_tool": (
        _POST_PATH, "'ai'",
        js_object([_event("tool_use_completed"), *_TOOL_META, _POST_COMMAND, _DUR])),
    "claude_output": (
        "'.tool-usage'", "'ai'", js_object([_event("tool_use_completed"), ("tool_name", js("tool_name"))])),
    "claude_prompt": (
        "'.prompts'", "'human'",
        js_object([_event("prompt_submission_attempt"), ("prompt_length", "CAST(length(user_prompt) AS VARCHAR)")])),
    "claude_paste": (
        "'.prompts'", "'human'",
        js_object([_event("prompt_submission_attempt"), ("prompt_length", "CAST(length(prompt) AS VARCHAR)")])),
    "claude_lifecycle": (
        "'.claude-session'", "'ai'",
        js_object([("event", js("event_name")), ("reason", js("reason")), ("trigger", js('"trigger"')),
                   ("notification", js("notification"))])),
    "cursor_pre_tool": (
        "'.tool-usage'", "'ai'", js_object([*_ATTEMPT, ("agent_message", js("agent_message"))])),
    "cursor_post_tool": (
        _POST_PATH, "'ai'",
        js_object([_event("tool_use_completed"), *_TOOL_META, _POST_COMMAND, _DUR,
                   ("cwd", f"CASE WHEN {_KNOWN_TOOL} THEN {js('cwd')} END")])),
    "cursor_failure": (
        "'.tool-failures'", "'ai'",
        js_object([_event("tool_use_failure"), *_TOOL_META, ("error_message", js("error_message")),
                   ("failure_type", js("failure_type")), _DUR,
                   ("is_interrupt", "CASE WHEN is_interrupt THEN 'true' ELSE 'false' END"), ("cwd", js("cwd"))])),
    "cursor_before_shell": (
        "'.shell-history'", "'ai'",
        js_object([_event("shell_execution_attempt"), ("command", js("command")), ("cwd", js("cwd")),
                   ("timeout", "CAST(timeout AS VARCHAR)")])),
    "cursor_mcp": (
        "'.mcp-executions'", "'ai'",
        js_object([_event("mcp_execution_attempt"), ("tool_name", js("tool_name")), ("tool_input", "tool_input"),
                   ("url", js("url")), ("command", js("command"))])),
    "cursor_prompt": ("'.prompts'", f"CASE WHEN {_FOLLOWUP} THEN 'ai' ELSE 'human' END", _prompt_meta(_ATTACHED)),
    "cursor_paste": ("'.prompts'", f"CASE WHEN {_FOLLOWUP} THEN 'ai' ELSE 'human' END", _prompt_meta("false")),
    "cursor_before_read": (
        "'.file-reads'", "'ai'",
        js_object([_event("file_read_attempt"), ("file_path", js("file_path")),
                   ("has_attachments", f"CASE WHEN {_ATTACHED} THEN 'true' ELSE 'false' END"),
                   ("attachments", "CASE WHEN attachment IS NULL THEN '[]' WHEN starts_with(attachment, '{') "
                                   f"THEN '[' || attachment || ']' ELSE '[' || {js('attachment')} || ']' END")])),
    "cursor_after_edit": ("file_path", "'ai'", js_object(_CONV)),
    "cursor_tab_edit": ("file_path", "'ai'", js_object(_CONV)),
    "cursor_after_shell": (
        "'.shell-history'", "'ai'", js_object([("command", js('"command"')), _DUR])),
    "cursor_after_mcp": (
        "'.mcp-executions'", "'ai'",
        js_object([_event("mcp_execution_completed"), ("tool_name", js("tool_name")), ("tool_input", "tool_input")])),
    "cursor_response": (
        "CASE event_name WHEN 'sessionStart' THEN '.sessions' WHEN 'afterAgentResponse' THEN '.agent-responses' "
        "ELSE '.agent-thoughts' END", "'ai'",
        "CASE event_name WHEN 'sessionStart' THEN " + js_object(
            [_event("session_start"), ("session_id", js("session_id")), ("composer_mode", js("composer_mode"))])
        + " WHEN 'afterAgentResponse' THEN " + js_object([_event("agent_response"), _TEXT_LEN])
        + " ELSE " + js_object([_event("agent_thought"), _TEXT_LEN, ("duration_ms", js_num("duration_ms"))]) + " END"),
    "cursor_session": (
        "CASE event_name WHEN 'sessionEnd' THEN '.sessions' WHEN 'preCompact' THEN '.context-compactions' ELSE '.subagents' END",
        "'ai'",
        "CASE event_name WHEN 'sessionEnd' THEN " + js_object(
            [_event("session_end"), ("session_id", js("session_id")), ("conversation_id", js("conversation_id")),
             ("reason", js("reason")), ("duration_ms", js_num("duration_ms"))])
        + " WHEN 'subagentStart' THEN " + js_object(
            [_event("subagent_start"), ("subagent_type", js("subagent_type")), ("prompt", js("prompt"))])
        + " WHEN 'subagentStop' THEN " + js_object(
            [_event("subagent_stop"), ("subagent_type", js("subagent_type")), ("status", js("status")), _DUR,
             ("agent_transcript_path", js("agent_transcript_path"))])
        + " ELSE " + js_object(
            [_event("context_compaction"), ("trigger", js('"trigger"')),
             ("context_usage_percent", js_num("context_usage_percent")), ("context_tokens", "CAST(context_tokens AS VARCHAR)"),
             ("context_window_size", "CAST(context_window_size AS VARCHAR)"), ("message_count", "CAST(message_count AS VARCHAR)"),
             ("messages_to_compact", "CAST(messages_to_compact AS VARCHAR)"),
             ("is_first_compaction", "CASE WHEN is_first_compaction THEN 'true' ELSE 'false' END")]) + " END"),
}


def _trace_select(name: str, columns: str) -> str:
    path, contributor, metadata = _TRACES[name]
    branch = BRANCHES[name]
    model = model_id("model") if "model" in branch.columns else "CAST(NULL AS VARCHAR)"
    url = (
        "CASE WHEN transcript_path <> '' THEN 'file://' || transcript_path END"
        if "transcript_path" in branch.columns else "CAST(NULL AS VARCHAR)"
    )
    return (
        f"SELECT {columns} FROM (SELECT event_uid, dialect, event_name, {path} AS path, {contributor} AS contributor_type, "
        f"{model} AS model_id, {url} AS url, {metadata} AS metadata FROM {_b(name)}) tr"
    )


CHECKS["traces_flat"] = " UNION ALL ".join(_trace_select(n, "*") for n in _TRACES)
CHECKS["contributor_attribution"] = " UNION ALL ".join(
    _trace_select(n, "event_uid, contributor_type, metadata")
    for n in ("cursor_prompt", "cursor_paste", "claude_prompt")
)


def _lines_in(text: str) -> str:
    return f"(length({text}) - length(replace({text}, chr(10), '')) + 1)"


def _ranges(source: str) -> str:
    """Ranges of one edit per row: ``event_uid, new_string, content`` rows."""
    return (
        "SELECT event_uid, 0 AS ordinal, CAST(CASE WHEN coalesce(new_string, '') = '' OR found_at = 0 THEN 1 "
        f"ELSE {_lines_in('left(content, found_at - 1)')} END AS INT) AS start_line, "
        "CAST(CASE WHEN coalesce(new_string, '') = '' THEN 1 WHEN found_at = 0 THEN "
        f"{_lines_in('new_string')} ELSE {_lines_in('left(content, found_at - 1)')} + {_lines_in('new_string')} - 1 END AS INT) "
        f"AS end_line, path FROM (SELECT *, coalesce(instr(content, new_string), 0) AS found_at FROM ({source}) r0) r1"
    )


_doc_edits = (
    "SELECT e.event_uid, e.file_path AS path, e.new_string, f.content FROM (SELECT * FROM "
    f"{_b('cursor_after_edit')}) e LEFT JOIN (SELECT * FROM {_v('files')}) f ON f.path = e.file_path UNION ALL "
    f"SELECT event_uid, file_path, new_string, NULL FROM {_b('cursor_tab_edit')}"
)


def _tool_edits(name: str) -> str:
    # One dialect gives no range to an edit without a path.
    placed = f" AND coalesce({ji('file_path')}, '') <> ''" if name.startswith("cursor") else ""
    return (
        f"SELECT e.event_uid, e.path, CASE WHEN {_EDIT_TOOL}{placed} THEN {ji('new_string')} END AS new_string, "
        f"CASE WHEN {_EDIT_TOOL} THEN f.content END AS content FROM (SELECT *, {ji('file_path')} AS path FROM "
        f"{_b(name)}) e LEFT JOIN (SELECT path AS p, content FROM {_v('files')}) f ON f.p = e.path"
    )


_tool_spans = " UNION ALL ".join(_tool_edits(n) for n in ("claude_post_tool", "cursor_post_tool"))
CHECKS["range_positions"] = (
    f"SELECT event_uid, ordinal, start_line, end_line FROM ({_ranges(_doc_edits + ' UNION ALL ' + _tool_spans)}) g"
)


def _records(source: str) -> str:
    """Records of the trace log from flat traces; every event here has one range."""
    bare = "CASE WHEN clean <> '/' AND ends_with(clean, '/') THEN clean[:-2] ELSE clean END"
    return (
        "SELECT '1.0' AS version, sha256(dialect || '|' || event_uid || '|0') AS id, CASE WHEN NOT starts_with(path, '/') "
        f"THEN path ELSE {_relative('full_path', ['work'])} END AS path, contributor_type, model_id, 1 AS n_ranges, "
        f"CASE dialect WHEN 'claude' THEN 'claude-code' ELSE {lit(rules.PRODUCER)} END AS tool, "
        f"CASE dialect WHEN 'claude' THEN CAST(NULL AS VARCHAR) ELSE {lit(rules.PRODUCER_VERSION)} END AS tool_version, "
        f"url, nullif(metadata, '{{}}') AS metadata FROM (SELECT *, {bare} AS full_path FROM "
        f"(SELECT *, {normalized('path')} AS clean FROM ({source}) t) a) b"
    )


_every_stop = " UNION ALL ".join(
    [_stop_rows(d, ", 1 AS n_ranges, ts") for d in DIALECTS] + [_vuln_rows(d, "n AS n_ranges, ts") for d in DIALECTS]
)
CHECKS["stop_records"] = (
    "SELECT '1.0' AS version, sha256(dialect || '|' || event_uid || '|0') AS id, "
    f"replace(path, {lit(PROJECT + '/')}, '') AS path, 'ai' AS contributor_type, model_id, CAST(n_ranges AS INT) AS n_ranges, "
    f"CASE dialect WHEN 'claude' THEN 'claude-code' ELSE {lit(rules.PRODUCER)} END AS tool, "
    f"CASE dialect WHEN 'claude' THEN CAST(NULL AS VARCHAR) ELSE {lit(rules.PRODUCER_VERSION)} END AS tool_version, "
    f"url, metadata, strftime(ts, '%Y-%m-%d %H:%M:%S') AS received FROM ({_every_stop}) e"
)
CHECKS["model_ids"] = f"SELECT event_id, {model_id('model')} AS model_id FROM {_v('tool_calls')}"
_bash = "dialect = 'cursor' AND coalesce(tool_name, '') = 'Bash'"
CHECKS["tool_info"] = " UNION ALL ".join(
    f"SELECT event_uid, CASE WHEN {_bash} THEN 'cursor' WHEN dialect = 'claude' THEN 'claude-code' "
    f"ELSE {lit(rules.PRODUCER)} END AS tool, CASE WHEN {_bash} THEN '1.7' WHEN dialect = 'claude' THEN CAST(NULL AS VARCHAR) "
    f"ELSE {lit(rules.PRODUCER_VERSION)} END AS version FROM (SELECT event_uid, dialect, {_has(n, 'tool_name')} AS tool_name "
    f"FROM {_b(n)}) ti_{n}"
    for n in BRANCHES
)


def _relative(full: str, root: list[str]) -> str:
    """Relative path of a normalised absolute path from fixed root segments."""
    chain, climb = f"'{'../' * len(root)}' || substr({full}, 2)", ""
    tests = []
    for depth in range(len(root), 0, -1):
        prefix = "/" + "/".join(root[:depth])
        up = len(root) - depth
        tests.append(
            f"WHEN {full} = {lit(prefix)} THEN {lit('/'.join(['..'] * up))} "
            f"WHEN starts_with({full}, {lit(prefix + '/')}) THEN {lit('../' * up)} || substr({full}, {len(prefix) + 2})"
        )
    return f"CASE {' '.join(tests)} ELSE {chain}{climb} END"


CHECKS["trace_records"] = _records(CHECKS["traces_flat"])
_no_slash = "CASE WHEN clean <> '/' AND ends_with(clean, '/') THEN clean[:-2] ELSE clean END"
CHECKS["relative_paths"] = (
    f"SELECT event_id, CASE WHEN NOT starts_with(file_path, '/') THEN file_path ELSE {_relative('full_path', ['work'])} END "
    "AS from_project, replace(doc_path, cwd || '/', '') AS from_cwd, "
    f"{_relative('doc_path', ['work', 'alt', 'x'])} AS climbing FROM (SELECT *, {_no_slash} AS full_path FROM "
    f"(SELECT *, {normalized('file_path')} AS clean FROM {_v('tool_calls')}) a) b"
)

# --- reports --------------------------------------------------------------------------

_calls = (
    "SELECT session_id AS session, event_id AS seq, tool_name, value, event_type, 't' || (event_id % 400) AS tool_use_id "
    f"FROM {_v('tool_calls')}"
)
_nth = "row_number() OVER (PARTITION BY session, tool_use_id ORDER BY seq) AS nth"
CHECKS["tool_pairs"] = (
    "SELECT a.session, a.seq, a.tool_use_id, a.tool_name, d.nth IS NOT NULL AS completed, d.value AS duration_ms FROM "
    f"(SELECT *, {_nth} FROM ({_calls}) c) a LEFT JOIN (SELECT *, {_nth} FROM ({_calls}) c WHERE event_type <> 'error') d "
    "ON d.session = a.session AND d.tool_use_id = a.tool_use_id AND d.nth = a.nth"
)
_failures = (
    "SELECT tool_name, CASE WHEN event_id % 3 = 0 THEN 'timeout' ELSE 'exit' END AS failure_type FROM "
    f"{_v('tool_calls')} WHERE event_type = 'error'"
)
CHECKS["failure_hotspots"] = (
    "SELECT tool_name, failure_type, count(*) AS failures, CAST(grouping(tool_name, failure_type) AS INT) AS level FROM "
    f"({_failures}) f GROUP BY ROLLUP (tool_name, failure_type)"
)
CHECKS["failure_top"] = (
    f"SELECT tool_name, failure_type, count(*) AS failures, 0 AS level FROM ({_failures}) f GROUP BY tool_name, failure_type "
    "ORDER BY failures DESC, tool_name, failure_type LIMIT 10"
)
_session_of = " UNION ALL ".join(
    f"SELECT event_uid, CAST(session AS BIGINT) AS session FROM {_b(n)}" for n in BRANCHES if "session" in BRANCHES[n].columns
)
CHECKS["contributor_share"] = (
    "SELECT session, path, "
    + ", ".join(f"count(CASE WHEN contributor_type = '{k}' THEN 1 END) AS {k}" for k in ("human", "ai", "mixed", "unknown"))
    + f" FROM ({CHECKS['traces_flat']}) t JOIN ({_session_of}) s USING (event_uid) GROUP BY session, path"
)
_painted = (
    "SELECT path, line, arg_max(session, seq) AS session FROM (SELECT path, session, seq, unnest(CASE WHEN seq % 9 > 0 "
    f"THEN range(seq % 9, seq % 9 + 3) ELSE [1] END) AS line FROM {_v('activity')} WHERE kind = 'edit') l GROUP BY path, line"
)
CHECKS["line_ownership"] = (
    "SELECT path, CAST(session AS VARCHAR) AS session, 'ai' AS contributor_type, count(*) AS lines, "
    f"count(*) / sum(count(*)) OVER (PARTITION BY path) AS share FROM ({_painted}) p GROUP BY path, session"
)
_shares = ", ".join(f"({x})" for x in ("0.0", "0.25", "0.5", "0.95", "1.0"))
CHECKS["duration_exact"] = (
    "SELECT tool_name, CAST(share AS DOUBLE) AS share, n, value FROM (SELECT tool_name, share, value, "
    "row_number() OVER (PARTITION BY tool_name, share ORDER BY value) AS place, count(*) OVER (PARTITION BY tool_name, share) AS n "
    f"FROM {_v('tool_calls')}, (VALUES {_shares}) s(share)) d WHERE place = greatest(ceil(CAST(share AS DOUBLE) * n), 1)"
)
_labelled = (
    f"SELECT strftime(ts, '%Y-%m-%d') AS day, doc_path AS path, '[shell command]' AS label, command AS text FROM {_v('tool_calls')} "
    f"UNION ALL SELECT strftime(ts, '%Y-%m-%d'), doc_path, '[tool params]', tool_input FROM {_v('tool_calls')}"
)
_hits_by_rule = " UNION ALL ".join(
    f"SELECT day, path, label, {lit(r[0])} AS rule_id, unnest(regexp_extract_all(text, {_secret_re(r)})) AS hit FROM ({_labelled}) h"
    for r in rules.SECRET_RULES
)
CHECKS["findings_over_days"] = (
    "SELECT day, rule_id, label, count(*) AS findings, count(DISTINCT hit) AS distinct_values, count(DISTINCT path) AS "
    f"distinct_files, CAST(grouping(day, rule_id, label) AS INT) AS level FROM ({_hits_by_rule}) f GROUP BY CUBE (day, rule_id, label)"
)
_answers = _decided(("claude_pre_tool", "cursor_before_shell", "openclaw_before_tool"), "event_name, response, exit_code")
CHECKS["written_decisions"] = (
    f"SELECT dialect, event_name, response, exit_code, count(*) AS events FROM ({_answers}) a GROUP BY ALL"
)
CHECKS["read_files"] = (
    "SELECT 'd' || (doc_id % 20) AS dir, CAST(sum(strlen(coalesce(content, '')) + 1) AS BIGINT) AS n_bytes, "
    f"CAST(sum(length(coalesce(content, '')) + 1) AS BIGINT) AS n_chars FROM {_v('files')} GROUP BY ALL"
)
CHECKS["edit_lines"] = CHECKS["range_positions"]
CHECKS["flow_edges"] = (
    "SELECT kind, next_kind, count(*) AS n FROM (SELECT kind, lead(kind) OVER (PARTITION BY session ORDER BY seq) "
    f"AS next_kind FROM {_v('activity')}) l WHERE next_kind IS NOT NULL GROUP BY kind, next_kind"
)
CHECKS["duration_percentiles"] = (
    "SELECT tool_name, count(*) AS calls, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, "
    f"max(value) AS longest FROM {_v('tool_calls')} GROUP BY tool_name"
)
_time = "strftime({}, '%Y-%m-%d %H:%M:%S')"
CHECKS["session_spans"] = (
    f"SELECT session, {_time.format('min(ts)')} AS first_ts, {_time.format('max(ts)')} AS last_ts, count(*) AS events, "
    "count(CASE WHEN kind = 'stop' THEN 1 END) AS stops, "
    f"{_time.format(chr(109) + 'in(CASE WHEN kind = ' + lit('start') + ' THEN ts END)')} AS first_start "
    f"FROM {_v('activity')} GROUP BY session"
)
CHECKS["findings_cube"] = (
    "SELECT rule_id, src, count(*) AS findings, CAST(grouping(rule_id, src) AS INT) AS level FROM "
    f"({CHECKS['secret_findings']}) f GROUP BY CUBE (rule_id, src)"
)
_tool_only = " UNION ALL ".join(
    f"SELECT event_uid, coalesce(path, '.unknown') AS path, new_string, content FROM ({_tool_edits(n)}) x "
    f"WHERE event_uid IN (SELECT event_uid FROM {_b(n)} WHERE {_EDIT_TOOL})"
    for n in ("claude_post_tool", "cursor_post_tool")
)
_spans = f"SELECT path, start_line, end_line FROM ({_ranges(_doc_edits + ' UNION ALL ' + _tool_only)}) g"
CHECKS["file_coverage"] = (
    "SELECT path, edits, lines_covered FROM (SELECT path, count(*) AS edits FROM "
    f"({_spans}) s GROUP BY path) e JOIN (SELECT path, count(*) AS lines_covered FROM (SELECT DISTINCT path, "
    f"unnest(range(start_line, end_line + 1)) AS line FROM ({_spans}) s) d GROUP BY path) c USING (path)"
)

# --- streams --------------------------------------------------------------------------

_stop_sets = (
    f"SELECT t.session, t.seq, s.first_seq, s.path FROM ({_epochs}) t JOIN ({_set}) s "
    "ON s.session = t.session AND s.epoch = t.epoch WHERE t.kind = 'stop'"
)
CHECKS["edited_stream"] = _stop_sets
CHECKS["edited_stream_keyed"] = _stop_sets
CHECKS["decision_stream"] = _decided(
    DECISIONS, "event_uid, event_name, action, context, message, response, exit_code, n_findings"
)
CHECKS["trace_roundtrip"] = CHECKS["trace_records"]
CHECKS["trace_stream"] = CHECKS["trace_records"]
CHECKS["stream_equals_batch"] = f"SELECT *, CAST(3 AS BIGINT) AS forms FROM ({_stop_sets}) e"
_timed = (
    "SELECT user_id AS session, 't' || event_id AS tool_use_id, ts, event_type, value, ts + to_minutes(CAST(event_id % 32 AS INT)) AS done "
    "FROM events"
)
_pair_mark = (
    f"(SELECT least(max(ts), max(CASE WHEN event_type <> 'error' THEN done END)) - INTERVAL {PAIR_LATE} FROM ({_timed}) m)"
)
CHECKS["tool_pairs_stream"] = (
    "SELECT session, tool_use_id, in_time AS completed, CASE WHEN in_time THEN value END AS duration_ms FROM (SELECT *, "
    f"event_type <> 'error' AND done <= ts + INTERVAL {PAIR_WITHIN} AS in_time FROM ({_timed}) c) d "
    f"WHERE in_time OR ts + INTERVAL {PAIR_WITHIN} < {_pair_mark}"
)
_stretches = (
    "SELECT *, sum(CASE WHEN before IS NULL OR ts > before + INTERVAL " + PAUSE + " THEN 1 ELSE 0 END) OVER "
    f"(PARTITION BY session ORDER BY ts) AS stretch FROM (SELECT *, lag(ts) OVER (PARTITION BY session ORDER BY ts) AS before FROM {_v('activity')}) l"
)
CHECKS["activity_spans_stream"] = (
    f"SELECT session, {_time.format('min(ts)')} AS first_ts, {_time.format('max(ts)')} AS last_ts, count(*) AS events, "
    f"count(CASE WHEN kind = 'stop' THEN 1 END) AS stops FROM ({_stretches}) s GROUP BY session, stretch "
    f"HAVING max(ts) + INTERVAL {PAUSE} < (SELECT max(ts) - INTERVAL {SPAN_LATE} FROM {_v('activity')})"
)
