"""One decision per event, in the shape its dialect expects.

A single pass adds what can be known from the row itself (policy verdict, secret
hits in its texts, paths to look up).  Only thin rows then meet the findings of
the files they read; the verdict is a ``CASE`` over both.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths, pii, policy, rules, secrets, shell
from ..functions.text import (
    has_text_sql, in_sql, json_field_sql, json_object_sql, json_value_sql, let, or_empty, quoted,
)
from ..sources.hook_events import with_event_columns
from .asof import versions_at
from .detect import scan_files
from .lineage import explode_paths, findings_of_reads, summed_findings
from .once import made_once


@dataclass(frozen=True)
class SecretCheck:
    """How one event type reports secrets."""

    dialect: str
    event: str
    heading: str
    context: str
    suffix: str = ""


# --- fixed values: headings, context codes and answers shown to the user -------
READ_HEADING = "SECRET DETECTED (file read blocked)"
COMMAND_HEADING = "SECRET DETECTED (command execution blocked)"
PROMPT_HEADING = "SECRET DETECTED (submission blocked)"
OUTPUT_HEADING = "SECRET DETECTED in recent output"
OUTPUT_SUFFIX = "\nBe careful with this sensitive data!"
# Checks whose message covers all findings of the event.
CHECKS = [
    SecretCheck("claude", "UserPromptSubmit", PROMPT_HEADING, "secret_detected_in_prompt"),
    SecretCheck("claude", "PostToolUse", OUTPUT_HEADING, "secret_detected_in_output"),
    SecretCheck("cursor", "beforeReadFile", READ_HEADING, "secret_detected_before_read"),
    SecretCheck("cursor", "beforeSubmitPrompt", PROMPT_HEADING, "secret_detected_in_prompt"),
    SecretCheck("cursor", "beforeShellExecution", READ_HEADING, "secret_detected_before_read"),
    SecretCheck(
        "cursor", "beforeMCPExecution", "SECRET DETECTED (MCP execution blocked)",
        "secret_detected_in_mcp_command",
    ),
    SecretCheck(
        "cursor", "afterFileEdit", "SECRET DETECTED in file edit", "secret_detected_after_edit"
    ),
    SecretCheck(
        "cursor", "afterShellExecution", OUTPUT_HEADING, "secret_detected_in_output", OUTPUT_SUFFIX
    ),
    SecretCheck(
        "cursor", "afterMCPExecution", OUTPUT_HEADING, "secret_detected_in_output", OUTPUT_SUFFIX
    ),
]

# --- end of fixed values --------------------------------------------------------

_TEXTS = "array<struct<label:string,text:string>>"


def _is(dialect: str, *events: str) -> str:
    return f"(dialect = '{dialect}' AND {in_sql('event_name', events)})"


_PLUGIN = _is("openclaw", "before_tool_call")
_PRE = _is("claude", "PreToolUse")
_SHELL_EVENT = _is("cursor", "beforeShellExecution")
_PLUGIN_SHELL = f"({_PLUGIN} AND {in_sql('tool_name', rules.OPENCLAW_COMMAND_TOOLS)})"
_CLAUDE_SHELL = f"({_PRE} AND {in_sql('tool_name', rules.SECRET_COMMAND_TOOLS)})"


def _input(name: str) -> str:
    return json_field_sql("tool_input", name)


def _case(branches: list[tuple[str, str]], default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in branches) + f" ELSE {default} END"


def _texts(*pairs: tuple[str, str]) -> str:
    rows = [
        f"CASE WHEN {has_text_sql(text)} THEN named_struct('label', {label}, 'text', {text}) END"
        for label, text in pairs
    ]
    return f"cast(array_compact(array({', '.join(rows)})) AS {_TEXTS})"


# Command of a tool call or of a shell or MCP event.
_COMMAND = "coalesce(" + _case(
    [
        (_is("cursor", "beforeShellExecution", "beforeMCPExecution"), "command"),
        (_PLUGIN, f"coalesce({_input('command')}, {_input('cmd')})"),
    ],
    _input("command"),
) + ", '')"

def _plugin_file(params: str) -> str:
    names = ("file_path", "path", "target_file")
    return f"coalesce({', '.join(f'nullif({json_field_sql(params, n)}, {quoted(str())})' for n in names)})"


def extract_file_path(params: Column) -> Column:
    """First non-empty of the three names a plugin tool may use."""
    return let(params, f"p -> {_plugin_file('p')}")


def _label(fallback: str) -> str:
    return f"coalesce(nullif(file_path, ''), '{fallback}')"


def scannable_texts() -> Column:
    """Labelled texts of an event that are searched for secrets."""
    command = ("'[shell command]'", "_command")
    response = "coalesce(tool_response, tool_result, tool_output)"
    edits = (
        f"cast(transform(filter(edits, e -> {has_text_sql('e.new_string')}), "
        f"e -> named_struct('label', {_label('[edit]')}, 'text', e.new_string)) AS {_TEXTS})"
    )
    bash = ("'[shell command]'", "CASE WHEN tool_name = 'Bash' THEN _command END")
    by_event = [
        (f"{_CLAUDE_SHELL} OR {_SHELL_EVENT} OR {_PLUGIN_SHELL}", _texts(command)),
        (_is("claude", "UserPromptSubmit"), _texts(("'[prompt]'", "coalesce(user_prompt, prompt)"))),
        (_is("claude", "PostToolUse"), _texts(("'[tool output]'", response), bash)),
        (_is("cursor", "beforeReadFile"), _texts((_label("[content]"), "content"))),
        (_is("cursor", "beforeSubmitPrompt"), _texts(("'[prompt]'", "prompt"))),
        (_is("cursor", "beforeMCPExecution"), _texts(("'[mcp command]'", "_command"))),
        (_is("cursor", "afterFileEdit"), edits),
        (_is("cursor", "afterShellExecution"),
         _texts(("'[shell stdout]'", "stdout"), ("'[shell stderr]'", "stderr"))),
        (_is("cursor", "afterMCPExecution"),
         _texts(("'[mcp stdout]'", "stdout"), ("'[mcp stderr]'", "stderr"),
                ("'[mcp output]'", "text"), ("'[mcp output]'", "message"))),
    ]
    return F.expr(_case(by_event))


def _lookup_paths(home: Column, default_dir: Column) -> Column:
    """Resolved paths whose file contents bear on the decision.

    One token walk serves all dialects: only the base directory differs.
    """
    own_dir = F.expr(f"CASE WHEN {has_text_sql('cwd')} THEN cwd END")
    params_dir = F.expr(f"CASE WHEN {has_text_sql(_input('cwd'))} THEN {_input('cwd')} END")
    first_root = F.expr("nullif(try_element_at(workspace_roots, 1), '')")
    base = F.coalesce(
        F.when(F.expr(_PLUGIN_SHELL), params_dir),
        F.when(F.expr(f"{_SHELL_EVENT} OR {_PRE}"), own_dir),
        F.when(F.expr(f"{_SHELL_EVENT} OR {_is('cursor', 'beforeReadFile')}"), first_root),
        default_dir,
    )
    file_path = "nullif(file_path, '')"
    target = _case(
        [
            (f"{_PRE} AND {in_sql('tool_name', rules.SECRET_READ_TOOLS)}",
             f"nullif(coalesce({_input('file_path')}, {_input('target_file')}), '')"),
            (f"{_is('cursor', 'beforeReadFile')} AND NOT {has_text_sql('content')}", file_path),
            (_is("cursor", "afterFileEdit"), file_path),
            (f"{_PLUGIN} AND {in_sql('tool_name', rules.OPENCLAW_READ_TOOLS)}", _plugin_file("tool_input")),
        ]
    )
    runs_shell = F.expr(f"{_CLAUDE_SHELL} OR {_SHELL_EVENT} OR {_PLUGIN_SHELL}")
    one = F.expr(f"array_compact(array({target}))")
    candidates = F.when(runs_shell, shell.read_candidates(F.col("_command"))).otherwise(one)
    return paths.resolve_candidates(candidates, base, home)


def _policy() -> Column:
    """Every judged event is a tool call; shell events count as a command tool."""
    runs_shell = f"({_PLUGIN_SHELL} OR {_SHELL_EVENT})"
    tool = F.expr(f"if({runs_shell}, '{rules.COMMAND_TOOLS[0]}', tool_name)")
    judged = F.expr(f"{runs_shell} OR {_PLUGIN} OR {_PRE} OR {_is('cursor', 'preToolUse')}")
    # Only shell tools and events may name their command otherwise.
    command = F.expr(f"if({runs_shell}, _command, coalesce({_input('command')}, ''))")
    return F.when(judged, policy.validate_tool_input(tool, F.col("tool_input"), command))


def _prepare(events: DataFrame) -> DataFrame:
    ready = with_event_columns(events)
    if "event_name" not in ready.columns:
        ready = ready.withColumn("event_name", F.coalesce("hook_event_name", F.lit("")))
    ready = ready.withColumn("tool_input", F.coalesce("tool_input", F.lit("{}")))
    return ready.withColumn("tool_name", or_empty(F.col("tool_name"))).withColumn(
        "_command", F.expr(_COMMAND)
    )


_EMPTY = "cast(array() AS array<string>)"
_COUNT = "coalesce(aggregate({}, 0, (a, h) -> a + h.n), 0)"


def _with_text_signals(events: DataFrame, more: dict[str, Column] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Thin rows: verdict parts that need nothing but the event itself, columns that are kept and more that are made."""
    hits = secrets.hits_sql("t.text")
    found = f"filter(transform(_texts, t -> named_struct('label', t.label, 'hits', {hits})), f -> size(f.hits) > 0)"
    more = more or {}
    scanned = made_once(
        events.withColumn("_texts", scannable_texts()), ["event_uid", "dialect", "event_name", "tool_name", *keep],
        {
            "_found": F.expr(found),
            "_policy": _policy(),
            "_pii_command": F.when(F.expr(_PLUGIN_SHELL), pii.contains_pii(F.col("_command"))),
            "_param_hits": F.when(F.expr(_PLUGIN), secrets.rule_hits(F.col("tool_input"))),
            "_pii_params": F.when(F.expr(_PLUGIN), pii.contains_pii(F.col("tool_input"))),
            **more,
        },
    )
    lines = secrets.lines_sql("f.hits", "f.label")
    return scanned.selectExpr(
        "event_uid", "dialect", "event_name", "tool_name",
        "_policy.severity AS severity",
        "_policy.reason AS policy_reason",
        f"coalesce(aggregate(_found, 0, (a, f) -> a + {_COUNT.format('f.hits')}), 0) AS text_n",
        f"coalesce(flatten(transform(_found, f -> {lines})), {_EMPTY}) AS text_lines",
        f"{_COUNT.format('_param_hits')} AS param_n",
        "coalesce(_pii_command, false) AS pii_command",
        "coalesce(_pii_params, false) AS pii_params",
        *keep, *more,
    )


def _looks_up() -> Column:
    """Events whose verdict may depend on files; the paths of no others are looked up."""
    reads = [
        _CLAUDE_SHELL, _SHELL_EVENT, _PLUGIN_SHELL,
        f"{_PRE} AND {in_sql('tool_name', rules.SECRET_READ_TOOLS)}",
        _is("cursor", "beforeReadFile", "afterFileEdit"),
        f"{_PLUGIN} AND {in_sql('tool_name', rules.OPENCLAW_READ_TOOLS)}",
    ]
    return F.coalesce(F.expr(" OR ".join(f"({test})" for test in reads)), F.lit(False))


_NEVER = "9999-01-01"


def _without_files(own: DataFrame) -> DataFrame:
    return own.withColumn("file_n", F.lit(0)).withColumn(
        "file_lines", F.array().cast("array<string>")
    )


def _with_files(own: DataFrame, reads: DataFrame, file_hits: DataFrame) -> DataFrame:
    """Thin rows with the findings of the files they read; ``reads`` has ``event_uid, path``, with versions ``at`` too."""
    if "valid_from" in file_hits.columns:
        held = versions_at(reads, file_hits).where("n_findings > 0")
        summary = summed_findings(held.select("event_uid", "path", "n_findings", "lines"), "event_uid")
    else:
        summary = findings_of_reads(reads, file_hits, "event_uid")
    return own.join(summary, "event_uid", "left").withColumns(
        {
            "file_n": F.coalesce("file_n", F.lit(0)),
            "file_lines": F.coalesce("file_lines", F.array().cast("array<string>")),
        }
    )


def _at() -> Column:
    # An event without a time is judged by the newest version.
    return F.coalesce("received_at", F.lit(_NEVER).cast("timestamp")).alias("at")


def signals(
    events: DataFrame, files: DataFrame | None, home: Column | None = None,
    default_dir: Column | None = None, file_hits: DataFrame | None = None,
) -> DataFrame:
    """Everything a verdict needs, one thin row per event."""
    home = F.lit("/root") if home is None else home
    default_dir = F.lit("/") if default_dir is None else default_dir
    ready = _prepare(events)
    if files is not None and file_hits is None:
        file_hits = scan_files(files)
    if file_hits is None:
        return _without_files(_with_text_signals(ready))
    # Only events with a path to look up meet the files, and only those whose files hold findings are left to join.
    looking, keys = ready.where(_looks_up()), ["event_uid"]
    if "valid_from" in file_hits.columns:
        looking, keys = looking.withColumn("at", _at()), ["event_uid", "at"]
    reads = explode_paths(looking, keys, _lookup_paths(home, default_dir)).drop("ordinal")
    return _with_files(_with_text_signals(ready), reads, file_hits)


def thin_events(events: DataFrame, home: Column | None = None, default_dir: Column | None = None) -> DataFrame:
    """What ``decide_thin`` takes, made of the events alone in one narrow pass; their texts are gone.

    ``_paths`` are the files to look up, ``received_at`` the time that versions are judged by.
    """
    home = F.lit("/root") if home is None else home
    default_dir = F.lit("/") if default_dir is None else default_dir
    wanted = F.when(_looks_up(), F.array_distinct(_lookup_paths(home, default_dir)))
    ready = _prepare(events)
    if "received_at" not in ready.columns:
        ready = ready.withColumn("received_at", F.lit(None).cast("timestamp"))
    return _with_text_signals(ready, {"_paths": wanted}, ("received_at",))


def decide_thin(thin: DataFrame, file_hits: DataFrame | None) -> DataFrame:
    """Decisions for events that ``thin_events`` has prepared; the rows are read twice."""
    own = thin.drop("_paths", "received_at")
    if file_hits is None:
        return _decided(_without_files(own))
    keys = ["event_uid", _at()] if "valid_from" in file_hits.columns else ["event_uid"]
    reads = thin.where("size(_paths) > 0").select(*keys, F.explode("_paths").alias("path")).where("path is not null")
    return _decided(_with_files(own, reads, file_hits))


def _outcome(action: str, context: str | None, message: str, n: str) -> str:
    named = "NULL" if context is None else f"'{context}'"
    return (
        f"named_struct('action', '{action}', 'context', cast({named} AS string), "
        f"'message', cast({message} AS string), 'n_findings', cast({n} AS int))"
    )


def _message(heading: str, lines: str, suffix: str = "") -> str:
    shown = f"concat_ws('\\n', '{heading}', array_sort(array_distinct({lines})))"
    return f"concat({shown}, {quoted(suffix)})" if suffix else shown


def _verdict() -> Column:
    """First match wins, in the order of each dialect."""
    blocked, warned = "severity = 'block'", "severity = 'warn'"
    own, files = _message(COMMAND_HEADING, "text_lines"), _message(READ_HEADING, "file_lines")
    chain = [
        (f"{_PRE} AND {blocked}", _outcome("block", None, "policy_reason", "0")),
        (f"{_PRE} AND text_n > 0", _outcome("block", "secret_detected_in_command", own, "text_n")),
        (f"{_PRE} AND file_n > 0", _outcome("block", "secret_detected_before_read", files, "file_n")),
    ]
    plugin_order = [
        (blocked, None, "coalesce(nullif(policy_reason, ''), 'Blocked by policy.')", "0"),
        ("text_n > 0", "secret_detected_in_command", "'Secret detected in command'", "text_n"),
        ("pii_command", None, "'PII detected in command'", "0"),
        ("file_n > 0", "secret_detected_before_read", "'Secret detected in file read'", "file_n"),
        ("param_n > 0", "secret_detected_in_params", "'Secret detected in tool parameters'", "param_n"),
        ("pii_params", None, "'PII detected in tool parameters'", "0"),
    ]
    chain += [
        (f"{_PLUGIN} AND {test}", _outcome("block", context, message, n))
        for test, context, message, n in plugin_order
    ]
    chain += [
        (
            f"{_is(check.dialect, check.event)} AND text_n + file_n > 0",
            _outcome(
                "block", check.context,
                _message(check.heading, "concat(text_lines, file_lines)", check.suffix),
                "text_n + file_n",
            ),
        )
        for check in CHECKS
    ]
    labelled = f"if({_is('cursor', 'preToolUse')}, concat(tool_name, ' - ', policy_reason), policy_reason)"
    # The plugin dialect and hooks without an answer stay silent.
    chain += [
        (f"dialect = 'openclaw' OR (dialect = 'claude' AND NOT {_PRE})", _outcome("none", None, "NULL", "0")),
        (blocked, _outcome("block", None, labelled, "0")),
        (warned, _outcome("warn", None, labelled, "0")),
    ]
    # Most events have nothing to report: they pass the chain at its head.
    silent = f"dialect = 'openclaw' OR (dialect = 'claude' AND NOT {_PRE})"
    passed = f"if({silent}, {_outcome('none', None, 'NULL', '0')}, {_outcome('allow', None, 'NULL', '0')})"
    quiet = (
        f"coalesce(NOT ({blocked} OR {warned}), true) AND text_n = 0 AND file_n = 0 AND param_n = 0 "
        "AND NOT pii_command AND NOT pii_params"
    )
    return F.expr(_case([(quiet, passed), *chain], _outcome("allow", None, "NULL", "0")))


# Policy verdicts are announced; findings messages are shown as they are.
_SHOWN = _case(
    [
        ("context IS NULL AND action = 'block'", "concat('BLOCKED: ', message)"),
        ("action = 'warn'", "concat('WARNING: ', message)"),
    ],
    "message",
)


def _pre_tool_response() -> str:
    inner = json_object_sql(
        [
            ("hookEventName", quoted('"PreToolUse"')),
            ("permissionDecision", _PERMISSION),
            ("permissionDecisionReason", json_value_sql("message")),
        ]
    )
    return json_object_sql([("hookSpecificOutput", inner), ("systemMessage", json_value_sql("shown"))])


_DENY, _ALLOW = quoted('"deny"'), quoted('"allow"')
_PERMISSION = f"if(action = 'block', {_DENY}, {_ALLOW})"


def _block_response() -> str:
    reason = json_value_sql("message")
    inner = json_object_sql(
        [("hookEventName", json_value_sql("event_name")), ("additionalContext", reason)]
    )
    return json_object_sql(
        [("decision", quoted('"block"')), ("reason", reason), ("hookSpecificOutput", inner)]
    )


def _cursor_response() -> str:
    """Answer by event family; a warning allows."""
    user_message = ("userMessage", json_value_sql("shown"))
    return _case(
        [
            ("event_name = 'beforeSubmitPrompt'",
             json_object_sql([("continue", "if(action = 'block', 'false', 'true')"), user_message])),
            (in_sql("event_name", ("afterFileEdit", "afterShellExecution", "afterMCPExecution")),
             json_object_sql([("message", json_value_sql("message"))])),
            ("event_name = 'preToolUse'",
             json_object_sql([("decision", _PERMISSION), user_message])),
        ],
        json_object_sql([("permission", _PERMISSION), user_message]),
    )


def _response() -> Column:
    plugin = json_object_sql([("block", "'true'"), ("blockReason", json_value_sql("message"))])
    return F.expr(
        _case(
            [
                (_PRE, _pre_tool_response()),
                ("dialect = 'claude' AND action = 'block'", _block_response()),
                ("dialect = 'cursor'", _cursor_response()),
                ("dialect = 'openclaw' AND action = 'block'", plugin),
            ]
        )
    )


def decide(
    events: DataFrame, files: DataFrame | None, home: Column | None = None,
    default_dir: Column | None = None, file_hits: DataFrame | None = None,
) -> DataFrame:
    """Decisions for events of all dialects.  Stop events are in ``stopscan``.

    ``file_hits`` is a stored result of ``scan_files``; with it the contents in
    ``files`` are not read again.  With the versions of ``scan_versions`` every
    event is judged by what its files held at its own time.
    """
    return _decided(signals(events, files, home, default_dir, file_hits))


def _decided(judged: DataFrame) -> DataFrame:
    flat = made_once(judged, ["event_uid", "dialect", "event_name"], {"_verdict": _verdict()}).select(
        "event_uid", "dialect", "event_name", "_verdict.*"
    )
    answered = flat.withColumn("shown", F.expr(_SHOWN)).withColumn("response", _response())
    exit_code = F.expr("if(dialect = 'cursor' AND action = 'block', 2, 0)")
    return answered.withColumn("exit_code", exit_code).select(
        "event_uid", "dialect", "event_name", "action", "context", "message", "response",
        "exit_code", "n_findings",
    )


PLUGIN_LABEL = rules.PRODUCER + "-openclaw"


def secret_detections(decisions: DataFrame) -> DataFrame:
    """Audit rows of decisions made because of secrets."""
    label = F.when(F.col("dialect") == "openclaw", F.lit(PLUGIN_LABEL))
    return decisions.where(F.col("context").isNotNull()).select(
        "event_uid", "event_name", "context", label.alias("tool_label"), "n_findings"
    )
