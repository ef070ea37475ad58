"""Audit traces: one record per event, built in one pass over the log.

Only edits need a join, for the content their line ranges refer to; all other
events are a narrow projection and never cross a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import audit, paths, rules
from ..functions.policy import json_field
from ..functions.text import (
    in_sql, json_field_sql, json_number_sql, json_object_sql, json_value_sql, or_empty, quoted,
)
from ..plans.session import stored
from ..sources.hook_events import EVENT_FIELDS, with_event_columns
from .locate import LineIndex, first_lines
from .stopscan import error_text

SENTINEL_UNKNOWN = ".unknown"


@dataclass(frozen=True)
class Handler:
    """What one kind of event leaves in the trace; all expressions are SQL."""

    dialect: str
    events: tuple[str, ...]
    path: str
    metadata: list[tuple[str, str]]
    when: str = "true"
    contributor: str = "'ai'"
    linked: bool = True  # carries the transcript url
    edit: bool = False
    whole_edits: bool = False  # the edit list comes with the event

    def applies(self) -> str:
        return f"dialect = '{self.dialect}' AND {in_sql('event_name', self.events)} AND {self.when}"


def _const(value: str) -> str:
    return quoted(f'"{value}"')


def _flag(test: str) -> str:
    return f"if({test}, 'true', 'false')"


def _json_list(name: str) -> str:
    """A list of JSON texts as one JSON list; strings that are not JSON are quoted."""
    item = f"CASE WHEN v RLIKE '^[{{\\\\[]' THEN v ELSE {json_value_sql('v')} END"
    return (
        f"concat('[', concat_ws(',', transform(coalesce({name}, cast(array() AS array<string>)), "
        f"v -> {item})), ']')"
    )


_IS_EDIT, _IS_SHELL, _IS_READ = (
    in_sql("tool_name", names) for names in (rules.WRITE_TOOLS, rules.COMMAND_TOOLS, rules.READ_TOOLS)
)
_IS_OTHER = f"NOT ({_IS_EDIT} OR {_IS_SHELL} OR {_IS_READ})"
_INPUT_PATH = json_field_sql("tool_input", "file_path")


#: Whether a prompt quotes the scan's own message, a column of ``_prepared``: long prompts are lowered once.
_FOLLOWUP = "_followup"


def handlers() -> list[Handler]:
    """Trace content per event, as data: (key, JSON text) in output order."""

    def event(name: str) -> tuple[str, str]:
        return ("event", _const(name))

    def text(*names: str) -> list[tuple[str, str]]:
        return [(name, json_value_sql(name)) for name in names]

    def number(*names: str) -> list[tuple[str, str]]:
        return [(name, json_number_sql(name)) for name in names]

    def flag(name: str) -> tuple[str, str]:
        return (name, f"cast({name} AS string)")

    def length(key: str, value: str) -> tuple[str, str]:
        units = f"cast(octet_length(encode({value}, 'UTF-16BE')) / 2 AS int)"
        return (key, f"cast({units} AS string)")

    followup = _FOLLOWUP
    attached = "greatest(coalesce(size(attachments), 0), 0)"
    has_path = "coalesce(file_path, '') <> ''"
    tool_ids = text("tool_name", "tool_use_id")
    tool_input = ("tool_input", "tool_input")
    duration = ("duration_ms", json_number_sql("duration"))
    conversation = text("conversation_id", "generation_id")
    attempt = [event("tool_use_attempt"), *tool_ids, tool_input, *text("cwd")]
    done = [event("tool_use_completed"), *tool_ids]
    shell = [("command", json_value_sql(json_field_sql("tool_input", "command"))), duration]
    edit_path = f"coalesce({_INPUT_PATH}, '{SENTINEL_UNKNOWN}')"
    read_path = f"coalesce({_INPUT_PATH}, '.file-reads')"
    post = ("postToolUse", "PostToolUse")
    lifecycle = ("SessionStart", "SessionEnd", "PreCompact", "SubagentStop", "Notification")
    return [
        # claude
        Handler("claude", ("PreToolUse",), "'.tool-usage'", attempt),
        Handler("claude", ("PostToolUse",), edit_path, [*done, duration], when=_IS_EDIT, edit=True),
        Handler("claude", ("PostToolUse",), "'.shell-history'", [*done, *shell], when=_IS_SHELL),
        Handler("claude", ("PostToolUse",), read_path, [*done, duration], when=_IS_READ),
        Handler("claude", ("PostToolUse",), "'.tool-usage'", [*done, duration], when=_IS_OTHER),
        Handler("claude", ("UserPromptSubmit",), "'.prompts'",
                [event("prompt_submission_attempt"),
                 length("prompt_length", "coalesce(user_prompt, prompt, '')")],
                contributor="'human'"),
        Handler("claude", lifecycle, "'.claude-session'",
                [("event", json_value_sql("event_name")), *text("reason", "trigger", "notification")]),
        # cursor
        Handler("cursor", ("afterFileEdit",), "file_path", conversation, when=has_path, edit=True,
                whole_edits=True),
        Handler("cursor", ("afterTabFileEdit",), "file_path", conversation, when=has_path,
                linked=False, whole_edits=True),
        Handler("cursor", ("afterShellExecution",), "'.shell-history'",
                [*conversation, *text("command"), duration]),
        Handler("cursor", ("sessionStart", "SessionStart"), "'.sessions'",
                [event("session_start"), *text("session_id", "conversation_id"),
                 flag("is_background_agent"), *text("composer_mode", "source")], linked=False),
        Handler("cursor", ("sessionEnd", "SessionEnd"), "'.sessions'",
                [event("session_end"), *text("session_id", "conversation_id", "reason"),
                 *number("duration_ms")], linked=False),
        Handler("cursor", ("preToolUse",), "'.tool-usage'", [*attempt, *text("agent_message")]),
        Handler("cursor", post, edit_path, [*done, duration, *text("cwd")], when=_IS_EDIT, edit=True),
        Handler("cursor", post, "'.shell-history'", [*done, *shell, *text("cwd")], when=_IS_SHELL),
        Handler("cursor", post, read_path, [*done, duration, *text("cwd")], when=_IS_READ),
        Handler("cursor", post, "'.tool-usage'", [*done, duration], when=_IS_OTHER),
        Handler("cursor", ("postToolUseFailure",), "'.tool-failures'",
                [event("tool_use_failure"), *tool_ids, *text("error_message", "failure_type"),
                 duration, flag("is_interrupt"), *text("cwd")]),
        Handler("cursor", ("subagentStart",), "'.subagents'",
                [event("subagent_start"), *text("subagent_type", "prompt")], linked=False),
        Handler("cursor", ("subagentStop",), "'.subagents'",
                [event("subagent_stop"), *text("subagent_type", "status"), duration,
                 *text("agent_transcript_path")], linked=False),
        Handler("cursor", ("beforeShellExecution",), "'.shell-history'",
                [event("shell_execution_attempt"), *text("command", "cwd"), *number("timeout")]),
        Handler("cursor", ("beforeMCPExecution",), "'.mcp-executions'",
                [event("mcp_execution_attempt"), *text("tool_name"), tool_input,
                 *text("url", "command")]),
        Handler("cursor", ("afterMCPExecution",), "'.mcp-executions'",
                [event("mcp_execution_completed"), *text("tool_name"), tool_input, duration]),
        Handler("cursor", ("beforeReadFile",), "'.file-reads'",
                [event("file_read_attempt"), *text("file_path"),
                 ("has_attachments", _flag(f"{attached} > 0")),
                 ("attachments", _json_list("attachments"))], when=has_path),
        Handler("cursor", ("beforeSubmitPrompt",), "'.prompts'",
                [event("prompt_submission_attempt"),
                 length("prompt_length", "coalesce(prompt, '')"),
                 ("has_attachments", _flag(f"{attached} > 0")),
                 ("attachment_count", f"cast({attached} AS string)"),
                 ("source", f"CASE WHEN {followup} THEN {_const(rules.PRODUCER)} END"),
                 ("source_hook", f"CASE WHEN {followup} THEN {_const('stop')} END")],
                contributor=f"if({followup}, 'ai', 'human')"),
        Handler("cursor", ("afterAgentResponse",), "'.agent-responses'",
                [event("agent_response"), length("text_length", "coalesce(text, '')")]),
        Handler("cursor", ("afterAgentThought",), "'.agent-thoughts'",
                [event("agent_thought"), length("text_length", "coalesce(text, '')"),
                 *number("duration_ms")]),
        Handler("cursor", ("preCompact",), "'.context-compactions'",
                [event("context_compaction"), *text("trigger"),
                 *number("context_usage_percent", "context_tokens", "context_window_size",
                         "message_count", "messages_to_compact"), flag("is_first_compaction")]),
    ]


def _any(table: list[Handler]) -> str:
    return "(" + " OR ".join(f"({h.applies()})" for h in table) + ")"


def _pick(table: list[Handler], value: Callable[[Handler], str]) -> Column:
    """The value of the handler that applies; equal neighbours share a branch."""
    branches: list[tuple[str, list[str]]] = []
    for handler in table:
        made = value(handler)
        if branches and branches[-1][0] == made:
            branches[-1][1].append(handler.applies())
        else:
            branches.append((made, [handler.applies()]))
    whens = " ".join(
        f"WHEN {' OR '.join(f'({t})' for t in tests)} THEN {made}" for made, tests in branches
    )
    return F.expr(f"CASE {whens} END")


_EDIT_TYPE = EVENT_FIELDS["edits"].dataType.simpleString()
_ONE_EDIT = (
    "array(named_struct('old_string', coalesce(get_json_object(tool_input, '$.old_string'), ''), "
    "'new_string', get_json_object(tool_input, '$.new_string'), 'range', NULL))"
)


def _edits(table: list[Handler]) -> Column:
    """Edits of the event as one array: its own list, or the tool's one edit."""
    whole = _any([h for h in table if h.whole_edits])
    # One dialect gives no range to an edit without a path.
    placed = f"(dialect <> 'cursor' OR coalesce({_INPUT_PATH}, '') <> '')"
    return F.expr(
        f"CASE WHEN {whole} THEN edits WHEN coalesce(get_json_object(tool_input, '$.new_string'), '') <> '' "
        f"AND {placed} THEN cast({_ONE_EDIT} AS {_EDIT_TYPE}) END"
    )


def _prepared(events: DataFrame) -> DataFrame:
    ready = with_event_columns(events)
    if "event_name" not in ready.columns:
        ready = ready.withColumn("event_name", F.coalesce("hook_event_name", F.lit("")))
    return ready.withColumn("tool_input", F.coalesce("tool_input", F.lit("{}"))).withColumns(
        {"tool_name": or_empty(F.col("tool_name")), _FOLLOWUP: audit.is_security_followup(or_empty(F.col("prompt")))}
    )


def _located_ranges(edit_rows: DataFrame, index: LineIndex) -> DataFrame:
    """``event_uid, _ranges`` of events with replacements, the lines found in an index."""
    kept = F.filter("_to_place.edits", lambda e: F.coalesce(e["new_string"], F.lit("")) != "")
    parts = edit_rows.select("event_uid", "path", F.posexplode(kept).alias("at", "edit"))
    parts = parts.withColumn("text", F.when(~audit.has_range(F.col("edit")), F.col("edit.new_string")))
    found = first_lines(parts.where("text is not null"), index)
    line = F.coalesce("line", F.lit(1))
    given = F.col("edit.range")
    span = F.when(
        F.col("text").isNull(),
        F.struct(given["start_line_number"].alias("start_line"), given["end_line_number"].alias("end_line")),
    ).otherwise(F.struct(line.alias("start_line"), (line + audit.line_count(F.col("text")) - 1).alias("end_line")))
    placed = parts.join(found, ["path", "text"], "left").select("event_uid", "at", span.alias("span"))
    # An event's edits, as many as its own list holds.
    whole = placed.groupBy("event_uid").agg(F.array_sort(F.collect_set(F.struct("at", "span"))).alias("parts"))
    return whole.select("event_uid", F.transform("parts", lambda p: p["span"]).cast(audit.RANGES).alias("_ranges"))


def _shaped(rows: DataFrame, chosen: list[Handler], ranges: Column, *more: Column) -> DataFrame:
    placed = [c for c in ("session", "seq") if c in rows.columns]
    linked = _any([h for h in chosen if h.linked])
    return rows.where(_any(chosen)).select(
        "event_uid", "dialect", "event_name", "received_at", "tool_version", *placed,
        _pick(chosen, lambda h: h.path).alias("path"),
        _pick(chosen, lambda h: h.contributor).alias("contributor_type"),
        audit.normalize_model_id(F.col("model")).alias("model_id"),
        ranges.alias("ranges"),
        F.expr(
            f"CASE WHEN {linked} AND coalesce(transcript_path, '') <> '' "
            "THEN concat('file://', transcript_path) END"
        ).alias("url"),
        _pick(chosen, lambda h: json_object_sql(h.metadata)).alias("metadata"),
        "tool_name", "tool_use_id", "status",
        F.coalesce("duration", "duration_ms").alias("duration_ms"), *more,
    )


def _given_ranges(table: list[Handler]) -> Column:
    """Ranges as far as the event itself tells them."""
    return audit.range_positions(_edits(table), F.lit(None).cast("string"))


def _plain_ranges(table: list[Handler]) -> Column:
    whole = F.expr(_any([h for h in table if h.whole_edits and not h.edit]))
    return audit.ranges_or_default(F.when(whole, _given_ranges(table)))


def unplaced_rows(events: DataFrame) -> DataFrame:
    """Flat traces from the events alone, in one narrow pass: what ``placed_rows`` takes.

    ``_to_place`` holds the edits of an event whose lines are still to be found, and ``_placed`` is false then; texts
    that a trace does not show are gone.
    """
    table = handlers()
    is_edit = F.expr(_any([h for h in table if h.edit]))
    ranges = F.when(is_edit, F.lit(None)).otherwise(_plain_ranges(table))
    to_place = F.when(is_edit, F.struct(_edits(table).alias("edits")))
    # Readers skip what a flag rules out; a list they must read.
    placed = ~F.coalesce(is_edit, F.lit(False))
    return _shaped(_prepared(events), table, ranges, to_place.alias("_to_place"), placed.alias("_placed"))


def placed_rows(rows: DataFrame, index: LineIndex | None = None) -> DataFrame:
    """Flat traces with the ranges of all edits; without an index those that bring none stand at the top."""
    edit_rows, rest = rows.where("NOT _placed"), rows.where("_placed").drop("_to_place", "_placed")
    if index is None:
        ranges = audit.range_positions(F.col("_to_place.edits"), F.lit(None).cast("string"))
    else:
        # Written aside: the events behind them are made once.
        edit_rows = stored(edit_rows, "edits-to-place")
        edit_rows = edit_rows.join(_located_ranges(edit_rows, index), "event_uid", "left")
        ranges = F.col("_ranges")
    edit_rows = edit_rows.withColumn("ranges", audit.ranges_or_default(ranges))
    return rest.unionByName(edit_rows.select(rest.columns))


def trace_rows(events: DataFrame, files: DataFrame | None = None, index: LineIndex | None = None) -> DataFrame:
    """Flat traces: one row per traced event, ranges as an array.

    Edit events look up the content of their file.  The join is on the path
    without salt copies, as contents are wide; AQE splits a hot path on the
    event side.  With an ``index`` of the files no contents are joined: edits
    meet the lines that may hold them.
    """
    if index is not None:
        return placed_rows(unplaced_rows(events), index)
    table = handlers()
    ready = _prepared(events)
    edits = [h for h in table if h.edit]
    plain = [h for h in table if not h.edit]
    rest = _shaped(ready, plain, _plain_ranges(table))
    if files is None:
        edit_rows, ranges = ready, _given_ranges(table)
    else:
        contents = files.select(F.col("path").alias("_path"), F.col("content").alias("_content"))
        edit_path = _pick(edits, lambda h: h.path)
        edit_rows = (
            ready.where(_any(edits)).withColumn("_path", edit_path).join(contents, "_path", "left")
        )
        ranges = audit.range_positions(_edits(table), F.col("_content"))
    return rest.unionByName(_shaped(edit_rows, edits, audit.ranges_or_default(ranges)))


def build_traces(flat: DataFrame, root: Column, revision: Column | None = None) -> DataFrame:
    """Nested records in the shape of the trace log."""
    conversation = F.struct(
        F.struct(F.col("contributor_type").alias("type"), "model_id").alias("contributor"),
        "ranges",
        "url",
    )
    file = F.struct(
        paths.relative_path(F.col("path"), root).alias("path"),
        F.array(conversation).alias("conversations"),
    )
    vcs = F.lit(None).cast("struct<type:string,revision:string>")
    if revision is not None:
        vcs = F.when(
            revision.isNotNull(), F.struct(F.lit("git").alias("type"), revision.alias("revision"))
        )
    return flat.select(
        F.lit(rules.TRACE_VERSION).alias("version"),
        F.sha2(F.concat_ws("|", "dialect", "event_uid", F.lit("0")), 256).alias("id"),
        F.col("received_at").alias("timestamp"),
        F.array(file).alias("files"),
        vcs.alias("vcs"),
        audit.tool_info(F.col("dialect"), F.col("tool_version")).alias("tool"),
        F.when(F.col("metadata") != "{}", F.col("metadata")).alias("metadata"),
    )


def edited_files(events: DataFrame) -> DataFrame:
    """Edit and stop rows for the edited-file sets: ``session, seq, kind, path``.

    One dialect also records edits whose path is missing, under a sentinel.
    """
    ready = _prepared(events)
    input_path = json_field(F.col("tool_input"), "file_path")
    is_edit = F.col("tool_name").isin(rules.WRITE_TOOLS)
    tool_path = F.when(
        is_edit & (F.col("event_name").isin("PostToolUse", "postToolUse")),
        F.when(F.col("dialect") == "claude", F.coalesce(input_path, F.lit(SENTINEL_UNKNOWN))).when(
            (F.col("dialect") == "cursor") & (input_path != SENTINEL_UNKNOWN), input_path
        ),
    )
    file_path = F.when(
        (F.col("dialect") == "cursor")
        & F.col("event_name").isin("afterFileEdit", "afterTabFileEdit"),
        F.nullif(F.col("file_path"), F.lit("")),
    )
    path = F.coalesce(tool_path, file_path)
    is_stop = F.col("event_name").isin("Stop", "stop")
    return ready.select(
        "session", "seq",
        F.when(is_stop, "stop").when(path.isNotNull(), "edit").alias("kind"),
        path.alias("path"),
    ).where(F.col("kind").isNotNull())


_ROOT = "coalesce(workspace_root, '')"
#: What a trace says of a report that cannot be read.
PARSE_ERROR = "SyntaxError: the report is not valid JSON"


def _stop_rows(rows: DataFrame, uid: Column, path: Column, ranges: Column, metadata: Column) -> DataFrame:
    """Flat traces of stops, in the columns of ``trace_rows``."""
    return rows.select(
        "session", "epoch", uid.alias("event_uid"), "dialect", F.lit("stop").alias("event_name"),
        "received_at", F.lit(None).cast("string").alias("tool_version"),
        path.alias("path"), F.lit("ai").alias("contributor_type"),
        audit.normalize_model_id(F.col("model")).alias("model_id"),
        ranges.alias("ranges"),
        F.expr("CASE WHEN coalesce(transcript_path, '') <> '' THEN concat('file://', transcript_path) END").alias("url"),
        metadata.alias("metadata"),
    )


def stop_traces(summary: DataFrame, dialect: str) -> DataFrame:
    """Flat trace of each stop: status, ids and what the status adds.

    ``summary`` has ``event_uid, dialect, received_at, model, transcript_path``
    and the ids of the stop event too.  Error texts are stored whole.
    """
    finished = "status IN ('vulnerabilities_found', 'no_vulnerabilities')"
    root = f"CASE WHEN {finished} THEN {json_value_sql(_ROOT)} END"
    failed = "status = 'scan_failed'"
    error = (
        f"CASE WHEN {failed} THEN {json_value_sql('_error')} "
        f"WHEN status = 'parse_error' THEN {_const(PARSE_ERROR)} END"
    )
    metadata = [
        ("event", _const("stop_hook_executed")),
        ("tool", _const(rules.PRODUCER)),
        ("conversation_id", json_value_sql("conversation_id")),
        ("generation_id", json_value_sql("generation_id")),
        ("status", json_value_sql("status")),
        ("error", error),
        (f"{rules.SCANNER}_path", f"CASE WHEN {failed} THEN {json_value_sql('scanner_path')} END"),
        ("total_vulnerabilities", "cast(total_vulnerabilities AS string)"),
        ("files_scanned", "cast(files_scanned AS string)"),
        *([("workspace_root", root)] if dialect == "cursor" else []),
    ]
    whole = summary.withColumn("_error", error_text())
    top = audit.ranges_or_default(F.lit(None).cast(audit.RANGES))
    return _stop_rows(whole, F.col("event_uid"), F.lit(".stop-hooks"), top, F.expr(json_object_sql(metadata)))


def vulnerability_traces(lists: DataFrame, stops: DataFrame, dialect: str) -> DataFrame:
    """Flat trace of each file with findings at a stop; one dialect lists them.

    ``stops`` are the rows that ``stop_traces`` takes.  A trace's id is the
    stop's with the file.
    """
    metadata = [
        ("event", _const("vulnerability_detected")),
        ("tool", _const(rules.PRODUCER)),
        ("scanner", _const(rules.SCANNER)),
        ("conversation_id", json_value_sql("conversation_id")),
        ("generation_id", json_value_sql("generation_id")),
        ("vulnerability_count", "cast(vulnerability_count AS string)"),
        *([("vulnerabilities", "to_json(vulnerabilities)")] if dialect == "cursor" else []),
    ]
    ids = stops.select(
        "session", "epoch", "event_uid", "dialect", "received_at", "model", "transcript_path",
        "conversation_id", "generation_id",
    )
    uid = F.concat_ws("|", "event_uid", "file")
    return _stop_rows(
        lists.join(ids, ["session", "epoch"]), uid, F.col("file"), F.col("ranges"),
        F.expr(json_object_sql(metadata)),
    )
