"""Hook events made from the views: one branch per dialect and event.

A branch is portable SQL over one view.  ``events_of`` turns branches into a
table of hook events; list columns are put together from scalar ones.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from ..sources.hook_events import EVENT_FIELDS
from .views import view, view_sql

Given = dict[str, DataFrame] | None


@dataclass(frozen=True)
class Branch:
    dialect: str
    event: str
    source: str
    row: str  # SQL for the row id
    columns: dict[str, str]

    def select(self, name: str) -> str:
        listed = ", ".join(f"{sql} AS {column}" for column, sql in self.columns.items())
        return (
            f"SELECT concat('{name}-', {self.row}) AS event_uid, '{self.dialect}' AS dialect, "
            f"{self.event} AS event_name, {listed} FROM {{{self.source}}} src"
        )


def _string(column: str) -> str:
    return f"cast({column} AS string)"


_TOOL = {
    "tool_name": "tool_name", "tool_input": "tool_input", "cwd": "cwd", "model": "model",
    "tool_use_id": "concat('t', cast(event_id AS string))",
    "transcript_path": "CASE WHEN event_id % 2 = 0 THEN '/t/log.jsonl' ELSE '' END",
    "received_at": "ts", "session": "session_id", "seq": "event_id",
}
_ID = _string("event_id")
_DONE = {**_TOOL, "duration": "value"}
_PLUGIN_TOOL = (
    "CASE WHEN event_id % 5 = 0 THEN tool_name WHEN tool_name = 'Bash' THEN 'exec' WHEN tool_name = 'Shell' THEN 'shell' "
    "WHEN tool_name = 'run_terminal_cmd' THEN 'bash' ELSE tool_name END"
)
_PLUGIN_INPUT = (
    "CASE WHEN event_id % 2 = 1 THEN replace(tool_input, '{{\"command\":', '{{\"cmd\":') "
    "ELSE tool_input END"
)
_DOC_ID = _string("doc_id")
_DOC = {"file_path": "path", "model": "'gpt-4'", "conversation_id": "concat('c', cast(doc_id AS string))"}
_LIFECYCLE = (
    "CASE kind WHEN 'start' THEN 'SessionStart' WHEN 'stop' THEN 'SessionEnd' "
    "WHEN 'failure' THEN 'Notification' ELSE 'PreCompact' END"
)

BRANCHES = {
    "claude_pre_tool": Branch("claude", "'PreToolUse'", "tool_calls", _ID, _TOOL),
    "claude_post_tool": Branch(
        "claude", "'PostToolUse'", "tool_calls", _ID, {**_DONE, "tool_response": "command"}
    ),
    "claude_output": Branch(
        "claude", "'PostToolUse'", "pages", _string("page_id"),
        {"tool_name": "'WebFetch'", "tool_input": "'{{}}'", "model": "'claude-x'",
         "tool_result": "replace(html, '&quot;', '\"')"},
    ),
    "claude_prompt": Branch(
        "claude", "'UserPromptSubmit'", "turns", "uid", {"user_prompt": "text", "model": "'claude-x'"}
    ),
    "claude_paste": Branch(
        "claude", "'UserPromptSubmit'", "documents", _DOC_ID, {"prompt": "text", "model": "'o3'"}
    ),
    "claude_lifecycle": Branch(
        "claude", _LIFECYCLE, "activity", _string("seq"),
        {"reason": "CASE WHEN kind = 'stop' THEN 'done' END",
         "trigger": "CASE WHEN kind = 'edit' THEN 'auto' END",
         "notification": "CASE WHEN kind = 'failure' THEN path END",
         "received_at": "ts", "session": "session", "seq": "seq"},
    ),
    "cursor_pre_tool": Branch(
        "cursor", "'preToolUse'", "tool_calls", _ID,
        {**_TOOL, "agent_message": "CASE WHEN event_id % 3 = 0 THEN 'next' END"},
    ),
    "cursor_post_tool": Branch("cursor", "'postToolUse'", "tool_calls", _ID, _DONE),
    "cursor_failure": Branch(
        "cursor", "'postToolUseFailure'", "tool_calls", _ID,
        {**_DONE, "error_message": "concat('exit ', cast(event_id % 5 AS string))",
         "failure_type": "event_type", "is_interrupt": "event_id % 4 = 0"},
    ),
    "cursor_before_shell": Branch(
        "cursor", "'beforeShellExecution'", "tool_calls", _ID,
        {"command": "command", "model": "model", "received_at": "ts",
         "cwd": "CASE WHEN event_id % 4 = 0 THEN '' ELSE cwd END", "workspace_root": "cwd",
         "timeout": "event_id % 7", "session": "session_id", "seq": "event_id"},
    ),
    "cursor_mcp": Branch(
        "cursor", "'beforeMCPExecution'", "tool_calls", _ID,
        {**_TOOL, "command": "command", "url": "'http://h/mcp'"},
    ),
    "cursor_prompt": Branch(
        "cursor", "'beforeSubmitPrompt'", "turns", "uid",
        {"prompt": "CASE WHEN turn % 3 = 0 THEN concat('Review the findings: ', text) ELSE text END",
         "model": "'gpt-4'", "attachment": "CASE WHEN turn % 2 = 0 THEN concat('notes', cast(turn AS string), '.md') END"},
    ),
    "cursor_paste": Branch(
        "cursor", "'beforeSubmitPrompt'", "documents", _DOC_ID, {"prompt": "text", "model": "''"}
    ),
    "cursor_before_read": Branch(
        "cursor", "'beforeReadFile'", "files", _DOC_ID,
        {**_DOC, "content": "CASE WHEN doc_id % 2 = 0 THEN content ELSE ' ' END",
         "attachment": "CASE doc_id % 3 WHEN 0 THEN concat('{{\"file_path\":\"', path, '\"}}') WHEN 1 THEN 'say \"hi\"' END"},
    ),
    "cursor_after_edit": Branch(
        "cursor", "'afterFileEdit'", "files", _DOC_ID,
        {**_DOC, "file_path": "CASE WHEN doc_id % 4 = 0 THEN concat(path, '.gone') ELSE path END",
         "new_string": "split_part(content, chr(10), 2)", "generation_id": "'g'"},
    ),
    "cursor_tab_edit": Branch(
        "cursor", "'afterTabFileEdit'", "files", _DOC_ID,
        {**_DOC, "new_string": "split_part(content, chr(10), 1)", "generation_id": "'g'"},
    ),
    "cursor_after_shell": Branch(
        "cursor", "'afterShellExecution'", "pages", _string("page_id"),
        {"stdout": "replace(html, '&quot;', '\"')", "stderr": "url", "command": "url",
         "model": "'o1-mini'", "duration": "cast(page_id AS double)"},
    ),
    "cursor_after_mcp": Branch(
        "cursor", "'afterMCPExecution'", "pages", _string("page_id"),
        {"text": "html", "message": "replace(html, '&quot;', '\"')", "stdout": "''",
         "tool_name": "'mcp_fetch'", "tool_input": "'{{}}'", "model": "'llama'"},
    ),
    "cursor_response": Branch(
        "cursor",
        "CASE role WHEN 'assistant' THEN 'afterAgentResponse' WHEN 'system' THEN 'sessionStart' "
        "ELSE 'afterAgentThought' END",
        "turns", "uid",
        {"text": "text", "model": "'gpt-4'", "session_id": "cast(conv_id AS string)",
         "composer_mode": "'agent'", "duration_ms": "cast(turn AS double)"},
    ),
    "cursor_session": Branch(
        "cursor",
        "CASE kind WHEN 'stop' THEN 'sessionEnd' WHEN 'start' THEN 'subagentStart' WHEN 'failure' THEN 'subagentStop' "
        "ELSE 'preCompact' END",
        "activity", _string("seq"),
        {"session_id": _string("session"), "conversation_id": "concat('c', cast(session AS string))", "model": "'o3'",
         "reason": "CASE WHEN seq % 2 = 0 THEN 'user \"quit\"' END", "duration_ms": "value", "duration": "value",
         "subagent_type": "CASE WHEN seq % 3 = 0 THEN 'explore' ELSE 'general' END", "prompt": "concat('look at ', path)",
         "status": "CASE WHEN seq % 5 = 0 THEN 'error' ELSE 'completed' END",
         "agent_transcript_path": "CASE WHEN seq % 4 = 0 THEN concat('/t/', cast(seq AS string), '.jsonl') END",
         "trigger": "'auto'", "context_usage_percent": "value", "context_tokens": "seq * 10",
         "context_window_size": "200000", "message_count": "seq % 50", "messages_to_compact": "seq % 7",
         "is_first_compaction": "seq % 2 = 1", "received_at": "ts", "session": "session", "seq": "seq"},
    ),
    "openclaw_before_tool": Branch(
        "openclaw", "'before_tool_call'", "tool_calls", _ID,
        {"tool_name": _PLUGIN_TOOL, "tool_input": _PLUGIN_INPUT, "received_at": "ts"},
    ),
}


def branch_sql(name: str) -> str:
    """A branch as stand-alone SQL over the registered tables."""
    branch = BRANCHES[name]
    source = view_sql(branch.source)
    return branch.select(name).format(**{branch.source: f"({source})"})


_ROW_FIELDS = {"session": "bigint", "seq": "bigint", "received_at": "timestamp"}


def _event_rows(spark: SparkSession, sf_dir: str, name: str, given: Given) -> DataFrame:
    """One branch in the full event shape, as one statement."""
    branch = BRANCHES[name]
    types = _ROW_FIELDS | {f.name: f.dataType.simpleString() for f in EVENT_FIELDS.fields}
    sql = dict(branch.columns)
    if "workspace_root" in sql:
        sql["workspace_roots"] = f"array({sql.pop('workspace_root')})"
    if "attachment" in sql:
        sql["attachments"] = f"array_compact(array({sql.pop('attachment')}))"
    if "new_string" in sql:
        sql["edits"] = (
            f"array(named_struct('old_string', '', 'new_string', {sql.pop('new_string')}, 'range', "
            "CAST(NULL AS struct<start_line_number:int,end_line_number:int>)))"
        )
    columns = {c: f"CAST({sql.get(c, 'NULL')} AS {kind})" for c, kind in types.items()}
    statement = Branch(branch.dialect, branch.event, branch.source, branch.row, columns).select(name)
    return spark.sql(statement, **{branch.source: view(spark, sf_dir, branch.source, given)})


def events_of(
    spark: SparkSession, sf_dir: str, *names: str, given: Given = None
) -> DataFrame:
    """Hook events of the named branches, all event columns present."""
    given = dict(given or {})
    for source in dict.fromkeys(BRANCHES[name].source for name in names):
        given[source] = view(spark, sf_dir, source, given)
    return reduce(
        DataFrame.unionByName, [_event_rows(spark, sf_dir, name, given) for name in names]
    )
