"""Registered queries: every operator over the whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import audit, paths, pii, policy, rules, secrets, shell
from ..functions.text import unescape_html
from ..operators import analytics, detect, edited, lineage, stopscan, trace
from ..operators.decide import READ_HEADING, decide, secret_detections
from ..operators.locate import LineIndex
from ..sources import files as file_source, hook_events, scan_reports
from ..sources.committed import CommittedTable
from ..sources.decisions import write_decisions
from ..sources.traces import read_traces, write_traces
from ..streaming import decisions as decision_streams, edited as edited_streams, pairs, spans
from .branches import BRANCHES, events_of
from .session import long_rows, run_folder, stored
from .views import table, view

HOME = "/home/dev"
DEFAULT_DIR = "/work"
PROJECT = "/work"
_SECONDS = "yyyy-MM-dd HH:mm:ss"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def _home() -> Column:
    return F.lit(HOME)


def _default_dir() -> Column:
    return F.lit(DEFAULT_DIR)


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "texts")


_ROW = ["src", "row_id"]


# --- detectors ----------------------------------------------------------------


@_query
def pii_ssn(spark, sf):
    return detect.explode_values(_texts(spark, sf), _ROW, pii.detect_ssn(F.col("text")), "value")


@_query
def pii_email(spark, sf):
    return detect.explode_values(_texts(spark, sf), _ROW, pii.detect_email(F.col("text")), "value")


@_query
def pii_phone(spark, sf):
    return detect.explode_values(_texts(spark, sf), _ROW, pii.detect_phone(F.col("text")), "value")


@_query
def pii_card(spark, sf):
    return detect.explode_values(_texts(spark, sf), _ROW, pii.detect_card(F.col("text")), "value")


@_query
def luhn_valid(spark, sf):
    candidates = detect.explode_values(
        _texts(spark, sf), _ROW, pii.card_candidates(F.col("text")), "candidate"
    )
    return candidates.withColumn("valid", pii.luhn_valid(F.col("candidate")))


@_query
def pii_findings(spark, sf):
    return detect.pii_findings(_texts(spark, sf), _ROW)


@_query
def contains_pii(spark, sf):
    return _texts(spark, sf).select(*_ROW, pii.contains_pii(F.col("text")).alias("has_pii"))


def _readable_texts(spark, sf) -> DataFrame:
    """Markup is unescaped before secrets are looked for."""
    text = F.when(F.col("src") == "pages", unescape_html(F.col("text"))).otherwise(F.col("text"))
    return _texts(spark, sf).withColumn("text", text)


@_query
def secret_findings(spark, sf):
    return detect.secret_findings(_readable_texts(spark, sf), _ROW)


def _read_targets(spark, sf) -> DataFrame:
    """Files the read tools ask for: ``event_id, path``."""
    calls = view(spark, sf, "tool_calls")
    target = paths.resolve_candidate(F.col("file_path"), F.col("cwd"), _home())
    wanted = calls.where(F.col("tool_name").isin(rules.SECRET_READ_TOOLS))
    return wanted.where(F.col("file_path") != "").select("event_id", target.alias("path"))


@_query
def secret_findings_files(spark, sf):
    files = view(spark, sf, "files")
    found = detect.secret_findings(
        files.withColumn("label", F.col("path")), ["path"], text="content"
    )
    joined = _read_targets(spark, sf).join(found, "path")
    return joined.select("event_id", "path", "rule_id", "ordinal", "line", "start", "masked")


@_query
def findings_message(spark, sf):
    texts = _readable_texts(spark, sf)
    hits = detect.explode_nonempty(texts, [*_ROW, "label"], secrets.rule_hits(F.col("text")), "hits")
    lines = secrets.finding_lines(F.col("hits"), F.col("label"))
    return hits.select(
        *_ROW,
        secrets.findings_message(F.lit("SECRET DETECTED"), lines).alias("message"),
        secrets.finding_count(F.col("hits")).alias("n_findings"),
    )


@_query
def params_scan(spark, sf):
    params = F.coalesce(F.get_json_object("tool_input", "$"), F.lit("{}"))
    calls = view(spark, sf, "tool_calls").select("event_id", params.alias("params"))
    return calls.select(
        "event_id",
        secrets.finding_count(secrets.rule_hits(F.col("params"))).alias("n_findings"),
        pii.contains_pii(F.col("params")).alias("has_pii"),
    )


@_query
def redacted_findings(spark, sf):
    return detect.redact(detect.pii_findings(_texts(spark, sf), _ROW))


# --- policy -------------------------------------------------------------------


def _rule_hits(spark, sf, hits: Callable[[Column], Column]) -> DataFrame:
    found = _texts(spark, sf).select(*_ROW, F.explode_outer(hits(F.col("text"))).alias("h"))
    return found.where(F.col("h").isNotNull()).select(*_ROW, "h.rule_no", "h.reason")


@_query
def dangerous_hits(spark, sf):
    return _rule_hits(spark, sf, policy.dangerous_hits)


@_query
def sensitive_hits(spark, sf):
    return _rule_hits(spark, sf, policy.sensitive_hits)


def _verdicts(rows: DataFrame, verdict: Column, *keys: str) -> DataFrame:
    judged = rows.select(*keys, verdict.alias("v"))
    return judged.select(*keys, "v.is_safe", "v.severity", "v.reason")


@_query
def validate_command(spark, sf):
    return _verdicts(_texts(spark, sf), policy.validate_command(F.col("text")), *_ROW)


@_query
def validate_command_counts(spark, sf):
    calls = view(spark, sf, "tool_calls")
    judged = _verdicts(calls, policy.validate_command(F.col("command")), "event_id")
    return judged.groupBy("severity", "reason").agg(F.count(F.lit(1)).alias("n"))


@_query
def normalize_path(spark, sf):
    path = F.col("file_path")
    return view(spark, sf, "tool_calls").select(
        "event_id",
        paths.normalize_path(path).alias("normalized"),
        paths.basename(path).alias("base_name"),
    )


@_query
def protected_paths(spark, sf):
    clean = paths.normalize_path(F.col("file_path"))
    calls = view(spark, sf, "tool_calls").select("event_id", clean.alias("path"))
    prefix = F.coalesce(
        *[F.when(F.startswith("path", F.lit(p)), F.lit(p)) for p in rules.PROTECTED_PREFIXES]
    )
    return calls.select(
        "event_id", prefix.alias("write_prefix"),
        F.col("path").isin(rules.PROTECTED_READ_FILES).alias("protected_file"),
    )


@_query
def validate_file_write(spark, sf):
    calls = view(spark, sf, "tool_calls")
    return _verdicts(calls, policy.validate_file_write(F.col("file_path")), "event_id")


@_query
def validate_file_read(spark, sf):
    calls = view(spark, sf, "tool_calls")
    return _verdicts(calls, policy.validate_file_read(F.col("file_path")), "event_id")


@_query
def validate_tool_input(spark, sf):
    calls = view(spark, sf, "tool_calls")
    verdict = policy.validate_tool_input(F.col("tool_name"), F.col("tool_input"))
    return _verdicts(calls, verdict, "event_id", "tool_name")


@_query
def task_prompt_warn(spark, sf):
    calls = view(spark, sf, "tool_calls")
    judged = calls.select("event_id", policy.task_prompt_verdict(F.col("command")).alias("v"))
    return judged.select("event_id", "v.severity", "v.reason")


@_query
def mcp_param_scan(spark, sf):
    calls = view(spark, sf, "tool_calls").select("event_id", "tool_input")
    hits = calls.select(
        "event_id", F.explode_outer(policy.mcp_param_hits(F.col("tool_input"))).alias("h")
    )
    return hits.where(F.col("h").isNotNull()).select("event_id", "h.key", "h.reason")


# --- lineage ------------------------------------------------------------------


@_query
def shell_tokens(spark, sf):
    calls = view(spark, sf, "tool_calls")
    return detect.explode_values(calls, ["event_id"], shell.shell_tokens(F.col("command")), "token")


@_query
def token_predicates(spark, sf):
    token = F.col("token")
    return shell_tokens(spark, sf).select(
        "event_id", "ordinal",
        paths.looks_like_path(token).alias("is_path"),
        paths.looks_like_bare_file(token).alias("is_bare_file"),
        paths.is_env_assignment(token).alias("is_env"),
        paths.expand_home(token, _home()).alias("expanded"),
        paths.strip_quoting(token).alias("stripped"),
    )


@_query
def read_paths_regex(spark, sf):
    calls = view(spark, sf, "tool_calls")
    found = shell.paths_by_regex(F.col("command"))
    return detect.explode_values(calls, ["event_id"], found, "candidate").drop("ordinal")


@_query
def read_paths_tokens(spark, sf):
    calls = view(spark, sf, "tool_calls")
    found = shell.paths_by_tokens(shell.shell_tokens(F.col("command")))
    return detect.explode_values(calls, ["event_id"], found, "candidate").drop("ordinal")


def _commands(spark, sf) -> DataFrame:
    calls = view(spark, sf, "tool_calls").select("event_id", "command", "cwd")
    return calls.withColumn("workspace_roots", F.array().cast("array<string>"))


@_query
def shell_read_paths(spark, sf):
    read = lineage.shell_read_paths(
        _commands(spark, sf), view(spark, sf, "files"), "event_id", _home(), _default_dir()
    )
    return read.select("event_id", "path")


@_query
def resolve_path(spark, sf):
    resolved = paths.resolve_candidate(F.col("file_path"), F.col("cwd"), _home())
    joined = paths.resolve_against(F.col("cwd"), F.col("file_path"))
    return view(spark, sf, "tool_calls").select(
        "event_id", resolved.alias("resolved"), joined.alias("joined")
    )


@_query
def path_escape_flag(spark, sf):
    return view(spark, sf, "tool_calls").select(
        "event_id", paths.escapes_base(F.col("file_path"), F.col("cwd")).alias("escapes")
    )


@_query
def shell_read_secret_join(spark, sf):
    candidates = lineage.resolved_candidates(F.col("command"), F.col("cwd"), _home())
    reads = lineage.explode_paths(_commands(spark, sf), ["event_id"], candidates).drop("ordinal")
    hits = detect.scan_files(view(spark, sf, "files"))
    found = lineage.findings_of_reads(reads, hits, "event_id")
    message = secrets.findings_message(F.lit(READ_HEADING), F.col("file_lines"))
    return found.select("event_id", "file_n", message.alias("message"))


# --- decisions ----------------------------------------------------------------

DECISIONS = {
    "claude_pre_tool": ["claude_pre_tool"],
    "claude_prompt": ["claude_prompt", "claude_paste"],
    "claude_post_tool": ["claude_post_tool", "claude_output"],
    "claude_lifecycle": ["claude_lifecycle"],
    "cursor_before_read": ["cursor_before_read"],
    "cursor_prompt": ["cursor_prompt", "cursor_paste"],
    "cursor_mcp": ["cursor_mcp"],
    "cursor_after_edit": ["cursor_after_edit"],
    "cursor_after_shell": ["cursor_after_shell"],
    "cursor_after_mcp": ["cursor_after_mcp"],
    "cursor_pre_tool": ["cursor_pre_tool"],
    "cursor_before_shell": ["cursor_before_shell"],
    "cursor_default": ["cursor_response", "cursor_post_tool", "cursor_tab_edit", "cursor_failure", "cursor_session"],
    "openclaw_before_tool": ["openclaw_before_tool"],
}
# Events whose verdict depends on the files they read.
WITH_FILES = {
    "claude_pre_tool", "cursor_before_read", "cursor_after_edit", "cursor_before_shell",
    "openclaw_before_tool",
}


def decisions_of(spark, sf, *branches: str, with_files: bool = True) -> DataFrame:
    files = view(spark, sf, "files") if with_files else None
    given = {}
    if sum(BRANCHES[name].source == "tool_calls" for name in branches) > 1:
        # Written aside: every branch reads the calls instead of making them anew.
        given["tool_calls"] = stored(view(spark, sf, "tool_calls"), "tool-calls")
    return decide(events_of(spark, sf, *branches, given=given), files, _home(), _default_dir())


def _decision_query(name: str) -> Query:
    def run(spark, sf):
        return decisions_of(
            spark, sf, *DECISIONS[name], with_files=name in WITH_FILES
        ).drop("dialect")

    return run


for _name in DECISIONS:
    QUERIES[_name] = _decision_query(_name)


@_query
def decisions(spark, sf):
    """All dialects and events: what was decided, and why."""
    every = [b for names in DECISIONS.values() for b in names]
    made = decisions_of(spark, sf, *every)
    return made.groupBy("dialect", "event_name", "action", "context").agg(
        F.count(F.lit(1)).alias("events"), F.sum("n_findings").alias("findings")
    )


@_query
def decisions_as_of(spark, sf):
    """Shell commands and reads judged by what the files held at the time of the event."""
    hits = detect.scan_versions(view(spark, sf, "file_versions"))
    events = events_of(spark, sf, "cursor_before_shell")
    return decide(events, None, _home(), _default_dir(), hits).drop("dialect")


@_query
def written_decisions(spark, sf):
    """Decisions of three dialects written by dialect, read back and counted."""
    folder = run_folder(spark, "written-decisions")
    write_decisions(decisions_of(spark, sf, *WRITTEN), folder)
    answers = spark.read.parquet(folder)
    return answers.groupBy("dialect", "event_name", "response", "exit_code").agg(F.count(F.lit(1)).alias("events"))


WRITTEN = ["claude_pre_tool", "cursor_before_shell", "openclaw_before_tool"]


@_query
def secret_detection_log(spark, sf):
    every = [b for names in DECISIONS.values() for b in names]
    return secret_detections(decisions_of(spark, sf, *every))


AGENTS = ("claude", "cursor", "openclaw")


def _over_dialects(make: Callable[[str], DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [make(dialect) for dialect in AGENTS])


@_query
def malformed_split(spark, sf):
    lines = view(spark, sf, "raw_lines")

    def quarantined(dialect: str) -> DataFrame:
        bad = hook_events.split_malformed(hook_events.parse_hook_events(lines, dialect, only=()))[1]
        return bad.select("event_id", "dialect", "parse_status", "response", "exit_code")

    return _over_dialects(quarantined)


@_query
def read_hook_events(spark, sf):
    lines = view(spark, sf, "raw_lines")
    names = ["hook_event_name", "tool_name", "tool_input", "duration"]

    def good(dialect: str) -> DataFrame:
        parsed = hook_events.parse_hook_events(lines, dialect, only=names)
        return hook_events.split_malformed(parsed)[0].select("event_id", "dialect", *names)

    return _over_dialects(good)


def _read_log(spark, sf) -> DataFrame:
    """The log from its lines, as the sources read it."""
    parsed = hook_events.parse_hook_events(view(spark, sf, "log_lines"), "cursor")
    return hook_events.split_malformed(parsed)[0]


@_query
def log_traces(spark, sf):
    rows = trace.trace_rows(_read_log(spark, sf), view(spark, sf, "workspace"))
    spans = F.concat_ws(
        ";", F.transform("ranges", lambda r: F.concat_ws("-", r["start_line"], r["end_line"]))
    )
    return rows.select(
        "event_uid", "event_name", "path", "model_id", "metadata", spans.alias("spans"),
        F.date_format("received_at", _SECONDS).alias("received"),
    )


#: Acts of a log that one task puts in order, on average.
ACTS = 100_000


def _epochs_of(acts: DataFrame, name: str, chunk: int) -> DataFrame:
    # Written aside, as several steps number them: each line is read and parsed once, and their number is known.
    acts = stored(acts, name)
    return edited.with_epochs(acts, chunk, acts.count() // ACTS + 1)


def _log_epochs(spark, sf) -> DataFrame:
    return _epochs_of(trace.edited_files(_read_log(spark, sf)), "log-acts", CHUNK)


@_query
def log_edited_set(spark, sf):
    return edited.edited_set(_log_epochs(spark, sf))


@_query
def log_stop_status(spark, sf):
    """Lines of the log, edited sets, reports of the stops, status."""
    # Written aside: sets and stops take the same numbers.
    epochs = stored(_log_epochs(spark, sf), "log-epochs")
    in_set = stopscan.with_existing(
        edited.edited_set(epochs), view(spark, sf, "workspace"), F.lit(PROJECT)
    )
    stops = epochs.where(F.col("kind") == "stop").select("session", "epoch", "seq")
    reports = view(spark, sf, "stop_reports").withColumn("session", F.col("session").cast("string"))
    summary = stopscan.stop_summary(stops.join(reports, ["session", "seq"]), in_set)
    return summary.select("session", "epoch", "status", "n_edited", "n_valid")


def _plain_log(spark, sf) -> DataFrame:
    """Log files without numbers and times, written and read as an agent's log: events are known by their place."""
    folder = run_folder(spark, "plain-log")
    view(spark, sf, "plain_log_lines").orderBy("seq").select("raw").write.text(folder)
    parsed = hook_events.read_hook_events(spark, folder, "cursor", rangeBytes=str(LOG_RANGE))
    return hook_events.split_malformed(parsed)[0]


@_query
def plain_log_traces(spark, sf):
    rows = trace.trace_rows(_plain_log(spark, sf), view(spark, sf, "workspace"))
    spans = F.concat_ws(
        ";", F.transform("ranges", lambda r: F.concat_ws("-", r["start_line"], r["end_line"]))
    )
    return rows.select("event_name", "path", "model_id", "metadata", spans.alias("spans"))


def _plain_epochs(spark, sf) -> DataFrame:
    return _epochs_of(trace.edited_files(_plain_log(spark, sf)), "plain-log-acts", LOG_RANGE)


@_query
def plain_log_edited_set(spark, sf):
    """Edited sets with the place of each path among those of its set."""
    sets = edited.edited_set(_plain_epochs(spark, sf))
    order = Window.partitionBy("session", "epoch").orderBy("first_seq")
    return sets.select("session", "epoch", "path", F.row_number().over(order).alias("position"))


@_query
def plain_log_stop_status(spark, sf):
    """Stops and reports of a session meet in their order: neither has a number."""
    epochs = _plain_epochs(spark, sf)
    in_set = stopscan.with_existing(edited.edited_set(epochs), view(spark, sf, "workspace"), F.lit(PROJECT))
    stops = epochs.where(F.col("kind") == "stop").select("session", "epoch")
    order = Window.partitionBy("session").orderBy("seq")
    reports = view(spark, sf, "stop_reports").withColumns(
        {"epoch": (F.row_number().over(order) - 1).cast("long"), "session": F.col("session").cast("string")}
    )
    summary = stopscan.stop_summary(stops.join(reports, ["session", "epoch"]), in_set)
    return summary.select("session", "epoch", "status", "n_edited", "n_valid")


# --- edited files and stop scans ------------------------------------------------

CHUNK = 2_000
#: Bytes of a log that one task reads, and of a chunk in which its events are ordered.
LOG_RANGE = 1 << 20


def _edited(spark, sf) -> tuple[DataFrame, DataFrame]:
    epochs = edited.with_epochs(view(spark, sf, "activity").drop("ts", "value"), CHUNK)
    return epochs, edited.edited_set(epochs)


@_query
def edited_epochs(spark, sf):
    return _edited(spark, sf)[0].select("session", "seq", "kind", "epoch")


@_query
def edited_set(spark, sf):
    return _edited(spark, sf)[1]


def _existing(spark, sf) -> tuple[DataFrame, DataFrame]:
    epochs, in_set = _edited(spark, sf)
    return epochs, stopscan.with_existing(in_set, view(spark, sf, "workspace"), F.lit(PROJECT))


@_query
def valid_files(spark, sf):
    found = _existing(spark, sf)[1].where("is_valid")
    return found.select("session", "epoch", "path", "first_seq")


def _summary(spark, sf, dialect: str = "cursor") -> tuple[DataFrame, DataFrame]:
    """Stops with epoch, report and status, and the edited set."""
    epochs, in_set = _existing(spark, sf)
    stops = epochs.where(F.col("kind") == "stop").select("session", "epoch", "seq")
    ready = stops.join(view(spark, sf, "stop_reports"), ["session", "seq"]).withColumns(
        {
            "event_uid": F.concat_ws("-", F.lit("stop"), "session", "seq"),
            "dialect": F.lit(dialect),
            "received_at": F.col("ts"),
            "model": F.lit("gpt-4"),
            "transcript_path": F.when(F.col("seq") % 2 == 0, "/t/log.jsonl"),
            "scanner_path": F.lit("/usr/local/bin/scanner"),
            "conversation_id": F.concat(F.lit("c"), F.col("session").cast("string")),
            "generation_id": F.when(F.col("seq") % 3 == 0, "g"),
            "workspace_root": F.lit(PROJECT),
        }
    )
    return stopscan.stop_summary(ready, in_set), in_set


@_query
def scan_results(spark, sf):
    parsed = scan_reports.parse_reports(view(spark, sf, "stop_reports"))
    return scan_reports.explode_results(parsed, ["session", "seq", "report_status"])


@_query
def result_paths(spark, sf):
    return stopscan.result_fields(scan_results(spark, sf)).drop("result", "report_status")


def _attributed(spark, sf) -> DataFrame:
    summary, in_set = _summary(spark, sf)
    found = summary.where(F.col("status") == "vulnerabilities_found")
    rows = scan_reports.explode_results(found, stopscan.STOP_KEY)
    results = stopscan.result_fields(rows)
    return stopscan.attribute_results(results, in_set)


@_query
def attributed_results(spark, sf):
    return _attributed(spark, sf).select("session", "epoch", "file", "ordinal", "rule_id")


@_query
def vulnerability_rollup(spark, sf):
    return stopscan.vulnerability_rollup(_attributed(spark, sf))


DIALECTS = ("claude", "cursor")


def _vulnerability_rows(spark, sf) -> DataFrame:
    lists = stopscan.vulnerability_lists(_attributed(spark, sf))
    rows = [
        trace.vulnerability_traces(lists, _summary(spark, sf, dialect)[0], dialect)
        for dialect in DIALECTS
    ]
    return rows[0].unionByName(rows[1])


def _stop_rows(spark, sf) -> DataFrame:
    rows = [trace.stop_traces(_summary(spark, sf, dialect)[0], dialect) for dialect in DIALECTS]
    return rows[0].unionByName(rows[1])


_STOP_TRACE = ["session", "epoch", "dialect", "event_uid", "path", "model_id", "url", "metadata"]


@_query
def vulnerability_traces(spark, sf):
    spans = F.concat_ws(
        ";", F.transform("ranges", lambda r: F.concat_ws("-", r["start_line"], r["end_line"]))
    )
    return _vulnerability_rows(spark, sf).select(*_STOP_TRACE, spans.alias("spans"))


@_query
def stop_status(spark, sf):
    return _summary(spark, sf)[0].select("session", "epoch", "status", "n_edited", "n_valid")


@_query
def stop_totals(spark, sf):
    return _summary(spark, sf)[0].groupBy("status").agg(
        F.count(F.lit(1)).alias("stops"),
        F.sum("total_vulnerabilities").alias("total_vulnerabilities"),
        F.sum("files_scanned").alias("files_scanned"),
    )


@_query
def claude_stop(spark, sf):
    answered = stopscan.stop_responses(_summary(spark, sf, "claude")[0], "claude")
    return answered.select("session", "epoch", "response")


@_query
def cursor_stop(spark, sf):
    answered = stopscan.stop_responses(_summary(spark, sf)[0], "cursor")
    return answered.select("session", "epoch", "response")


@_query
def stop_traces(spark, sf):
    return _stop_rows(spark, sf).select(*_STOP_TRACE)


@_query
def stop_records(spark, sf):
    """Stop and vulnerability traces in the shape of the trace log."""
    rows = _stop_rows(spark, sf).unionByName(_vulnerability_rows(spark, sf))
    made = trace.build_traces(rows, F.lit(PROJECT))
    return _record_columns(made, F.date_format("timestamp", _SECONDS).alias("received"))


# --- traces -------------------------------------------------------------------


def _log(spark, sf) -> DataFrame:
    return events_of(spark, sf, *BRANCHES)


def _traces(spark, sf, *branches: str) -> DataFrame:
    log = events_of(spark, sf, *(branches or BRANCHES))
    return trace.trace_rows(log, view(spark, sf, "files"))


@_query
def traces_flat(spark, sf):
    return _traces(spark, sf).select(
        "event_uid", "dialect", "event_name", "path", "contributor_type", "model_id", "url",
        "metadata",
    )


@_query
def range_positions(spark, sf):
    made = _traces(
        spark, sf, "cursor_after_edit", "cursor_tab_edit", "claude_post_tool", "cursor_post_tool"
    )
    spans = made.select("event_uid", F.posexplode("ranges").alias("ordinal", "span"))
    return spans.select("event_uid", "ordinal", "span.start_line", "span.end_line")


def _record_columns(made: DataFrame, *more: Column) -> DataFrame:
    first = F.col("files")[0]
    talk = first["conversations"][0]
    return made.select(
        "version", "id", first["path"].alias("path"),
        talk["contributor"]["type"].alias("contributor_type"),
        talk["contributor"]["model_id"].alias("model_id"),
        F.size(talk["ranges"]).alias("n_ranges"), talk["url"].alias("url"), "metadata",
        F.col("tool.name").alias("tool"), F.col("tool.version").alias("tool_version"), *more,
    )


@_query
def trace_records(spark, sf):
    return _record_columns(trace.build_traces(_traces(spark, sf), F.lit(PROJECT)))


#: Codec of the stored trace logs.
LOG_CODEC = "gzip"


@_query
def trace_roundtrip(spark, sf):
    """Write the trace log and read it back."""
    folder = run_folder(spark, "traces")
    write_traces(trace.build_traces(_traces(spark, sf), F.lit(PROJECT)), folder, compression=LOG_CODEC)
    return _record_columns(read_traces(spark, folder))


@_query
def model_ids(spark, sf):
    return view(spark, sf, "tool_calls").select(
        "event_id", audit.normalize_model_id(F.col("model")).alias("model_id")
    )


@_query
def tool_info(spark, sf):
    version = F.when(F.col("tool_name") == "Bash", F.lit("1.7")).otherwise(F.lit(""))
    info = _log(spark, sf).select("event_uid", audit.tool_info(F.col("dialect"), version).alias("t"))
    return info.select("event_uid", F.col("t.name").alias("tool"), F.col("t.version").alias("version"))


@_query
def relative_paths(spark, sf):
    return view(spark, sf, "tool_calls").select(
        "event_id",
        paths.relative_path(F.col("file_path"), F.lit(PROJECT)).alias("from_project"),
        paths.relative_path(F.col("doc_path"), F.col("cwd")).alias("from_cwd"),
        paths.relative_path(F.col("doc_path"), F.lit("/work/alt/x")).alias("climbing"),
    )


@_query
def contributor_attribution(spark, sf):
    made = _traces(spark, sf, "cursor_prompt", "cursor_paste", "claude_prompt")
    return made.select("event_uid", "contributor_type", "metadata")


# --- reports ------------------------------------------------------------------


@_query
def read_files(spark, sf):
    """A tree of text files with the texts of the documents, read back file by file and summed by folder."""
    folder = run_folder(spark, "tree")
    files = view(spark, sf, "files").select(F.concat(F.lit("d"), F.col("doc_id") % 20).alias("dir"), "content")
    files.write.partitionBy("dir").text(folder)
    found = file_source.read_files(spark, folder, "*.txt")
    name = F.regexp_extract("path", "/dir=([^/]+)/[^/]+$", 1)
    return found.groupBy(name.alias("dir")).agg(
        F.sum(F.octet_length("content")).alias("n_bytes"), F.sum(F.length("content")).alias("n_chars")
    )


@_query
def edit_lines(spark, sf):
    """Line ranges of all edits from a stored index of lines; no contents are joined."""
    index = LineIndex.write(view(spark, sf, "files"), run_folder(spark, "line-index"))
    log = events_of(spark, sf, "cursor_after_edit", "cursor_tab_edit", "claude_post_tool", "cursor_post_tool")
    spans = trace.trace_rows(log, index=index).select("event_uid", F.posexplode("ranges").alias("ordinal", "span"))
    return spans.select("event_uid", "ordinal", "span.start_line", "span.end_line")


def _calls(spark, sf) -> DataFrame:
    # Agents use ids again: several calls of a session share one.
    return view(spark, sf, "tool_calls").select(
        F.col("session_id").alias("session"), F.col("event_id").alias("seq"), "tool_name", "value",
        "event_type", F.concat(F.lit("t"), (F.col("event_id") % 400).cast("string")).alias("tool_use_id"),
    )


@_query
def tool_pairs(spark, sf):
    calls = _calls(spark, sf)
    done = calls.where(F.col("event_type") != "error").withColumnRenamed("value", "duration_ms")
    pairs = analytics.tool_pairs(calls.select("session", "seq", "tool_use_id", "tool_name"), done)
    return pairs.select("session", "seq", "tool_use_id", "tool_name", "completed", "duration_ms")


def _failures(spark, sf) -> DataFrame:
    return view(spark, sf, "tool_calls").where(F.col("event_type") == "error").select(
        "tool_name",
        F.when(F.col("event_id") % 3 == 0, "timeout").otherwise("exit").alias("failure_type"),
    )


@_query
def failure_hotspots(spark, sf):
    return analytics.failure_hotspots(_failures(spark, sf))


@_query
def failure_top(spark, sf):
    return analytics.failure_hotspots(_failures(spark, sf), 10)


@_query
def contributor_share(spark, sf):
    """Records by contributor, from the traces of every event that has a session."""
    made = _traces(spark, sf).where("session is not null")
    return analytics.contributor_share(made.select("session", "path", "contributor_type"))


@_query
def line_ownership(spark, sf):
    """Lines of each file by the session that wrote them last."""
    made = trace.trace_rows(_read_log(spark, sf), view(spark, sf, "workspace")).where("event_name = 'afterFileEdit'")
    ranges = made.select("path", "session", "seq", "contributor_type", F.explode("ranges").alias("r"))
    return analytics.ownership(ranges.select("path", "session", "seq", "contributor_type", "r.*"), ["session", "contributor_type"], "seq", BAND)


@_query
def duration_exact(spark, sf):
    """Exact percentiles beside the sketch's."""
    calls = view(spark, sf, "tool_calls").select("tool_name", F.col("value").alias("duration_ms"))
    return analytics.exact_percentiles(calls, "tool_name", "duration_ms", [0.0, 0.25, 0.5, 0.95, 1.0])


@_query
def findings_over_days(spark, sf):
    """Findings of commands and tool inputs per day, stored as mergeable rows and merged over every set."""
    calls = view(spark, sf, "tool_calls")
    labelled = F.explode(
        F.array(
            F.struct(F.lit("[shell command]").alias("label"), F.col("command").alias("text")),
            F.struct(F.lit("[tool params]").alias("label"), F.col("tool_input").alias("text")),
        )
    )
    texts = calls.select(F.to_date("ts").alias("day"), F.col("doc_path").alias("path"), labelled.alias("t"))
    found = detect.secret_findings(texts.select("day", "path", "t.*"), ["day", "path"])
    folder = run_folder(spark, "daily-findings")
    analytics.daily_findings(found).write.partitionBy("day").parquet(folder)
    return analytics.findings_over_days(spark.read.parquet(folder)).withColumn("day", F.col("day").cast("string"))


@_query
def flow_edges(spark, sf):
    return analytics.flow_edges(view(spark, sf, "activity"), CHUNK)


@_query
def duration_percentiles(spark, sf):
    calls = view(spark, sf, "tool_calls")
    return analytics.duration_percentiles(
        calls.select("tool_name", F.col("value").alias("duration_ms"))
    )


@_query
def session_spans(spark, sf):
    spans = analytics.session_spans(view(spark, sf, "activity"))
    times = {c: F.date_format(c, _SECONDS) for c in ("first_ts", "last_ts", "first_start")}
    return spans.withColumns(times)


@_query
def findings_cube(spark, sf):
    return analytics.findings_cube(secret_findings(spark, sf).select("rule_id", "src"))


@_query
def file_coverage(spark, sf):
    made = _traces(spark, sf, "cursor_after_edit", "cursor_tab_edit", "claude_post_tool", "cursor_post_tool")
    edits = made.where(F.col("tool_name").isin("", *rules.WRITE_TOOLS))
    spans = edits.select("path", F.explode("ranges").alias("span")).select("path", "span.*")
    return analytics.file_coverage(spans)


# --- streams --------------------------------------------------------------------

#: Lines of a band in which the last writers are found.
BAND = 4


def _event_stream(spark, sf, name: str = "events") -> DataFrame:
    """A table as a file stream."""
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}*.parquet")


def _streamed(spark, sf) -> dict[str, DataFrame]:
    """Everything that events are made of, as it arrives."""
    events, documents, pages, turns = (_event_stream(spark, sf, t) for t in ("events", "documents", "pages", "conversations"))
    return {
        "pages": pages, "documents": documents,
        "tool_calls": view(spark, sf, "tool_calls", {"events": events}),
        "activity": view(spark, sf, "activity", {"events": events}),
        "files": view(spark, sf, "files", {"documents": documents}),
        "turns": view(spark, sf, "turns", {"conversations": turns}),
    }


def _finish(writer) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


@_query
def edited_stream(spark, sf):
    """Edited sets per stop, batch operators on every micro-batch."""
    folder = run_folder(spark, "edited")
    activity = view(spark, sf, "activity", {"events": _event_stream(spark, sf)})
    writer = edited_streams.StopSetWriter(f"{folder}/sets", f"{folder}/open", CHUNK)
    _finish(
        activity.writeStream.foreachBatch(writer).option(
            "checkpointLocation", f"{folder}/checkpoint"
        )
    )
    return spark.read.parquet(f"{folder}/sets").select("session", "seq", "first_seq", "path")


@_query
def stream_equals_batch(spark, sf):
    """Edited sets of each stop as the batch, the table stream and the keyed stream give them, and by how many."""
    epochs, sets = _edited(spark, sf)
    stops = epochs.where("kind = 'stop'").select("session", "epoch", "seq")
    batch = sets.join(stops, ["session", "epoch"]).select("session", "seq", "first_seq", "path")
    every = batch.unionByName(edited_stream(spark, sf)).unionByName(edited_stream_keyed(spark, sf))
    return every.groupBy("session", "seq", "first_seq", "path").agg(F.count(F.lit(1)).alias("forms"))


PAIR_WITHIN, PAIR_LATE, PAUSE, SPAN_LATE = "30 minutes", "10 minutes", "4 hours", "1 hour"


def _calls_of(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attempts, and completions some minutes later; one call in eight takes longer than is waited for."""
    calls = events.select(
        F.col("user_id").alias("session"), F.concat(F.lit("t"), F.col("event_id")).alias("tool_use_id"),
        F.col("ts").alias("attempted_at"), "event_type", F.col("value").alias("duration_ms"),
        F.expr("ts + make_interval(0, 0, 0, 0, 0, event_id % 32, 0)").alias("completed_at"),
    )
    done = calls.where("event_type <> 'error'").select("session", "tool_use_id", "completed_at", "duration_ms")
    return calls.select("session", "tool_use_id", "attempted_at"), done


@_query
def tool_pairs_stream(spark, sf):
    """Calls and their completions joined as both arrive; calls still open at the end are not given out."""
    folder = run_folder(spark, "pairs")
    attempts, done = _calls_of(_event_stream(spark, sf))
    paired = pairs.paired_calls(attempts, done, PAIR_WITHIN, PAIR_LATE)
    _finish(paired.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp"))
    out = spark.read.schema(paired.schema).parquet(f"{folder}/out")
    return out.select("session", "tool_use_id", "completed", "duration_ms")


@_query
def activity_spans_stream(spark, sf):
    """Stretches of activity, closed by a pause, as a stream; those still open at the end are not given out."""
    folder = run_folder(spark, "spans")
    activity = view(spark, sf, "activity", {"events": _event_stream(spark, sf)})
    made = spans.activity_spans(activity, PAUSE, SPAN_LATE)
    _finish(made.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp"))
    out = spark.read.schema(made.schema).parquet(f"{folder}/out")
    return out.withColumns({c: F.date_format(c, _SECONDS) for c in ("first_ts", "last_ts")})


@_query
def edited_stream_keyed(spark, sf):
    """Edited sets per stop from keyed state."""
    folder = run_folder(spark, "keyed")
    activity = view(spark, sf, "activity", {"events": _event_stream(spark, sf)})
    sets = edited_streams.keyed_stop_sets(activity)
    _finish(
        sets.writeStream.format("parquet").option("path", f"{folder}/sets").option(
            "checkpointLocation", f"{folder}/checkpoint"
        )
    )
    return spark.read.schema(edited_streams.STOP_SET_SCHEMA).parquet(f"{folder}/sets")


@_query
def decision_stream(spark, sf):
    """Every event decided as it arrives."""
    folder = run_folder(spark, "decisions")
    every = [b for names in DECISIONS.values() for b in names]
    events = events_of(spark, sf, *every, given=_streamed(spark, sf))
    detect.scan_files(view(spark, sf, "files")).write.parquet(f"{folder}/file_hits")
    _finish(
        decision_streams.decision_stream(
            events, spark.read.parquet(f"{folder}/file_hits"), f"{folder}/out", f"{folder}/checkpoint", _home(),
            _default_dir(),
        )
    )
    return CommittedTable(spark, f"{folder}/out").read()


@_query
def trace_stream(spark, sf):
    """Every event traced as it arrives."""
    folder = run_folder(spark, "trace-stream")
    events = events_of(spark, sf, *BRANCHES, given=_streamed(spark, sf))
    index = LineIndex.write(view(spark, sf, "files"), f"{folder}/index")
    with long_rows(spark):
        _finish(
            decision_streams.trace_stream(
                events, index, f"{folder}/log", f"{folder}/checkpoint", F.lit(PROJECT), compression=LOG_CODEC
            )
        )
    return _record_columns(read_traces(spark, f"{folder}/log"))
