"""Hook events: one JSON document per agent action, batch or stream."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.text import has_text, trim_space
from ..operators.once import made_once
from . import offset_lines

_RANGE = T.StructType(
    [T.StructField("start_line_number", T.IntegerType()),
     T.StructField("end_line_number", T.IntegerType())]
)
_EDIT = T.StructType(
    [T.StructField("old_string", T.StringType()), T.StructField("new_string", T.StringType()),
     T.StructField("range", _RANGE)]
)
_STRINGS = T.ArrayType(T.StringType())
_BY_TYPE = [
    # Objects asked for as strings arrive as compact JSON text, key order kept.
    (T.StringType(),
     "hook_event_name tool_name tool_input tool_use_id model transcript_path cwd user_prompt "
     "prompt tool_response tool_result tool_output reason trigger notification conversation_id "
     "generation_id file_path content command stdout stderr text message session_id "
     "composer_mode source error_message failure_type subagent_type status "
     "agent_transcript_path agent_message url session_key tool_version timestamp"),
    (T.DoubleType(), "duration duration_ms context_usage_percent"),
    (T.LongType(),
     "timeout context_tokens context_window_size message_count messages_to_compact seq"),
    (T.BooleanType(), "stop_hook_active is_background_agent is_interrupt is_first_compaction"),
    (_STRINGS, "workspace_roots attachments"),
    (T.ArrayType(_EDIT), "edits"),
]

# Every field any dialect reads.
EVENT_FIELDS = T.StructType(
    [T.StructField(name, kind) for kind, names in _BY_TYPE for name in names.split()]
)
_FILE_TIME, _PLACE = "_file_time", "_place"
_OPTIONS = {"mode": "PERMISSIVE", "allowSingleQuotes": "false"}
_ALWAYS = ("hook_event_name", "session_id", "conversation_id", "session_key", "timestamp", "seq")
_PLUGIN = ("toolName", "params", "sessionKey")


def with_event_columns(events: DataFrame) -> DataFrame:
    """Add the event columns a table does not have, as typed NULLs."""
    missing = {
        field.name: F.lit(None).cast(field.dataType)
        for field in EVENT_FIELDS.fields
        if field.name not in events.columns
    }
    return events.withColumns(missing) if missing else events


def parse_hook_events(
    lines: DataFrame, dialect: str, raw: str = "raw", only: Iterable[str] | None = None
) -> DataFrame:
    """Parse raw documents; ``parse_status`` is ok, blank or malformed.

    The plugin dialect sends ``{toolName, params, sessionKey}``; its names are
    mapped to the common ones.  ``only`` names the fields that are read at all,
    besides those that make the columns below.

    Every event gets the columns that later steps order it by, unless the lines
    have them: ``session`` (of the event's session, conversation or plugin key),
    ``received_at`` (its timestamp, else the time of its file) and ``seq`` (its
    own number, else its place in the log, for lines without a place the
    microsecond of ``received_at``).
    """
    text = trim_space(F.col(raw))
    wanted = EVENT_FIELDS
    if only is not None:
        names = {*only, *_ALWAYS}
        wanted = T.StructType([f for f in EVENT_FIELDS.fields if f.name in names])
    plugin = dialect == "openclaw"
    read = T.StructType([*wanted.fields, *(T.StructField(n, T.StringType()) for n in _PLUGIN if plugin)])
    # Boxed in a list, so that text after the first document is an error too;
    # status and document come from one parse.
    boxed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), T.ArrayType(read), _OPTIONS)
    docs = F.when(F.startswith(text, F.lit("{")), boxed)
    once = made_once(lines, lines.columns, {"_blank": ~has_text(F.col(raw)), "_docs": docs})
    status = F.when(F.col("_blank"), "blank").when(F.size("_docs") == 1, "ok").otherwise("malformed")
    parsed = once.select(*lines.columns, status.alias("parse_status"), F.when(status == "ok", F.get("_docs", F.lit(0))).alias("_doc"))
    fields = {f.name: F.col(f"_doc.{f.name}") for f in wanted.fields}
    fields["hook_event_name"] = F.coalesce(fields["hook_event_name"], F.lit(""))
    if plugin:
        fields["hook_event_name"] = F.lit("before_tool_call")
        fields["tool_name"] = F.col("_doc.toolName")
        fields["tool_input"] = F.coalesce("_doc.params", F.lit("{}"))
        fields["session_key"] = F.col("_doc.sessionKey")
    file_time = F.col(_FILE_TIME) if _FILE_TIME in lines.columns else F.lit(None).cast("timestamp")
    given = set(lines.columns)
    time = F.col("received_at") if "received_at" in given else F.coalesce(
        F.try_to_timestamp(fields.pop("timestamp")), file_time
    )
    fields.pop("timestamp", None)
    own_seq = fields.pop("seq")
    added = {
        "received_at": time,
        "session": F.coalesce(
            fields["session_id"], fields["conversation_id"], fields["session_key"], F.lit("")
        ),
        "seq": F.coalesce(own_seq, F.col(_PLACE) if _PLACE in given else F.unix_micros(time)),
    }
    fields |= {name: value for name, value in added.items() if name not in given}
    kept = [c for c in lines.columns if c not in fields and c not in (_FILE_TIME, _PLACE)]
    return parsed.select(
        *kept, "parse_status", F.lit(dialect).alias("dialect"),
        *[value.alias(name) for name, value in fields.items()],
    )


def malformed_response(dialect: Column) -> Column:
    """The fail-open answer to an event that cannot be read."""
    return F.when(dialect == "cursor", F.lit('{"permission":"allow"}'))


def split_malformed(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable events, and a quarantine with the default answer and exit code 0."""
    good = parsed.where(F.col("parse_status") == "ok")
    bad = (
        parsed.where(F.col("parse_status") != "ok")
        .withColumn("response", malformed_response(F.col("dialect")))
        .withColumn("exit_code", F.lit(0))
    )
    return good, bad


def _lines(frame: DataFrame) -> DataFrame:
    """Lines with an id and an order number made from their place, stable over retries.

    Equal lines are different events: a line is known by its file and first byte.
    """
    place = F.shiftleft(F.col("file_no").cast("long"), offset_lines.OFFSET_BITS) + F.col("start")
    return frame.select(
        F.sha2(F.concat_ws("|", "file", "start"), 256).alias("event_uid"),
        F.col("line").alias("raw"), place.alias(_PLACE), F.col("file_time").alias(_FILE_TIME),
    )


def read_hook_events(spark: SparkSession, path: str, dialect: str, **options) -> DataFrame:
    """Events of log files, parsed; lines without a number of their own keep the order of the files."""
    offset_lines.register(spark)
    return parse_hook_events(_lines(spark.read.format(offset_lines.NAME).options(**options).load(path)), dialect)


def stream_hook_events(spark: SparkSession, path: str, dialect: str, numbers: str, **options) -> DataFrame:
    """The same as a stream; ``numbers`` is a folder that only this stream uses."""
    offset_lines.register(spark)
    lines = spark.readStream.format(offset_lines.NAME).options(numbers=numbers, **options).load(path)
    return parse_hook_events(_lines(lines), dialect)
