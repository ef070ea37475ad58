"""Work that is saved changes no result: gates before costly expressions, and steps that are made once."""

from pyspark.sql import functions as F

from tracewarden.functions import policy, secrets, shell
from tracewarden.operators import analytics
from tracewarden.operators.asof import versions_at
from tracewarden.operators.decide import decide, decide_thin, thin_events
from tracewarden.operators.detect import scan_files

T = F.col("t")
COMMANDS = [
    "cat a/b", "CAT a/b x.txt", "xcat a/b", "cat|grep x ./f", "c'a't a/b", 'c"at" ~/n', "c\\at ./x", "ls;cat\t.env", "cat", "  ",
    "", None, "sort<d/e", "echo a/b && wc -l < c/d", "rm x.y", "ls a/b/c", "tr a b", "trx ./q", "cat p/q", "awk p/q", "~",
]


def _plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_read_candidates_are_those_of_both_readings(apply):
    both = F.array_union(shell.paths_by_tokens(shell.shell_tokens(T)), shell.paths_by_regex(T))
    plain = F.coalesce(F.when(T.rlike(r"[^\s  ]"), both), F.array().cast("array<string>"))
    assert apply(shell.read_candidates(T), *COMMANDS) == apply(plain, *COMMANDS)


def test_escaped_parameters_are_judged(apply):
    inputs = ['{"q":"\\u0073udo x"}', '{"q":"sudo x"}', '{"q":"SUDO x"}', '{"q":"x"}', "{'q':'sudo x'}", "nothing", None]
    got = [v and v["reason"] for v in apply(policy.mcp_verdict(T), *inputs)]
    assert got == ["Dangerous pattern in q: Sudo command"] * 3 + [None, got[1], None, None]


def test_texts_are_lowered_once(apply):
    assert secrets.hits_sql("t").count("lower(") == 1
    texts = ["TOKEN = abcdefghijklmnop1", "token=x", "AKIA" + "A" * 16, "nothing", "", None]
    found = [[(h["rule_id"], h["n"]) for h in hits] for hits in apply(secrets.rule_hits(T), *texts)]
    assert found == [[("generic_secret", 1)], [], [("aws_access_key", 1)], [], [], []]


def test_reads_and_versions_are_made_once(spark):
    made = F.sha2(F.col("id").cast("string"), 256)
    rows = spark.range(20)
    reads = rows.select(F.lit("p").alias("path"), F.timestamp_seconds("id").alias("at"), made.alias("key"))
    versions = spark.sql("SELECT 'p' AS path, timestamp_seconds(5) AS valid_from, 3 AS n")
    last = versions_at(reads, versions)
    assert "sha2" not in _plan(last)
    assert sorted(str(r["n"]) for r in last.collect()) == ["3"] * 15 + ["None"] * 5


def test_ranges_are_made_once(spark):
    rows = spark.range(20).select(
        F.left(F.sha2(F.lit("a"), 256), F.lit(4)).alias("path"), (F.col("id") % 5 + 1).cast("int").alias("start_line"),
        (F.pmod(F.hash("id"), F.lit(5)) + 5).alias("end_line"),
    )
    covered = analytics.file_coverage(rows)
    assert "hash(" not in _plan(covered)
    assert [r["edits"] for r in covered.collect()] == [20]


def test_thin_events_decide_the_same_without_their_texts(spark):
    secret = "token = abcdefghijklmnop1"
    names = ["event_uid", "dialect", "event_name", "tool_name", "tool_input", "command", "cwd", "prompt", "user_prompt"]
    rows = [
        ("1", "cursor", "beforeShellExecution", None, None, "cat ./a.txt", "/w", None, None),
        ("2", "cursor", "beforeShellExecution", None, None, "rm -rf /", "/w", None, None),
        ("3", "claude", "PreToolUse", "Read", '{"file_path":"a.txt"}', None, "/w", None, None),
        ("4", "claude", "UserPromptSubmit", None, None, None, None, secret, None),
        ("5", "openclaw", "before_tool_call", "exec", '{"cmd":"cat a.txt"}', None, None, None, None),
        ("6", "cursor", "afterAgentResponse", None, None, None, None, None, None),
        ("1", "cursor", "beforeShellExecution", None, None, "cat ./a.txt", "/w", None, None),
        (None, "cursor", "beforeSubmitPrompt", None, None, None, None, secret, None),
        ("7", "claude", "PreToolUse", "Bash", '{"command":"cat .env"}', None, "/w", None, None),
    ]
    events = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    files = spark.createDataFrame([("/w/a.txt", secret)], "path string, content string")
    places = (F.lit("/home/u"), F.lit("/w"))
    thin = thin_events(events, *places)
    assert not {"prompt", "command", "tool_input", "content"} & set(thin.columns)
    for hits in (scan_files(files), None):
        want = decide(events, None, *places, file_hits=hits).collect()
        assert sorted(map(repr, decide_thin(thin, hits).collect())) == sorted(map(repr, want))
    assert {r["event_uid"]: r["action"] for r in decide_thin(thin, scan_files(files)).collect()} == {
        "1": "block", "2": "block", "3": "block", "4": "block", "5": "block", "6": "allow", None: "block", "7": "warn",
    }
