"""Golden commands, path policies and tool dispatch."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tracewarden.functions import policy, rules
from tracewarden.plans.views import COMMANDS

T = F.col("t")

# Verdicts of the first 54 commands: "b" block, "w" warn, "-" ok.
GOLDEN = "b" * 30 + "-b-" + "w" * 11 + "-b----" + "--bb"


def verdicts(apply, *values):
    return [(v["severity"], v["reason"]) for v in apply(policy.validate_command(T), *values)]


def test_golden_commands(apply):
    commands = COMMANDS[:54]
    severities = {"b": "block", "w": "warn", "-": "ok"}
    got = [s for s, _ in verdicts(apply, *commands)]
    assert got == [severities[c] for c in GOLDEN]


def test_first_rule_wins_and_reasons(apply):
    got = verdicts(
        apply, "rm -rf /", "rm -rf ~/x", "sudo rm -rf /", "git branch -d old", "cat ~/.ssh/id_rsa",
        "git push --force-with-lease", "", "rm -r -f /",
    )
    assert got == [
        ("block", "Recursive delete from root"), ("block", "Recursive delete from home"),
        ("block", "Recursive delete from root"), ("block", "Git branch delete"),
        ("warn", "SSH directory access"), ("block", "Git force push"), ("ok", ""), ("ok", ""),
    ]


def test_delete_look_ahead_stays_on_its_line(apply):
    got = verdicts(
        apply, "delete from t\nwhere id=1", "delete from t where id=1",
        "delete from a where x; delete from b", "delete from a; delete from b where id=1",
    )
    assert [s for s, _ in got] == ["block", "ok", "block", "ok"]


def test_word_edges_are_ascii_and_space_is_unicode(apply):
    got = verdicts(apply, "ésudo x", "pseudosudo", "rm -rf /", "find . \u0085 -delete")
    assert [s for s, _ in got] == ["block", "ok", "block", "block"]


def test_file_policies(apply):
    write = apply(
        policy.validate_file_write(T), "/etc/passwd", "/tmp/../etc/x", "/etc", "a/../.env", "", "etc/x"
    )
    assert [(v["severity"], v["reason"]) for v in write] == [
        ("block", "Write to protected path: /etc/"), ("block", "Write to protected path: /etc/"),
        ("ok", ""), ("warn", "Environment file access"), ("ok", ""), ("ok", ""),
    ]
    read = apply(policy.validate_file_read(T), "//etc//shadow", "/etc/hosts", "~/.aws/credentials")
    assert [(v["severity"], v["reason"]) for v in read] == [
        ("block", "Read of protected system file: /etc/shadow"),
        ("block", "Read from protected system path: /etc/"), ("warn", "AWS credentials"),
    ]


def test_tool_dispatch(spark):
    rows = [
        ("Bash", '{"command":"rm -rf /"}', "block", "Recursive delete from root"),
        ("bash", '{"command":"rm -rf /"}', "ok", ""),
        ("Write", '{"file_path":"/etc/passwd"}', "block", "Write to protected path: /etc/"),
        ("Read", '{"target_file":"/etc/sudoers"}', "block",
         "Read of protected system file: /etc/sudoers"),
        ("Read", '{"file_path":"","target_file":"/etc/sudoers"}', "ok", ""),
        ("read", '{"file_path":"/etc/shadow"}', "ok", ""),
        ("Task", '{"prompt":"then sudo it"}', "warn", "Prompt contains pattern: Sudo command"),
        ("mcp_x", '{"zeta":"sudo","10":"rm -rf /"}', "block",
         "Dangerous pattern in 10: Recursive delete from root"),
        ("myMCP", '{"n":1,"o":{"q":"sudo"},"a":"ls"}', "ok", ""),
        ("mcp_x", '{"b":"sudo x","a":"rm -rf /"}', "block", "Dangerous pattern in b: Sudo command"),
        ("Bash", "{}", "ok", ""),
        ("Bash", None, "ok", ""),
    ]
    frame = spark.createDataFrame(rows, "tool string, input string, severity string, reason string")
    judged = frame.withColumn("v", policy.validate_tool_input(F.col("tool"), F.col("input")))
    wrong = judged.where("v.severity <> severity or v.reason <> reason").collect()
    assert wrong == []


def test_all_hits_list_every_rule(apply):
    hits = apply(policy.dangerous_hits(T), "sudo rm -rf / && reboot")[0]
    assert [h["rule_no"] for h in hits] == [1, 4, 10, 25]


def test_rules_equal_plain_patterns_on_random_text(apply):
    """The reordered and gated forms answer as the stated patterns do."""
    rng = random.Random(2)
    bits = [
        "find", "Find ", " -delete", "-deleted", "curl", "wget ", "|", "| sh", "|bash", "python3", " -c ", "exec (",
        "exec", "$(", ")", "\n", " ", "x", "dd if=a", " of=/dev/", "base64 -d", "delete from t", " where ", "\r",
        "git clean -xf", "rm -rf", "/", "kill -9", "; ", "DROP  table", "\u2028", "eval $(",
    ]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    stated = [re.compile(_plain(p), re.I | re.A) for p, _ in rules.DANGEROUS_PATTERNS]
    want = [[n for n, p in enumerate(stated, 1) if p.search(t)] for t in texts]
    got = [[h["rule_no"] for h in row] for row in apply(policy.dangerous_hits(T), *texts)]
    assert got == want


def _plain(pattern):
    """Four line terminators and Unicode space, spelled for this regex engine."""
    line, space = "[^\\n\\r\\u2028\\u2029]", "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
    return pattern.replace(".*", line + "*").replace(r"\s", space).replace(r"\S", "[^" + space[1:])


def test_long_line_is_read_once(apply):
    text = "python -c find curl $( " * 40_000
    assert verdicts(apply, text, text + "exec(") == [("ok", ""), ("block", "Python exec injection")]


@pytest.mark.parametrize("document,found", [
    ('{"q":"rm -rf /","n":{"a":1,"a":2}}', "q"),
    ('{"q":"rm -rf /","q":"x"}', None),
    ('{"q":"x","z":"sudo x","q":"rm -rf /"}', "q"),
    ('{"a":"{rm -rf /","n":{"a":1,"a":2}}', "a"),
    ('{"a":{"x":"rm -rf /"},"n":{"a":1,"a":2}}', None),
    ('{"a":"{\\"x\\":\\"rm -rf /\\"}","n":{"a":1,"a":2}}', "a"),
    ('{"10":"sudo x","a":"rm -rf /","2":"reboot"}', "2"),
    ('["rm -rf /"]', None), ("rm -rf /", None), (None, None),
])
def test_parameters_with_repeated_keys(apply, document, found):
    verdict = apply(policy.mcp_verdict(F.col("t")), document)[0]
    assert (verdict and verdict["reason"].startswith(f"Dangerous pattern in {found}: ")) == (True if found else None)
