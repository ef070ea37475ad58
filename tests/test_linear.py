"""Scans of long hostile texts take time in proportion, and find what plain patterns find."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tracewarden.functions import pii, rules, secrets

T = F.col("t")


def test_email_equals_the_plain_rule(apply):
    rng = random.Random(3)
    pieces = ["a", "b1", ".", "-", "_", "%", "+", "@", "@", ".co", ".com", ".c", " ", "é", "x.org", "\n", "|"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))) for _ in range(3_000)]
    texts += ["a@b.com.c@d.org", "..@x.com", "x@y@z.com", "a@b.com@c.org", "-a@b.co", "a@b.com-c@d.com"]
    want = [re.findall(rules.EMAIL_PATTERN, t, re.ASCII) for t in texts]
    assert apply(pii.detect_email(T), *texts) == want
    assert apply(T.rlike(pii._EMAIL), *texts) == [bool(w) for w in want]


def _seconds(spark, expression, text):
    frame = spark.createDataFrame([(text,)], "t string").select(F.length(F.to_json(F.struct(expression.alias("x")))))
    frame.collect()
    started = time.perf_counter()
    frame.collect()
    return time.perf_counter() - started


@pytest.mark.parametrize("make", [
    lambda n: "@ " + "a." * n,
    lambda n: "@ " + "a" * 2 * n,
    lambda n: "x@" + "a." * n,
    lambda n: "a@b." * (n // 2),
])
def test_email_scan_grows_with_the_text(spark, make):
    for expression in (pii.detect_email(T), pii.contains_pii(T)):
        assert _seconds(spark, expression, make(80_000)) < 5


def test_secret_scan_grows_with_the_matches(spark, apply):
    line = "token = \"24be64439e3e49cf46b2d7c90f3602a3\"\n"
    found = apply(secrets.scan_text(T, F.lit("[x]")), line * 200)[0]
    own = [f for f in found if f["rule_id"] == "generic_secret"]
    assert [(f["ordinal"], f["line"]) for f in own] == [(i + 1, i + 1) for i in range(200)]
    assert [f["start"] for f in own] == [i * len(line) + 1 for i in range(200)]
    few, many = (_seconds(spark, secrets.scan_text(T, F.lit("[x]")), line * n) for n in (4_000, 32_000))
    assert many < 20 * few + 3
