"""Operator 6: URL filter with a blocked Bloom filter before an exact hash join.

Listed canonical URLs (a host with the path that must be a prefix) are put into a blocked Bloom filter: one
block of 512 bits for each key, ``PROBES`` bits in it.  The filter has a fixed number of blocks, so what every
task holds does not grow with the list; a longer list only makes more false positives, which the exact join on
(host, path) removes.  Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.work import fresh

BLOCKS = 4_096  # 256 KiB
WORDS = 8  # 64-bit words of a block
PROBES = 6

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def url_host(url: Column) -> Column:
    """What stands between the first :// and the next slash, ? or #, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ? or #; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(host: Column, path: Column) -> Column:
    return F.pmod(F.xxhash64(host, path), F.lit(BLOCKS))


def _bits(host: Column, path: Column) -> list[Column]:
    second = F.xxhash64(path, host, F.lit(1))
    return [F.shiftrightunsigned(second, 9 * i).bitwiseAND(F.lit(511)) for i in range(PROBES)]


def bloom(rules: DataFrame) -> DataFrame:
    """One row, one array of BLOCKS * WORDS long values."""
    host, path = F.col("host"), F.col("path")
    bits = rules.select(_block(host, path).alias("block"), F.explode(F.array(*_bits(host, path))).alias("bit"))
    words = bits.groupBy((F.col("block") * WORDS + F.floor(F.col("bit") / 64)).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("mask")
    )
    every = rules.sparkSession.range(BLOCKS * WORDS, numPartitions=1).withColumnRenamed("id", "word")
    dense = every.join(words, "word", "left").select("word", F.coalesce("mask", F.lit(0)).alias("mask"))
    ordered = F.array_sort(F.collect_list(F.struct("word", "mask")))
    return dense.agg(F.transform(ordered, lambda x: x["mask"]).alias("words"))


def possible(words: Column, host: Column, path: Column) -> Column:
    """Whether the filter lets a key pass: always for listed ones."""
    base = _block(host, path) * WORDS
    tests = []
    for bit in _bits(host, path):
        word = F.get(words, (base + F.shiftright(bit, 6)).cast("int"))
        tests.append(F.call_function("getbit", word, bit.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return reduce(lambda a, b: a & b, tests)


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Judge every row's url by the longest rule that fits; adds host, path, rule and verdict.

    rules: host, path, action.  A rule fits its host and all subdomains if the url's path starts with the rule's.
    The longest host and path together win, then the longer host, then block before allow.  No fitting rule: rule
    null, verdict ``default``.  A null url, or one without ``://``, has an empty host and path and fits no rule, as
    does any empty host.  Rules with a null or empty host, or a null action, are ignored; a null path counts as
    empty.  Equal rows stay as they are, other columns pass through, and input columns named like an added one are
    replaced.  Empty tables give no rows, an empty list gives the default for all.
    """
    spark = pages.sparkSession
    rules = (
        rules.where("host != '' and action is not null")
        .select("host", F.coalesce("path", F.lit("")).alias("path"), "action")
        .groupBy("host", "path")
        .agg(F.max("action").alias("action"))
    )
    # A shape is (labels of the host, length of the path): some hundreds at most, however long the list is.
    shapes = rules.select(
        F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("length")
    ).distinct().collect()
    h, p = fresh("host"), fresh("path")
    keyed = pages.withColumns({h: url_host(F.col(url)), p: url_path(F.col(url))})
    seen = keyed.select(F.col(h).alias("host"), F.col(p).alias("path")).where("host != ''").distinct()
    kind = "array<struct<labels:int,length:int>>"
    known = F.array(*[F.struct(F.lit(s["labels"]).alias("labels"), F.lit(s["length"]).alias("length")) for s in shapes])
    labels = F.split("host", r"\.")
    keys = seen.withColumn("shape", F.explode(known.cast(kind))).where(
        (F.size(labels) >= F.col("shape.labels")) & (F.length("path") >= F.col("shape.length"))
    ).select(
        "host",
        "path",
        F.call_function("substring_index", F.col("host"), F.lit("."), -F.col("shape.labels")).alias("rule_host"),
        F.substring("path", F.lit(1), F.col("shape.length")).alias("rule_path"),
    )
    hits = keys.withColumn("words", bloom(rules).scalar()).where(
        possible(F.col("words"), F.col("rule_host"), F.col("rule_path"))
    ).drop("words")
    listed = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "action")
    size = F.length("rule_host") + F.length("rule_path")
    best = (
        hits.join(listed, ["rule_host", "rule_path"])
        .groupBy("host", "path")
        .agg(
            F.max_by(
                F.struct(F.concat("rule_host", "rule_path").alias("rule"), "action"),
                F.struct(size, F.length("rule_host")),
            ).alias("best")
        )
        .select(F.col("host").alias(h), F.col("path").alias(p), "best")
    )
    judged = keyed.join(best, [h, p], "left")
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return judged.select(
        *[F.col(f"`{c}`") for c in keep],
        F.col(h).alias("host"),
        F.col(p).alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"),
    )


def listed_urls(urls: DataFrame, url: str = "url", action: str = "block") -> DataFrame:
    """Rules from a list of whole URLs: their canonical host and path."""
    return urls.select(url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"), F.lit(action).alias("action"))
