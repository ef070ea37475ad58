"""Operator 10: benchmark decontamination by winnowing.

Every run of WINDOW words keeps the smallest digest of its GRAM-word grams as its fingerprint, so two texts that
share a run share the fingerprint.  Fingerprints of the benchmark go into a bitmap of fixed size, which lets a
document's fingerprints pass before they leave its task; the rest meet the benchmark's in an equi-join that also
extends each hit to the whole run.  Items shorter than a run are one run of their own length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.work import byte_table, fresh, grams, small_batches, staged, utf8_parts, words

WINDOW, GRAM = 13, 8
#: Bits of the bitmap: 2 MiB for every worker, whatever the benchmark's size.
BITS = 24

_TABLE = byte_table(lambda c: c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or 0x41 <= c <= 0x5A)

_HIT = "array<struct<start:int,length:int,print:bigint,run:bigint>>"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _fingerprints(digests: np.ndarray) -> np.ndarray:
    """For every run of WINDOW words, the smallest digest of its grams."""
    out = grams(digests, GRAM)
    width, have = WINDOW - GRAM + 1, 1
    while have < width:  # minima of runs of doubling width
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _bit(prints: np.ndarray) -> np.ndarray:
    return prints >> np.uint64(64 - BITS)


class Scanner:
    """Finds the runs of documents whose fingerprints the bitmap lets pass."""

    def __init__(self, bitmap: np.ndarray, lengths: list[int]):
        self.bitmap, self.lengths = bitmap, lengths

    def _passes(self, prints: np.ndarray) -> np.ndarray:
        at = _bit(prints)
        word = self.bitmap[(at >> np.uint64(6)).astype(np.int64)]
        return (word >> (at & np.uint64(63))) & np.uint64(1) != 0

    def __call__(self, column: pa.Array) -> pa.Array:
        data, offsets = utf8_parts(column)
        digests, bounds = words(data, offsets, _TABLE)
        found = []
        for length in self.lengths:
            prints = _fingerprints(digests) if length == WINDOW else grams(digests, length)
            at = np.flatnonzero(self._passes(prints)) if len(prints) else np.zeros(0, np.int64)
            row = np.searchsorted(bounds, at, side="right") - 1
            inside = at + length <= bounds[row + 1]
            at, row = at[inside], row[inside]
            runs = grams(digests, length)[at] if len(at) else np.zeros(0, np.uint64)
            found.append((row, at - bounds[row], np.full(len(at), length), prints[at], runs))
        row, start, length, prints, runs = map(np.concatenate, zip(*found, strict=True)) if found else [np.zeros(0, np.uint64)] * 5
        order = np.argsort(row, kind="stable")
        ends = np.searchsorted(row[order], np.arange(len(column) + 1))
        hits = pa.StructArray.from_arrays(
            [
                pa.array(start[order].astype(np.int32)),
                pa.array(length[order].astype(np.int32)),
                pa.array(_signed(prints[order].astype(np.uint64))),
                pa.array(_signed(runs[order].astype(np.uint64))),
            ],
            ["start", "length", "print", "run"],
        )
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), hits)
        return pa.StructArray.from_arrays([pa.array(np.diff(bounds).astype(np.int64)), lists], ["n_words", "hits"])


def benchmark_runs(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Every run of every item: item (id as text), length, print, run."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, bounds = words(*utf8_parts(batch.column(1)), _TABLE)
            for i, (low, high) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                own = digests[low:high]
                if not len(own):
                    continue
                length = min(len(own), WINDOW)
                run = grams(own, length)
                prints = _fingerprints(own) if length == WINDOW else run
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0)[i].as_py()] * len(run), pa.string()),
                        pa.array(np.full(len(run), length, np.int32)),
                        pa.array(_signed(prints)),
                        pa.array(_signed(run)),
                    ],
                    ["item", "length", "print", "run"],
                )

    small_batches(items.sparkSession)
    named = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(text).alias("text"))
    return named.mapInArrow(runs, "item string, length int, print long, run long").distinct()


def _bitmap(runs: DataFrame) -> np.ndarray:
    """The bitmap of the fingerprints: at most 2 ** (BITS - 6) rows come to the driver."""
    at = F.shiftrightunsigned("print", 64 - BITS)
    rows = (
        runs.groupBy(F.shiftright(at, 6).alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))).alias("mask"))
        .collect()
    )
    out = np.zeros(1 << (BITS - 6), np.int64)
    for row in rows:
        out[row["word"]] = row["mask"]
    return out.view(np.uint64)


def find_contamination(
    documents: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Judge every document's text; returns its other columns with n_words, n_hit, n_items, items and contaminated.

    Words are runs of ASCII letters, digits and characters beyond ASCII; A-Z count as a-z.  A run is WINDOW
    consecutive words of an item, or the whole of an item of fewer words.  A document's word is hit if it stands in
    an occurrence of a run.  items: ids, as text, of the items with occurring runs, sorted; equal ids are one item,
    a null id is ``null``.  contaminated: n_hit > 0 and 20 * n_hit >= n_words.  Null and empty texts have no words
    and are clean; items without words are ignored; an empty benchmark leaves every document clean.  Equal rows are
    judged alike; input columns named like an added one are replaced.  The text column is not returned.
    """
    spark = documents.sparkSession
    small_batches(spark)
    runs = staged(benchmark_runs(items, item_id, item_text), "benchmark-runs")
    lengths = sorted(r[0] for r in runs.select("length").distinct().collect())  # at most WINDOW values
    bitmap = spark.sparkContext.broadcast(_bitmap(runs))

    @F.arrow_udf(f"struct<n_words:bigint,hits:{_HIT}>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(bitmap.value, lengths)
        for batch in batches:
            yield scanner(batch)

    added = ("n_words", "n_hit", "n_items", "items", "contaminated")
    scanned, key = fresh("scan"), fresh("text")
    keep = [c for c in documents.columns if c != text and c not in added]
    passed = [F.col(f"`{c}`") for c in keep]
    rows = staged(
        documents.select(*passed, scan(F.col(text)).alias(scanned), F.sha1(F.coalesce(text, F.lit(""))).alias(key)),
        "scanned-documents",
    )
    hits = f"{scanned}.hits"
    n_words = F.col(f"{scanned}.n_words").alias("n_words")
    clean = rows.where(F.size(hits) == 0).select(
        *passed,
        n_words,
        F.lit(0).cast("long").alias("n_hit"),
        F.lit(0).cast("long").alias("n_items"),
        F.array().cast("array<string>").alias("items"),
        F.lit(False).alias("contaminated"),
    )
    suspects = rows.where(F.size(hits) > 0)
    # Copies of one text are looked up once.
    texts = suspects.groupBy(key).agg(F.any_value(hits).alias("hits")).select(key, F.explode("hits").alias("hit"))
    flat = texts.select(key, "hit.*")
    on = ["length", "print", "run"]
    covered = (
        flat.join(runs.select(*on).distinct(), on, "left_semi")
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("spans"))
        .select(key, _covered("spans").alias("n_hit"))
    )
    items_of = flat.join(runs, on).groupBy(key).agg(F.array_sort(F.collect_set("item")).alias("items"))
    judged = (
        suspects.join(covered.join(items_of, key), key, "left")
        .withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "items": F.coalesce("items", F.array().cast("array<string>"))})
        .select(
            *passed,
            n_words,
            "n_hit",
            F.size("items").cast("long").alias("n_items"),
            "items",
            ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col(f"{scanned}.n_words"))).alias("contaminated"),
        )
    )
    return clean.unionByName(judged)


def _covered(spans: str):
    """Words inside sorted spans, each word once."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end"))
    return F.aggregate(
        spans,
        start,
        lambda a, x: F.struct(
            (a["sum"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["end"], x["start"]))).alias("sum"),
            F.greatest(a["end"], x["end"]).alias("end"),
        ),
        lambda a: a["sum"],
    )


def drop_contaminated(documents: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents that find_contamination judges clean, unchanged."""
    key = fresh("text")
    keyed = documents.select(F.sha1(F.coalesce(text, F.lit(""))).alias(key), F.col(text).alias("text"))
    bad = find_contamination(keyed, items).where("contaminated").select(key).distinct()
    bad = staged(bad, "contaminated-texts")
    return documents.withColumn(key, F.sha1(F.coalesce(text, F.lit("")))).join(bad, key, "left_anti").select(*documents.columns)
