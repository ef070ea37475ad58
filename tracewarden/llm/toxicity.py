"""Operator 5: toxicity classifier regularised by counterfactuals.

A logistic model over the words of a text and their beginnings.  Labelled texts that mention a group are read a
second time with the mention swapped for another one of its kind; the fit penalises any change of the score between
the two readings, so a mention alone cannot carry weight and neutral texts about a group are not flagged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.work import (
    CHUNK_BYTES,
    byte_table,
    fresh,
    grams,
    mix,
    prefix_digest,
    small_batches,
    span_digest,
    staged,
    utf8_parts,
)

#: Labelled texts of each class that the fit uses at most, and features it may choose.
FIT_ROWS, FEATURES = 6_000, 5_000
#: Least evidence (G statistic) and number of texts of a chosen feature.
EVIDENCE, SUPPORT = 10.0, 3
#: Bytes at the beginning of a word that make features of their own.
HEADS = (4, 5, 6, 7)

#: Terms that name a group, in four languages; those of one kind can stand for each other.  Fixed words.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("immigrants", "natives", "refugees"),
    ("old", "young"),
    ("femmes", "hommes"),
    ("filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "arabes"),
    ("immigrés", "réfugiés"),
    ("frauen", "männer"),
    ("mädchen", "jungen"),
    ("muslime", "christen", "juden", "hinduisten", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten", "araber"),
    ("einwanderer", "einheimische", "flüchtlinge"),
    ("mujeres", "hombres"),
    ("chicas", "chicos"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "árabes"),
    ("inmigrantes", "nativos", "refugiados"),
)

_TABLE = byte_table(lambda c: c >= 0x80 or 0x61 <= c <= 0x7A or 0x41 <= c <= 0x5A)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Digests of words and word beginnings of lower-cased texts with the row of each; repeats are kept."""
    data, offsets = utf8_parts(column)
    inside = _TABLE[0][data] if len(data) else np.zeros(0, bool)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    found, rows, at = [], [], 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + CHUNK_BYTES, side="right")))
        low = start[at]
        prefix = prefix_digest(_TABLE[1][data[low : end[to - 1]]])
        s, e = start[at:to] - low, end[at:to] - low
        found.append(span_digest(prefix, s, e))
        rows.append(row[at:to])
        for size in HEADS:
            longer = np.flatnonzero(e - s > size)
            found.append(mix(span_digest(prefix, s[longer], s[longer] + size) + np.uint64(size)))
            rows.append(row[at:to][longer])
        at = to
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(rows)


def _lists(ids: np.ndarray, rows: np.ndarray, count: int) -> pa.ListArray:
    """Each row's distinct ids."""
    order = np.lexsort((ids, rows))
    ids, rows = ids[order], rows[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1])
    ends = np.searchsorted(rows[new], np.arange(count + 1))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids[new].view(np.int64)))


def _smallest_shingle(words: np.ndarray) -> np.int64:
    size = min(5, len(words))
    return grams(words, size).min().view(np.int64) if size else np.int64(0)


def _swaps(kinds: tuple[tuple[str, ...], ...]) -> tuple[re.Pattern | None, dict[str, str]]:
    other = {term: kind[(i + 1) % len(kind)] for kind in kinds for i, term in enumerate(kind)}
    words = "|".join(sorted(map(re.escape, other), key=len, reverse=True))
    return (re.compile(rf"(?<!\w)(?:{words})(?!\w)") if words else None), other


@dataclass
class Model:
    ids: np.ndarray  # sorted digests of the features
    weights: np.ndarray
    base: float

    def scores(self, column: pa.Array) -> np.ndarray:
        """Between 0 and 1 for every row; higher is likelier toxic."""
        logits = np.full(len(column), self.base)
        if len(self.ids):
            ids, rows = features(column)
            sieve = np.zeros(1 << 20, bool)  # most features are none of the model's
            sieve[(self.ids >> np.uint64(44)).astype(np.int64)] = True
            near = np.flatnonzero(sieve[(ids >> np.uint64(44)).astype(np.int64)])
            ids, rows = ids[near], rows[near]
            at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
            hit = self.ids[at] == ids
            pairs = np.unique(rows[hit] * len(self.ids) + at[hit])
            np.add.at(logits, pairs // len(self.ids), self.weights[pairs % len(self.ids)])
        return 1 / (1 + np.exp(-np.clip(logits, -500, 500)))


def fit_logistic(
    rows: np.ndarray, columns: np.ndarray, labels: np.ndarray, width: int, changes: tuple, ridge: float, swap: float, steps: int = 400
) -> tuple[np.ndarray, float]:
    """Weights and base of a sparse 0/1 design; changes: (pair, column, sign) of swapped readings."""
    n, weights, base = len(labels), np.zeros(width), 0.0
    pair, changed, sign = changes
    pairs = int(pair.max()) + 1 if len(pair) else 0
    share = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, n - labels.sum()))
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        logits = np.bincount(rows, weights[columns], minlength=n) + base
        error = (1 / (1 + np.exp(-np.clip(logits, -500, 500))) - labels) * share
        slope = np.bincount(columns, error[rows], minlength=width) + ridge * weights
        if pairs:
            drift = np.bincount(pair, sign * weights[changed], minlength=pairs)
            slope += 2 * swap / pairs * np.bincount(changed, sign * drift[pair], minlength=width)
        slope = np.append(slope, error.sum())
        first += 0.1 * (slope - first)
        second += 0.001 * (slope * slope - second)
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-12)
        weights -= move[:-1]
        base -= move[-1]
    return weights, base


def train(
    documents: DataFrame,
    labels: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    label: str = "toxic",
    fit_rows: int = FIT_ROWS,
    kinds: tuple[tuple[str, ...], ...] = IDENTITY_TERMS,
    ridge: float = 2e-4,
    swap: float = 1.0,
) -> Model:
    """Fit on at most ``fit_rows`` labelled texts of each class (those with the smallest id digests).

    A label is 1 if any row of its id has 1, else 0; rows with a null id or label are ignored, and so are ids
    without a document.  Copies and texts with the same smallest shingle count once.  Without texts of both classes
    the model is a constant.  Both classes weigh
    alike in the fit; the base is then moved half the way towards their share among the labels.
    """
    spark = documents.sparkSession
    small_batches(spark)
    known = (
        labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(doc_id).alias("id"))
        .agg(F.max(F.col(label).cast("int")).alias("y"))
    )
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    ones, zeros = counts.get(1, 0), counts.get(0, 0)
    if not ones or not zeros:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 30.0 if ones else -30.0)
    some = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(fit_rows) for y in (0, 1)]
    chosen = some[0].unionByName(some[1])  # at most 2 * fit_rows rows
    texts = documents.select(F.col(doc_id).alias("id"), F.lower(text).alias("text")).where("text is not null")
    texts = texts.join(F.broadcast(chosen), "id")
    pattern, other = _swaps(kinds)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            ids, rows = features(column)
            swapped = [pattern.sub(lambda m: other[m[0]], t) if pattern else t for t in column.to_pylist()]
            changed = pa.array([t if t != old else None for t, old in zip(swapped, column.to_pylist(), strict=True)], pa.string())
            again, at = features(changed)
            mask = np.array([not v.is_valid for v in changed], bool) if len(changed) else np.zeros(0, bool)
            own, swaps = _lists(ids, rows, len(column)), _lists(again, at, len(column))
            swaps = pa.ListArray.from_arrays(swaps.offsets, swaps.values, mask=pa.array(mask)) if len(mask) else swaps
            order = np.argsort(rows, kind="stable")
            words = ids[order]
            edges = np.searchsorted(rows[order], np.arange(len(column) + 1))
            key = [int(_smallest_shingle(words[a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(2).cast(pa.int32()), pa.array(key, pa.int64()), own, swaps], ["id", "y", "key", "own", "swapped"])

    sample = staged(
        texts.select(F.col("id").cast("string").alias("id"), "text", "y")
        .mapInArrow(read, "id string, y int, key long, own array<long>, swapped array<long>")
        .groupBy("y", "key")
        .agg(F.min_by(F.struct("id", "own", "swapped"), "id").alias("row"))
        .select("y", "row.*"),
        "toxicity-sample",
    )
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(ones / zeros)))
    ids = _choose(sample, sizes)
    own, pairs = fresh("own"), fresh("swapped")
    table = spark.sparkContext.broadcast(ids)

    @F.arrow_udf("array<int>")
    def known_only(column: pa.Array) -> pa.Array:
        column = column.fill_null([]) if column.null_count else column
        values = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        sizes = np.diff(column.offsets.to_numpy())
        rows = np.repeat(np.arange(len(column)), sizes)
        at = np.minimum(np.searchsorted(table.value, values), max(0, len(table.value) - 1))
        hit = table.value[at] == values if len(table.value) else np.zeros(len(values), bool)
        ends = np.searchsorted(rows[hit], np.arange(len(column) + 1))
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(at[hit].astype(np.int32)))

    thin = sample.select("y", "id", known_only("own").alias(own), F.when(F.col("swapped").isNotNull(), known_only("swapped")).alias(pairs))
    fitted = sorted(thin.collect(), key=lambda r: (r["y"], r["id"]))  # at most 2 * fit_rows rows of chosen features
    rows = np.repeat(np.arange(len(fitted)), [len(r[own]) for r in fitted])
    columns = np.array([c for r in fitted for c in r[own]], dtype=np.int64)
    y = np.array([r["y"] for r in fitted], dtype=np.float64)
    change = [
        (i, c, 1.0 if c in before else -1.0)
        for i, (before, after) in enumerate((set(r[own]), set(r[pairs])) for r in fitted if r[pairs] is not None)
        for c in sorted(before ^ after)
    ]
    pair, changed, sign = (np.array(v) for v in zip(*change, strict=True)) if change else (np.zeros(0, np.int64),) * 3
    weights, base = fit_logistic(rows, columns, y, len(ids), (pair, changed, sign), ridge, swap)
    return Model(ids, weights, base + 0.5 * float(np.log(ones / zeros)))


def _choose(sample: DataFrame, sizes: dict[int, int]) -> np.ndarray:
    """The FEATURES features that tell the classes apart best."""
    each = sample.select("y", F.explode("own").alias("id")).groupBy("id").agg(
        F.count_if(F.col("y") == 1).alias("a"), F.count_if(F.col("y") == 0).alias("b")
    )
    total = F.lit(float(sizes[0] + sizes[1]))

    def part(seen, own: int, of):
        return F.when(seen > 0, seen * F.log(seen * total / (F.lit(float(own)) * of))).otherwise(F.lit(0.0))

    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    having, lacking = a + b, total - a - b
    g = 2 * (
        part(a, sizes[1], having) + part(b, sizes[0], having) + part(sizes[1] - a, sizes[1], lacking) + part(sizes[0] - b, sizes[0], lacking)
    )
    best = each.where((having >= SUPPORT) & (g >= EVIDENCE)).orderBy(g.desc(), "id").limit(FEATURES).select("id").collect()
    return np.sort(np.array([r["id"] for r in best], dtype=np.int64).view(np.uint64))


def score_toxicity(
    documents: DataFrame, model: Model, text: str = "text", limit: float = 0.5, score: str = "score", predicted: str = "predicted"
) -> DataFrame:
    """Add score (0 to 1) and predicted (1 if score >= limit) from the whole text alone.

    Null and empty texts get the score of a text without features.  Equal texts score alike; an empty table gives no
    rows; other columns pass through, and input columns named like an added one are replaced.
    """
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(shared.value.scores(batch))

    scored = documents.withColumn(score, scores(F.lower(F.coalesce(F.col(text), F.lit("")))))
    return scored.withColumn(predicted, (F.col(score) >= limit).cast("int"))


def drop_toxic(documents: DataFrame, model: Model, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The documents that the model does not predict, with all their columns as they were, whatever their names."""
    score, predicted = fresh("score"), fresh("predicted")
    return score_toxicity(documents, model, text, limit, score, predicted).where(F.col(predicted) == 0).drop(score, predicted)


def held_out(doc_id: str = "doc_id"):
    """Rows that no model may learn from: crc32 of the id as text is divisible by 5; never for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))
