"""Helpers of the operators: written intermediate tables, free column names, word digests."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.plans.session import run_folder

#: Rows that Arrow hands to a Python worker at once; long texts make larger batches costly.
ARROW_ROWS = 1_000
#: Words of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes whose word digests are computed at once.
CHUNK_BYTES = (2 << 20) - 256

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(frame: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write a frame below the shared checkpoint folder and read it back: its lineage ends there."""
    return staged_at(frame, name, compression=compression)[0]


def staged_at(frame: DataFrame, name: str, by: str | None = None, compression: str | None = None) -> tuple[DataFrame, str]:
    """The same with the folder, which has one for each value of the column ``by``."""
    spark = frame.sparkSession
    folder = run_folder(spark, name)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")  # the table replaces the shuffles it was made of
    try:
        (frame.write.partitionBy(by) if by else frame.write).parquet(folder, compression=compression)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(frame.schema).parquet(folder), folder


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a written table, or a part of one, that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound what one Arrow batch holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def fresh(name: str) -> str:
    """A column name that no input has."""
    return f"__{name}_{uuid.uuid4().hex[:8]}"


def word_count(text):
    """Words of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def column_or_null(frame: DataFrame, name: str, kind: str):
    return F.col(name) if name in frame.columns else F.lit(None).cast(kind)


def join_counted(rows: DataFrame, counted: DataFrame, key: str | list[str], spread: list[str]) -> DataFrame:
    """Rows with the columns of their key, where the key is counted; part: which of the key's ``parts`` a row is dealt to.

    Keys with more than one part must be few by construction, each a fixed share of all rows: they are known to every
    task, and their rows are dealt to parts by a digest of the columns ``spread``, so no key is ever one task.
    """
    keys = [key] if isinstance(key, str) else key
    few = counted.where("parts > 1").select(*keys, F.col("parts").alias("of"))
    part = F.coalesce(F.pmod(F.xxhash64(*spread), F.col("of")), F.lit(0)).cast("int")
    marked = rows.join(F.broadcast(few), keys, "left").withColumn("part", part).drop("of")
    return marked.join(counted.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), [*keys, "part"])


def meet_blocks(
    points: DataFrame, asked: DataFrame, blocks: int, build: Callable, search: Callable, schema: str, batch: int = 1_024
) -> DataFrame:
    """Every row of ``asked`` meets every block of ``points``; both have id and values, and other columns of one type.

    A task holds one block at a time: ``build`` makes it from its record batches once, then ``search(block, batch)``
    gives the arrays of ``schema`` for the asked rows as they come, a batch at a time.  So points cross the shuffle once,
    asked rows once for each block, and memory is bounded by a block, whatever the number of either.
    """
    names = [*asked.columns]
    missing = [F.lit(None).cast(dict(asked.dtypes)[c]).alias(c) for c in names if c not in points.columns]
    block = F.pmod(F.xxhash64("id", "values"), F.lit(blocks)).cast("int").alias("block")
    mine = points.select("*", *missing).select(*names, block, F.lit(False).alias("asks"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    theirs = asked.select(*names, every, F.lit(True).alias("asks"))
    dealt = mine.unionByName(theirs).repartition(blocks, "block").sortWithinPartitions("block", "asks", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        block, number = None, None
        for rows in batches:
            numbers, asks = rows.column("block").to_numpy(), rows.column("asks").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for low, high in zip([0, *edges], [*edges, len(rows)], strict=True):
                part = rows.slice(low, high - low)
                if number != numbers[low]:
                    held, block, number = [], None, numbers[low]
                if not asks[low]:
                    held.append(part)
                    continue
                if held:
                    block, held = build(pa.Table.from_batches(held)), []
                if block is not None:  # else no row stands in this block
                    yield search(block, part)

    small_batches(dealt.sparkSession, batch)
    return dealt.mapInArrow(run, schema)


def matrix(column: pa.Array | pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Lists of numbers as rows of a matrix, shorter ones with zeros behind, longer ones cut at a width if it is given."""
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    width = width or int(sizes.max(initial=0))
    out = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(column)), sizes)
    step = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row[step < width], step[step < width]] = column.flatten().to_numpy()[step < width]
    return out


# Word digests, computed for all bytes of a batch at once.

_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


@cache
def _byte_values() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: np.uint64, count: int) -> np.ndarray:
    """base ** 0 .. base ** (count - 1) modulo 2 ** 64."""
    size = 1 << max(16, (count - 1).bit_length())
    return (_powers(int(base), size) if size <= 1 << 24 else _powers.__wrapped__(int(base), size))[:count]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_digest(data: np.ndarray) -> np.ndarray:
    """out[i]: polynomial digest of data[:i]; span_digest takes those of its parts from it."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_byte_values()[data] * powers(_STEP, len(data)), out=out[1:]) if len(data) else None
    return out


def span_digest(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Digest of each span, the same wherever equal bytes stand."""
    return mix((prefix[end] - prefix[start]) * powers(_BACK, len(prefix))[start])


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset at which each row begins, and the end; null is empty."""
    column = column.cast(pa.large_utf8()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_table(is_word, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """For every byte: does it belong to a word, and what it counts as."""
    codes = np.arange(256, dtype=np.uint8)
    folded = codes.copy()
    if lower:
        folded[ord("A") : ord("Z") + 1] += 32
    return np.array([is_word(int(c)) for c in codes]), folded


def words(data: np.ndarray, offsets: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Digest of every word of every row, and the index at which each row's words begin, and the end."""
    inside = table[0][data] if len(data) else np.zeros(0, bool)
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + CHUNK_BYTES, side="right")))
        low = start[at]
        prefix = prefix_digest(table[1][data[low : end[to - 1]]])
        out[at:to] = span_digest(prefix, start[at:to] - low, end[at:to] - low)
        at = to
    return out, np.searchsorted(start, offsets)


_JOIN = np.uint64(0xD6E8FEB86659FD93)


def grams(digests: np.ndarray, size: int) -> np.ndarray:
    """Digest of every run of size consecutive words, whatever row they are in."""
    count = len(digests) - size + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = digests[:count].copy()
    for k in range(1, size):
        out *= _JOIN
        out += digests[k : k + count]
    return mix(out ^ np.uint64(size * 0x9E3779B9))
