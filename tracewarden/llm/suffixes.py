"""Operator 4: exact removal of repeated byte strings with a logarithmic family of sparse suffix arrays.

Every string of LENGTH bytes has an anchor: the place of its smallest GRAM-byte gram, which its bytes alone decide.
The strings that share an anchor form a segment.  A suffix array holds one entry per distinct segment, ordered by the
bytes of the suffix at its anchor (GRAM of them) and a digest of the whole segment, with its first place.  A string has
_SIDE bytes more on one side of the gram at least; digests of these sides tell which segments can share a string at all.

A new batch of documents gets its suffix array and is merge-scanned against the levels of the index: a segment that
stands there, or earlier in the batch, is a repeat as a whole; a segment whose suffix is shared by others stays open.
The batch then becomes a level, and levels of equal size merge, so n batches leave at most log2(n) + 1 levels.  Bytes
are fetched for the sides of open segments that stand in others too, and all their strings are compared, side by side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.llm.work import (
    _BACK,
    discard,
    fresh,
    join_counted,
    mix,
    powers,
    prefix_digest,
    small_batches,
    span_digest,
    staged,
    staged_at,
    utf8_parts,
)

LENGTH, GRAM = 100, 16
#: Bytes whose anchors are found at once, rows of a suffix array read at once, sides of segments compared at once.
PIECE, ROWS, OPEN = (1 << 19) - 256, 2_000, 20_000
#: A side that stands in more than one of so many of all compared ones is dealt to parts of that size, but not smaller.
SHARE, LEAST = 1_024, 200
#: Bits of the sieve that keeps documents without repeats from being shuffled.
SIEVE = 24

_WIDE = LENGTH - GRAM + 1
_LOCAL = np.uint64((1 << 23) - 1)

#: Bytes beside the gram that every string has on one side of it at least.
_SIDE = (LENGTH - GRAM) // 2

# An entry's place: start in the document << 32 | anchor's offset << 8 | length of the segment; its sides: digest of the
# left one << 32 | of the right one.
_ENTRY = "g0 long, g1 long, digest long, doc long, place long, sides long, tag int"
_ORDER = ["g0", "g1", "digest", "doc", "place"]
_NAMES = [*_ORDER, "sides"]
_HALF = np.uint64((1 << 32) - 1)
_OLD, _NEW, _DONE = 0, 1, 2  # tags: of a level, of the batch, found to repeat within its Arrow batch


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def segments(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All segments of the rows: row, start in the row, length, anchor's offset, sides, gram (two ordered integers), digest."""
    parts = [_segments_of(data, offsets, low) for low in range(0, max(0, len(data) - LENGTH + 1), PIECE)]
    names = ("row", "start", "length", "offset", "sides", "g0", "g1", "digest")
    if not parts:
        return {n: np.zeros(0, np.int64) for n in names}
    return {n: np.concatenate(column) for n, column in zip(names, zip(*parts, strict=True), strict=True)}


def _segments_of(data: np.ndarray, offsets: np.ndarray, low: int) -> tuple[np.ndarray, ...]:
    """Segments of the strings that begin in one piece."""
    part = data[low : low + PIECE + LENGTH - 1]
    windows = len(part) - LENGTH + 1
    prefix = prefix_digest(part)
    grams = len(part) - GRAM + 1
    value = mix((prefix[GRAM:] - prefix[:-GRAM]) * powers(_BACK, grams))
    value = (value & ~_LOCAL) | np.arange(grams, dtype=np.uint64)
    have = 1
    while have < _WIDE:
        step = min(have, _WIDE - have)
        value = np.minimum(value[: len(value) - step], value[step:])
        have += step
    anchor = (value & _LOCAL).astype(np.int64)
    # Strings do not cross rows.
    inside = np.zeros(windows + 1, np.int32)
    first, last = np.maximum(offsets[:-1] - low, 0), np.minimum(offsets[1:] - low - LENGTH + 1, windows)
    some = first < last
    np.add.at(inside, first[some], 1)
    np.add.at(inside, last[some], -1)
    valid = np.cumsum(inside[:-1]) > 0
    row_begins = np.zeros(windows, bool)
    row_begins[first[some]] = True
    change = np.ones(windows, bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1]) | row_begins[1:]
    begin = np.flatnonzero(change)
    end = np.append(begin[1:], windows)
    begin, end = begin[valid[begin]], end[valid[begin]]
    at = anchor[begin]
    stop = end + LENGTH - 1
    gram = part[at[:, None] + np.arange(GRAM)].view(">u8").astype(np.uint64)
    # Signed integers in the order of the bytes.
    gram = _signed(gram ^ np.uint64(1 << 63)).reshape(-1, 2)
    row = np.searchsorted(offsets, begin + low, side="right") - 1
    left = span_digest(prefix, np.maximum(at - _SIDE, 0), at) & _HALF
    right = span_digest(prefix, at, np.minimum(at + GRAM + _SIDE, len(part))) & _HALF
    # A side that leaves the segment says nothing, and would depend on the neighbours of the row.
    left[at - begin < _SIDE] = 0
    right[stop - at < GRAM + _SIDE] = 0
    sides = _signed(left << np.uint64(32) | right)
    return row, begin + low - offsets[row], stop - begin, at - begin, sides, gram[:, 0], gram[:, 1], _signed(span_digest(prefix, begin, stop))


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of documents (doc, text); repeats within an Arrow batch are told apart at once."""
    for batch in batches:
        found = segments(*utf8_parts(batch.column(1)))
        doc = batch.column(0).to_numpy()[found["row"]]
        place = found["start"] << 32 | found["offset"] << 8 | found["length"]
        order = np.lexsort((place, doc, found["digest"], found["g1"], found["g0"]))
        g0, g1, digest, doc, place, sides = (x[order] for x in (found["g0"], found["g1"], found["digest"], doc, place, found["sides"]))
        again = np.zeros(len(g0), bool)
        again[1:] = (g0[1:] == g0[:-1]) & (g1[1:] == g1[:-1]) & (digest[1:] == digest[:-1])
        # A row that repeats its document as a whole is the same place, not a later one.
        again[1:] &= (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])
        g0, g1 = np.where(again, mix(doc.view(np.uint64)).view(np.int64), g0), np.where(again, place, g1)
        tag = np.where(again, _DONE, _NEW).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g0, g1, digest, doc, place, sides, tag)], [*_NAMES, "tag"])


_FOUND = "g0 long, g1 long, digest long, doc long, place long, sides long, kind string"


def _sharing(group: np.ndarray, place: np.ndarray, sides: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Which segments may share a string with another one of their suffix, one of the two being new.

    A string has _SIDE bytes left or right of the gram, so both segments have the same digest on that side.
    """
    out = np.zeros(len(group), bool)
    offset, length = place >> 8 & 255, place & 255
    for shift, usable in ((32, offset >= _SIDE), (0, length - offset > GRAM + _SIDE)):
        at = np.flatnonzero(usable)
        _, side = np.unique(group[at] << 32 | sides[at] >> shift & 0xFFFFFFFF, return_inverse=True)
        out[at] |= (np.bincount(side)[side] > 1) & (np.bincount(side, new[at])[side] > 0) if len(at) else False
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge-scan entries in suffix order: kind index (new entries), repeat or open (places)."""
    names = _NAMES
    last = None  # the segment that the previous row belongs to: g0, g1, digest, first doc and place
    shared, waiting = 0, None  # segments of its suffix so far; the only one, while it is the only one

    def out(kind: str, rows: dict[str, np.ndarray], at) -> pa.RecordBatch:
        columns = [pa.array(rows[n][at]) for n in names]
        if kind == "repeat":  # only its place is needed
            columns = [c if n in ("doc", "place") else pa.nulls(len(c), pa.int64()) for n, c in zip(names, columns, strict=True)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([kind] * len(columns[0]), pa.string())], [*names, "kind"])

    for batch in batches:
        rows = {n: batch.column(n).to_numpy() for n in names}
        tag = batch.column("tag").to_numpy()
        done = tag == _DONE
        if done.any():
            yield out("repeat", rows, done)
            rows, tag = {n: c[~done] for n, c in rows.items()}, tag[~done]
        if not len(tag):
            continue
        if last is not None:  # go on from the previous row, which is put in front
            rows = {n: np.concatenate(([last[n]], c)) for n, c in rows.items()}
            tag = np.concatenate(([_OLD], tag)).astype(np.int32)
        fresh_gram = np.ones(len(tag), bool)
        fresh_gram[1:] = (rows["g0"][1:] != rows["g0"][:-1]) | (rows["g1"][1:] != rows["g1"][:-1])
        head = fresh_gram.copy()
        head[1:] |= rows["digest"][1:] != rows["digest"][:-1]
        segment = np.cumsum(head) - 1
        first = np.flatnonzero(head)[segment]
        moved = (rows["doc"] != rows["doc"][first]) | (rows["place"] != rows["place"][first])
        yield out("repeat", rows, moved & (tag == _NEW))
        yield out("index", rows, head & (tag == _NEW))
        # Segments that share their suffix with another one are open.
        groups = np.flatnonzero(fresh_gram)
        count = np.add.reduceat(head.astype(np.int64), groups)
        if last is not None:
            count[0] += shared - 1
            if waiting is not None and count[0] > 1:
                yield out("open", waiting, slice(None))
                waiting = None
        group = np.cumsum(fresh_gram) - 1
        opened = head & (count[group] > 1)
        # Suffixes that go on in other batches stay open as a whole.
        inner = np.flatnonzero(opened & (group > 0) & (group < group[-1]))
        opened[inner] = _sharing(group[inner], rows["place"][inner], rows["sides"][inner], tag[inner] == _NEW)
        if last is not None:
            opened[0] = False  # told before, or waiting
        yield out("open", rows, opened)
        end = first[-1]
        alone = count[-1] == 1
        if alone and (last is None or group[-1] > 0 or waiting is None):
            waiting = {n: c[end : end + 1] for n, c in rows.items()}
        elif not alone:
            waiting = None
        last, shared = {n: c[end] for n, c in rows.items()}, int(count[-1])


class SuffixIndex:
    """The levels of sparse suffix arrays; add() takes batches of documents in the order of their numbers."""

    def __init__(self) -> None:
        self.levels: dict[int, tuple[DataFrame, str]] = {}

    def add(self, documents: DataFrame, last: bool = False) -> tuple[DataFrame, DataFrame]:
        """Repeats (doc, place) of documents (doc, text), and open segments (all of an entry) old and new.

        The documents' numbers must be larger than those of all batches before.  ``last``: no batch follows, so the
        new entries are not kept, and the levels go.
        """
        spark = documents.sparkSession
        small_batches(spark, ROWS)
        new = documents.select("doc", "text").mapInArrow(_entries, _ENTRY)
        known = [level.withColumn("tag", F.lit(_OLD)) for level, _ in self.levels.values()]
        every = reduce(DataFrame.unionByName, known, new).repartition("g0", "g1").sortWithinPartitions(*_ORDER)
        scan = every.mapInArrow(_scan, _FOUND)
        found, folder = staged_at(scan.where("kind != 'index'") if last else scan, "suffix-scan", by="kind")
        if last:
            for _, old in self.levels.values():
                discard(spark, old)
            self.levels = {}
        else:
            level, rows, folder = 0, found.where("kind = 'index'").select(*_NAMES), f"{folder}/kind=index"
            while level in self.levels:
                other, old = self.levels.pop(level)
                merged, target = staged_at(rows.unionByName(other), "suffix-level")
                discard(spark, old)
                discard(spark, folder)
                level, rows, folder = level + 1, merged, target
            self.levels[level] = (rows, folder)
        return found.where("kind = 'repeat'").select("doc", "place"), found.where("kind = 'open'").select(*_NAMES)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare all strings of sides (key, part, parts, doc, start, bytes) that stand together, group by group.

    kind span: a run of strings that start earlier too, as (doc, start, end).  Of a key in several parts, kind string is
    a string that is the first of its part, as (key, digest, doc, start), to be compared once more among the parts.
    """

    def strings(table: pa.Table, share: int, shares: int) -> tuple[np.ndarray, ...]:
        """digest, row and start of the strings, or of a share of them by digest."""
        out = []
        for low in range(0, len(table), OPEN):
            piece = table.slice(low, OPEN)
            data, offsets = _bytes(piece.column("bytes"))
            count = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
            row = np.repeat(np.arange(len(count)), count)
            step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            at = offsets[row] + step
            digest = span_digest(prefix_digest(data), at, at + LENGTH)
            mine = digest % np.uint64(shares) == share
            out.append((digest[mine], row[mine] + low, (piece.column("start").to_numpy()[row] + step)[mine]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        doc, key, parts = (table.column(n).to_numpy() for n in ("doc", "key", "parts"))
        shares = -(-len(table) // (2 * OPEN))
        for share in range(shares):
            digest, row, where = strings(table, share, shares)
            order = np.lexsort((where, doc[row], digest))
            digest, row, where = digest[order], row[order], where[order]
            owner = doc[row]
            head = np.ones(len(row), bool)
            head[1:] = digest[1:] != digest[:-1]
            first = np.flatnonzero(head)[np.cumsum(head) - 1] if len(row) else row
            later = (owner != owner[first]) | (where != where[first])
            back = np.lexsort((where[later], owner[later]))
            d, w = owner[later][back], where[later][back]
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1]) | (w[1:] > w[:-1] + 1)
            begin = np.flatnonzero(new)
            finish = np.append(begin[1:], len(d)) - 1
            none = np.zeros(len(begin), np.int64)
            if len(d):
                yield _row("span", none, none, d[begin], w[begin], w[finish] + LENGTH)
            head &= parts[row] > 1
            if head.any():
                yield _row("string", key[row[head]], _signed(digest[head]), owner[head], where[head], where[head] + LENGTH)

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if len(held) > OPEN:
            key, part = held.column("key").to_numpy(), held.column("part").to_numpy()
            ends = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
            if len(ends):  # the last group may go on
                yield from run(held.slice(0, int(ends[-1])))
                held = held.slice(int(ends[-1]))
    if held is not None and len(held):
        yield from run(held)


def _bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks().cast(pa.large_binary())
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


_SPANS = "kind string, key long, digest long, doc long, start long, end long"


def _row(kind: str, *columns: np.ndarray) -> pa.RecordBatch:
    names = ["kind", "key", "digest", "doc", "start", "end"]
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(columns[0]), pa.string()), *map(pa.array, columns)], names)


def _sieve(ids: DataFrame):
    """A function column -> boolean that is true for every listed id and for few others; its size is fixed."""
    at = F.shiftrightunsigned(F.xxhash64("doc"), 64 - SIEVE)
    rows = ids.groupBy(F.shiftright(at, 6).alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))).alias("m")
    ).collect()  # at most 2 ** (SIEVE - 6) rows
    bits = np.zeros(1 << (SIEVE - 6), np.int64)
    for row in rows:
        bits[row["w"]] = row["m"]
    shared = ids.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    @F.arrow_udf("boolean")
    def maybe(column: pa.Array) -> pa.Array:
        bit = column.to_numpy().view(np.uint64) >> np.uint64(64 - SIEVE)
        return pa.array((shared.value[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) != 0)

    return lambda column: maybe(F.xxhash64(column))


def _shared_sides(opened: DataFrame) -> DataFrame:
    """key, part, parts, doc, place, left: sides of open segments that stand in several of them.

    Strings with _SIDE bytes or more left of the gram are told apart by their left side, the others by their right one,
    so equal strings always meet under one key.
    """
    opened = opened.groupBy("g0", "g1", "digest").agg(F.min(F.struct("doc", "place", "sides")).alias("first")).select("g0", "g1", "first.*")
    offset, length = F.shiftright("place", 8).bitwiseAND(F.lit(255)), F.col("place").bitwiseAND(F.lit(255))
    side = lambda left, digest, usable: F.when(usable, F.struct(F.lit(left).alias("left"), digest.alias("digest")))
    both = F.array_compact(
        F.array(
            side(True, F.shiftright("sides", 32), offset >= _SIDE),
            side(False, F.col("sides").bitwiseAND(F.lit(0xFFFFFFFF)), length - offset > GRAM + _SIDE),
        )
    )
    sides = opened.select("g0", "g1", "doc", "place", F.explode(both).alias("side")).select(
        F.xxhash64("g0", "g1", "side.left", "side.digest").alias("key"), "doc", "place", "side.left"
    )
    sides = staged(sides, "segment-sides", compression="zstd")
    counted = staged(sides.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "side-counts", compression="zstd")
    total = counted.agg(F.sum("n")).first()[0] or 0
    most = max(total // SHARE, LEAST)
    return join_counted(sides, counted.withColumn("parts", F.ceil(F.col("n") / F.lit(most)).cast("int")), "key", ["doc", "place"])


def _partial_spans(opened: DataFrame, numbered: DataFrame) -> DataFrame:
    """Spans (doc, start, end) of strings of open segments that start earlier too."""
    sides = _shared_sides(opened)
    segment = F.struct("key", "part", "parts", "place", "left")
    lists = staged(sides.groupBy("doc").agg(F.collect_list(segment).alias("segments")), "open-segments", compression="zstd")
    near = numbered.where(_sieve(lists.select("doc"))(F.col("doc"))).join(lists, "doc")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_parts(batch.column(1))
            lists = batch.column(2)
            found = lists.flatten()
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            place, left = found.field("place").to_numpy(), found.field("left").to_numpy(zero_copy_only=False)
            start, end = place >> 32, (place >> 32) + (place & 255)
            at = start + (place >> 8 & 255)
            start = np.where(left, start, np.maximum(start, at - _SIDE + 1))
            end = np.where(left, np.minimum(end, at - _SIDE + LENGTH), end)
            whole, low = data.tobytes(), offsets[row]
            pieces = [whole[a:b] for a, b in zip((low + start).tolist(), (low + end).tolist(), strict=True)]
            columns = [found.field("key"), found.field("part"), found.field("parts"), pa.array(batch.column(0).to_numpy()[row]), pa.array(start)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(pieces, pa.binary())], ["key", "part", "parts", "doc", "start", "bytes"])

    pieces = near.select("doc", "text", "segments").mapInArrow(cut, "key long, part int, parts int, doc long, start long, bytes binary")
    dealt = pieces.repartition("key", "part").sortWithinPartitions("key", "part")
    found = staged(dealt.mapInArrow(_compare, _SPANS), "open-spans", compression="zstd")
    # A string stands here once for each part of its key, of which there are SHARE at most.
    strings = found.where("kind = 'string'").select("key", "digest", "doc", "start", "end")
    first = strings.withColumn("first", F.min(F.struct("doc", "start")).over(Window.partitionBy("key", "digest")))
    later = first.where("first.doc != doc or first.start != start").select("doc", "start", "end")
    return found.where("kind = 'span'").select("doc", "start", "end").unionByName(later)


def _numbered(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The documents with doc: a number in the order of (id, null last, text digest), equal for equal documents.

    Ids that are whole numbers and stand for one text each are such numbers themselves.
    """
    digest = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    plain = dict(documents.dtypes)[doc_id] in ("tinyint", "smallint", "int", "bigint")
    texts = documents.groupBy(F.col(doc_id).alias("id")).agg(F.min(digest).alias("a"), F.max(digest).alias("b"))
    if plain and texts.where("id is null or a != b").isEmpty():
        return documents.withColumn("doc", F.col(doc_id).cast("long"))
    order = [F.col("id").asc_nulls_last(), F.col("print")]
    thin = documents.select(F.col(doc_id).alias("id"), digest.alias("print")).distinct().repartitionByRange(*order)
    thin = staged(thin.withColumn("part", F.spark_partition_id()), "document-numbers")
    sizes = thin.groupBy("part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    numbers = thin.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy(*order))).join(
        sizes.select("part", F.coalesce(before, F.lit(0)).alias("before")), "part"
    ).select(F.col("id").alias("of_id"), F.col("print").alias("of_print"), (F.col("before") + F.col("at")).alias("doc"))
    same = F.col(doc_id).eqNullSafe(F.col("of_id")) & (digest == F.col("of_print"))
    return documents.join(numbers, same).drop("of_id", "of_print")


def repeated_spans(numbered: DataFrame, batches: int) -> DataFrame:
    """Spans (doc, start, end) of bytes in strings of LENGTH bytes that start earlier too, from documents (doc, text).

    The documents go through the index in ``batches`` of about the same number, in order.
    """
    shares = [i / batches for i in range(1, batches)]
    bounds = numbered.agg(F.percentile_approx("doc", shares, 1_000)).first()[0] if shares else []
    edges = [None, *sorted(set(bounds or [])), None]
    index, repeats, opened = SuffixIndex(), [], []
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        batch = numbered
        batch = batch.where(F.col("doc") > low) if low is not None else batch
        batch = batch.where(F.col("doc") <= high) if high is not None else batch
        found = index.add(batch, last=high is None)
        repeats.append(found[0])
        opened.append(found[1])
    partial = _partial_spans(reduce(DataFrame.unionByName, opened), numbered)
    start = F.shiftright("place", 32)
    whole = reduce(DataFrame.unionByName, repeats).select("doc", start.alias("start"), (start + F.col("place").bitwiseAND(F.lit(255))).alias("end"))
    return whole.unionByName(partial)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted runs that the spans cover."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _without(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for run in runs for x in run), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _at_characters(data: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs without the parts of characters at their ends that lie outside in part."""
    out = []
    for start, end in runs:
        while start < end and data[start] & 0xC0 == 0x80:
            start += 1
        while end > start and end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append((start, end))
    return out


def _with_spans(documents: DataFrame, doc_id: str, text: str, batches: int, doc: str, spans: str) -> tuple[DataFrame, DataFrame]:
    """Documents that repeat nothing, and the others with the list of their spans."""
    small_batches(documents.sparkSession)
    numbered = _numbered(documents.withColumnRenamed("doc", f"{doc}_own") if "doc" in documents.columns else documents, doc_id, text)
    found = repeated_spans(numbered.select("doc", F.coalesce(text, F.lit("")).alias("text")), batches)
    lists = staged(found.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias(spans)), "removed-spans")
    maybe = _sieve(lists.select("doc"))(F.col("doc"))
    small_batches(documents.sparkSession)
    out = [numbered.where(~maybe), numbered.where(maybe).join(lists, "doc", "left")]
    out = [f.withColumnRenamed("doc", doc) for f in out]
    return tuple(f.withColumnRenamed(f"{doc}_own", "doc") for f in out) if "doc" in documents.columns else tuple(out)


#: Batches in which a whole table goes through the index.
BATCHES = 4


def remove_repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = BATCHES) -> DataFrame:
    """What is left of every text without the bytes of strings of LENGTH bytes that also start earlier.

    Earlier is: in a document of smaller id, or earlier in the same document.  Strings are those of the input; they
    may overlap, and never cross documents.  Returns the columns but the text with n_bytes, n_removed, n_spans
    (maximal removed runs) and kept_sha256 (of the remaining bytes).  Null texts are empty.  A null id is later than
    all others; documents of one id stand in the order of their text digests; rows that repeat a document are one
    document, and each gets its result.  Texts under LENGTH bytes lose nothing.  Empty tables give no rows; input
    columns named like an added one are replaced.
    """
    added = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    passed = [F.col(f"`{c}`") for c in documents.columns if c != text and c not in added]
    doc, spans = fresh("doc"), fresh("spans")
    alone, others = _with_spans(documents, doc_id, text, batches, doc, spans)

    @F.arrow_udf("struct<n_removed:bigint,n_spans:bigint,kept_sha256:string>")
    def cut(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for t, found in zip(texts, lists, strict=True):
            data = t.as_buffer().to_pybytes() if t.is_valid else b""
            runs = _merged([(x["start"], x["end"]) for x in found.as_py() or []])
            out.append({"n_removed": sum(b - a for a, b in runs), "n_spans": len(runs), "kept_sha256": hashlib.sha256(_without(data, runs)).hexdigest()})
        return pa.array(out, pa.struct([("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))

    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")
    none = F.lit(0).cast("long")
    first = alone.select(*passed, size, none.alias("n_removed"), none.alias("n_spans"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("kept_sha256"))
    second = others.withColumn(spans, cut(F.col(text), F.col(spans))).select(*passed, size, f"{spans}.*")
    return first.unionByName(second)


def without_repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = BATCHES) -> DataFrame:
    """The documents with the text that remove_repeats leaves; a character that is removed in part stays whole.

    Null texts stay null, and no row goes, even if nothing of its text is left.
    """
    doc, spans = fresh("doc"), fresh("spans")
    alone, others = _with_spans(documents, doc_id, text, batches, doc, spans)

    @F.arrow_udf("string")
    def cut(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for t, found in zip(texts, lists, strict=True):
            if not t.is_valid:
                out.append(None)
                continue
            data = t.as_buffer().to_pybytes()
            out.append(_without(data, _at_characters(data, _merged([(x["start"], x["end"]) for x in found.as_py() or []]))).decode())
        return pa.array(out, pa.string())

    cut_texts = others.withColumn(text, cut(F.col(text), F.col(spans)))
    columns = [F.col(f"`{c}`") for c in documents.columns]
    return alone.select(*columns).unionByName(cut_texts.select(*columns))
