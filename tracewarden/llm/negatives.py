"""Operator 13: hard negatives from score windows, by slot-decomposed selection.

An anchor's positives are its nearest rows of its own label; each positive asks for the nearest rows of other labels
whose score lies in a window below the positive's.  The upper limits of an anchor's windows, in the order of its
positives, cut the scores into disjoint slots.  A block of rows keeps the first k rows of every slot, blocks are
combined in the same way, and the answer to a window is a merge of the slots from its upper limit downwards: first
slot first, until k rows are found, without those under its lower limit.  So every row is scored once for all windows
of an anchor, however much they overlap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.llm.topk import quantised
from tracewarden.llm.work import matrix, meet_blocks, staged

#: Rows of a block, least number of blocks, anchors scored against a block at once.
BLOCK, BLOCKS, TILE = 16_384, 32, 256

class Block:
    """The rows of one block, by label and then by id."""

    def __init__(self, table: pa.Table):
        ids, labels = table.column("id").to_numpy(), table.column("label").to_numpy()
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.values = ids[order], labels[order], matrix(table.column("values"))[order]

    def same_label(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + 1]))


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k highest scores, equal ones by id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def _positives(block: Block, anchors: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, int, int]]:
    """anchor, 0, id, score of the k first other rows of each anchor's label."""
    asked, labels = anchors.column("id").to_numpy(), anchors.column("label").to_numpy()
    vectors = _vectors(block, anchors)
    for label in np.unique(labels):
        own, mine = block.same_label(label), np.flatnonzero(labels == label)
        ids = block.ids[own]
        for at in range(0, len(mine) if len(ids) else 0, TILE):
            part = mine[at : at + TILE]
            scores = vectors[part] @ block.values[own].T
            scores[asked[part][:, None] == ids[None, :]] = -np.inf
            for row, anchor in zip(scores, asked[part], strict=True):
                for best in _first(row, ids, k):
                    if row[best] > -np.inf:
                        yield anchor, 0, ids[best], int(row[best])


def _slots(block: Block, anchors: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, int, int]]:
    """anchor, slot, id, score of the k first rows of other labels in every slot of each anchor.

    limits: the upper limits, descending.  A score's slot is the last limit that it does not pass, counted from 1.
    """
    asked, labels = anchors.column("id").to_numpy(), anchors.column("label").to_numpy()
    vectors = _vectors(block, anchors)
    limits = anchors.column("limits").to_pylist()
    for at in range(0, len(asked), TILE):
        scores = vectors[at : at + TILE] @ block.values.T
        for row, anchor, label, upper in zip(scores, asked[at : at + TILE], labels[at : at + TILE], limits[at : at + TILE], strict=True):
            row[block.same_label(label)] = np.inf
            upper = np.asarray(upper, dtype=float)
            for slot in range(1, len(upper) + 1):
                below = upper[slot] if slot < len(upper) else -np.inf
                inside = np.flatnonzero((row <= upper[slot - 1]) & (row > below))
                for best in inside[_first(row[inside], block.ids[inside], k)]:
                    yield anchor, slot, block.ids[best], int(row[best])


def _vectors(block: Block, anchors: pa.RecordBatch) -> np.ndarray:
    width = block.values.shape[1]
    return matrix(anchors.column("values"), width) if width else np.zeros((len(anchors), 0))


_FOUND = ["anchor_id", "slot", "id", "score"]


def _meet(points: DataFrame, anchors: DataFrame, blocks: int, search: Callable, k: int) -> DataFrame:
    """What a search finds in every block for every anchor."""

    def found(block: Block, part: pa.RecordBatch) -> pa.RecordBatch:
        rows = list(search(block, part, k))
        columns = zip(*rows, strict=True) if rows else ([], [], [], [])
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, dtype=np.int64)) for c in columns], _FOUND)

    return meet_blocks(points, anchors, blocks, Block, found, ", ".join(f"{n} long" for n in _FOUND))


def _per_cent(score: Column, share: int) -> Column:
    """The largest whole number that is not above a share of the score."""
    product = score * F.lit(share).cast("long")
    return F.call_function("div", product - F.pmod(product, F.lit(100)), F.lit(100))


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k first of each anchor's slot among those of all blocks, with their place."""
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.col("score").desc(), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def hard_negatives(
    vectors: DataFrame,
    anchors: DataFrame,
    k: int = 10,
    positives: int = 5,
    low: int = 30,
    high: int = 90,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for each anchor and positive.

    Both frames have vec_id, vector and label (a whole number).  Scores are integer inner products of floor(256 * x);
    higher ones come first, ties go to the smaller vec_id.  An anchor's positives are its first ``positives`` other
    rows of its label; a positive's negatives the first ``k`` rows of other labels whose score is from ``low`` to
    ``high`` per cent of the positive's, both ends included; high is not negative.  Windows of negative scores are
    empty.  With fewer rows all are returned; a positive without negatives gives no row.

    Rows with a null id, label or vector, or null or non-finite components take no part.  Vectors of different lengths
    are compared as if the shorter one went on with zeros.  Other rows are those of other ids; repeated rows are
    positives or negatives each, and an anchor id that repeats asks once, with its smallest label and vector.  Empty
    tables give no rows; other columns are ignored.  Scores are exact up to 2 ** 53.
    """
    usable = "id is not null and label is not null and values is not null"

    def read(frame: DataFrame) -> DataFrame:
        return frame.select(
            F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), quantised(vector).alias("values")
        ).where(usable)

    points = staged(read(vectors), "labelled-vectors")
    asked = read(anchors).groupBy("id").agg(F.min(F.struct("label", "values")).alias("own")).select("id", "own.*")
    asked = staged(asked, "anchors")
    blocks = max(BLOCKS, -(-points.count() // block))
    none = F.lit(None).cast("array<long>")
    found = _best(_meet(points, asked.withColumn("limits", none), blocks, _positives, positives), positives)
    chosen = staged(found.select("anchor_id", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # The limits fall as the positives' scores do: a window's slots are its own one and all behind it.
    lists = chosen.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("positives"))
    limits = lists.withColumn("limits", F.transform("positives", lambda p: _per_cent(p["positive_score"], high)))
    limited = asked.join(limits.select(F.col("anchor_id").alias("id"), "limits"), "id")
    slots = _best(_meet(points, limited, blocks, _slots, k), k)
    # At most k rows a slot and one slot a positive: an anchor's rows are bounded.
    row = F.struct((-F.col("score")).alias("order"), "id", "slot")
    suffix = slots.groupBy("anchor_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    asking = suffix.join(lists, "anchor_id").select("anchor_id", "rows", F.explode("positives").alias("p"))
    first = F.slice(F.filter("rows", lambda r: r["slot"] >= F.col("p.place")), 1, k)
    kept = F.filter(first, lambda r: -r["order"] * 100 >= F.col("p.positive_score") * low)
    return asking.select("anchor_id", "p", F.posexplode(kept).alias("at", "row")).select(
        "anchor_id", "p.positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("row.id").alias("negative_id"),
        "p.positive_score", (-F.col("row.order")).alias("negative_score"),
    )
