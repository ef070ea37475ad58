"""Operator 3: exact top-k inner products with an impact-ordered index, processed score at a time.

Vectors are quantised to integers and dealt to blocks by a digest of their id.  A block's index holds postings
(component, vector, impact) in segments of descending impact; it is built once, and all queries pass by it.  A batch of
queries adds the segments in that order to its accumulators.  What a vector's postings of later segments can still add is at most the product of the query's norm
and the norm of that rest, which bounds every final score on both sides; a query stops only when the bounds prove
that few candidates can be members, and those are rescored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.llm.work import matrix, meet_blocks, staged

#: Vectors of a block, least number of blocks, and queries that are scored at once.
BLOCK, BLOCKS, QUERIES = 8_192, 32, 256
#: Segments end where impacts fall below these shares of a block's largest impact.
SEGMENTS = (0.5, 0.3, 0.18, 0.09, 0.0)
#: A query is rescored once at most this share of a block can be members.
FEW = 0.05


class ImpactIndex:
    """Postings of one block in segments of descending impact."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        size = np.abs(vectors)
        limits = [float(size.max()) * share for share in SEGMENTS] if size.size else []
        level = np.full(size.shape, len(SEGMENTS))
        for i, limit in reversed(list(enumerate(limits))):
            level[(size >= limit) & (vectors != 0)] = i
        self.segments = []
        for i in range(len(limits)):
            vector, component = np.nonzero(level == i)
            impact = vectors[vector, component]
            order = np.argsort(-np.abs(impact), kind="stable")
            rest = np.sqrt((np.where((level > i) & (level < len(SEGMENTS)), vectors, 0.0) ** 2).sum(axis=1))
            self.segments.append((component[order], vector[order], impact[order], rest))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its possible members and their exact scores; own: positions of its own row, else -1."""
        count, width = self.vectors.shape
        norms = np.sqrt((queries**2).sum(axis=1))
        live = np.arange(len(queries))
        scores = np.zeros((len(queries), count))
        banned = np.flatnonzero(own >= 0)
        for i, (component, vector, impact, rest) in enumerate(self.segments):
            part = np.zeros((width, count))
            part[component, vector] = impact
            scores += queries[live] @ part
            if i + 1 == len(self.segments):
                break
            slack = norms[live, None] * rest[None, :] * (1 + 1e-9) + 1e-6
            low = scores - slack
            low[np.isin(live, banned).nonzero()[0], own[live[np.isin(live, banned)]]] = -np.inf
            least = np.partition(low, count - k, axis=1)[:, count - k] if count > k else np.full(len(live), -np.inf)
            may = scores + slack >= least[:, None]
            few = may.sum(axis=1) <= max(k, FEW * count)
            for at in np.flatnonzero(few):
                found = np.flatnonzero(may[at])
                yield live[at], found, self.vectors[found] @ queries[live[at]]
            scores, live = scores[~few], live[~few]
            if not len(live):
                return
        every = np.arange(count)
        for at, query in enumerate(live):
            yield query, every, scores[at]


def quantised(vector: str):
    """floor(256 * x) of each component; null for vectors that are null or have null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    value = F.transform(vector, lambda x: F.floor(256 * x.cast("double")).cast("double"))
    return F.when(F.col(vector).isNotNull() & ~bad, value)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """The k highest integer inner products of every query with the vectors; query_id, rank, vec_id, score.

    Both frames have vec_id and vector.  A query's own row, which is any row of its id, is no candidate.  Rows with a
    null id, a null vector or null or non-finite components take no part.  Vectors of different lengths are compared
    as if the shorter one went on with zeros; an empty vector scores 0.  Ties go to the smaller vec_id.  Repeated rows
    are candidates each; a query id that repeats is asked once, with its smallest vector.  With fewer than k
    candidates all are returned; empty tables give no rows.  Scores are exact up to 2 ** 53.
    """
    asked = queries.select(F.col(vec_id).alias("id"), quantised(vector).alias("values")).where("id is not null and values is not null")
    asked = staged(asked.groupBy("id").agg(F.min("values").alias("values")), "top-k-queries")
    points = vectors.select(F.col(vec_id).alias("id"), quantised(vector).alias("values")).where("id is not null and values is not null")
    points = staged(points, "top-k-vectors")
    blocks = max(BLOCKS, -(-points.count() // block))

    class Vectors:
        """The vectors of one block by id, with their index."""

        def __init__(self, table: pa.Table):
            order = np.argsort(table.column("id").to_numpy(), kind="stable")
            self.ids = table.column("id").to_numpy()[order]
            self.index = ImpactIndex(matrix(table.column("values"))[order])

    def search(vectors: Vectors, part: pa.RecordBatch) -> pa.RecordBatch:
        ids, query_ids, width = vectors.ids, part.column("id").to_numpy(), vectors.index.vectors.shape[1]
        low, high = np.searchsorted(ids, query_ids), np.searchsorted(ids, query_ids, side="right")
        asked = matrix(part.column("values"), width) if width else np.zeros((len(part), 0))
        extra = int((high - low).max(initial=0))  # rows of the query's id, which are no candidates
        out = [[], [], []]
        for at in range(0, len(part), QUERIES):
            some = slice(at, at + QUERIES)
            own = np.where(high > low, low, -1)[some]
            for q, found, scores in vectors.index.search(asked[some], own, k + max(0, extra - 1)):
                mask = ids[found] != query_ids[some][q]
                found, scores = ids[found[mask]], scores[mask]
                best = np.lexsort((found, -scores))[:k]
                for column, values in zip(out, (np.full(len(best), query_ids[some][q]), found[best], scores[best]), strict=True):
                    column.append(values)
        arrays = [pa.array(np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64)) for c in out]
        return pa.RecordBatch.from_arrays(arrays, ["query_id", "vec_id", "score"])

    # Every query meets every block: the stated query set against all rows, in blocks.
    met = meet_blocks(points, asked, blocks, Vectors, search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
