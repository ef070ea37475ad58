"""Operator 8: near-duplicates by a chosen-path set similarity join over word shingles.

Copies of one shingle set are one class.  In each of TREES independent trees, classes branch by the smallest token
under the node's own hash: a node's members share all tokens chosen on the path to it.  Nodes of at most LEAF classes
are compared exhaustively by sketch; larger ones branch again.  At depth DEPTH what is still large, as groups of near
copies are, is compared in chunks that all hold one common member, and members that stay apart from the node's main
component meet every chunk.  Two classes of similarity s meet in a leaf of depth d with probability s ** d in every
tree.  Compared nodes give a spanning forest, not all pairs; its links are confirmed on full sets.  Where one fails,
all pairs of its leaf that are still apart are confirmed too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.graph import components
from tracewarden.llm.work import byte_table, fresh, grams, mix, small_batches, staged, utf8_parts, words

SHINGLE, SIMILAR = 5, 75
TREES, DEPTH = 20, 4
LEAF, BLOCK = 64, 256
#: Sketch similarity from which a pair is confirmed: over five deviations below SIMILAR with TREES * DEPTH values.
SURELY_NOT = 0.5
#: Bits of the sieve that keeps unneeded texts from being shuffled: 2 MiB for every worker.
SIEVE = 24

_TABLE = byte_table(lambda c: not (c == 0x20 or 0x09 <= c <= 0x0D))
_KEY, _SKETCH = 16, TREES * DEPTH * 4

_ROLL = np.random.default_rng(8)
_XOR = _ROLL.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)
_TIMES = _ROLL.integers(0, 1 << 62, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SECOND = np.uint64(0xA0761D6478BD642F)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingles of every text."""
    digests, bounds = words(*utf8_parts(column), _TABLE)
    every = grams(digests, SHINGLE)
    out = []
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        if high - low >= SHINGLE:
            out.append(np.unique(every[low : high - SHINGLE + 1]))
        else:
            out.append(grams(digests[low:high], int(high - low)) if high > low else np.zeros(0, np.uint64))
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary column from a matrix of bytes."""
    rows = np.ascontiguousarray(rows)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def _keys(sets: list[np.ndarray]) -> np.ndarray:
    """16 bytes that stand for each set."""
    sums = [[int(mix(s).sum(dtype=np.uint64)), int(mix(s ^ _SECOND).sum(dtype=np.uint64))] for s in sets]
    sums = np.array(sums, dtype=np.uint64).reshape(len(sets), 2)
    return mix(sums + np.array([len(s) for s in sets], dtype=np.uint64)[:, None]).view(np.uint8).reshape(len(sets), _KEY)


def sketches(column: pa.Array) -> pa.Array:
    """For every text the size of its set, its key and, for each hash, the smallest value."""
    sets = shingle_sets(column)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    full = np.flatnonzero(sizes)
    sketch = np.zeros((len(sets), TREES * DEPTH), dtype=np.uint32)
    if len(full):
        flat = np.concatenate([sets[i] for i in full])
        starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
        for k, (xor, times) in enumerate(zip(_XOR, _TIMES, strict=True)):
            sketch[full, k] = np.minimum.reduceat((flat ^ xor) * times, starts) >> np.uint64(32)
    return pa.StructArray.from_arrays(
        [pa.array(sizes), _binary(_keys(sets)), _binary(sketch.view(np.uint8).reshape(len(sets), _SKETCH))], ["n", "key", "sketch"]
    )


def _forest(similar: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of a maximum spanning forest over pairs that are not surely dissimilar."""
    left, right = np.nonzero(np.triu(similar >= SURELY_NOT, 1))
    root = list(range(len(similar)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    open_pairs = len(similar) - 1
    for k in np.argsort(-similar[left, right], kind="stable"):
        a, b = find(left[k]), find(right[k])
        if a != b:
            root[b] = a
            yield int(left[k]), int(right[k])
            open_pairs -= 1
            if not open_pairs:
                return


def _joining(open_pairs: np.ndarray, roots: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links on full sets that join roots not joined before."""
    above = {r.tobytes(): r.tobytes() for r in roots}

    def find(x: bytes) -> bytes:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    for i in np.flatnonzero(open_pairs.any(axis=1)):
        for j in np.flatnonzero(open_pairs[i]):
            a, b = find(roots[i].tobytes()), find(roots[j].tobytes())
            if a != b and _similar(sets[i], sets[j]):
                above[b] = a
                yield int(i), int(j)


def _matrix(column: pa.Array, width: int, kind=np.uint8) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    start = column.offset * width
    return np.frombuffer(column.buffers()[2], np.uint8)[start : start + len(column) * width].reshape(len(column), width).view(kind)


def _leaf_pairs(apart: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Compare the rows (leaf, key, n, sketch, root) of each leaf, which stand together.

    A spanning forest of what may be similar; or with ``apart`` the members that may be similar to one of another
    root, each paired with itself; or, if the rows have tokens, links that join the roots they can join.
    """

    def pairs(leaf: int, keys: np.ndarray, sizes: np.ndarray, sketch: np.ndarray, roots: np.ndarray, sets: list) -> tuple[list, list, list]:
        same = np.zeros((len(keys), len(keys)), np.float32)
        for k in range(TREES * DEPTH):
            same += sketch[:, k, None] == sketch[None, :, k]
        same /= TREES * DEPTH
        # No pair of such sizes can reach the similarity.
        same[SIMILAR * np.maximum.outer(sizes, sizes) > 100 * np.minimum.outer(sizes, sizes)] = 0
        if not apart:
            found = list(_forest(same))
        else:
            same[(roots[:, None, :] == roots[None, :, :]).all(axis=2)] = 0
            open_pairs = np.triu(same >= SURELY_NOT, 1)
            some = np.flatnonzero(open_pairs.any(axis=0) | open_pairs.any(axis=1))
            found = list(_joining(open_pairs, roots, sets)) if sets else list(zip(some, some, strict=True))
        ends = [sorted((keys[i].tobytes(), keys[j].tobytes())) for i, j in found]
        return [leaf] * len(found), [e[0] for e in ends], [e[1] for e in ends]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def compare(table: pa.Table) -> pa.RecordBatch:
            leaf = table.column("leaf").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(leaf)) + 1).tolist(), len(leaf)]
            keys, sizes = _matrix(table.column("key"), _KEY), table.column("n").to_numpy()
            sketch, roots = _matrix(table.column("sketch"), _SKETCH, np.uint32), _matrix(table.column("root"), _KEY)
            tokens = table.column("tokens").combine_chunks() if "tokens" in table.column_names else None
            out: tuple[list, list, list] = ([], [], [])
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                # A class may stand twice in a leaf: once for itself, once as the common member.
                _, at = np.unique(keys[low:high].view([("", np.uint8, _KEY)]).ravel(), return_index=True)
                at += low
                if len(at) > 1:
                    sets = [np.frombuffer(tokens[int(i)].as_buffer(), np.uint64) for i in at] if tokens is not None else []
                    for whole, part in zip(out, pairs(int(leaf[low]), keys[at], sizes[at], sketch[at], roots[at], sets), strict=True):
                        whole.extend(part)
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], ["leaf", "a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            leaf = table.column("leaf").to_numpy()
            if not len(leaf):
                continue
            # The last leaf may go on in the next batch.
            cut = int(np.flatnonzero(leaf != leaf[-1])[-1]) + 1 if (leaf != leaf[-1]).any() else 0
            done, rest = (table.slice(0, cut), table.slice(cut)) if cut else (None, table)
            if done is not None:
                yield compare(pa.concat_tables([*held, done]).combine_chunks())
                held = []
            elif held and held[-1].column("leaf")[-1].as_py() != int(leaf[0]):
                yield compare(pa.concat_tables(held).combine_chunks())
                held = []
            held.append(rest)
        if held:
            yield compare(pa.concat_tables(held).combine_chunks())

    return run


def _compared(members: DataFrame, classes: DataFrame, apart: bool = False, sets: DataFrame | None = None) -> DataFrame:
    """leaf, a, b for members (leaf, key and, with apart, root) of leaves."""
    if not apart:
        members = members.withColumn("root", F.col("key"))
    columns = ["leaf", "key", "n", "sketch", "root", *(["tokens"] if sets is not None else [])]
    rows = members.join(classes.select("key", "n", "sketch"), "key")
    rows = rows.join(sets, "key") if sets is not None else rows
    dealt = rows.select(*columns).repartition("leaf").sortWithinPartitions("leaf")
    return dealt.mapInArrow(_leaf_pairs(apart), "leaf long, a binary, b binary")


def _leaves(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (leaf, key) of the leaves worth comparing, and (node, key, count) of nodes that stay large."""
    step = DEPTH * 4
    state = classes.select("key", "sketch", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select(
        "key", F.xxhash64("tree").alias("node"), F.call_function("substring", "sketch", F.col("tree") * step + 1, F.lit(step)).alias("path")
    )
    leaves = []
    for level in range(DEPTH):
        token = F.call_function("substring", "path", F.lit(level * 4 + 1), F.lit(4))
        state = state.withColumn("node", F.xxhash64("node", token))
        counts = state.groupBy("node").agg(F.count("*").alias("count")).where("count > 1")
        state = staged(state.join(counts, "node"), "tree-nodes")
        leaves.append(state.where(F.col("count") <= LEAF).select(F.col("node").alias("leaf"), "key"))
        large = state.where(F.col("count") > LEAF)
        state = large.drop("count")
    members = leaves[0]
    for more in leaves[1:]:
        members = members.unionByName(more)
    # Near copies are alone together in many trees: leaves of the same members are compared once.
    alike = members.groupBy("leaf").agg(F.bit_xor(F.xxhash64("key")).alias("x"), F.count("*").alias("c"), F.min("key").alias("k"))
    chosen = alike.groupBy("x", "c", "k").agg(F.min("leaf").alias("leaf")).select("leaf")
    return staged(members.join(chosen, "leaf", "left_semi"), "leaves"), large.select("node", "key", "count")


def _blocks(large: DataFrame) -> DataFrame:
    """Large nodes in chunks of about BLOCK members, each with the node's first member."""
    chunk = F.pmod(F.xxhash64("key", F.lit(7)), F.ceil(F.col("count") / BLOCK))
    dealt = large.withColumn("leaf", F.xxhash64("node", chunk))
    first = large.groupBy("node").agg(F.min("key").alias("key"))
    chunks = dealt.select("node", "leaf").distinct()
    return dealt.select("leaf", "key").unionByName(chunks.join(first, "node").select("leaf", "key"))


def _strays(large: DataFrame, roots: DataFrame) -> DataFrame:
    """Members (leaf, key, root) of large nodes outside the node's main component, with every chunk of the node."""
    known = large.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    sizes = known.groupBy("node", "root").agg(F.count("*").alias("c"))
    main = sizes.groupBy("node").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("roots"))
    open_nodes = staged(known.join(main.where("roots > 1"), "node"), "open-nodes")
    chunks = F.ceil(F.col("count") / BLOCK).cast("long")
    stray = open_nodes.where("root != main")
    stray_blocks = stray.groupBy("node").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    both = open_nodes.join(stray_blocks, "node")
    deal = lambda seed, n: F.pmod(F.xxhash64("key", F.lit(seed)), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    all_rows = both.select("node", "key", "root", deal(7, chunks).alias("chunk"), every(F.col("blocks")).alias("block"))
    own = both.where("root != main").select("node", "key", "root", deal(9, F.col("blocks")).alias("block"), every(chunks).alias("chunk"))
    leaf = F.xxhash64("node", "chunk", "block", F.lit(1)).alias("leaf")
    return all_rows.select(leaf, "key", "root").unionByName(own.select(leaf, "key", "root"))


def _full_sets(keys: DataFrame, classes: DataFrame, documents: DataFrame, text: str) -> DataFrame:
    """key, tokens: the whole sets of the classes with these keys, from the texts."""
    spark = keys.sparkSession
    needed = staged(keys.join(classes.select("key", "digest"), "key").select("digest"), "needed-texts")
    at = F.shiftrightunsigned(F.xxhash64("digest"), 64 - SIEVE)
    rows = needed.groupBy(F.shiftright(at, 6).alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))).alias("m")
    ).collect()  # at most 2 ** (SIEVE - 6) rows
    sieve = np.zeros(1 << (SIEVE - 6), np.int64)
    for row in rows:
        sieve[row["w"]] = row["m"]
    shared = spark.sparkContext.broadcast(sieve.view(np.uint64))

    @F.arrow_udf("boolean")
    def maybe(column: pa.Array) -> pa.Array:
        bit = column.to_numpy().view(np.uint64) >> np.uint64(64 - SIEVE)
        return pa.array((shared.value[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) != 0)

    @F.arrow_udf("struct<key:binary,tokens:binary>")
    def tokens(column: pa.Array) -> pa.Array:
        sets = shingle_sets(column)
        return pa.StructArray.from_arrays([_binary(_keys(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "tokens"])

    texts = documents.select(F.col(text).alias("text"), _digest(text).alias("digest"))
    near = texts.where(maybe(F.xxhash64("digest"))).join(needed, "digest", "left_semi")
    # Copies of a text give one row for each task.
    sets = near.groupBy("digest").agg(F.any_value("text").alias("text")).select(tokens("text").alias("s")).select("s.*")
    return staged(sets, "shingle-sets")


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = np.concatenate((x, y))
    both.sort(kind="stable")  # two sorted runs: a merge
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= SIMILAR * (len(x) + len(y) - common)


def _confirmed(pairs: DataFrame, classes: DataFrame, documents: DataFrame, text: str) -> DataFrame:
    """The pairs (a, b) with linked: whether their full sets are similar."""

    @F.arrow_udf("boolean")
    def similar(left: pa.Array, right: pa.Array) -> pa.Array:
        sets = ([np.frombuffer(v.as_buffer(), np.uint64) for v in column] for column in (left, right))
        return pa.array([_similar(a, b) for a, b in zip(*sets, strict=True)], pa.bool_())

    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    sets = _full_sets(keys, classes, documents, text)
    half = pairs.join(sets.select(F.col("key").alias("a"), F.col("tokens").alias("left")), "a")
    both = half.join(sets.select(F.col("key").alias("b"), F.col("tokens").alias("right")), "b")
    return staged(both.select("a", "b", similar("left", "right").alias("linked")), "confirmed-pairs")


def _links_in_leaves(
    members: DataFrame, classes: DataFrame, documents: DataFrame, text: str
) -> DataFrame:
    """Links (a, b) between members (leaf, key, root) of different roots; each set goes to a leaf once."""
    members = staged(members.distinct(), "open-members")
    used = staged(_compared(members, classes, apart=True).select("leaf", F.col("a").alias("key")), "compared-members")
    sets = _full_sets(used.select("key").distinct(), classes, documents, text)
    rows = members.join(used, ["leaf", "key"], "left_semi")
    return staged(_compared(rows, classes, apart=True, sets=sets).select("a", "b").distinct(), "late-links")


def _digest(text: str):
    return F.unhex(F.sha1(F.coalesce(F.col(text), F.lit(""))))


def near_duplicates(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Group documents whose sets of SHINGLE-word shingles have a Jaccard similarity of at least SIMILAR percent.

    Returns the columns but the text with text_digest, n_shingles, component_id and kept.  Words are separated by ASCII
    white space, A-Z count as a-z.  A text of fewer words is one shingle; null, empty and blank texts have no set, are
    linked with nothing and form their own component.  component_id: smallest doc_id that links reach; a null id is
    larger than any other, and null where all are null.  kept: doc_id equals component_id, so all rows that repeat the
    kept id are kept.  Empty tables give no rows; input columns named like an added one are replaced.
    """
    small_batches(documents.sparkSession)
    sketch = F.arrow_udf(sketches, "struct<n:bigint,key:binary,sketch:binary>")
    added = ("text_digest", "n_shingles", "component_id", "kept")
    keep = [c for c in documents.columns if c != text and c not in added]
    passed = [F.col(f"`{c}`") for c in keep]
    s, key, ident = fresh("sketch"), fresh("key"), fresh("id")
    rows = staged(documents.select(*passed, sketch(F.col(text)).alias(s), _digest(text).alias("text_digest")), "sketches")
    classes = staged(
        rows.where(F.col(f"{s}.n") > 0)
        .groupBy(F.col(f"{s}.key").alias("key"))
        .agg(
            F.min(F.col(doc_id)).alias("id"),
            F.any_value(f"{s}.n").alias("n"),
            F.any_value(f"{s}.sketch").alias("sketch"),
            F.min("text_digest").alias("digest"),
        ),
        "classes",
    )
    roots = _roots(classes, documents, text)
    ids = classes.select("key", "id").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = ids.groupBy("root").agg(F.min("id").alias(ident))
    named = ids.join(least, "root").select(F.col("key").alias(key), ident)
    out = rows.withColumn(key, F.col(f"{s}.key"))
    alone = out.where(F.col(f"{s}.n") == 0).withColumn(ident, F.col(doc_id))
    grouped = out.where(F.col(f"{s}.n") > 0).join(named, key)
    return grouped.unionByName(alone).select(
        *passed, "text_digest", F.col(f"{s}.n").alias("n_shingles"), F.col(ident).alias("component_id"),
        F.col(doc_id).eqNullSafe(F.col(ident)).alias("kept"),
    )


def _roots(classes: DataFrame, documents: DataFrame, text: str) -> DataFrame:
    """key, root for the classes that are linked with another one."""
    members, large = _leaves(classes)
    every = staged(members.unionByName(_blocks(large)), "leaf-members")
    forest = staged(_compared(every, classes), "forest")
    checked = _confirmed(forest.select("a", "b").distinct(), classes, documents, text)
    links = checked.where("linked").select("a", "b")
    roots = components(links).withColumnRenamed("node", "key")
    failed = checked.where("not linked").select("a", "b")
    again = forest.join(failed, ["a", "b"], "left_semi").select("leaf").distinct()
    reopened = every.join(again, "leaf", "left_semi").distinct().join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    found = _links_in_leaves(
        reopened.select("leaf", "key", "root").unionByName(_strays(large, roots)), classes, documents, text
    )
    if found.isEmpty():
        return roots
    return components(links.unionByName(found)).withColumnRenamed("node", "key")


def drop_near_duplicates(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents that near_duplicates keeps, unchanged."""
    ident, digest = fresh("id"), fresh("digest")
    thin = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    gone = near_duplicates(thin).where("not kept").select(F.col("doc_id").alias(ident), F.col("text_digest").alias(digest)).distinct()
    gone = staged(gone, "dropped-duplicates")
    same = F.col(ident).eqNullSafe(F.col(doc_id)) & (F.col(digest) == _digest(text))
    return documents.join(gone, same, "left_anti")
