"""Operator 1: mixing sources to target weights with fixed-length blocks.

The documents of a source, in a pseudorandom order, make one stream of words that is cut into blocks of ``block``
words.  Every source gets a number of slots that fills its target; each slot is dealt to an output shard by a
seeded draw, which makes the source counts of the shards multinomial with exact totals.  A source's slots run
through a pseudorandom permutation of its block numbers, once per epoch, and meet the blocks by number.  Stream
positions are prefix sums over three levels of buckets, so no source is ever one group.  The documents' words are cut
where blocks end and packed by block number; a slot that meets its block is one row of its shard, with the words, and
what a document gives to the mixture is counted from these rows.  Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.llm.work import WORD, discard, fresh, staged, staged_at, word_count

BLOCK = 64
#: Documents of a bucket, and buckets of a group of buckets.
BUCKET, GROUP = 256, 256
#: Slots written out by one row, and slots of an output shard on average.
CHUNK, SHARD = 16_384, 65_536
#: Rounds in which slots meet the words of their blocks.
ROUNDS = 2
#: Parts of a shard in which positions are counted.
PARTS = 64
#: Tasks that write slots out at most.
TASKS = 10_000
#: Primes larger than any number of blocks; one multiplies block numbers in each epoch.
PRIMES = (2305843009213693951, 2305843009213693921)

_SPACE = 1 << 60


@dataclass
class Mixture:
    documents: DataFrame  # the input's columns with size, source_size, target, taken
    sources: DataFrame  # rank, source, size, weight, target, blocks, slots
    slots: DataFrame  # rank, slot, shard, position, block: what each output shard takes, and in which order
    shards: DataFrame  # the slots with pieces (start of the document in the stream, doc_id, offset, words, text), in order


def draw(seed: str, *parts: Column) -> Column:
    """60 pseudorandom bits from a seed and values, the same in every engine that has MD5."""
    text = [F.coalesce(p.cast("string"), F.lit("null")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *text)), 1, 15), 16, 10).cast("long")


def source_targets(sized: DataFrame, source: str, size: str, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """One row per source with its weight and target; the number of sources is taken to be small."""
    totals = sized.groupBy(F.col(source).alias("source")).agg(
        F.sum(size).cast("long").alias("source_size"), F.count("*").alias("rows")
    )
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int") + 1)
    ranked = totals.withColumn("rank", rank).withColumn("weight", weight)
    ranked = ranked.withColumn("cap", most * F.col("source_size"))
    # Sources reach their cap in this order; what they leave is shared by weight among those behind them.
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    every = Window.partitionBy()
    filled = ranked.withColumns(
        {
            "all": share * F.sum("source_size").over(every),
            "before": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "left": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
        }
    ).withColumn("full", F.col("cap") <= (F.col("all") - F.col("before")) / F.col("left") * F.col("weight"))
    level = (F.col("all") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0.0))) / F.sum(
        F.when(~F.col("full"), F.col("weight"))
    ).over(every)
    return filled.withColumn("level", level).select(
        "rank", "source", "source_size", "rows", "weight",
        F.when(F.col("full"), F.col("cap")).otherwise(F.col("level") * F.col("weight")).alias("target"),
    )


def mix_sources(
    documents: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    block: int = BLOCK,
    seed: str = "mix",
    keep_text: bool = False,
) -> Mixture:
    """Draw a mixture of ``share`` times all words in which sources stand by weight, none above ``most`` times its size.

    Size: words of the text that ASCII white space separates; null and empty texts have size 0 and take no part, but
    keep their row with taken 0.  Sources weigh ``weights`` in turn by code point, a null source last.  taken: words
    of the document in the mixture, repeats counted, at most ``most`` times its size.  A source's taken words differ
    from its target by less than ``most`` blocks.  The same rows give the same mixture in any order and partitioning;
    equal rows are different documents that may take different amounts, and rows of equal doc_id and text may swap
    theirs.  A null doc_id is a value like others.  Empty tables give no rows.  Other columns pass through; input
    columns named like an added one are replaced.

    Shards are written before this returns: one row for every slot, with a block's pieces in the order of the stream.  A
    piece's text has single spaces between its words; offset counts the document's words before it.  Positions of a shard
    run from 0.  ``documents`` is read twice and must give the same rows.
    """
    added = ("size", "source_size", "target", "taken")
    keep = [c for c in documents.columns if c not in added and (keep_text or c != text)]
    size, at, tie, rank, start, key, bucket, width = (
        fresh(n) for n in ("size", "draw", "tie", "rank", "start", "key", "bucket", "width")
    )
    measured = documents.withColumns({size: word_count(F.col(text)), at: draw(seed, F.col(doc_id)), tie: F.xxhash64(text)})
    sized = staged(measured.select(*[f"`{c}`" for c in keep], size, at, tie), "sized-documents")
    targets = source_targets(sized, source, size, weights, share, most)
    blocks = F.ceil(F.col("source_size") / block)
    slots = F.least(F.round(F.col("target") * blocks / F.col("source_size")), F.lit(most) * blocks).cast("long")
    sources = staged(
        targets.withColumns(
            {
                "blocks": blocks,
                "slots": F.when(F.col("source_size") > 0, slots).otherwise(F.lit(0)).cast("long"),
                "width": F.expr(f"{_SPACE} div ceil(rows / {BUCKET})") + 1,
            }
        ),
        "mixture-sources",
    )
    mine = sources.select(F.col("source").alias(key), F.col("rank").alias(rank), F.col("width").alias(width), "target", "source_size")

    def placed_in_stream(rows: DataFrame) -> DataFrame:
        dealt = rows.join(mine, F.col(f"`{source}`").eqNullSafe(F.col(key))).withColumn(bucket, F.expr(f"`{at}` div `{width}`"))
        return _positions(dealt, sized_sums, rank, bucket, [at, doc_id, size, tie], size, start).drop(key, width)

    sums = sized.join(mine, F.col(f"`{source}`").eqNullSafe(F.col(key))).withColumn(bucket, F.expr(f"`{at}` div `{width}`"))
    sized_sums = sums.groupBy(rank, bucket).agg(F.sum(size).alias("words"))
    placed = staged(placed_in_stream(sized), "placed-documents")
    # The words go with their own pass: here they cross two shuffles, as documents and as pieces.
    texts = placed_in_stream(measured.select(text, doc_id, source, size, at, tie)).where(F.col(size) > 0)
    cuts = cut(texts.select(rank, start, doc_id, text), rank, start, doc_id, text, block)
    drawn = staged(draw_slots(sources, seed), "mixture-slots", compression="zstd")
    shards = _shards(drawn, cuts)
    taken = (
        shards.select("rank", F.explode("pieces").alias("piece"))
        .groupBy(F.col("rank").alias(rank), F.col("piece.start").alias(key))
        .agg(F.sum("piece.words").cast("long").alias("taken"))
    )
    # Documents without words share their start with the next one: they get a key that meets nothing.
    keyed = placed.withColumn(key, F.when(F.col(size) > 0, F.col(start)).otherwise(-1 - F.col(at)))
    out = keyed.join(taken, [rank, key], "left").select(
        *[f"`{c}`" for c in keep],
        F.col(size).alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
    )
    return Mixture(out, sources, drawn, shards)


def cut(texts: DataFrame, rank: str, start: str, doc_id: str, text: str, block: int) -> DataFrame:
    """The words of each document that begins at start of its source's stream, cut where blocks end."""
    begin = F.col(start)

    def piece(words: Column, number: Column) -> Column:
        offset = F.greatest(number * block - begin, F.lit(0))
        part = F.slice(words, (offset + 1).cast("int"), ((number + 1) * block - begin - offset).cast("int"))
        return F.struct(number.alias("block"), offset.alias("offset"), part.alias("part"))

    # Bound to a variable, the words of a text are found once and not for every block.
    of_all = F.transform(
        F.array(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))),
        lambda words: F.transform(
            F.sequence(F.expr(f"`{start}` div {block}"), F.floor((begin + F.size(words) - 1) / block)), lambda number: piece(words, number)
        ),
    )
    pieces = texts.select(F.col(rank).alias("rank"), begin.alias("start"), F.col(doc_id).alias("doc_id"), F.explode(F.get(of_all, 0)).alias("piece"))
    return pieces.select(
        "rank", "piece.block", "start", "doc_id", "piece.offset",
        F.size("piece.part").cast("long").alias("words"), F.array_join("piece.part", " ").alias("text"),
    )


def _shards(slots: DataFrame, cuts: DataFrame) -> DataFrame:
    """Slots with their blocks, in rounds, so that the disk holds the shuffle of one and what is left of the cut words."""
    spark = slots.sparkSession
    turn = F.pmod("block", F.lit(ROUNDS)).cast("int")
    pieces, folder = staged_at(cuts.withColumn("round", turn), "cut-words", by="round", compression="zstd")
    done = []
    for k in range(ROUNDS):
        # Their number is not seen in the size of the table they are exploded from: never a table to broadcast.
        mine = slots.where(turn == k).hint("merge")
        done.append(staged(mine.join(pack(pieces.where(F.col("round") == k)), ["rank", "block"]), "mixture-shards", compression="zstd"))
        discard(spark, f"{folder}/round={k}")
    return reduce(DataFrame.unionByName, done)


def pack(pieces: DataFrame) -> DataFrame:
    """Blocks with their pieces in order: as many at most as a block has words."""
    piece = F.struct("start", "doc_id", "offset", "words", "text")
    return pieces.groupBy("rank", "block").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))


def _positions(dealt: DataFrame, sums: DataFrame, rank: str, bucket: str, order: list[str], size: str, start: str) -> DataFrame:
    """Where each document begins in its source's stream, given the words of each bucket."""
    group = F.floor(F.col(bucket) / GROUP).cast("long")
    before = lambda by, order: F.coalesce(
        F.sum("words").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    sums = sums.withColumn("group", group)
    groups = sums.groupBy(rank, "group").agg(F.sum("words").alias("words"))
    groups = groups.select(rank, "group", before([rank], "group").alias("before_group"))
    buckets = sums.select(rank, "group", bucket, before([rank, "group"], bucket).alias("before_bucket"))
    base = fresh("base")
    starts = buckets.join(groups, [rank, "group"]).select(rank, bucket, (F.col("before_group") + F.col("before_bucket")).alias(base))
    earlier = Window.partitionBy(rank, bucket).orderBy(*[f"`{c}`" for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    inner = dealt.withColumn(start, F.coalesce(F.sum(size).over(earlier), F.lit(0)))
    return inner.join(starts, [rank, bucket]).withColumn(start, F.col(start) + F.col(base)).drop(base, bucket)


def draw_slots(sources: DataFrame, seed: str) -> DataFrame:
    """Every slot with its shard, its position there and its block."""
    # One draw for each epoch of a source, not for each slot.
    turns = F.transform(F.expr("sequence(0L, (slots - 1) div blocks)"), lambda epoch: draw(f"{seed}-turn", F.col("rank"), epoch))
    chunks = sources.where("slots > 0").select("rank", "blocks", "slots", turns.alias("turns")).select(
        "rank", "blocks", "slots", "turns", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(slots - 1) div {CHUNK}"))).alias("chunk")
    )
    total = sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    # Rows of a few bytes that grow to CHUNK slots each: as many tasks as there are such rows.
    tasks = min(max(1, -(-total // CHUNK)), TASKS)
    slots = chunks.repartition(tasks, "rank", "chunk").select(
        "rank", "blocks", "turns",
        F.explode(F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, F.col("slots")) - 1)).alias("slot"),
    )
    epoch = F.expr("slot div blocks")
    numbered = slots.withColumn("epoch", epoch).withColumn("turn", F.get("turns", F.col("epoch").cast("int")))
    prime = F.element_at(F.array(*map(F.lit, PRIMES)), F.pmod("epoch", F.lit(len(PRIMES))).cast("int") + 1)
    wide = "decimal(20,0)"
    moved = F.pmod(F.col("slot"), F.col("blocks")).cast(wide) * F.pmod(prime, F.col("blocks")).cast("decimal(18,0)")
    block = ((moved + F.pmod("turn", F.col("blocks")).cast("decimal(18,0)")) % F.col("blocks").cast("decimal(18,0)")).cast("long")
    shards = F.lit(max(1, -(-total // SHARD)))
    dealt = numbered.select(
        "rank", "slot", F.pmod(F.xxhash64(F.lit(f"{seed}-shard"), "rank", "slot"), shards).alias("shard"), block.alias("block"),
        F.xxhash64(F.lit(f"{seed}-place"), "rank", "slot").bitwiseAND(F.lit(_SPACE - 1)).alias("place"),
    ).withColumn("part", F.expr(f"place div {_SPACE // PARTS}"))
    dealt = staged(dealt, "dealt-slots", compression="zstd")
    counts = dealt.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("place", "rank", "slot"))
    # Parts are few for a shard, slots are not: only the former may ever be a table to broadcast.
    placed = dealt.withColumn("inside", inside).hint("merge").join(bases, ["shard", "part"])
    return placed.select("rank", "slot", "shard", (F.col("base") + F.col("inside") - 1).alias("position"), "block")


def emitted(mixture: Mixture, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The mixture's words, a row for every piece: shard, position and start put them in order.

    offset: words of the document before the piece.  size and taken: words of the piece; over all rows of a document
    taken sums to what the mixture takes of it.
    """
    names = mixture.sources.select("rank", F.col("source").alias(source))
    rows = mixture.shards.select("rank", "shard", "position", "block", F.explode("pieces").alias("piece"))
    return rows.join(names, "rank").select(
        F.col("piece.doc_id").alias(doc_id), F.col("piece.text").alias("text"), source, "shard", "position", "block",
        "piece.start", "piece.offset", F.col("piece.words").alias("size"), F.col("piece.words").alias("taken"),
    )
