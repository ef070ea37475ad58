"""Operator 7: chat formatting by linking quotations.

Lines that begin with ``>`` are quoted, once for every ``>``.  A passage is a run of lines of one level without a
blank one between them.  Normalised passages, and their lines for quotes that were cut or wrapped anew, are hashed and
meet what earlier messages of the conversation wrote themselves.  Messages then follow the message they quote, and
linked quotes leave the text; lines that quote nothing known stay.  The latest earlier writer is found with running maxima over chunks of turns, so no pair of a
quote and every writer is made and no conversation is one group.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.llm.work import fresh, staged

#: Turns of one chunk of a conversation.
CHUNK = 4_096
#: Lines that introduce a quote: fixed phrases of mail and chat programs.
INTRODUCTION = r"(?i)^\s*(?:on .*wrote|am .*schrieb.*|le .*a écrit|el .*escribió)\s*:\s*$"

_MARKS = r"^(?:[ \t]{0,3}>)+"


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 0), "[^>]", ""))


def normalised(text: Column) -> Column:
    """Lower case, white space runs as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _lines(text: Column) -> Column:
    return F.transform(
        F.split(text, r"\r\n|\r|\n"),
        lambda x, i: F.struct(i.alias("at"), x.alias("raw"), _level(x).alias("level"), normalised(F.regexp_replace(x, _MARKS, "")).alias("body")),
    )


def unquoted(lines: str, gone: str) -> Column:
    """The lines but those at the positions gone and introductions of them, trimmed of blank lines at both ends."""
    intro = lambda i: F.get(lines, i)["raw"].rlike(INTRODUCTION) & F.array_contains(gone, i + 1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    kept = F.transform(F.filter(left, lambda i: ~intro(i)), lambda i: F.get(lines, i)["raw"])
    return F.regexp_replace(F.array_join(kept, "\n"), r"^(?:[ \t]*\n)+|(?:\n[ \t]*)+$", "")


def _units(messages: DataFrame, lines: str, key: str, conv: str, turn: str) -> DataFrame:
    """Passages and lines: key, conv, turn, level, passage, whole (of a passage), hash, size, places (of its lines)."""
    flat = messages.select(key, F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.explode(lines).alias("line")).select(
        key, "conv", "turn", "line.at", "line.level", "line.body"
    )
    # A message's lines are bounded by its text.
    order = Window.partitionBy(key, "conv", "turn").orderBy("at")
    breaks = (F.col("body") == "") | (F.col("level") != F.lag("level", 1, -1).over(order))
    flat = flat.withColumn("passage", F.sum(breaks.cast("int")).over(order)).where("body != ''")
    line = flat.select(key, "conv", "turn", "level", "passage", F.lit(False).alias("whole"), "body", F.array("at").alias("places"))
    passage = flat.groupBy(key, "conv", "turn", "level", "passage").agg(F.array_sort(F.collect_list(F.struct("at", "body"))).alias("own"))
    passage = passage.select(
        key, "conv", "turn", "level", "passage", F.lit(True).alias("whole"),
        F.array_join(F.transform("own", lambda x: x["body"]), " ").alias("body"), F.transform("own", lambda x: x["at"]).alias("places"),
    )
    units = passage.unionByName(line)
    return units.select(
        key, "conv", "turn", "level", "passage", "whole", F.sha1("body").alias("hash"), F.length("body").alias("size"), "places"
    )


def _originals(units: DataFrame, key: str) -> DataFrame:
    """Each quoted unit with the latest earlier turn that wrote it itself, or null."""
    events = units.withColumns({"chunk": F.floor(F.col("turn") / CHUNK).cast("long"), "own": F.when(F.col("level") == 0, F.col("turn"))})
    hashed = ["conv", "hash"]
    chunks = events.groupBy(*hashed, "chunk").agg(F.max("own").alias("last"))
    over = Window.partitionBy(*hashed).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.withColumn("carried", F.max("last").over(over)).drop("last")
    within = Window.partitionBy(*hashed, "chunk").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = events.withColumn("near", F.max("own").over(within)).where("level > 0")
    found = near.join(carried, [*hashed, "chunk"], "left")
    return found.select(key, "conv", "turn", "level", "passage", "whole", "size", "places", F.coalesce("near", "carried").alias("original"))


def link_quotes(
    messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """The quoted passages with their originals, and the messages in reply order without quotes.

    Quotes: conv, turn, level, passage, original (turn or null).  A passage is linked to the latest earlier message
    of its conversation that wrote it itself; where nobody wrote the whole, to the message that wrote most of its
    lines (by characters), the later of equals.

    Messages: the input's columns with the text without linked quotes and the lines that introduce them, n_quotes,
    n_linked, max_level, links (level, passage and original of each linked passage, in order), parent_turn, thread_turn and
    depth.  Quoted lines that link to nothing stay in the text.  The parent is the message that wrote most characters of the lowest quoted level, the
    later of equals; a message that quotes nothing known begins a thread of its own (parent null, depth 0).  The
    rows are sorted by conversation, thread and turn, so that each follows its parent.

    Null texts stay null; empty texts stay empty.  Null conversations or turns are never linked.  Rows of equal
    conversation and turn are one place in the conversation; equal rows are treated alike and all kept.  Other columns pass through; input columns named like an added one are replaced.  Empty tables give empty results.
    """
    added = ["n_quotes", "n_linked", "max_level", "links", "parent_turn", "thread_turn", "depth"]
    columns = [c for c in messages.columns if c not in added]
    key, lines, gone = fresh("message"), fresh("lines"), fresh("gone")
    parsed = messages.select(*[f"`{c}`" for c in columns]).withColumn(lines, _lines(F.col(text)))
    parsed = parsed.withColumn(key, F.sha1(F.coalesce(text, F.lit(""))))
    quoting = F.exists(lines, lambda x: x["level"] > 0)
    placed = F.col(conv).isNotNull() & F.col(turn).isNotNull() & F.col(text).isNotNull()
    concerned = parsed.where(placed & quoting).select(F.col(conv).alias("with_quotes")).distinct()
    near = parsed.where(placed).join(concerned, F.col(conv) == F.col("with_quotes"), "left_semi")
    near = near.select(key, conv, turn, lines).dropDuplicates([key, conv, turn])
    found = staged(_originals(_units(near, lines, key, conv, turn), key), "quoted-units")
    place = [key, "conv", "turn"]
    passage = [*place, "level", "passage"]
    whole = found.where("whole").select(*passage, "size", "places", F.col("original").alias("by_passage"))
    votes = found.where("not whole and original is not null").groupBy(*passage, "original").agg(F.sum("size").alias("votes"))
    by_lines = votes.groupBy(*passage).agg(F.max_by("original", F.struct("votes", "original")).alias("by_lines"))
    quotes = staged(
        whole.join(by_lines, passage, "left").select(*passage, "size", "places", F.coalesce("by_passage", "by_lines").alias("original")), "quotes"
    )
    lowest = quotes.withColumn("lowest", F.min(F.when(F.col("original").isNotNull(), F.col("level"))).over(Window.partitionBy(*place)))
    answered = lowest.where("original is not null and level = lowest").groupBy(*place, "original").agg(F.sum("size").alias("size"))
    parents = answered.groupBy(*place).agg(F.max_by("original", F.struct("size", "original")).alias("parent_turn"))
    counts = quotes.groupBy(*place).agg(
        F.count("*").alias("n_quotes"), F.count("original").alias("n_linked"), F.max("level").alias("max_level"),
        # As many as the message's text has passages and lines.
        F.array_sort(F.collect_list(F.when(F.col("original").isNotNull(), F.struct("passage", "level", "original")))).alias("links"),
        F.flatten(F.collect_list(F.when(F.col("original").isNotNull(), F.col("places")))).alias(gone),
    )
    linked = staged(counts.join(parents, place, "left"), "linked-messages")
    threads = _threads(linked.groupBy("conv", "turn").agg(F.max("parent_turn").alias("parent")))
    facts = linked.join(threads, ["conv", "turn"], "left").select(
        F.col(key).alias("k"), F.col("conv").alias("c"), F.col("turn").alias("t"), "n_quotes", "n_linked", "max_level", "links", "parent_turn", "root", "depth", gone
    )
    joined = parsed.join(facts, (F.col(key) == F.col("k")) & (F.col(conv) == F.col("c")) & (F.col(turn) == F.col("t")), "left")
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    clean = F.when(F.col("n_linked") > 0, unquoted(lines, gone)).otherwise(F.col(text))
    link = lambda x: F.struct(x["level"].cast("long").alias("level"), x["passage"].cast("long").alias("passage"), x["original"].cast("long").alias("original"))
    none = F.array().cast("array<struct<level:bigint,passage:bigint,original:bigint>>")
    out = joined.select(
        *[clean.alias(text) if c == text else F.col(f"`{c}`") for c in columns],
        zero("n_quotes"), zero("n_linked"), zero("max_level"), F.coalesce(F.transform("links", link), none).alias("links"),
        F.col("parent_turn").cast("long"), F.coalesce("root", F.col(turn)).cast("long").alias("thread_turn"), zero("depth"),
    )
    return quotes.drop(key, "size", "places"), out.orderBy(conv, "thread_turn", turn)


def _threads(parents: DataFrame) -> DataFrame:
    """Root and depth of every message with a parent, by doubling jumps: as many rounds as the depth has bits."""
    state = staged(
        parents.where("parent is not null").select("conv", "turn", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")), "threads"
    )
    while True:
        up = state.select("conv", F.col("turn").alias("root"), F.col("root").alias("above"), F.col("depth").alias("more"))
        moved = staged(
            state.join(up, ["conv", "root"], "left").select(
                "conv", "turn", F.coalesce("above", "root").alias("root"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("above").isNotNull().alias("went"),
            ),
            "threads",
        )
        state = moved.drop("went")
        if moved.where("went").isEmpty():
            return state
