"""Operator 11: lines that several documents share stay in the first of them only.

Every text is exploded into lines; a line's key (stripped, ASCII letters lower-cased) becomes two 64-bit digests, and
the distinct documents of each digest are counted.  Lines of digests over the threshold are looked up by an equi-join
that gives positions only; the texts meet the list of their own dropped positions and are put together again from the
lines that stay, in order.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.work import fresh, staged

#: ASCII white space, stripped from a line's ends.
BLANKS = " \t\n\x0b\f\r"
#: Keys with at least this share (one in so many) of all lines are dealt apart; there are at most so many of them.
HOT = 1_000
#: Parts into which the lines of such a key are dealt.
PARTS = 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = ["h0", "h1"]


def split_lines(text: Column) -> Column:
    """The lines of a text; a null or empty one is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(BLANKS)), _UPPER, _LOWER)


def _lines(documents: DataFrame, doc_id: str, text: str, least_chars: int) -> DataFrame:
    """doc, print (of the text), at, h0, h1 of every line whose key is long enough."""
    keyed = documents.select(
        F.col(doc_id).alias("doc"), F.xxhash64(text).alias("print"),
        F.posexplode(F.transform(split_lines(F.col(text)), line_key)).alias("at", "key"),
    ).where(F.length("key") >= least_chars)
    return keyed.select("doc", "print", "at", F.xxhash64("key").alias("h0"), F.xxhash64(F.lit(1), "key").alias("h1"))


def shared_lines(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", least_docs: int = 2, least_chars: int = 10) -> DataFrame:
    """Digests (h0, h1) of keys that at least ``least_docs`` documents hold, with first (smallest id) and n (lines).

    Documents are told apart by id; all rows with a null id are one document, which comes after all others.
    """
    lines = _lines(documents, doc_id, text, least_chars)
    no_id = F.max(F.when(F.col("doc").isNull(), 1).otherwise(0))
    counted = lines.groupBy(*_KEY).agg(
        F.min("doc").alias("first"), (F.count_distinct("doc") + no_id).alias("n_docs"), F.count("*").alias("n")
    )
    return counted.where(F.col("n_docs") >= least_docs).select(*_KEY, "first", "n")


def _dropped(lines: DataFrame, shared: DataFrame) -> DataFrame:
    """doc, print, at of shared lines outside the first document.

    A key with one line in HOT of all shared lines or more would be one task: there are at most HOT such keys, so they
    are known everywhere, and their lines are dealt to PARTS parts.
    """
    total = shared.agg(F.sum("n")).first()[0] or 0
    hot = shared.where(F.col("n") * HOT >= F.lit(total)).select(*_KEY, F.lit(True).alias("hot"))
    part = F.when(F.col("hot"), F.pmod(F.xxhash64("doc", "print", "at"), F.lit(PARTS))).otherwise(F.lit(0)).cast("int")
    marked = lines.join(F.broadcast(hot), _KEY, "left").withColumn("part", part).drop("hot")
    is_hot = F.col("n") * HOT >= F.lit(total)
    every = F.sequence(F.lit(0), F.lit(PARTS - 1))
    firsts = shared.select(*_KEY, "first", F.explode(F.when(is_hot, every).otherwise(F.array(F.lit(0)))).alias("part"))
    held = marked.join(firsts, [*_KEY, "part"])
    return held.where(~F.col("doc").eqNullSafe(F.col("first"))).select("doc", "print", "at")


def drop_shared_lines(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", least_docs: int = 2, least_chars: int = 10
) -> DataFrame:
    """The documents with the text that is left, n_lines (before) and n_dropped.

    A text is split at line feeds; a line's key is the line without ASCII white space at its ends and with A-Z
    lower-cased.  Keys of at least ``least_chars`` code points that at least ``least_docs`` documents hold lose all
    their lines except in the document of the smallest id; the other lines stay as they are, joined by line feeds.

    A null or empty text is one empty line; null stays null.  Documents are told apart by id: rows of one id are one
    document, each with its own text and result, and rows with a null id are one document that comes last.  Repeated
    rows get the same result.  Texts of any length are read whole; an empty table gives no rows; other columns pass
    through, and input columns named like an added one are replaced.
    """
    added = ("n_lines", "n_dropped")
    passed = [c for c in documents.columns if c not in added]
    shared = staged(shared_lines(documents, doc_id, text, least_docs, least_chars), "shared-lines", compression="zstd")
    gone, doc, print_ = fresh("gone"), fresh("doc"), fresh("print")
    lists = (
        _dropped(_lines(documents, doc_id, text, least_chars), shared)
        .groupBy(F.col("doc").alias(doc), F.col("print").alias(print_)).agg(F.collect_set("at").alias(gone))
    )
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col(doc)) & (F.xxhash64(text) == F.col(print_))
    met = documents.select(*[f"`{c}`" for c in passed]).join(lists, same, "left")
    # Bound to a variable, a text is split once.
    kept = F.transform(
        F.array(split_lines(F.col(text))),
        lambda lines: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)), lambda at: F.get(lines, at)), "\n"
        ),
    )
    size = F.coalesce(F.regexp_count(text, F.lit("\n")), F.lit(0)) + 1
    dropped = F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(gone))
    left = F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.get(kept, 0))
    return met.select(
        *[left.alias(c) if c == text else F.col(f"`{c}`") for c in passed],
        size.cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"),
    )
