"""Where a text first stands in a file, from a stored index instead of the contents.

The index holds the lines of every file.  Of a text to be found the first piece must end a line of the file, or stand in
one if it is the only piece; the lines of a file of which few texts are asked are compared with each of them.  For files
of which many texts are asked, digests of the words of each line and of the whole line are made: the words of a text that
no edge cuts and the lines that lie whole inside it must stand in the file with the same offsets, and the one of them
that is rarest in the file gives the candidates by an equi-join, so only their lines are compared.  A text without any
such anchor is compared with the lines of its own file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.session import stored

_WORD = r"[\p{L}\p{N}_]"
_LINES = "path string, line_no int, line string"
#: Texts of one file that are compared with all its lines; more are looked up by their anchors.
FEW = 64


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({_WORD}+)"), F.lit(1))


def _word_anchor(word: Column) -> Column:
    return F.xxhash64(F.lit("word"), word)


def _line_anchor(line: Column) -> Column:
    return F.xxhash64(F.lit("line"), line)


@dataclass
class LineIndex:
    """Lines of files with their numbers, from 1."""

    lines: DataFrame

    @staticmethod
    def write(files: DataFrame, folder: str) -> LineIndex:
        """Index ``files`` (path, content) below a folder; null contents have no lines."""
        split = F.posexplode(F.split("content", "\n", -1)).alias("at", "line")
        lines = files.select("path", split).select("path", (F.col("at") + 1).alias("line_no"), "line")
        lines.write.parquet(f"{folder}/lines")
        return LineIndex.read(files.sparkSession, folder)

    @staticmethod
    def read(spark: SparkSession, folder: str) -> LineIndex:
        return LineIndex(spark.read.schema(_LINES).parquet(f"{folder}/lines"))


def _anchors(pieces: Column) -> Column:
    """``array<struct<anchor, at>>`` of a text's pieces between line feeds."""
    last = F.size(pieces) - 1

    def of_piece(piece: Column, at: Column) -> Column:
        # Words that begin or end the text may go on in the file.
        left = F.when(at == 0, F.regexp_replace(piece, f"^{_WORD}+", "")).otherwise(piece)
        whole = F.when(at == last, F.regexp_replace(left, f"{_WORD}++$", "")).otherwise(left)
        words = F.transform(_words(whole), _word_anchor)
        inner = F.when((at > 0) & (at < last), F.array(_line_anchor(piece))).otherwise(F.array().cast("array<bigint>"))
        return F.transform(F.concat(words, inner), lambda a: F.struct(a.alias("anchor"), at.alias("at")))

    return F.flatten(F.transform(pieces, of_piece))


def _begins() -> Column:
    """Whether a text may begin in a line."""
    first = F.get("pieces", F.lit(0))
    return F.when(F.size("pieces") > 1, F.endswith("line", first)).otherwise(F.contains("line", first))


def _anchored_starts(asks: DataFrame, lines: DataFrame, key: list[str]) -> DataFrame:
    """``path, print, start``: the lines where the rarest anchor of a text would have it begin."""
    of_line = F.array_distinct(
        F.concat(F.transform(_words(F.col("line")), _word_anchor), F.array(_line_anchor(F.col("line"))))
    )
    places = lines.select("path", F.explode(of_line).alias("anchor"), "line_no")
    counts = places.groupBy("path", "anchor").agg(F.count(F.lit(1)).alias("n"))
    anchored = asks.select(*key, F.explode_outer(_anchors(F.col("pieces"))).alias("a")).select(*key, "a.*")
    counted = anchored.join(counts, ["path", "anchor"], "left")
    # An anchor that the file lacks comes first: then the text is not there.
    rarest = counted.groupBy(*key).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "anchor", "at")).alias("best"))
    best = rarest.select(*key, "best.*")
    placed = best.where("n > 0").join(places, ["path", "anchor"]).select(*key, (F.col("line_no") - F.col("at")).alias("start"))
    unanchored = best.where("anchor is null").select(*key).join(asks, key).join(lines, "path").where(_begins())
    return placed.where("start > 0").unionByName(unanchored.select(*key, F.col("line_no").alias("start"))).distinct()


def first_lines(wanted: DataFrame, index: LineIndex, few: int = FEW) -> DataFrame:
    """``path, text, line`` for each distinct path and text that the file holds: the line of its first place, from 1.

    Empty texts are not looked for.  The distinct texts are written aside once, as several steps need them.
    """
    asks = stored(wanted.where("text <> ''").select("path", "text").distinct(), "texts-to-find")
    many = asks.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > few).select("path")
    many = stored(many, "files-of-many-texts")
    asks = asks.withColumns({"print": F.xxhash64("text"), "pieces": F.split("text", "\n", -1)})
    key = ["path", "print"]
    last = F.size("pieces") - 1
    # Written aside, as the candidates and their pieces below: their real sizes decide whether lines are shuffled again.
    met = asks.join(many, "path", "left_anti").join(index.lines, "path").where(_begins())
    met = stored(met.select(*key, F.col("line_no").alias("start"), last.alias("last")), "lines-that-begin-texts")
    # A text of one piece stands in the line already.
    held_whole = met.where("last = 0")
    starts = met.where("last > 0").select(*key, "start").distinct()
    if not many.isEmpty():
        crowded = index.lines.join(many, "path", "left_semi")
        starts = starts.unionByName(_anchored_starts(asks.join(many, "path", "left_semi"), crowded, key))
    pieces = starts.join(asks, key).select(*key, "start", last.alias("last"), F.posexplode("pieces").alias("at", "piece"))
    spread = stored(pieces.withColumn("line_no", F.col("start") + F.col("at")), "pieces-to-match")
    fits = (
        F.when(F.col("last") == 0, F.contains("line", F.col("piece")))
        .when(F.col("at") == 0, F.endswith("line", F.col("piece")))
        .when(F.col("at") == F.col("last"), F.startswith("line", F.col("piece")))
        .otherwise(F.col("line") == F.col("piece"))
    )
    held = spread.join(index.lines, ["path", "line_no"]).where(fits).select(*key, "start", "last")
    whole = held.unionByName(held_whole).groupBy(*key, "start", "last").agg(F.count(F.lit(1)).alias("n")).where("n = last + 1")
    found = whole.groupBy(*key).agg(F.min("start").alias("line"))
    return found.join(asks, key).select("path", "text", "line")
