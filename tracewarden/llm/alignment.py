"""Operator 12: alignment of two tokenizers' tokens over the bytes of each text.

Tokenizer A (tokenizers, byte-level) reads a space and the text, tokenizer B (sentencepiece) the text, to which it adds
that space.  Their character offsets and proto spans are coarse cuts of the bytes: exact wherever a token begins where
the one before it ended.  Tokens between two such cuts - parts of a character, byte-fallback tokens - are placed by the
lengths of their decoded bytes, and the joined bytes of all tokens must be the text's.  Bytes at which tokens of both
end cut them into groups; inside a group every token overlaps its neighbours on the other side.

Texts are cut where neither tokenizer can see across: behind a character that is no white space and before a space or
line break, and between a letter and a punctuation mark.  A's splitting rule starts anew at these places, and B has no
piece with such two characters side by side, which the vocabulary file proves mark by mark.  So parts can be tokenized
in any company: a worker reads new parts in blocks, one library call and one numpy pass for each, and remembers their
alignments.  Vocabularies without the proof, and texts with a part whose bytes differ, are read as one part.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.token_counts import SPACE, Counter
from tracewarden.llm.work import fresh, small_batches, staged

#: Parts that a worker remembers, bytes of their alignments, and the longest of them in characters.
REMEMBERED, HELD, LONGEST = 600_000, 160 << 20, 40
#: New parts that are tokenized and aligned at once.
BLOCK = 500
#: Texts whose parts a worker holds at once.
TOGETHER = 250
#: Pairs with at least this share (one in so many) of all documents' pairs are known everywhere: at most so many.
HEAD = 1 << 17
#: Bits of an id of B in a pair.
ID_BITS = 31

#: Letters that every version of every library's tables knows as such; texts are cut behind no others.
LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
_LETTER, _OTHER = f"[{LETTERS}]", rf"[^\s{LETTERS}]"
#: Marks behind letters at which texts may be cut, where the vocabulary allows it.
MARKS = ",.;:!?)\"'-"


def part_pattern(marks: str) -> re.Pattern:
    """Parts of a text that begins with a space; marks: those that no letter before them can join."""
    own = f"[{re.escape(marks)}]" if marks else r"(?!)"
    body = f"{_OTHER}*+(?:{_LETTER}++(?!{own}){_OTHER}++)*+{_LETTER}*+"
    return re.compile(rf"(?:[ \n]\s*+|(?={own})){body}(?:[^\S \n]\s*+{body})*+")


def open_marks(pieces: list[str]) -> str:
    """The marks that stand behind a letter in no piece."""
    joined = {second for piece in pieces for second in re.findall(f"{_LETTER}(?=(.))", piece, re.DOTALL)}
    return "".join(m for m in MARKS if m not in joined)


@cache
def byte_characters() -> dict[str, int]:
    """What a byte-level vocabulary writes for every byte: printable bytes as they are, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


def refined_ends(spans: list[tuple[int, int]], sizes: list[int]) -> list[int]:
    """Where tokens end, from coarse byte spans and the lengths of their decoded bytes.

    A span's end is taken if the span is not empty and the next one begins there; else the token ends its own length
    behind the one before.
    """
    out, at = [], 0
    for i, (start, end) in enumerate(spans):
        exact = end > start and (i + 1 == len(spans) or spans[i + 1][0] == end)
        at = end if exact else at + sizes[i]
        out.append(at)
    return out


def all_ends(spans: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The same for arrays."""
    exact = spans[:, 1] > spans[:, 0]
    exact[:-1] &= spans[1:, 0] == spans[:-1, 1]
    by_size = np.cumsum(sizes)
    last = np.maximum.accumulate(np.where(exact, np.arange(len(sizes)), -1))
    return by_size + np.where(last >= 0, spans[last, 1] - by_size[last], 0)


def _names(count: int, close: str) -> tuple[np.ndarray, np.ndarray]:
    """Every id as text, with a comma and with the mark that closes a group's side."""
    return tuple(np.array([f"{i}{mark}" for i in range(count)], object) for mark in (",", close))


class Aligner:
    """Aligns parts of texts; a is the JSON of a byte-level tokenizer, b a sentencepiece model."""

    def __init__(self, a: str, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work to cores
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a)
        self.a.encode_special_tokens = True
        counter = Counter(b)
        self.b = counter.library
        codes = byte_characters()
        self.a_bytes = {i: bytes(map(codes.__getitem__, t)) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.b_bytes = [self._piece(i) for i in range(self.b.vocab_size())]
        plan = json.loads(a)
        splits = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        known = plan.get("pre_tokenizer") or {}
        self.proved = counter.proved and not plan.get("normalizer") and all(known.get(k) == v for k, v in splits.items())
        self.edge = len(self.b.encode("\n"))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size()) if not self.b.is_byte(i)]
        self.pattern = part_pattern(open_marks(pieces))
        self.a_names, self.b_names = _names(max(self.a_bytes) + 1, "|"), _names(len(self.b_bytes), ";")
        self.a_sizes, self.b_sizes = np.zeros(len(self.a_names[0]), np.int64), np.array(list(map(len, self.b_bytes)))
        for i, own in self.a_bytes.items():
            self.a_sizes[i] = len(own)
        self.clear()

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE, " ").encode()

    def clear(self) -> None:
        self.known: dict[str, int] = {}  # part -> its number
        self.groups: list[str] = []  # a1,a2|b1;...
        self.numbers = array("q")  # of every part: tokens of A, of B, groups, links
        self.pairs = array("q")  # a << ID_BITS | b of every link, part by part
        self.bad: set[int] = set()  # parts whose joined bytes differ
        self.held = 0

    def _align(self, text: str, a, b, skip: int, lead: int) -> None:
        """Add what is known of one text; skip: tokens of B before it, lead: bytes B's offsets are behind by."""
        data = text.encode("utf-8", "surrogatepass")
        a_ids = a.ids
        a_bytes = list(map(self.a_bytes.__getitem__, a_ids))
        b_tokens = b.pieces[skip:]
        b_ids = [t.id for t in b_tokens]
        b_bytes = list(map(self.b_bytes.__getitem__, b_ids))
        if b"".join(a_bytes) != data or b"".join(b_bytes) != data:
            self.bad.add(len(self.groups))
            self.groups.append("")
            self.numbers.extend((0, 0, 0, 0))
            return
        a_spans = a.offsets
        if not text.isascii():
            at = [0, *accumulate(len(c.encode()) for c in text)]
            a_spans = [(at[s], at[e]) for s, e in a_spans]
        a_ends = refined_ends(a_spans, list(map(len, a_bytes)))
        b_ends = refined_ends([(t.begin + lead, t.end + lead) for t in b_tokens], list(map(len, b_bytes)))
        # Both lists end with the text: one walk finds groups and links.
        out, pairs = [], []
        i = j = a_from = b_from = 0
        while i < len(a_ids):
            pairs.append(a_ids[i] << ID_BITS | b_ids[j])
            if a_ends[i] == b_ends[j]:
                i += 1
                j += 1
                out.append(",".join(map(str, a_ids[a_from:i])) + "|" + ",".join(map(str, b_ids[b_from:j])))
                a_from, b_from = i, j
            elif a_ends[i] < b_ends[j]:
                i += 1
            else:
                j += 1
        self.groups.append(";".join(out))
        self.numbers.extend((len(a_ids), len(b_ids), len(out), len(pairs)))
        self.pairs.extend(pairs)
        self.held += len(self.groups[-1]) + 8 * len(pairs)

    def _learn(self, parts: list[str]) -> None:
        """Align new parts: those that may stand next to others in blocks, the rest alone."""
        plain = [p for p in parts if SPACE not in p and not p[-1].isspace()]
        alone = [p for p in parts if SPACE in p or p[-1].isspace()]
        # Every part follows what it may follow: one that begins with a mark a letter, the first one a part as well.
        placed = [x for p in plain for x in ((p,) if p[0] in " \n" else (" a", p))]
        blocks = [placed[at : at + BLOCK] for at in range(0, len(placed), BLOCK)]
        texts = [" a" + "".join(block) for block in blocks]
        a = self.a.encode_batch(texts, add_special_tokens=False)
        b = self.b.encode([t[1:] for t in texts], return_type="proto", num_threads=1) if texts else []
        for block, text, x, y in zip(blocks, texts, a, b, strict=True):
            if not self._align_block(block, text, x, y):
                alone += block
        if alone:
            a = self.a.encode_batch(alone, add_special_tokens=False)
            # Behind a line break a part gets no space of its own.
            b = self.b.encode(["\n" + part for part in alone], return_type="proto", num_threads=1)
            for part, x, y in zip(alone, a, b, strict=True):
                self.known[part] = len(self.groups)
                self._align(part, x, y, self.edge, -1)

    def _align_block(self, block: list[str], text: str, a, b) -> bool:
        """The same for many parts at once; False if the joined bytes differ somewhere."""
        data = text.encode()
        sizes = [2, *(map(len, block) if text.isascii() else (len(p.encode()) for p in block))]
        a_ids = np.array(a.ids)
        b_ids, *b_spans = np.array([v for t in b.pieces for v in (t.id, t.begin, t.end)]).reshape(-1, 3).T
        joined = b"".join(map(self.a_bytes.__getitem__, a.ids)), b"".join(map(self.b_bytes.__getitem__, b_ids.tolist()))
        if joined != (data, data):
            return False
        a_spans = np.array(list(chain.from_iterable(a.offsets))).reshape(-1, 2)
        if not text.isascii():
            a_spans = np.array([0, *accumulate(len(c.encode()) for c in text)])[a_spans]
        b_spans = np.stack(b_spans, axis=1) + 1
        a_ends, b_ends = all_ends(a_spans, self.a_sizes[a_ids]), all_ends(b_spans, self.b_sizes[b_ids])
        # Bytes at which both end close groups; those at which one ends close links.
        common, every = np.intersect1d(a_ends, b_ends), np.union1d(a_ends, b_ends)
        edges = np.cumsum(sizes)
        if not np.isin(edges, common).all():
            return False
        a_group, b_group = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        # A group's tokens of A come before those of B; the last one of each side ends where the group does.
        names = np.concatenate(
            [np.where(ends == common[group], own[1][ids], own[0][ids])
             for ends, group, own, ids in ((a_ends, a_group, self.a_names, a_ids), (b_ends, b_group, self.b_names, b_ids))]
        )
        written = names[np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")].tolist()
        pairs = a_ids[np.searchsorted(a_ends, every)] << ID_BITS | b_ids[np.searchsorted(b_ends, every)]
        at = [np.searchsorted(ends, edges, side="right") for ends in (a_ends, b_ends, common, every)]
        counts = np.diff(np.stack(at, axis=1), axis=0)
        tokens = (at[0] + at[1]).tolist()
        first = len(self.groups)
        self.known.update(zip(block, range(first, first + len(block)), strict=True))
        groups = ["".join(written[low:high])[:-1] for low, high in zip(tokens[:-1], tokens[1:], strict=True)]
        self.groups += groups
        self.numbers.frombytes(counts.astype(np.int64).tobytes())
        self.pairs.frombytes(np.ascontiguousarray(pairs[at[3][0] :], np.int64).tobytes())
        self.held += sum(map(len, groups)) + 8 * int(counts[:, 3].sum())
        return True

    def _whole(self, text: str) -> int:
        """Number of a text that is read as one part."""
        self._align(" " + text, self.a.encode(" " + text, add_special_tokens=False), self.b.encode(text, return_type="proto"), 0, 1)
        return len(self.groups) - 1

    def align(self, texts: list[str | None]) -> list[list[int]]:
        """The numbers of each text's parts; a text without tokens has none."""
        if len(self.groups) > REMEMBERED or self.held > HELD:
            self.clear()
        if not self.proved:
            own = [[self._whole(t)] if t else [] for t in texts]
        else:
            parts = [self.pattern.findall(" " + t) if t else [] for t in texts]
            rest = set().union(*parts).difference(self.known)
            if rest:
                self._learn(sorted(rest))
            own = [list(map(self.known.__getitem__, p)) for p in parts]
            if self.bad:
                own = [x if self.bad.isdisjoint(x) else [self._whole(t)] for t, x in zip(texts, own, strict=True)]
            for part in rest:
                if len(part) > LONGEST:
                    del self.known[part]
        return [x if self.bad.isdisjoint(x) else [] for x in own] if self.bad else own


_ALIGNERS: dict[str, Aligner] = {}


def _aligner(digest: str, a: str, b: bytes) -> Aligner:
    """The worker's aligner of two files; the tasks of a worker share what it remembers."""
    if digest not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[digest] = Aligner(a, b)
    return _ALIGNERS[digest]


def _distinct(aligner: Aligner, part: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of every row, in order, with how often they stand there, and their rows; part: of which row."""
    links = np.frombuffer(aligner.numbers, np.int64).reshape(-1, 4)[:, 3]
    starts = np.cumsum(links) - links
    count = links[part]
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    pair = np.frombuffer(aligner.pairs, np.int64)[np.repeat(starts[part], count) + step]
    row = np.repeat(row, count)
    order = np.lexsort((pair, row))
    pair, row = pair[order], row[order]
    head = np.ones(len(pair), bool)
    head[1:] = (pair[1:] != pair[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(head)
    return pair[first], np.diff(np.append(first, len(pair))), row[first]


def align(
    documents: DataFrame, a: str | Path, b: str | Path, text: str = "text", keep_groups: bool = True, head: int = HEAD
) -> tuple[DataFrame, DataFrame]:
    """Two frames: the documents with their alignment, and the corpus's pairs (a, b, n_docs, best).

    a: file of a byte-level tokenizer of the tokenizers library; b: sentencepiece model.  Both read without special
    tokens, whose strings in a text are ordinary text.  The first frame has the other columns with n_a, n_b, n_groups,
    n_links, groups (``a1,a2|b1;a3|b2,b3``: ids in order; only with ``keep_groups``), groups_sha256 (of that string; empty
    without tokens), n_best (links whose pair is the most frequent of its A id, ties included) and count_sum (documents
    of the pair, summed over links).  Links are all pairs of an A and a B token whose byte ranges overlap; n_docs counts
    the documents that hold a pair; best: no pair of that A id is held by more.

    Null and empty texts, and texts whose joined token bytes differ from the space and the text (those with U+2581), have no
    tokens: zeros.  Texts of any length are read whole.  Every row is a document, repeated rows too; ids are not looked
    at.  Empty tables give no rows in either frame; input columns named like an added one are replaced.
    """
    small_batches(documents.sparkSession)
    files = (Path(a).read_text(encoding="utf-8"), Path(b).read_bytes())  # vocabulary files: at most some MB
    digest = hashlib.sha256(files[0].encode() + files[1]).hexdigest()
    added = ("n_a", "n_b", "n_groups", "n_links", "groups", "groups_sha256", "n_best", "count_sum")
    passed = [c for c in documents.columns if c != text and c not in added]
    own, key = fresh("own"), fresh("key")
    fields = "n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint," + ("groups:string," if keep_groups else "")
    fields += "groups_sha256:string,pairs:array<bigint>,times:array<int>"

    @F.arrow_udf(f"struct<{fields}>")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        aligner = _aligner(digest, *files)
        for batch in batches:
            pieces = [_rows(aligner, batch.slice(at, TOGETHER).to_pylist(), keep_groups) for at in range(0, len(batch), TOGETHER)]
            yield pa.concat_arrays(pieces) if pieces else pa.array([], _type(keep_groups))

    aligned = documents.select(*[f"`{c}`" for c in passed], read(F.col(text)).alias(own))
    aligned = staged(aligned.withColumn(key, F.monotonically_increasing_id()), "aligned-documents", compression="zstd")
    pairs = staged(_counted(aligned.select(F.explode(f"{own}.pairs").alias("pair"))), "token-pairs", compression="zstd")
    sums = _sums(aligned.select(F.col(key), F.col(f"{own}.pairs").alias("pairs"), F.col(f"{own}.times").alias("times")), pairs, key, head)
    names = ["n_a", "n_b", "n_groups", "n_links", *(["groups"] if keep_groups else []), "groups_sha256"]
    out = aligned.join(sums, key, "left").select(
        *[f"`{c}`" for c in passed], *[f"{own}.{n}" for n in names],
        *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("n_best", "count_sum")],
    )
    ids = F.shiftright("pair", ID_BITS), F.col("pair").bitwiseAND(F.lit((1 << ID_BITS) - 1))
    return out, pairs.select(ids[0].cast("int").alias("a"), ids[1].cast("int").alias("b"), "n_docs", "best")


def _type(keep_groups: bool) -> pa.DataType:
    number, word = pa.int64(), pa.string()
    fields = [(n, number) for n in ("n_a", "n_b", "n_groups", "n_links")] + ([("groups", word)] if keep_groups else [])
    return pa.struct([*fields, ("groups_sha256", word), ("pairs", pa.list_(number)), ("times", pa.list_(pa.int32()))])


def _rows(aligner: Aligner, texts: list[str | None], keep_groups: bool) -> pa.Array:
    parts = aligner.align(texts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    part, row = np.fromiter(chain.from_iterable(parts), np.int64, int(sizes.sum())), np.repeat(np.arange(len(parts)), sizes)
    sums = np.zeros((len(parts), 4), np.int64)
    np.add.at(sums, row, np.frombuffer(aligner.numbers, np.int64).reshape(-1, 4)[part])
    groups = [";".join(map(aligner.groups.__getitem__, x)) for x in parts]
    pair, times, of = _distinct(aligner, part, row)
    columns = [pa.array(c) for c in np.ascontiguousarray(sums.T)]
    if keep_groups:
        columns.append(pa.array(groups, pa.string()))
    columns.append(pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups], pa.string()))
    offsets = pa.array(np.searchsorted(of, np.arange(len(parts) + 1)), pa.int32())
    columns += [pa.ListArray.from_arrays(offsets, pa.array(pair)), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))]
    return pa.StructArray.from_arrays(columns, fields=list(_type(keep_groups)))


def _counted(pairs: DataFrame) -> DataFrame:
    """pair, n_docs, best; documents hold each of their pairs once."""
    counted = pairs.groupBy("pair").agg(F.count("*").alias("n_docs"))
    most = counted.groupBy(F.shiftright("pair", ID_BITS).alias("a")).agg(F.max("n_docs").alias("most"))
    return counted.join(most, F.shiftright("pair", ID_BITS) == F.col("a")).select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def _sums(held: DataFrame, pairs: DataFrame, key: str, head: int) -> DataFrame:
    """n_best and count_sum of every document that has links.

    Pairs with one in ``head`` of all documents' pairs or more are at most ``head`` rows and go to every task; the rest, of
    which none has many rows, is joined by pair.
    """
    total = pairs.agg(F.sum("n_docs")).first()[0] or 0
    frequent = F.col("n_docs") * head >= F.lit(total)
    links = held.select(key, F.explode(F.arrays_zip("pairs", "times")).alias("link")).select(key, "link.pairs", "link.times")
    links = links.withColumnRenamed("pairs", "pair")
    known = links.join(F.broadcast(pairs.where(frequent)), "pair", "left")
    rest = known.where("n_docs is null").select(key, "pair", "times").join(pairs.where(~frequent), "pair")
    columns = [key, (F.col("times") * F.col("best").cast("int")).alias("n_best"), (F.col("times") * F.col("n_docs")).alias("count_sum")]
    both = _summed(known.where("n_docs is not null").select(*columns), key).unionByName(_summed(rest.select(*columns), key))
    return _summed(both, key)


def _summed(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
