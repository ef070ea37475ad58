"""Operator 9: token counts with a whole-token shortcut.

A pre-token is a line break, or a run of spaces with the run of other characters behind it.  What the vocabulary
file says decides offline whether texts may be cut there: no piece has a space behind another character, and no
piece has a line break, so no merge ever crosses a cut and the counts of the pre-tokens add up.  Each vocabulary
string that encodes alone as one token is counted by a look-up; only other pre-tokens are merged by the library,
and short ones are remembered.  A model without this proof is run over whole texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.work import small_batches

SPACE = "▁"
#: What a worker remembers: pre-tokens, and the longest of them in characters.
REMEMBERED, LONGEST = 700_000, 40
#: Texts whose pre-tokens a worker holds at once.
TOGETHER = 250

_PARTS = re.compile(r"\n| *[^ \n]+| +")


def _fields(blob: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = blob[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(blob):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, blob[at : at + size]
            at += size


def _plain_normaliser(model: bytes) -> bool:
    """Whether the model only puts one space before a text and replaces no characters."""
    for field, value in _fields(model):
        if field == 3:  # the normaliser's settings
            spec = dict(_fields(value))
            return not spec.get(2) and spec.get(3, 1) == 1 and spec.get(4, 1) == 0 and spec.get(5, 1) == 1
    return False


@lru_cache(maxsize=4)
def _counter(digest: str, load):
    return Counter(load())


class Counter:
    """Counts the tokens of texts with one sentencepiece model."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        strings = [
            self.library.id_to_piece(i)
            for i in range(self.library.vocab_size())
            if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i))
        ]
        self.proved = _plain_normaliser(model) and not any(re.search(f"[^{SPACE}]{SPACE}|\n", s) for s in strings)
        self.known: dict[str, int] = {}
        if self.proved:
            self.edge = len(self.library.encode("\n"))
            whole = [s for s in strings if len(s) > 1 and s[0] == SPACE and SPACE not in s[1:]]
            alone = self.library.encode([s[1:] for s in whole], num_threads=1)
            self.known = {" " + s[1:]: 1 for s, ids in zip(whole, alone, strict=True) if len(ids) == 1}
            self.known["\n"] = self.edge - 1
        self.base = len(self.known)

    def _remember(self, parts: list[str]) -> None:
        # Behind a line break a pre-token gets no space of its own.
        ids = self.library.encode(["\n" + part for part in parts], num_threads=1)
        self.known.update(zip(parts, (len(x) - self.edge for x in ids), strict=True))

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; what must be merged is merged for all of them at once."""
        if not self.proved:
            return [len(x) for x in self.library.encode([t or "" for t in texts], num_threads=1)]
        if len(self.known) - self.base > REMEMBERED:
            for part in list(self.known)[self.base :]:
                del self.known[part]
        parts = [_PARTS.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        rest = set(chain.from_iterable(parts)).difference(self.known)
        self._remember(list(rest))
        out = [sum(map(self.known.__getitem__, own)) for own in parts]
        for part in rest:
            if len(part) > LONGEST:
                del self.known[part]
        return out


def count_tokens(frame: DataFrame, model: str | Path, text: str = "text", limit: int = 4_096) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit (more tokens than limit) for the text of every row.

    Tokens are those of the sentencepiece model file, without begin, end or added special tokens and without
    truncation; strings of special tokens inside a text are ordinary text.  A null or empty text has 0 bytes and 0
    tokens.  Texts of any length are counted whole.  Equal rows are counted alike, an empty table gives no rows,
    other columns pass through, and input columns named like an added one are replaced.
    """
    small_batches(frame.sparkSession)
    blob = Path(model).read_bytes()  # a vocabulary file: at most some MB
    digest = hashlib.sha256(blob).hexdigest()

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(digest, lambda: blob)
        for batch in batches:
            counts: list[int] = []
            for at in range(0, len(batch), TOGETHER):
                counts += counter.counts(batch.iloc[at : at + TOGETHER].tolist())
            yield pd.Series(counts, dtype="int64")

    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    counted = frame.withColumns({"n_bytes": size, "n_tokens": tokens(F.col(text))})
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
