import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import brute
from tracewarden.llm import alignment, lines, negatives

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _line_rows(seed):
    rnd = random.Random(seed)
    pool = ["shared line one", "  Shared LINE one\t", "short", "123456789", "1234567890", "", "\r", "é" * 10, "É" * 10, "another line that repeats", "x\x85" + "y" * 9]
    rows = [(i, "\n".join(rnd.choice([*pool, f"own line of document {i}"]) for _ in range(rnd.randrange(1, 9)))) for i in range(60)]
    odd = [(3, "shared line one\nmore"), (3, rows[3][1]), (None, "shared line one\nnull one of two"), (None, "null one of two")]
    return rows + odd + [(70, None), (71, ""), (72, "\n")]


def _lines_left(rows, least_docs=2):
    left = brute.without_shared_lines(rows, least_docs)
    return Counter((d, *x[:2], x[2] if t is not None else None) for (d, t), x in zip(rows, left, strict=True))


@pytest.mark.parametrize("docs,hot", [(2, lines.HOT), (3, 2)])
def test_lines_equal_brute_force(spark, monkeypatch, docs, hot):
    monkeypatch.setattr(lines, "HOT", hot)
    rows = _line_rows(docs)
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, first string, n_lines string").repartition(4)
    out = lines.drop_shared_lines(frame, least_docs=docs).collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out) == _lines_left(rows, docs)
    assert {r["first"] for r in out} == {"x"}


def test_lines_of_awkward_rows(spark, awkward, no_documents):
    rows = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    out = lines.drop_shared_lines(awkward)
    assert set(out.columns) == {*awkward.columns, "n_lines", "n_dropped"}
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect()) == _lines_left(rows)
    assert lines.drop_shared_lines(no_documents).collect() == []


def test_a_very_common_line_is_dealt_to_many_tasks(spark):
    text = F.concat(F.lit("a line of every document\nown line "), F.col("id"))
    frame = spark.range(20_000).select(F.col("id").alias("doc_id"), text.alias("text"))
    out = lines.drop_shared_lines(frame.repartition(4))
    assert [tuple(r) for r in out.groupBy("n_dropped").count().orderBy("n_dropped").collect()] == [(0, 1), (1, 19_999)]
    shared = lines.shared_lines(frame)
    assert [tuple(r)[2:] for r in shared.collect()] == [(0, 20_000)]
    plan = lines._dropped(lines._lines(frame, "doc_id", "text", 10), shared)._jdf.queryExecution().toString()
    assert "part" in plan and "Python" not in plan


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


ODD = [
    "plain words, plain words", "a\tb \n c\t d\n\n\ne", "é日本語 😀😀 \U000e0001 𓀀x", "  two  spaces   three ", "\n", " ", "\t",
    "<|endoftext|> <s></s> <unk>", "tab\t \n x", "nbsp  　x   y", "it's we'll 1234567 !!! ... ''", "a▁b c",
    "end▁", "\x1c \x85 z", "\r\n\r\n", "é ö", "x" * 300, None, "", "\x00",
]


def _check(spark, texts, libraries, head):
    schema = "doc_id long, text string, pair string, n_a string, a string"
    frame = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(texts)], schema)
    out, pairs = alignment.align(frame.repartition(3), A, B, head=head)
    expected, count = brute.aligned(texts, *libraries)
    rows = {r["doc_id"]: r.asDict() for r in out.collect()}
    assert len(rows) == len(texts)
    for i, own in enumerate(expected):
        assert {k: rows[i][k] for k in own} == own, texts[i]
        assert rows[i]["pair"] == "x" and rows[i]["a"] == "z"
    assert {(r["a"], r["b"]): (r["n_docs"], r["best"]) for r in pairs.collect()} == count


@pytest.mark.parametrize("head", [alignment.HEAD, 20])
def test_alignment_equals_brute_force(spark, libraries, text_prose, head):
    texts = [*ODD, *ODD[:4], *(text_prose(i, 30) for i in range(20)), "日本語の文章には空白がない" * 30]
    _check(spark, texts, libraries, head)


def test_alignment_of_awkward_rows(spark, awkward, no_documents, libraries):
    texts = [r["text"] for r in awkward.select("text").collect()]
    out, _ = alignment.align(awkward, A, B, keep_groups=False)
    assert "groups" not in out.columns
    small = [t for t in texts if t is None or len(t) < 5_000]
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    found = Counter(tuple(r[n] for n in names) for r in out.collect())
    assert sum(found.values()) == len(texts)
    assert not Counter(tuple(d[n] for n in names) for d in brute.aligned(small, *libraries)[0]) - found
    empty, pairs = alignment.align(no_documents, A, B)
    assert empty.collect() == [] and pairs.collect() == []


@settings(max_examples=200, deadline=None)
@given(
    st.lists(
        st.text(st.one_of(st.sampled_from(" \n\t\u00a0▁abs'é日😀.,!-1"), st.characters(exclude_categories=["Cs"])), max_size=40),
        min_size=1, max_size=4,
    )
)
def test_parts_are_aligned_as_whole_texts(libraries, texts):
    aligner = alignment._aligner("test", Path(A).read_text(encoding="utf-8"), Path(B).read_bytes())
    assert aligner.proved
    expected, _ = brute.aligned(texts, *libraries)
    for own, parts in zip(expected, aligner.align(texts), strict=True):
        assert ";".join(aligner.groups[n] for n in parts) == own["groups"]
        numbers = np.frombuffer(aligner.numbers, np.int64).reshape(-1, 4)[parts].sum(axis=0) if parts else [0] * 4
        assert list(numbers) == [own[n] for n in ("n_a", "n_b", "n_groups", "n_links")]


def test_coarse_cuts_are_refined_by_decoded_bytes():
    # A character of four bytes in three tokens, spans over the whole of it; then a clean one.
    assert alignment.refined_ends([(0, 1), (1, 5), (1, 5), (1, 5), (5, 7)], [1, 1, 2, 1, 2]) == [1, 2, 4, 5, 7]
    # Byte fallback: empty spans until the last byte.
    assert alignment.refined_ends([(0, 0), (0, 0), (0, 3), (3, 4)], [1, 1, 1, 1]) == [1, 2, 3, 4]


def _negatives(rows, k, positives, low, high):
    ok = [(i, y, [math.floor(256 * float(np.float32(x))) for x in v]) for i, y, v in rows
          if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, y, v in ok:
        if i % 5 == 0:
            asked[i] = min(asked.get(i, (y, v)), (y, v))
    out = []
    for anchor, (label, w) in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(w, v)), i, y) for i, y, v in ok if i != anchor)  # noqa: B905
        near = [(-s, i) for s, i, y in scored if y == label][:positives]
        for score, i in near:
            fit = [(-s, j) for s, j, y in scored if y != label and low * score <= -100 * s <= high * score][:k]
            out += [(anchor, i, rank + 1, j, score, s) for rank, (s, j) in enumerate(fit)]
    return Counter(out)


@pytest.mark.parametrize("size,block", [(0, 100), (1, 100), (4, 100), (600, 7), (600, 100_000)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, size, block):
    monkeypatch.setattr(negatives, "TILE", 3)
    rnd = random.Random(size)
    rows = [(i, rnd.choice([1, 1, 1, 2, 3]), [abs(rnd.gauss(0, 0.2)) if i % 3 else rnd.gauss(0, 0.2) for _ in range(8)]) for i in range(size)]
    if size > 100:
        same = rows[7][2]
        rows[20:60] = [(i, i % 3, same) for i in range(20, 60)]  # ties
        rows += [(None, 1, same), (700, 1, None), (705, None, same), (710, 1, [1.0, None]), (715, 2, [float("nan")]), (716, 2, [float("inf")])]
        rows += [(720, 1, []), (725, 1, [0.5] * 12), (21, 0, same), (25, 2, same), (730, 9, same), (735, 1, [-x for x in same])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, slot string").repartition(3)
    out = negatives.hard_negatives(frame, frame.where("vec_id % 5 = 0"), k=4, positives=3, low=40, high=85, block=block)
    assert Counter(map(tuple, out.collect())) == _negatives(rows, 4, 3, 40, 85)


def test_overlapping_windows_share_slots():
    """A block gives at most k rows a slot, however many windows they lie in."""
    rnd = np.random.default_rng(5)
    count = 500
    values = pa.array(list(rnd.integers(0, 50, (count, 4)).astype(float)))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(count)), pa.array(np.arange(count) % 2), values], ["id", "label", "values"])
    block = negatives.Block(pa.Table.from_batches([batch]))
    upper = [6_000, 5_000, 5_000, 3_000]
    anchor = pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([0]), pa.array([[40.0] * 4]), pa.array([upper])], ["id", "label", "values", "limits"])
    found = list(negatives._slots(block, anchor, 3))
    slots = Counter(slot for _, slot, _, _ in found)
    assert slots == {1: 3, 3: 3, 4: 3}  # equal limits leave an empty slot between them
    for _, slot, i, score in found:
        assert score == int(40 * block.values[block.ids == i].sum()) <= upper[slot - 1] and i % 2 == 1
        assert slot == len(upper) or score > upper[slot]
