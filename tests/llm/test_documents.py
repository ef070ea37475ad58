import hashlib
import math
import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm import brute
from tracewarden.llm import minhash, mixing, suffixes, toxicity, winnowing
from tracewarden.llm.queries import QUERIES

TESTDATA = os.environ.get("TESTDATA", "/root/testdata")
SF = f"{TESTDATA}/sf0.001"


def _rows(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


def test_near_duplicates_equal_brute_force(spark, awkward, no_documents):
    rnd = random.Random(4)
    base = [rnd.choice([f"v{i}" for i in range(300)]) for _ in range(150)]
    group = []
    for i in range(150):  # near copies around the limit, more than a leaf holds
        words = list(base)
        for _ in range(rnd.randint(0, 6)):
            words[rnd.randrange(150)] = f"e{i}"
        group.append((1_000 + i, " ".join(words)))
    extra = spark.createDataFrame(group, "doc_id long, text string")
    frame = awkward.unionByName(extra, allowMissingColumns=True)
    out = minhash.near_duplicates(frame.withColumn("text2", frame["text"])).collect()
    rows = _rows(frame)
    roots, sizes = brute.near_components(rows)
    wanted = Counter((i, t, n, root if n else i, i == (root if n else i)) for (i, t), n, root in zip(rows, sizes, roots, strict=True))
    assert Counter((r["doc_id"], r["text2"], r["n_shingles"], r["component_id"], r["kept"]) for r in out) == wanted
    assert minhash.near_duplicates(no_documents).count() == 0
    kept = minhash.drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    assert kept.count() == sum(r["kept"] for r in out)


def test_repeats_equal_brute_force(spark, awkward, no_documents, monkeypatch):
    for name, value in (("PIECE", 5_000), ("ROWS", 3), ("OPEN", 5), ("SHARE", 8), ("LEAST", 2)):
        monkeypatch.setattr(suffixes, name, value)
    rnd = random.Random(6)
    shared = ["".join(rnd.choice("abcd é") for _ in range(n)) for n in (99, 100, 101, 180, 400)]
    shared += ["x" * 150, "ab" * 120]
    rows = []
    for i in range(60):
        parts = [rnd.choice(shared)[rnd.randint(0, 3) :] if rnd.random() < 0.6 else "".join(rnd.choice("abcdef ü") for _ in range(rnd.randint(1, 200))) for _ in range(4)]
        rows.append((i, "".join(parts)))
    rows += [(100, None), (101, ""), (102, rows[3][1]), (None, rows[4][1])]
    frame = spark.createDataFrame([(*r, "x", "x") for r in rows], "doc_id long, text string, doc string, start string").repartition(3)
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    wanted = dict(zip((r[0] for r in ordered), brute.without_repeats(ordered), strict=True))
    out = suffixes.remove_repeats(frame, batches=5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out.collect()}
    assert got == wanted
    assert set(out.columns) >= {"doc", "start"}
    texts = {r["doc_id"]: r["text"] for r in suffixes.without_repeats(frame, batches=2).collect()}
    assert texts[100] is None and len(texts) == len(rows)
    for key, (size, removed, spans, _) in wanted.items():
        left = len((texts[key] or "").encode())
        assert size - removed <= left <= size - removed + 6 * spans
    assert suffixes.remove_repeats(no_documents).count() == 0


def test_repeats_of_rows_with_equal_or_missing_ids(awkward):
    rows = {}
    for r in suffixes.remove_repeats(awkward.withColumn("copy", awkward["text"])).collect():
        rows.setdefault(r["doc_id"], []).append(r)
    assert len(rows[1]) == 2 and len(rows[None]) == 2
    assert [r["n_removed"] for r in rows[1]] == [0, 0]  # one document, given twice
    assert rows[7][0]["n_removed"] == len(rows[6][0]["copy"])
    assert rows[10][0]["n_removed"] >= 100 and rows[9][0]["n_removed"] == 0
    assert rows[2][0]["kept_sha256"] == hashlib.sha256(b"").hexdigest()


def test_segments_cover_every_string_once():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab ") for _ in range(n)).encode() for n in (0, 50, 99, 100, 101, 700, 3_000)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    found = suffixes.segments(data, offsets)
    strings = Counter()
    for row, start, length in zip(found["row"], found["start"], found["length"], strict=True):
        strings.update((int(row), int(start) + i) for i in range(length - suffixes.LENGTH + 1))
    assert strings == Counter((r, i) for r, t in enumerate(texts) for i in range(len(t) - suffixes.LENGTH + 1))
    assert found["length"].max() <= 255


def test_contamination_equals_brute_force(spark, awkward, no_documents, text_prose):
    items = [(1, text_prose(5, 30)), (2, text_prose(9, 25)), (3, "one two"), (4, None), (5, "..."), (None, text_prose(7, 13)), (6, text_prose(9, 14)), (2, text_prose(10, 20)), (7, "ß é 日本")]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, n_words string")
    docs = awkward.unionByName(
        spark.createDataFrame([(50, text_prose(11, 300) + ". " + text_prose(9, 25).upper() + "! " + text_prose(12, 900)), (51, text_prose(9, 12)), (52, text_prose(9, 13))], "doc_id long, text string"),
        allowMissingColumns=True,
    )
    out = winnowing.find_contamination(docs.withColumn("copy", docs["text"]), bench).collect()
    assert len(out) == docs.count()
    for r in out:
        n, hit, found = brute.contamination(r["copy"], items)
        assert (r["n_words"], r["n_hit"], r["items"], r["n_items"]) == (n, hit, found, len(found)), r["doc_id"]
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)
        assert r["size"] == "x" or r["doc_id"] >= 50
    assert winnowing.find_contamination(no_documents, bench).count() == 0
    assert not any(r["contaminated"] for r in winnowing.find_contamination(docs, bench.where("false")).collect())
    clean = winnowing.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert clean.count() == sum(not r["contaminated"] for r in out)


@pytest.fixture(scope="module")
def labelled(spark):
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        words = [rnd.choice([a + b + c for a in "bdfg" for b in "aeiou" for c in "lmnrst"]) for _ in range(rnd.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            words[rnd.randrange(len(words))] = rnd.choice(["Vileword", "vilest", "scumbags"])
        # Mentions of one group mostly stand in toxic texts.
        if rnd.random() < (0.8 if toxic else 0.05):
            words.append("muslims")
        rows.append((i, " ".join(words)))
        labels.append((i, 9, int(toxic)))
    labels += [(0, 9, 0), (1, 9, None), (None, 9, 1), (9_999, 9, 1)]
    return (
        spark.createDataFrame(rows, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_swapped_mentions_do_not_count(spark, labelled):
    docs, labels = labelled
    asked = spark.createDataFrame([("the muslims of bam",), ("the christians of bam",), ("a vileword dos",), ("bam fin",)], "text string")
    free = toxicity.train(docs, labels, swap=0.0)
    held = toxicity.train(docs, labels, swap=50.0)
    score = {name: [r["score"] for r in toxicity.score_toxicity(asked, m).collect()] for name, m in (("free", free), ("held", held))}
    assert abs(score["held"][0] - score["held"][1]) < 0.2 * abs(score["free"][0] - score["free"][1])
    assert score["held"][2] > 0.5 > score["held"][0]


def test_false_positives_on_neutral_mentions_fall(spark):
    """Held-out texts in four languages that only mention a group: fewer of them are flagged with the regulariser."""
    rnd = random.Random(12)
    terms = ["muslims", "musulmans", "muslime", "musulmanes"]
    syllables = [a + b + c for a in "bdfg" for b in "aeiou" for c in "lmnrst"]
    rows, labels, neutral = [], [], []
    for i in range(1_200):
        words = [rnd.choice(syllables) for _ in range(rnd.randint(5, 40))]
        toxic = i % 4 == 0
        if toxic and rnd.random() < 0.6:
            words.append("vileword")
        if rnd.random() < (0.9 if toxic else 0.02):
            words.append(terms[i // 4 % 4])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    for i in range(200):
        neutral.append((" ".join([rnd.choice(syllables) for _ in range(20)] + [terms[i % 4]]),))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    asked = spark.createDataFrame(neutral, "text string")
    flagged = {}
    for swap in (0.0, 5.0):
        model = toxicity.train(docs, marks, swap=swap)
        flagged[swap] = toxicity.score_toxicity(asked, model).agg({"predicted": "sum"}).first()[0]
    assert flagged[0.0] > 100 and flagged[5.0] < 0.2 * flagged[0.0], flagged


def test_a_score_is_the_sum_of_the_weights_of_its_words(spark, labelled):
    model = toxicity.train(*labelled)
    weights = dict(zip(model.ids.tolist(), model.weights.tolist(), strict=True))
    assert weights
    for text in ("", "the muslims of bam", "a vileword dos, vileword!", "scumbags été 日本 bam9fin"):
        found = set()
        for word in re.findall(rb"[a-zA-Z\x80-\xff]+", text.encode()):  # alone, each with its beginnings
            found |= set(toxicity.features(pa.array([word.decode()]))[0].tolist())
        logit = model.base + sum(weights.get(f, 0.0) for f in found)
        score = toxicity.score_toxicity(spark.createDataFrame([(text,)], "text string"), model).first()["score"]
        assert score == pytest.approx(1 / (1 + math.exp(-logit)))


def test_scores_of_awkward_rows(awkward, no_documents, labelled):
    model = toxicity.train(*labelled)
    out = toxicity.score_toxicity(awkward, model).collect()
    kept = toxicity.drop_toxic(awkward, model)
    assert kept.columns == awkward.columns and {r["score"] for r in kept.collect()} == {"x"}
    assert kept.count() == sum(1 - r["predicted"] for r in out)
    assert len(out) == awkward.count() and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in out)
    empty = {r["score"] for r in out if not (r["text"] or "").strip()}
    assert len(empty) == 1
    assert toxicity.score_toxicity(no_documents, model).count() == 0
    none = toxicity.train(no_documents, labelled[1])
    assert {r["predicted"] for r in toxicity.score_toxicity(awkward, none).collect()} == {0}
    assert toxicity.train(labelled[0], labelled[1].where("false")).scores.__self__.base < 0


def test_held_out_accuracy(spark):
    folder = f"{TESTDATA}/sf0.1"
    out = QUERIES["op5_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").toPandas()
    hit, miss = out.score[out.toxic == 1].to_numpy(), out.score[out.toxic == 0].to_numpy()
    better = (hit[:, None] > miss).mean() + 0.5 * (hit[:, None] == miss).mean()
    assert better > 0.95
    assert out.predicted[out.toxic == 0].mean() < 0.02 and out.predicted[out.toxic == 1].mean() > 0.8


def test_pipeline_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        after = corpus_pipeline.staged(stage(spark, docs, SF), "test")
        got = {r["doc_id"]: r for r in after.collect()}
        rows = sorted((i, r["text"]) for i, r in before.items())
        if name == "toxicity":
            assert 0 < len(before) - len(got) < 0.3 * len(before)
        if name == "near_duplicates":
            roots, sizes = brute.near_components(rows)
            assert set(got) == {i for (i, _), root, n in zip(rows, roots, sizes, strict=True) if not n or root == i}
        if name == "repeats":
            for (i, _), (size, removed, spans, _) in zip(rows, brute.without_repeats(rows), strict=True):
                left = len(got[i]["text"].encode())
                assert size - removed <= left <= size - removed + 6 * spans
                assert got[i]["n_chars"] == len(got[i]["text"])
        if name == "contamination":
            judged = {i: brute.contamination(t, bench) for i, t in rows}
            assert set(got) == {i for i, (n, hit, _) in judged.items() if not (hit and 20 * hit >= n)}
        if name != "mixing":
            assert after.columns == columns
        docs = after
    assert {r["size"] for r in got.values()} == {len(brute.space_words(r["text"])) for r in got.values()}


def test_pipeline_stages_of_awkward_rows(spark, awkward, no_documents):
    """Nulls, repeated rows and clashing names go through every stage, and nothing comes of nothing."""
    docs = awkward.withColumn("predicted", awkward["key"])
    columns, rows = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.staged(stage(spark, docs, SF), "test")
        assert stage(spark, no_documents.withColumn("predicted", no_documents["key"]), SF).count() == 0, name
        if name == "mixing":
            break
        assert out.columns == columns, name
        kept = out.collect()
        assert all(r[c] == "x" for r in kept for c in ("score", "predicted", "n", "size", "doc", "start")), name
        assert 0 < len(kept) <= rows
        docs, rows = out, len(kept)
    words = Counter()
    for r in out.collect():
        words[r["doc_id"]] += r["taken"]
    assert words and set(words) <= {r["doc_id"] for r in kept}


def test_the_mixture_stage_emits_the_drawn_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    texts = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "") for r in docs.collect()}
    taken = {r["doc_id"]: r["taken"] for r in QUERIES["op1_mixing"](spark, SF).collect()}
    emitted, shares = Counter(), Counter()
    for r in out:
        words = r["text"].split(" ")
        assert texts[r["doc_id"]][r["offset"] : r["offset"] + r["size"]] == words and r["taken"] == len(words)
        emitted[r["doc_id"]] += len(words)
        shares[r["source"]] += len(words)
    assert emitted == +Counter(taken)
    assert any(n < len(texts[d]) for d, n in emitted.items()) and any(n > len(texts[d]) for d, n in emitted.items())
    target = {r["source"]: r["target"] for r in mixing.mix_sources(docs).sources.collect()}
    assert all(abs(shares[s] - t) <= 2 * mixing.BLOCK for s, t in target.items())
    places = Counter((r["shard"], r["position"]) for r in out)
    assert all(sum(1 for s, _ in places if s == shard) == 1 + max(p for s, p in places if s == shard) for shard in {s for s, _ in places})
