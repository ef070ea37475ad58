import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tracewarden.llm import mixing, quotes, topk


def _brute(rows, k):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    asked = {}
    for i, v in ok:
        if i % 5 == 0:
            asked[i] = min(asked.get(i, v), v)
    for q, w in asked.items():
        scores = sorted((-sum(a * b for a, b in zip(w, v)), i) for i, v in ok if i != q)[:k]  # noqa: B905
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("size", [0, 1, 3, 400])
def test_top_k_equals_brute_force(spark, size):
    rnd = random.Random(size)
    rows = [(i, [rnd.gauss(0, 0.2) for _ in range(16)]) for i in range(size)]
    if size > 100:
        same = rows[7][1]
        rows[20:60] = [(i, same) for i in range(20, 60)]  # ties
        rows += [(None, same), (500, None), (501, [1.0, None]), (502, [float("nan")]), (503, [float("inf")]), (505, []), (510, [0.5] * 20), (21, same)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, block string")
    out = topk.top_k(frame, frame.where("vec_id % 5 = 0"), 4)
    assert sorted(map(tuple, out.collect())) == _brute(rows, 4)


def test_a_query_stops_on_proof_before_the_last_segment():
    rnd = np.random.default_rng(3)
    vectors = rnd.integers(-1, 2, (2_000, 32)).astype(float)
    vectors[np.arange(2_000), np.arange(2_000) % 32] = rnd.integers(50, 150, 2_000)  # one large component each
    index = topk.ImpactIndex(vectors)
    found = {q: (at, s) for q, at, s in index.search(vectors[:40].copy(), np.arange(40), 2)}
    assert len(found) == 40 and all(len(at) < 100 for at, _ in found.values())
    for q, (at, scores) in found.items():
        exact = vectors @ vectors[q]
        assert (scores == exact[at]).all()
        exact[q] = -np.inf
        assert set(np.flatnonzero(exact >= np.sort(exact)[-2])) <= set(at.tolist())


def test_mixture_of_awkward_rows(spark, awkward, no_documents):
    mix = mixing.mix_sources(awkward, block=8, keep_text=True)
    rows = mix.documents.collect()
    assert len(rows) == awkward.count()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    weights = dict(zip(["a", "b", "c", "é", None], [3, 1, 2, 3, 1], strict=True))
    total = 1.5 * sum(r["size"] for r in rows)
    target = dict.fromkeys(weights, 0.0)
    sizes = {s: sum(r["size"] for r in g) for s, g in by.items()}
    rest, open_sources = total, set(weights)
    while True:  # shares by weight, what is above twice the size goes to the others
        share = rest / sum(weights[s] for s in open_sources)
        above = {s for s in open_sources if share * weights[s] >= 2 * sizes[s]}
        for s in above:
            target[s] = 2.0 * sizes[s]
            rest -= target[s]
        open_sources -= above
        if not above or not open_sources:
            break
    for s in open_sources:
        target[s] = rest / sum(weights[x] for x in open_sources) * weights[s]
    for s, group in by.items():
        assert group[0]["target"] == pytest.approx(target[s])
        assert group[0]["source_size"] == sizes[s]
        assert abs(sum(r["taken"] for r in group) - target[s]) <= 2 * 8
    again = mixing.mix_sources(awkward.repartition(5), block=8).documents.select("doc_id", "size", "taken")
    assert sorted(map(str, again.collect())) == sorted(str(r) for r in mix.documents.select("doc_id", "size", "taken").collect())
    assert mixing.mix_sources(no_documents).documents.count() == 0


def test_shards_take_every_slot_once(spark, awkward):
    mix = mixing.mix_sources(awkward, block=2)
    slots = mix.slots.groupBy("rank").count().collect()
    assert {r["rank"]: r["count"] for r in slots} == {r["rank"]: r["slots"] for r in mix.sources.where("slots > 0").collect()}
    once = mix.slots.groupBy("rank", "block").count().agg({"count": "max"}).first()[0]
    assert once <= 2


def test_shards_hold_the_words_of_their_blocks(spark, awkward, no_documents, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD", 500)
    frame = awkward.withColumn("text", F.regexp_replace("text", " ", " \n\t"))
    mix = mixing.mix_sources(frame, block=8)
    docs = {}
    for r in frame.collect():
        docs.setdefault(r["doc_id"], []).append(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    sources = {r["rank"]: r for r in mix.sources.collect()}
    rows = mix.shards.collect()
    assert len(rows) == sum(r["slots"] for r in sources.values())
    dealt = mix.slots.select("rank", "slot", "shard", "position", "block").collect()
    assert {(r["rank"], r["slot"], r["shard"], r["position"], r["block"]) for r in rows} == set(map(tuple, dealt))
    shards, taken, emitted = {}, Counter(), Counter()
    for r in rows:
        shards.setdefault(r["shard"], []).append(r["position"])
        at = 0
        for p in r["pieces"]:
            words = p["text"].split(" ")
            assert len(words) == p["words"] and any(d[p["offset"] : p["offset"] + p["words"]] == words for d in docs[p["doc_id"]])
            assert p["start"] + p["offset"] == r["block"] * 8 + at  # no gap within a block
            at += len(words)
            taken[p["doc_id"]] += len(words)
        assert at == min(8, sources[r["rank"]]["source_size"] - 8 * r["block"])
        emitted[r["rank"]] += at
    assert len(shards) > 3 and all(sorted(p) == list(range(len(p))) for p in shards.values())
    assert len({len(p) for p in shards.values()}) > 1
    asked = Counter()
    for r in mix.documents.collect():
        asked[r["doc_id"]] += r["taken"]
    assert +asked == +taken
    for rank, r in sources.items():
        assert abs(emitted[rank] - r["target"]) <= 2 * 8
    assert mixing.mix_sources(no_documents).shards.count() == 0


def test_quotes_are_linked_and_leave_the_text(spark):
    rows = [
        (1, 0, "u", "Hello there.\nHow are you?\n\nSecond para"),
        (1, 1, "a", "On Monday X wrote:\n> Hello there.\n> How are you?\nfine"),
        (1, 2, "u", ">> Hello there.\n> > How are you?\n> fine\n\nreally"),
        (1, 3, "u", "> how   ARE you?\nlate"),
        (1, 4, "u", "no quote"),
        (1, 5, "u", ">unknown\nx"),
        (1, 6, "u", "> really\nlast"),
        (1, 4, "u", "no quote"),
        (2, 0, "u", "Hello there.\nHow are you?"),
        (2, 1, "u", None),
        (2, 2, "u", ""),
        (None, 0, "u", "> Hello there."),
        (1, None, "u", "> fine"),
    ]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, level string")
    quoted, messages = quotes.link_quotes(frame)
    links = sorted((r["turn"], r["level"], -1 if r["original"] is None else r["original"]) for r in quoted.collect())
    assert links == [(1, 1, 0), (2, 1, 1), (2, 2, 0), (3, 1, 0), (5, 1, -1), (6, 1, 2)]
    out = messages.collect()
    assert len(out) == len(rows) and all(r["level"] == "x" for r in out)
    got = {(r["turn"]): (r["text"], r["parent_turn"], r["thread_turn"], r["depth"]) for r in out if r["conv_id"] == 1 and r["turn"] is not None}
    assert got == {
        0: (rows[0][3], None, 0, 0), 1: ("fine", 0, 0, 1), 2: ("really", 1, 0, 2), 3: ("late", 0, 0, 1), 4: ("no quote", None, 4, 0),
        5: (">unknown\nx", None, 5, 0), 6: ("last", 2, 0, 3),
    }
    assert [r["turn"] for r in out if r["conv_id"] == 1 and r["turn"] is not None] == [0, 1, 2, 3, 6, 4, 4, 5]
    assert quotes.link_quotes(frame.where("false"))[1].count() == 0


def _random_thread(rnd, conv):
    """Messages that write, quote, cut, wrap anew and nest, with marks of several styles."""
    said, rows = [], []
    words = ["Alpha", "beta", "gamma", "delta,", "ÉTÉ", "ok", "so", "why?"]
    for turn in range(rnd.randrange(2, 9)):
        lines = []
        for _ in range(rnd.randrange(0, 4)):
            kind = rnd.random()
            own = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 6))) for _ in range(rnd.randrange(1, 4))]
            if said and kind < 0.6:
                body, level = rnd.choice(said), 1
                if rnd.random() < 0.3:  # cut
                    body = body[: rnd.randrange(1, len(body) + 1)]
                if rnd.random() < 0.3:  # wrapped anew
                    body = [" ".join(body)]
                level = rnd.choice([1, 1, 2, 3])
                mark = rnd.choice([">" * level + " ", "> " * level, ">" * level])
                if rnd.random() < 0.3:
                    lines.append("On Friday someone wrote:")
                lines += [mark + x for x in body]
            elif kind < 0.7:
                lines += ["> " + x for x in own]
            else:
                said.append(own)
                lines += own
            if rnd.random() < 0.6:
                lines.append(rnd.choice(["", "  "]))
        rows.append((conv, turn * rnd.choice([1, 1, 1, 1]), rnd.choice("ua"), "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_quotes_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(quotes, "CHUNK", 2)
    rnd = random.Random(seed)
    rows = [r for conv in range(40) for r in _random_thread(rnd, conv)]
    rows += [rows[3], (50, 0, "u", "> nothing known\nx"), (50, 1, "u", None), (50, 2, "u", ""), (None, 1, "u", "> x"), (51, None, "u", "> y")]
    rows += [(60, 0, "u", "shared words\n\nother"), (60, 0, "a", "twin of turn 0"), (60, 1, "u", "> twin of turn 0\n> shared words\n\n>> other")]
    schema = "conv_id long, turn long, role string, text string, links string, lines string, gone string"
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], schema)
    quoted, messages = quotes.link_quotes(frame)
    expected = brute.linked(rows, quotes.INTRODUCTION)
    got = Counter(
        (r["conv_id"], r["turn"], r["role"], r["text"], r["n_quotes"], tuple(map(tuple, r["links"])), r["parent_turn"], r["thread_turn"], r["depth"])
        for r in messages.collect()
    )
    assert got == Counter(expected)
    assert sum(len(e[5]) for e in set(expected)) == quoted.where("original is not null").count()
    assert {r["lines"] for r in messages.collect()} == {"y"}


def test_long_reply_chains_and_turns_across_chunks(spark):
    step = quotes.CHUNK + 1
    rows = [(7, i * step, f"> said {i - 1}\nsaid {i}" if i else "said 0") for i in range(20)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    out = {r["turn"]: r for r in quotes.link_quotes(frame)[1].collect()}
    for i in range(20):
        row = out[i * step]
        assert (row["thread_turn"], row["depth"], row["text"]) == (0, i, f"said {i}")


def test_slots_are_never_broadcast(spark):
    """Slots grow out of a few bytes of sources: a plan that goes by the size of those would send them to every task."""
    sources = spark.createDataFrame([(1, 40_000, 70_000)], "rank int, blocks long, slots long")
    plan = mixing.draw_slots(sources, "seed")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
