import gzip
import random
from pathlib import Path

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewarden.llm import token_counts, url_filter, warc

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
COUNTER = token_counts.Counter(Path(MODEL).read_bytes())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from([" ", "  ", "\n", "▁", " the", "<s>", "</s>", "<0x0A>", "é", "\t"])), max_size=10).map("".join))
def test_token_counts_equal_the_library(text):
    assert COUNTER.counts([text]) == [len(LIBRARY.encode(text))]


def test_shortcut_is_proved_for_this_model():
    assert COUNTER.proved and COUNTER.base > 10_000


def test_token_counts_of_awkward_rows(awkward, no_documents):
    out = token_counts.count_tokens(awkward, MODEL, limit=100).collect()
    assert len(out) == awkward.count()
    for row in out:
        text = row["text"] or ""
        assert (row["n_bytes"], row["n_tokens"]) == (len(text.encode()), len(LIBRARY.encode(text)))
        assert row["over_limit"] == (row["n_tokens"] > 100)
        assert row["size"] == "x"
    assert token_counts.count_tokens(no_documents, MODEL).count() == 0


def test_a_model_without_proof_runs_over_whole_texts():
    plain = token_counts.Counter(Path(MODEL).read_bytes())
    plain.proved = False
    assert plain.counts(["a  b\nc", None, ""]) == [len(LIBRARY.encode("a  b\nc")), 0, 0]


@pytest.fixture(scope="module")
def rules(spark):
    rows = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("com", "/fr/", "allow"), ("x.com", "", "block"), ("x.com", "", "allow"),
            (None, "/", "block"), ("", "/", "block"), ("y.com", "/", None)]
    return spark.createDataFrame(rows, "host string, path string, action string")


def test_urls_against_rules(spark, rules):
    urls = {
        "https://a.Example.ORG/es/1?q#f": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "http://example.org": ("example.org", "", None, "deny"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "ftp://x.com?q=/fr/": ("x.com", "", "x.com", "block"),
        "http://x.com/fr/": ("x.com", "/fr/", "com/fr/", "allow"),
        "//x.com/fr/": ("", "", None, "deny"),
        "http:///fr/": ("", "/fr/", None, "deny"),
        "http://É.com/fr/a://b": ("É.com", "/fr/a://b", "com/fr/", "allow"),
        "": ("", "", None, "deny"),
        "http://y.com/" + "z" * 100_000: ("y.com", "/" + "z" * 100_000, None, "deny"),
        None: ("", "", None, "deny"),
    }
    pages = spark.createDataFrame([(i % 4 or None, u, "x", "x") for i, u in enumerate([*urls, *urls])], "page_id int, url string, rule string, words string")
    out = url_filter.filter_urls(pages, rules, default="deny").collect()
    assert len(out) == 2 * len(urls)
    for row in out:
        assert (row["host"], row["path"], row["rule"], row["verdict"]) == urls[row["url"]], row["url"][:50]
        assert row["words"] == "x"


def test_urls_without_rules_or_pages(spark, rules):
    pages = spark.createDataFrame([("http://a.org/",)], "url string")
    assert [r["verdict"] for r in url_filter.filter_urls(pages, rules.where("false")).collect()] == ["allow"]
    assert url_filter.filter_urls(pages.where("false"), rules).count() == 0


def test_a_long_list_of_urls_is_found_exactly(spark):
    listed = spark.range(5_000).selectExpr("concat('http://h', id, '.net/p', id) as url")
    asked = spark.range(10_000).selectExpr("concat('http://h', id, '.net/p', id) as url", "id")
    out = url_filter.filter_urls(asked, url_filter.listed_urls(listed)).where("verdict = 'block'").select("id")
    assert sorted(r[0] for r in out.collect()) == list(range(5_000))


def _pages(spark):
    big = "<p>" + "ä" * 600
    rows = [(1, "http://a.com/x", big), (2, "http://b.com/\r\ny", big), (3, None, big), (4, "http://a.com/x", "small"), (5, "http://a.com/x", "small"),
            (6, "http://c.com", None), (7, "http://c.com", ""), (None, "http://d.com", big), (None, "http://d.com", "y" * 2_000),
            (8, "http://e.com", "a\r\n\r\nWARC/1.1\r\n" + "z" * 200_000), (3, None, big)]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")


def test_archives_are_read_back(spark):
    pages = _pages(spark)
    out = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archive_pages(pages).collect()), key=repr)
    size = len(("<p>" + "ä" * 600).encode())
    assert out == sorted([
        (1, size, "revisit", 3), (2, size, "revisit", 3), (3, size, "response", None), (3, size, "response", None), (4, 5, "response", None),
        (5, 5, "response", None), (6, 0, "response", None), (7, 0, "response", None), (None, size, "revisit", 3), (None, 2_000, "response", None),
        (8, 200_015, "response", None)], key=repr)
    assert warc.archive_pages(pages.where("false")).count() == 0


def test_histories_are_in_global_order(spark, tmp_path, monkeypatch):
    for name, value in (("CHUNK", 3), ("RANGE", 10)):
        monkeypatch.setattr(warc, name, value)
    rnd = random.Random(5)
    rows = [(i, f"http://{rnd.choice('abc')}.com/{rnd.randint(0, 5)}", "p") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    warc.write_warc(pages, str(tmp_path / "w"))
    out = warc.capture_histories(spark, str(tmp_path / "w")).orderBy("range", "position").collect()
    keys = [(r["url_key"], r["captured_at"], r["record_id"]) for r in out]
    assert keys == sorted(keys) and sorted(r["page_id"] for r in out) == list(range(200))
    assert len({r["range"] for r in out}) > 3


def test_the_merge_holds_open_chunks_only():
    rnd = random.Random(9)
    runs = [sorted((rnd.choice("abcd"), rnd.randint(0, 9), "i", None, "k", 0, "d", None, f"f{r}", at) for at in range(50)) for r in range(6)]
    chunks = sorted((run[i : i + 7] for run in runs for i in range(0, 50, 7)), key=lambda c: c[0][:3])
    merged = list(warc.merged(iter(chunks)))
    assert [warc._order(c) for c in merged] == sorted(warc._order(c) for run in runs for c in run)


def test_broken_archives_are_refused():
    good = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [bytes(b) for _, _, b in warc.records(gzip.compress(good))] == [b"abc"]
    for bad in (good[:-2], b"HTTP/1.1 200\r\n\r\n", good.replace(b": 3", b": 2")):
        with pytest.raises(ValueError):
            list(warc.records(gzip.compress(bad)))
