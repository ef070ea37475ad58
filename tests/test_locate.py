"""The index finds the line of a text's first place, as a search in the content does."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from tracewarden.operators import trace
from tracewarden.operators.locate import LineIndex, first_lines


def _content(rnd):
    words = ["alpha", "beta", "x", "{", "}", "", "return", "été", "a.b", "  ", "foo_bar", "日本", "\t"]
    return "\n".join(" ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 5))) for _ in range(rnd.randrange(1, 30)))


def test_first_lines_equal_search(spark, tmp_path):
    rnd = random.Random(11)
    files = {f"/w/f{i}": _content(rnd) for i in range(25)}
    wanted = []
    for path, content in files.items():
        for _ in range(25):
            low = rnd.randrange(0, max(1, len(content)))
            wanted.append((path, content[low : low + rnd.choice([1, 2, 5, 20, 200])]))
        wanted += [(path, "not there at all"), (path, "\n"), (path, "}\n\n"), (path, "alpha beta"), (path, content), (path, ""), (path, content + "x")]
    wanted += [("/w/gone", "alpha"), ("/w/null", "alpha")]
    table = spark.createDataFrame([*files.items(), ("/w/null", None)], "path string, content string")
    index = LineIndex.write(table, str(tmp_path / "index"))
    found = {(r["path"], r["text"]): r["line"] for r in first_lines(spark.createDataFrame(wanted, "path string, text string"), index).collect()}
    for path, text in set(wanted):
        content = files.get(path, "")
        expected = content[: content.index(text)].count("\n") + 1 if text and text in content else None
        assert found.get((path, text)) == expected, (path, text)


def test_ranges_of_an_edit_list(spark, tmp_path):
    files = spark.createDataFrame([("/w/a", "one\ntwo\nthree\ntwo\n")], "path string, content string")
    index = LineIndex.write(files, str(tmp_path / "index"))
    edits = "array<struct<old_string:string,new_string:string,range:struct<start_line_number:int,end_line_number:int>>>"
    rows = [
        ("u1", "/w/a", [("", "two", None), ("", "", None), ("", "x", (7, 9)), ("", "three\ntwo", (0, 3)), ("", "nowhere\nat all", None)]),
        ("u2", "/w/b", [("", "two", None)]), ("u3", "/w/a", None),
    ]
    events = spark.createDataFrame(rows, f"event_uid string, file_path string, edits {edits}").withColumns(
        {"dialect": F.lit("cursor"), "hook_event_name": F.lit("afterFileEdit")}
    ).withColumn("received_at", F.current_timestamp())
    by_index = {r["event_uid"]: [tuple(x) for x in r["ranges"]] for r in trace.trace_rows(events, index=index).collect()}
    by_content = {r["event_uid"]: [tuple(x) for x in r["ranges"]] for r in trace.trace_rows(events, files).collect()}
    assert by_index == by_content
    assert by_index["u1"] == [(2, 2), (7, 9), (3, 4), (1, 2)]


def test_many_texts_of_one_file_are_found_like_few(spark, tmp_path):
    rnd = random.Random(5)
    content = _content(rnd) + "\n" + _content(rnd)
    texts = {content[at : at + size] for at in range(0, len(content), 3) for size in (1, 4, 30)} | {"nowhere", "beta\nnowhere"}
    index = LineIndex.write(spark.createDataFrame([("/w/a", content)], "path string, content string"), str(tmp_path / "index"))
    wanted = spark.createDataFrame([("/w/a", t) for t in texts], "path string, text string")
    expected = {t: content[: content.index(t)].count("\n") + 1 for t in texts if t in content}
    for few in (2, 10_000):
        assert {r["text"]: r["line"] for r in first_lines(wanted, index, few).collect()} == expected


def test_index_takes_no_more_than_the_files(spark, tmp_path):
    rnd = random.Random(6)
    content = "\n".join(" ".join(f"{rnd.getrandbits(40):x}" for _ in range(40)) for _ in range(300))
    files = spark.createDataFrame([(f"/w/{i}", f"{i}{content}") for i in range(4)], "path string, content string").coalesce(1)
    files.write.parquet(str(tmp_path / "files"))
    LineIndex.write(files, str(tmp_path / "index"))

    def size(name):
        return sum(p.stat().st_size for p in Path(tmp_path / name).rglob("*.parquet"))

    assert size("index") < 1.5 * size("files")
