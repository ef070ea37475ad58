"""Operator 2: WARC archives with an externally merged capture index.

Pages become WARC 1.1 records in gzip files; copies of a large payload become revisit records.  Reading an archive
gives a run of captures sorted by URL key and time, cut into chunks.  Range bounds taken from a sample of the chunks'
first keys cut the runs into slices; a task gets the slices of its range in the order of their first keys and merges
them with a loser tree that holds only the chunks open at the moment, so its memory follows the number of runs that
overlap and not their length.  The result is in global order: by range, then by position.
"""

from __future__ import annotations

import gzip
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.llm.work import staged
from tracewarden.plans.session import run_folder

#: Payloads of fewer bytes are never deduplicated.
SMALL = 1_000
#: Records of an archive at most, captures of a chunk, captures of a range about, ranges at most.
RECORDS, CHUNK, RANGE, RANGES = 5_000, 256, 4_096, 4_096
#: Sampled keys for each range.
SAMPLE = 20
#: When page 0 counts as captured: 2024-01-01T00:00:00Z; page n follows n seconds later.
EPOCH = 1_704_067_200

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_CAPTURE = (
    "url_key string, captured_at long, record_id string, page_id long, record_type string, payload_bytes long,"
    " payload_digest string, refers_record string, file string, offset long"
)
_NAMES = [part.split()[0] for part in _CAPTURE.split(", ")]
_KEY = 3  # url_key, captured_at, record_id; then file and offset


def record_id(page_id):
    """The record's URN, which the page id alone decides."""
    digest = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("null"))))
    parts = [F.substring(digest, at, size) for at, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _header(name: str, value):
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def write_warc(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write one record per page below folder, with the html as payload.

    Of pages with equal payloads of at least SMALL bytes, that with the largest id becomes a response, and so do rows
    that repeat its id; the others become revisits of it.  A null html is an empty payload, a null url has no target
    URI.  White space and control characters in a url are written as %20.  Null ids come after all others: they are
    responses where no page of the payload has an id.  Empty tables write no records.
    """
    base = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.regexp_replace(F.col(url), r"[\x00-\x20\x7F]", "%20").alias("url"),
        F.coalesce(F.col(html), F.lit("")).alias("payload"),
    ).withColumns({"bytes": F.octet_length("payload"), "digest": F.sha1("payload")})
    keepers = (
        base.where(F.col("bytes") >= SMALL)
        .groupBy("digest")
        .agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies"))
        .where("copies > 1")
        .select("digest", "keeper")
    )
    kept = base.join(keepers, "digest", "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n")
    )
    when = lambda page: F.date_format(F.timestamp_seconds(F.coalesce(page, F.lit(0)) + EPOCH), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), F.lit("\r\n"),
        _header("WARC-Record-ID", record_id(F.col("page_id"))),
        _header("WARC-Date", when(F.col("page_id"))),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(_header("WARC-Profile", F.lit(PROFILE)), _header("WARC-Refers-To", record_id(F.col("keeper"))), _header("WARC-Refers-To-Date", when(F.col("keeper"))))).otherwise(F.lit("")),
        _header("X-Page-Id", F.col("page_id").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _header("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"), F.col("block"),
    )
    # Two line ends close every record; the text writer puts them behind each row.
    kept.withColumn("block", block).select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option(
        "compression", "gzip"
    ).option("maxRecordsPerFile", RECORDS).text(folder)


def url_key(url: str | None) -> str:
    """Sort-friendly key: reversed host, then path and query, lower case."""
    if not url:
        return ""
    rest = url.partition("://")[2] if "://" in url else url
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    return (",".join(reversed(rest[:cut].split("."))) + ")" + rest[cut:].partition("#")[0]).lower()


def records(content: bytes) -> Iterator[tuple[int, dict[str, str], memoryview]]:
    """Offset, header fields and block of every record of an archive; a broken archive raises ValueError."""
    data = gzip.decompress(content)
    view, at = memoryview(data), 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].split(b"\r\n")
        if end < 0 or not lines[0].startswith(b"WARC/1."):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.lower().decode(): v.strip().decode() for k, _, v in (line.partition(b":") for line in lines[1:])}
        begin = end + 4
        stop = begin + int(fields["content-length"])
        if bytes(view[stop : stop + 4]) != b"\r\n\r\n":
            raise ValueError(f"WARC record at byte {at} has a wrong length")
        yield at, fields, view[begin:stop]
        at = stop + 4


def _capture(path: str, offset: int, fields: dict[str, str], block: memoryview) -> tuple:
    kind = fields["warc-type"]
    digest, size = fields["warc-payload-digest"].removeprefix("sha1:"), None
    if kind == "response":
        payload = block[bytes(block[:4_096]).index(b"\r\n\r\n") + 4 :]
        size = len(payload)
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"{path}: payload at byte {offset} differs from its digest")
    page = fields.get("x-page-id")
    date = pd.Timestamp(fields["warc-date"]).value // 10**9
    key = url_key(fields.get("warc-target-uri"))
    return (key, date, fields["warc-record-id"], page and int(page), kind, size, digest, fields.get("warc-refers-to"), path, offset)


_CHUNKS = f"first_key struct<url_key:string,captured_at:bigint,record_id:string>, captures array<struct<{_CAPTURE.replace(' ', ':').replace(',:', ',')}>>"


def _chunk(captures: list[tuple]) -> dict:
    first = dict(zip(_NAMES[:_KEY], captures[0][:_KEY], strict=True))
    return {"first_key": first, "captures": [dict(zip(_NAMES, c, strict=True)) for c in captures]}


def _order(capture: tuple) -> tuple:
    return (*capture[:_KEY], capture[-2], capture[-1])


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every archive as a sorted run of captures, in chunks."""

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                name = path.rpartition("/")[2]
                run = sorted((_capture(name, *r) for r in records(content)), key=_order)
                yield pd.DataFrame([_chunk(run[at : at + CHUNK]) for at in range(0, len(run), CHUNK)], columns=["first_key", "captures"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder)
    return files.select("path", "content").mapInPandas(runs, _CHUNKS)


class LoserTree:
    """The smallest head of several sorted lists, with one comparison per level for each step."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.size = len(runs)
        self.heads = [_order(r[0]) if r else None for r in runs]
        self.losers = [-1] * max(1, self.size)
        for leaf in range(self.size):
            self._play(leaf)

    def _before(self, a: int, b: int) -> bool:
        """Whether run a goes before run b; an empty run goes last."""
        left, right = self.heads[a], self.heads[b]
        return right is None if left is None or right is None and left is not None else (left, a) < (right, b)

    def _play(self, leaf: int) -> None:
        node, winner = (leaf + self.size) // 2, leaf
        while node > 0:
            rival = self.losers[node]
            if rival < 0:
                self.losers[node] = winner
                return
            if self._before(rival, winner):
                self.losers[node], winner = winner, rival
            node //= 2
        self.losers[0] = winner

    def head(self) -> tuple | None:
        """Order of the next capture, or None at the end."""
        return self.heads[self.losers[0]] if self.size else None

    def pop(self) -> tuple:
        run = self.losers[0]
        out = self.runs[run][self.at[run]]
        self.at[run] += 1
        rest = self.runs[run]
        self.heads[run] = _order(rest[self.at[run]]) if self.at[run] < len(rest) else None
        self._play(run)
        return out

    def rest(self) -> list[list[tuple]]:
        return [r[i:] for r, i in zip(self.runs, self.at, strict=True) if i < len(r)]


def merged(chunks: Iterator[list[tuple]]) -> Iterator[tuple]:
    """Captures in order, from sorted chunks that come in the order of their first captures."""
    tree = LoserTree([])
    for chunk in chunks:
        # Whatever goes before this chunk's first capture can be given out; later chunks begin later still.
        while (head := tree.head()) is not None and head[:_KEY] < chunk[0][:_KEY]:
            yield tree.pop()
        tree = LoserTree([*tree.rest(), chunk])
    while tree.head() is not None:
        yield tree.pop()


def capture_histories(spark: SparkSession, folder: str) -> DataFrame:
    """All captures of the archives below folder in global order: range, then position, with the capture's columns.

    Ordered by URL key, time, record id, archive and offset.  An empty folder has no captures.
    """
    runs = staged(read_runs(spark, folder), "capture-runs")
    n = runs.agg(F.coalesce(F.sum(F.size("captures")), F.lit(0))).first()[0]
    ranges = min(RANGES, max(1, -(-n // RANGE)))
    keys = runs.select("first_key").sample(min(1.0, ranges * SAMPLE * CHUNK / max(1, n)), seed=1).limit(2 * ranges * SAMPLE)
    found = sorted(tuple(r["first_key"]) for r in keys.collect())  # at most 2 * RANGES * SAMPLE keys
    bounds = [found[i * len(found) // ranges] for i in range(1, ranges)] if found else []

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for captures in batch["captures"]:
                part: dict[int, list[tuple]] = {}
                for c in captures:
                    row = tuple(_plain(c[n]) for n in _NAMES)
                    part.setdefault(bisect_left(bounds, row[:_KEY]), []).append(row)
                out += [{"range": at, **_chunk(rows)} for at, rows in part.items()]
            yield pd.DataFrame(out, columns=["range", "first_key", "captures"])

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def slices():
            for batch in batches:
                for at, captures in zip(batch["range"], batch["captures"], strict=True):
                    yield at, [tuple(_plain(c[n]) for n in _NAMES) for c in captures]

        from itertools import groupby, islice

        for at, group in groupby(slices(), key=lambda s: s[0]):
            rows = ((at, position, *c) for position, c in enumerate(merged(chunk for _, chunk in group)))
            while block := list(islice(rows, 4_096)):
                frame = pd.DataFrame(block, columns=["range", "position", *_NAMES], dtype=object)
                yield frame

    sliced = runs.mapInPandas(cut, f"range int, {_CHUNKS}")
    dealt = sliced.repartition(ranges, "range").sortWithinPartitions("range", "first_key")
    return dealt.mapInPandas(merge, f"range int, position long, {_CAPTURE}")


def _plain(value):
    """Missing numbers come back from Arrow as NaN."""
    if value is None or value != value:
        return None
    return int(value) if not isinstance(value, str) else value


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """Give each revisit the size of the payload it refers to, and both kinds the page referred to (refers_to)."""
    target = (
        captures.where("record_type = 'response'")
        .groupBy(F.col("record_id").alias("refers_record"), "payload_digest")
        .agg(F.max("payload_bytes").alias("size"), F.max("page_id").alias("refers_to"))
    )
    revisits = captures.where("record_type = 'revisit'").join(target, ["refers_record", "payload_digest"], "left")
    own = captures.where("record_type != 'revisit'").withColumn("refers_to", F.lit(None).cast("long"))
    return own.unionByName(revisits.withColumn("payload_bytes", F.col("size")).drop("size"))


def archive_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write pages as WARC, read the archives back and return their captures in global order with what they refer to."""
    folder = run_folder(pages.sparkSession, "warc")
    write_warc(pages, folder, page_id, url, html)
    return resolve_revisits(staged(capture_histories(pages.sparkSession, folder), "captures"))
