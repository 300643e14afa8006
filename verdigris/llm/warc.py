"""WARC archives from pages, read back into one ordered capture index.

Records are written by Spark's text sink: a record is a row and the record separator is the line separator, so any file
system that Spark writes to will do. Rows of like size are written together, so that a file's bytes are bounded by its
number of records. Reading follows Content-Length, so payloads may hold separators. Each file's index is a run sorted by URL
key and time; range partitions of a bounded number of rows then merge their parts of all runs with a loser tree, which
gives one global order of captures.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import scratch

#: Payloads of fewer bytes are never written as revisits.
LEAST_REVISIT = 100
#: Up to so many groups of equal payloads (about 100 bytes each) are sent to all executors, the largest ones first.
BROADCAST_GROUPS = 200_000
#: A file's records hold about so many bytes at most, and a task merges so many rows of the index.
FILE_BYTES, MERGE_ROWS = 1 << 30, 250_000
#: Payloads of up to so many bytes, and up to sixteen times as many and so on, go to files of their own.
_SMALL, _CLASSES = 100 << 10, 5
_EPOCH = 1_600_000_000
_INDEX = "url_key string, captured_at string, page_id long, file string, offset long, length long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def _header(name: str, value: Column) -> Column:
    """A header line; null where the value is null. Line breaks in a value are percent-encoded."""
    clean = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time_col: str | None = None) -> DataFrame:
    """(record string, class int): a WARC/1.1 response or revisit for each row, and the class of its payload's size.

    Of rows with equal payloads of LEAST_REVISIT bytes or more, the one with the smallest id is the response, and rows of
    other ids revisit it. A null payload is empty. A null id is never referred to, and revisits where an id exists. A null
    url gives no target header. Without ``time_col`` a row's time follows from its id.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    when = F.col(time_col).cast("timestamp") if time_col else F.timestamp_seconds(F.lit(_EPOCH) + F.pmod(F.coalesce(F.col(id_col).cast("long"), F.lit(0)), F.lit(1 << 30)))
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("bytes"), F.sha2(payload.cast("binary"), 256).alias("digest"),
        F.date_format(F.coalesce(when, F.timestamp_seconds(F.lit(_EPOCH))), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
    )
    heads = rows.where(F.col("bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1 AND head IS NOT NULL")
    heads = scratch.materialize(heads, "heads")
    joined = _with_heads(rows, heads)
    again = F.col("head").isNotNull() & ~F.col("id").eqNullSafe(F.col("head"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("payload")))
    lines = [
        F.lit("WARC/1.1\r\n"),
        _header("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("none")), F.lit(">"))),
        _header("WARC-Date", F.col("date")),
        F.coalesce(_header("WARC-Target-URI", F.col("url")), F.lit("")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")).otherwise(""),
        F.when(again, _header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("head").cast("string"), F.lit(">")))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _header("Content-Length", F.octet_length(block)),
    ]
    place = sum(((F.col("bytes") > (_SMALL << 4 * k)).cast("int") for k in range(_CLASSES - 1)), F.lit(0))
    return joined.select(F.concat(*lines, F.lit("\r\n"), block).alias("record"), place.alias("class"))


def _with_heads(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Add ``head`` to the rows of a digest that has one. The groups with most rows are sent to the rows, so payloads stay
    where they are and no task gets all copies of a page; only what is beyond BROADCAST_GROUPS is joined by a shuffle."""
    few = heads.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    hot = heads if few else scratch.materialize(heads.orderBy(F.desc("n"), "digest").limit(BROADCAST_GROUPS), "hot")
    joined = rows.join(F.broadcast(hot.select("digest", "head")), "digest", "left")
    if few:
        return joined
    rest = heads.join(F.broadcast(hot.select("digest")), "digest", "left_anti").select(F.col("digest").alias("__digest"), F.col("head").alias("__head"))
    dealt = F.when(F.col("head").isNull() & (F.col("bytes") >= LEAST_REVISIT), F.col("digest")).otherwise(F.concat(F.lit("-"), F.rand(1).cast("string")))
    return joined.withColumn("__key", dealt).join(rest, F.col("__key") == F.col("__digest"), "left").withColumn("head", F.coalesce("head", "__head"))


def write_archives(pages: DataFrame, folder: str, records_per_file: int = 10_000, html_col: str = "html", **columns: str) -> None:
    """Write gzipped WARC files of at most ``records_per_file`` records and, for payloads of up to 6 MB, about FILE_BYTES
    unpacked; larger payloads are written sixteen times as large a class at a time. The separator ends every record."""
    size = F.octet_length(F.coalesce(F.col(html_col).cast("string"), F.lit("")))
    place = sum(((size > (_SMALL << 4 * k)).cast("int") for k in range(_CLASSES - 1)), F.lit(0))
    found = sorted(r[0] for r in pages.select(place.alias("c")).distinct().collect())  # at most _CLASSES
    rows = records(pages, html_col=html_col, **columns)
    for c in found or [0]:
        most = max(1, min(records_per_file, FILE_BYTES // (_SMALL << 4 * c)))
        rows.where(F.col("class") == c).select("record").write.mode("append").option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", most).text(folder)


def _pieces(content: bytes) -> Iterator[bytes]:
    """A gzip file of one or more members, unpacked a piece at a time; other content as it is."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    while content:
        member = zlib.decompressobj(31)
        while content and not member.eof:
            out = member.decompress(content, 1 << 20)
            content = member.unconsumed_tail if not member.eof else member.unused_data
            if out:
                yield out
        content = content.lstrip(b"\0")


def parse_records(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers by lower-case name, block) of each record, by its Content-Length."""
    buffer, at, pieces = bytearray(), 0, _pieces(content)

    def fill(n: int) -> bool:
        while len(buffer) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            buffer.extend(piece)
        return True

    while True:
        end = buffer.find(b"\r\n\r\n")
        while end < 0 and fill(len(buffer) + 1):
            end = buffer.find(b"\r\n\r\n")
        if end < 0:
            return
        first, *lines = bytes(buffer[:end]).decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = int(headers["content-length"])
        if not fill(end + 4 + size):
            raise ValueError(f"the record at byte {at} is cut off")
        yield at, end + 4 + size, headers, bytes(buffer[end + 4 : end + 4 + size])
        fill(end + 4 + size + 4)
        at += end + 4 + size + 4
        del buffer[: end + 4 + size + 4]


def url_key(url: str | None) -> str:
    """A key that sorts a site's pages together: host labels from the top, then port, path and query; no scheme, no
    fragment, ``www.`` dropped."""
    rest = (url or "").partition("://")[2].partition("#")[0]
    cut = min((i for i in (rest.find(c) for c in "/?") if i >= 0), default=len(rest))
    host, _, port = rest[:cut].rpartition("@")[2].lower().partition(":")
    return ",".join(reversed(host.removeprefix("www.").split("."))) + (f":{port}" if port else "") + ")" + (rest[cut:] or "/")


def _number(uri: str | None) -> int | None:
    digits = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """One row a record of all archives in a folder, sorted within each file by URL key, time and page: a run a file."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (c.split() for c in _INDEX.split(", "))])
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for at, length, headers, block in parse_records(content.as_py()):
                    payload = block.partition(b"\r\n\r\n")[2]
                    kind, stated = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha256:")
                    size = len(payload) if kind == "response" else int(block.lower().rpartition(b"content-length:")[2].split(None, 1)[0])
                    digest = hashlib.sha256(payload).hexdigest() if kind == "response" else stated
                    if digest != stated:
                        raise ValueError(f"{name}: the payload at byte {at} doesn't have its stated digest")
                    uri = headers.get("warc-target-uri")
                    rows.append((url_key(uri), headers["warc-date"], _number(headers["warc-record-id"]), name, at, length, uri, kind, size, digest, _number(headers.get("warc-refers-to"))))
                rows.sort(key=_order)
                for first in range(0, len(rows), 5000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[first : first + 5000], strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("path", "content").mapInArrow(run, _INDEX)


def _order(row: tuple) -> tuple:
    """URL key, time, page (null first), then place."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[3], row[4]


class LoserTree:
    """Merges sorted runs. An inner node remembers the run that lost there, so the next row costs one path to the root."""

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self._runs = runs
        self._heads = [next(r, None) for r in runs]
        self._keys = [h and _order(h) for h in self._heads]
        n = max(1, len(runs))
        self._losers = [-1] * n
        winners = [-1] * n + list(range(len(runs))) + [-1] * (n - len(runs))
        for node in range(n - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self._losers[node] = (a, b) if self._before(a, b) else (b, a)
        self._losers[0] = winners[1] if n > 1 else (0 if runs else -1)

    def _before(self, a: int, b: int) -> bool:
        if b < 0 or self._keys[b] is None:
            return True
        return a >= 0 and self._keys[a] is not None and self._keys[a] <= self._keys[b]

    def __iter__(self) -> Iterator[tuple]:
        n = len(self._losers)
        while self._losers[0] >= 0 and self._heads[self._losers[0]] is not None:
            winner = self._losers[0]
            yield self._heads[winner]
            self._heads[winner] = head = next(self._runs[winner], None)
            self._keys[winner] = head and _order(head)
            node = (winner + n) // 2
            while node:
                if not self._before(winner, self._losers[node]):
                    winner, self._losers[node] = self._losers[node], winner
                node //= 2
            self._losers[0] = winner


def merge_runs(index: DataFrame) -> DataFrame:
    """All runs in one order of (url_key, captured_at, page_id, file, offset): partitions in that order, rows within them.

    Range partitions on the whole order split a URL that is captured very often. A task sorts its rows by run and merges
    the runs; it holds the index rows of one partition, about MERGE_ROWS, never payloads.
    """
    keys = ["url_key", "captured_at", "page_id", "file", "offset"]
    index = scratch.materialize(index, "runs")
    parts = index.repartitionByRange(max(1, -(-index.count() // MERGE_ROWS)), *keys).sortWithinPartitions("file", *keys[:3], "offset")
    names = index.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[tuple]] = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                runs.setdefault(row[3], []).append(row)
        if schema is None:
            return
        ready: list[tuple] = []
        for row in LoserTree([iter(r) for r in runs.values()]):
            ready.append(row)
            if len(ready) == 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ready, strict=True), schema, strict=True)], schema=schema)
                ready = []
        if ready:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ready, strict=True), schema, strict=True)], schema=schema)

    return parts.mapInArrow(run, index.schema).select(names)


def archive(pages: DataFrame, folder: str | None = None, **columns: str) -> DataFrame:
    """Write pages as archives into ``folder`` (a new one in the shared folder if not given) and return the merged index
    of what was written: a row a page, whatever its values. An empty table gives an empty index."""
    spark = pages.sparkSession
    folder = folder or scratch.new_path(spark, "warc")
    write_archives(pages, folder, **columns)
    return merge_runs(read_index(spark, folder))
