"""WARC archives of web pages, and one index over all of them in URL and time order.

Writing: every page becomes a record of format 1.1 with an HTTP block. Of pages with equal payloads, at least
``least_bytes`` long, the one with the smallest id is a ``response``; the others are ``revisit`` records that name it
and hold no payload. Spark's text writer writes the archives (compressed, records parted by the empty lines the
format asks for), so they go to any file system that Spark writes to.

Reading: an archive is parsed record by record by its lengths; digests of responses are computed from the payload read.
The entries of an archive are sorted by URL key, time and id: one sorted run per archive.

Merging: entries are dealt by ranges of (URL key, time, id), so one URL with very many captures spreads over several
ranges. Inside a range, the runs meet in a loser tree: each step plays only the path of the run that gave the last entry.
Partitions in order, and rows within them, hold the capture history of every URL.

Rules for unusual rows: a NULL payload is empty; a NULL url is the empty one and sorts first. Rows with a NULL id are left
out, as no record could name them. Repeated ids are records each; all rows with the smallest id of equal payloads are
responses. Line ends in an url are percent-encoded. Other columns are never read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeloom.session import checkpoint_folder

from .common import stored

#: Records in one archive file at most; bounds what a reading task holds.
RECORDS_PER_FILE = 2_000
#: Index entries in one range, about.
ENTRIES_PER_RANGE = 50_000
#: When no column says when a page was fetched.
NO_DATE = "1970-01-01T00:00:00Z"

# --- fixed values of the public WARC 1.1 format ---
VERSION = "WARC/1.1"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http;msgtype=response"
# --- end of fixed values ---

ID_PREFIX = "urn:page:"
ENTRY = (
    "url_key string, captured string, page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, "
    "refers_to bigint, archive string, position bigint, run string, place int"
)


def sha1_base32(value: Column) -> Column:
    """SHA-1 in upper-case base32: four groups of ten hex digits, each eight characters of five bits."""
    digest = F.sha1(value)
    letters = []
    for group in range(4):
        number = F.conv(digest.substr(10 * group + 1, 10), 16, 10).cast("bigint")
        for i in range(8):
            at = F.shiftright(number, 35 - 5 * i).bitwiseAND(F.lit(31)) + 1
            letters.append(F.substring(F.lit(BASE32), at.cast("int"), F.lit(1)))
    return F.concat(*letters)


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date_col: str | None = None, least_bytes: int = 0) -> DataFrame:
    """``(page_id, record)``: the text of every record."""
    date = F.date_format(F.col(date_col).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'") if date_col else F.lit(None).cast("string")
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.coalesce(F.replace(F.replace(F.col(url_col), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit("")).alias("url"),
        F.coalesce(F.col(payload_col), F.lit("")).alias("payload"),
        F.coalesce(date, F.lit(NO_DATE)).alias("captured"),
    ).where("page_id IS NOT NULL")
    rows = rows.select("*", F.octet_length("payload").cast("bigint").alias("size"), sha1_base32(F.col("payload").cast("binary")).alias("digest"))
    several = rows.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.min("page_id").alias("original"), F.count("*").alias("n")).where("n > 1")
    told = rows.join(several.select("digest", "size", "original"), ["digest", "size"], "left")
    revisit = F.col("original").isNotNull() & (F.col("original") != F.col("page_id"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    lines = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit(f"WARC-Record-ID: <{ID_PREFIX}"), F.col("page_id").cast("string"), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), F.col("captured")),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.when(revisit, F.concat(F.lit(f"WARC-Refers-To: <{ID_PREFIX}"), F.col("original").cast("string"), F.lit(">"))),
        F.lit(f"Content-Type: {HTTP_TYPE}"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return told.select("page_id", F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block).alias("record"))


def write_archives(rows: DataFrame, folder: str, per_file: int = RECORDS_PER_FILE) -> None:
    """Archives of the records; a record is followed by two line ends, as the format says."""
    rows.select("record").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(folder)


def url_key(url: str) -> str:
    """Sort-friendly form: host labels from the top-level domain down, then port, path and query."""
    try:
        parts = urlsplit(url.strip().lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.strip().lower()
    if not host:
        return url.strip().lower()
    labels = host.removeprefix("www.").split(".")
    shown = f":{port}" if port and port != {"http": 80, "https": 443}.get(parts.scheme) else ""
    return ",".join(reversed(labels)) + shown + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def parse_archive(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """``(position, header fields, block)`` of every record; positions count uncompressed bytes."""
    with gzip.GzipFile(fileobj=io.BytesIO(content)) as file:
        while True:
            position = file.tell()
            line = file.readline()
            if not line:
                return
            if line.strip() == b"":
                continue
            if line.strip().decode() != VERSION:
                raise ValueError(f"no record begins at byte {position}")
            fields = {}
            while (line := file.readline()).strip():
                name, _, value = line.decode().rstrip("\r\n").partition(":")
                fields[name.lower()] = value.removeprefix(" ")
            block = file.read(int(fields["content-length"]))
            yield position, fields, block


def _page(value: str) -> int:
    return int(value.strip("<> ").removeprefix(ID_PREFIX))


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in ENTRY.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32()]
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            archive, run = path.rpartition("/")[2], []
            for position, fields, block in parse_archive(content.as_py()):
                head, _, payload = block.partition(b"\r\n\r\n")
                if fields["warc-type"] == "response":
                    size, digest, refers = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), None
                else:
                    size = int(head.lower().partition(b"content-length:")[2].split(b"\r\n")[0])
                    digest, refers = fields["warc-payload-digest"].removeprefix("sha1:"), _page(fields["warc-refers-to"])
                url = fields["warc-target-uri"]
                run.append((url_key(url), fields["warc-date"], _page(fields["warc-record-id"]), url, fields["warc-type"], size, digest, refers, archive, position))
            run.sort(key=lambda e: e[:3])
            columns = list(zip(*run, strict=True)) or [[]] * 10
            columns += [[archive] * len(run), range(len(run))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Index entries (:data:`ENTRY`) of all archives in ``folder``; each archive is one sorted ``run``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder)
    return files.select("path", "content").mapInArrow(_entries, ENTRY)


class LoserTree:
    """Tournament over the heads of sorted runs. Inner nodes keep the loser of their match, so replacing the winner
    replays one path from its leaf to the root."""

    def __init__(self, heads: list):
        self.size = len(heads)
        self.heads = heads  # None: the run has ended
        self.losers = [-1] * self.size
        self.winner = 0
        winners = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (b, a) if self._beats(b, a) else (a, b)
        self.winner = winners[1] if self.size > 1 else 0

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def replace(self, head) -> None:
        """The winner's run goes on with ``head``."""
        now = self.winner
        self.heads[now] = head
        node = (now + self.size) // 2
        while node:
            if self._beats(self.losers[node], now):
                now, self.losers[node] = self.losers[node], now
            node //= 2
        self.winner = now


def merge_runs(runs: list[list]) -> Iterator[tuple[int, int]]:
    """``(run, place)`` of all entries of the sorted ``runs`` in global order."""
    if not runs:
        return
    places = [0] * len(runs)
    tree = LoserTree([r[0] if r else None for r in runs])
    while tree.heads[tree.winner] is not None:
        run = tree.winner
        yield run, places[run]
        places[run] += 1
        tree.replace(runs[run][places[run]] if places[run] < len(runs[run]) else None)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held)
    keys = list(zip(*(table.column(c).to_pylist() for c in ("url_key", "captured", "page_id")), strict=True))
    names = table.column("run").to_pylist()
    starts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
    bounds = list(zip(starts, [*starts[1:], len(names)], strict=True))
    order = [bounds[run][0] + place for run, place in merge_runs([keys[a:b] for a, b in bounds])]
    yield from table.take(pa.array(order, pa.int64())).combine_chunks().to_batches(max_chunksize=10_000)


def capture_index(entries: DataFrame, per_range: int = ENTRIES_PER_RANGE) -> DataFrame:
    """Entries of all runs in global order of URL key, time and id."""
    entries = stored(entries, "entries")
    ranges = max(1, -(-entries.count() // per_range))
    dealt = entries.repartitionByRange(ranges, "url_key", "captured", "page_id").sortWithinPartitions("run", "place")
    return dealt.select(*entries.columns).mapInArrow(_merge, entries.schema)


def archive_pages(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Write the archives of ``pages``, read them back, and return their merged index."""
    spark = pages.sparkSession
    folder = folder or f"{checkpoint_folder(spark)}/archives-{uuid.uuid4().hex}"
    write_archives(records(pages, **columns), folder)
    return capture_index(read_archives(spark, folder))
