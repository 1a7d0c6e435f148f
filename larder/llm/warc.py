"""WARC archives of captures, and their index by external merge.

Writing: a task appends records to archives of bounded size in the shared folder,
each record a gzip member of its own. Of captures with equal payloads of some
length the first is a response, the others are revisits that refer to it.

Indexing: each archive is read back record by record (payload digests are checked)
and gives one locally sorted run of captures. Runs are cut at global key bounds;
in each key range a loser tree merges the runs' pieces by URL key and timestamp, so
that the ranges in order hold the globally ordered capture histories. The bounds
include timestamp and place, so the captures of one URL may span ranges.

Failure: a task that is run again writes new archives; only those listed by tasks
that succeeded are indexed. The list and the runs are stored tables.

Nulls and ties: a null payload is empty, a null URL has the empty key, which comes
first. Rows that share the smallest id of a payload are all responses; a null id
comes after all others, and a payload with null ids only has responses only. An
empty table gives no archives and no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import batches_of, make_folder, open_input, open_output, prepare, rows_of, shuffle_tasks
from larder.session import materialise, scratch_path

#: Payloads below this many bytes are never revisits.
REVISIT_BYTES = 100
ARCHIVE_BYTES = 32 << 20
#: Captures that one merge task holds.
RANGE_ROWS = 400_000
EPOCH = 1_600_000_000

_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LIST = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
_CAPTURE = pa.schema(
    [
        ("run", pa.string()),
        ("url_key", pa.string()),
        ("captured", pa.int64()),
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("url", pa.string()),
        ("offset", pa.int64()),
        ("length", pa.int64()),
    ]
)
_CAPTURE_DDL = "run string, url_key string, captured long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, offset long, length long"
_URL = re.compile(r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?([^#]*)", re.IGNORECASE)


def url_key(url: str | None) -> str:
    """Sort key: host labels in reverse, without www, then path and query; lower case."""
    if not url:
        return ""
    host, port, rest = _URL.match(url.strip()).groups()
    labels = host.lower().removeprefix("www.").split(".")
    return ",".join(reversed(labels)) + (port or "") + ")" + (rest.lower() or "/")


def _header(lines: list[tuple[str, object]], first: str) -> bytes:
    return "\r\n".join([first, *(f"{name}: {value}" for name, value in lines), "", ""]).encode()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _safe(url: str) -> str:
    """The URL without characters that would break a header line."""
    return re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url)


def _unsafe(url: str) -> str:
    return re.sub(r"%(00|01|[01][0-9A-F]|20|7F|25)", lambda m: chr(int(m[1], 16)), url)


def record_bytes(page_id: int | None, url: str | None, captured: int, payload: bytes, digest: str, first_id: int | None) -> bytes:
    """One WARC record, gzip-compressed; ``first_id`` makes it a revisit of that page."""
    revisit = first_id is not None
    http = _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))], "HTTP/1.1 200 OK")
    block = http if revisit else http + payload
    lines: list[tuple[str, object]] = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", datetime.fromtimestamp(captured, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")),
    ]
    if url is not None:
        lines.append(("WARC-Target-URI", _safe(url)))
    if page_id is not None:
        lines.append(("X-Page-ID", page_id))
    lines.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if revisit:
        lines += [("WARC-Profile", _REVISIT_PROFILE), ("WARC-Refers-To", _record_id(first_id, digest)), ("X-Refers-To-Page-ID", first_id)]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(_header(lines, "WARC/1.1") + block + b"\r\n\r\n") + packer.flush()


def write_archives(rows: Iterator[tuple], folder: str, task: int, archive_bytes: int) -> Iterator[tuple]:
    """Append rows (page_id, url, captured, payload, digest, first_id) to archives; lists the archives."""
    sink, place, records, size = None, "", 0, 0
    for page_id, url, captured, payload, digest, first_id in rows:
        if sink is None:
            place, records, size = f"{folder}/{task:06d}-{uuid.uuid4().hex}.warc.gz", 0, 0
            sink = open_output(place)
        data = record_bytes(page_id, url, captured, payload or b"", digest, first_id)
        sink.write(data)
        records, size = records + 1, size + len(data)
        if size >= archive_bytes:
            sink.close()
            sink = None
            yield place, records, size
    if sink is not None:
        sink.close()
        yield place, records, size


def _members(source) -> Iterator[tuple[int, int, bytes]]:
    """(offset, compressed length, content) of each gzip member of an open file."""
    offset, rest = 0, b""
    while True:
        data = rest or source.read(1 << 20)
        if not data:
            return
        unpacker, parts, used = zlib.decompressobj(31), [], 0
        while not unpacker.eof:
            if not data:
                raise ValueError(f"archive ends inside the record at {offset}")
            parts.append(unpacker.decompress(data))
            used += len(data)
            data = b"" if unpacker.eof else source.read(1 << 20)
        rest = unpacker.unused_data
        length = used - len(rest)
        yield offset, length, b"".join(parts)
        offset += length


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def read_archive(place: str) -> Iterator[tuple]:
    """Captures of one archive, in file order, with digests checked against payloads."""
    with open_input(place) as source:
        for offset, length, content in _members(source):
            head, _, rest = content.partition(b"\r\n\r\n")
            warc = _fields(head)
            block = rest[: int(warc["Content-Length"])]
            http, _, payload = block.partition(b"\r\n\r\n")
            size, digest = int(_fields(http)["Content-Length"]), warc["WARC-Payload-Digest"].removeprefix("sha256:")
            kind = warc["WARC-Type"]
            if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                raise ValueError(f"payload of the record at {offset} of {place} differs from its digest")
            url = _unsafe(warc["WARC-Target-URI"]) if "WARC-Target-URI" in warc else None
            captured = int(datetime.strptime(warc["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc).timestamp())
            page, refers = warc.get("X-Page-ID"), warc.get("X-Refers-To-Page-ID")
            yield (place, url_key(url), captured, page and int(page), size, digest, kind, refers and int(refers), url, offset, length)


def _key(capture: tuple) -> tuple:
    """Merge order: URL key, timestamp, then the record's place."""
    return capture[1], capture[2], capture[0], capture[9]


class LoserTree:
    """k-way merge of sorted iterators: a tournament whose inner nodes hold the losers.

    The next capture costs one comparison per level of the tree.
    """

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.heads = [next(run, None) for run in runs]
        self.keys = [None if head is None else _key(head) for head in self.heads]
        self.k = len(runs)
        self.losers = [-1] * self.k
        for leaf in range(self.k):
            self._replay(leaf, building=True)

    def _beats(self, a: int, b: int) -> bool:
        """Whether run a's head comes before run b's; ended runs lose."""
        x, y = self.keys[a], self.keys[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or (x == y and a < b)

    def _replay(self, leaf: int, building: bool = False) -> None:
        winner, node = leaf, (leaf + self.k) >> 1
        while node:
            other = self.losers[node]
            if other < 0:
                if building:
                    self.losers[node] = winner
                    return
            elif self._beats(other, winner):
                self.losers[node], winner = winner, other
            node >>= 1
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[best := self.losers[0]] is not None:
            yield self.heads[best]
            self.heads[best] = head = next(self.runs[best], None)
            self.keys[best] = None if head is None else _key(head)
            self._replay(best)


def merge_runs(captures: Iterator[tuple]) -> Iterator[tuple]:
    """Merge the sorted pieces of runs that a key range received, one after another."""
    pieces: list[list[tuple]] = []
    last = None
    for capture in captures:
        key = _key(capture)
        if last is None or key < last or capture[0] != pieces[-1][-1][0]:
            pieces.append([])
        pieces[-1].append(capture)
        last = key
    yield from LoserTree([iter(piece) for piece in pieces])


def archive_pages(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write archives of (page_id, url, captured, payload); the stored list (archive, records, bytes)."""
    spark = prepare(pages.sparkSession)
    known = pages.withColumn("digest", F.sha2(F.coalesce("payload", F.lit("").cast("binary")), 256))
    firsts = materialise(
        known.filter(F.length("payload") >= revisit_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("captures"))
        .filter("captures > 1 AND first_id IS NOT NULL")
        .select("digest", "first_id"),
        "warc-firsts",
    )
    folder = make_folder(scratch_path(spark, "warc"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))

    def write(batches):
        yield from batches_of(write_archives(rows_of(batches), folder, TaskContext.get().partitionId(), archive_bytes), _LIST)

    return materialise(
        known.join(firsts, "digest", "left")
        .select("page_id", "url", "captured", "payload", "digest", refers.alias("first_id"))
        .mapInArrow(write, "archive string, records long, bytes long"),
        "warc-list",
    )


def capture_runs(archives: DataFrame) -> DataFrame:
    """Read archives back; one run of captures per archive, sorted by URL key and timestamp."""

    def read(batches):
        def captures():
            for (place,) in rows_of(batches):
                yield from sorted(read_archive(place), key=_key)

        yield from batches_of(captures(), _CAPTURE)

    tasks = max(1, archives.count())
    return materialise(archives.select("archive").repartition(tasks).mapInArrow(read, _CAPTURE_DDL), "warc-runs")


def capture_histories(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Runs merged into global order: key ranges in order of ``shard``, captures in order of ``place``.

    ``visit`` counts the captures of a URL key inside its shard.
    """
    spark = prepare(runs.sparkSession)
    ranges = shuffle_tasks(spark, runs.count(), range_rows)

    def merge(batches):
        shard = TaskContext.get().partitionId()

        def ordered():
            before, visit = None, 0
            for place, capture in enumerate(merge_runs(rows_of(batches))):
                visit = visit + 1 if capture[1] == before else 1
                before = capture[1]
                yield (*capture, shard, place, visit)

        yield from batches_of(ordered(), schema)

    schema = pa.schema([*_CAPTURE, ("shard", pa.int64()), ("place", pa.int64()), ("visit", pa.int64())])
    return runs.repartitionByRange(ranges, "url_key", "captured", "run", "offset").mapInArrow(
        merge, _CAPTURE_DDL + ", shard long, place long, visit long"
    )


def archived_captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time_col: str | None = None) -> DataFrame:
    """Archive pages, index the archives and merge the index: one row per capture, in global order.

    Without a column of capture times (seconds), a page's time follows from its id.
    """
    seconds = F.col(time_col).cast("long") if time_col else F.pmod(F.coalesce(F.col(id_col).cast("long"), F.lit(0)), F.lit(1 << 30)) + EPOCH
    captures = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(seconds, F.lit(EPOCH)).alias("captured"),
        F.coalesce(F.col(html_col).cast("binary"), F.lit("").cast("binary")).alias("payload"),
    )
    return capture_histories(capture_runs(archive_pages(captures)))
