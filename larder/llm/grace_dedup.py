"""Exact dedup by Grace hashing.

Rows are compared by their whole content, after runs of ASCII white space have
become one space. Three steps:

1. Each task first groups its own rows in an open-addressing table, so that a
   text held by a third of all rows reaches the shuffle a few times a task.
2. These local groups are partitioned by a digest (Spark's shuffle writes the
   first partition files). A bucket whose distinct contents outgrow the table's
   limit is partitioned again into spill files by further digest bits, and so on
   until each bucket fits; equal contents never add to a table's size.
3. The surviving row of each local group's class goes back to the group's rows
   by group id.

Nulls and ties: a null text counts as empty. A null id comes after all others.
Of rows with equal id and text one stays. An empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import (
    ASCII_SPACE,
    batches_of,
    make_folder,
    open_input,
    open_output,
    prepare,
    remove_file,
    rows_of,
    shuffle_tasks,
)
from larder.session import materialise, scratch_path

#: Bytes of distinct content that a table holds before it flushes (local groups) or splits (buckets).
LOCAL_BYTES = 16 << 20
BUCKET_BYTES = 64 << 20
#: Ids in a row of a local group; a larger group makes more rows.
IDS_PER_ROW = 4096
FAN_OUT = 16

_GROUPS = pa.schema([("gid", pa.int64()), ("sha", pa.binary()), ("content", pa.binary()), ("content_bytes", pa.int64()), ("ids", pa.list_(pa.int64()))])
_GROUPS_DDL = "gid long, sha binary, content binary, content_bytes long, ids array<long>"
_RECORD = pa.schema([("gid", pa.int64()), ("sha", pa.binary()), ("content", pa.binary()), ("least_id", pa.int64()), ("n", pa.int64())])
_CLASS = pa.schema([("gid", pa.int64()), ("keep_gid", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
_CLASS_DDL = "gid long, keep_gid long, keep_id long, group_size long"


def normal_form(text: bytes | None) -> bytes:
    """The text with each run of ASCII white space replaced by one space."""
    if not text:
        return b""
    words = text.split()
    if not words:
        return b" "
    lead = b" " if text[0] in ASCII_SPACE else b""
    trail = b" " if text[-1] in ASCII_SPACE else b""
    return lead + b" ".join(words) + trail


class ContentTable:
    """Open addressing with linear probing; equal means equal content, not equal hash."""

    def __init__(self, slots: int = 1024):
        self.slots = [-1] * slots
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.values: list[list] = []
        self.bytes = 0

    def entry(self, sha: bytes, content: bytes) -> list:
        """The values held for a content; a new, empty list when it is new."""
        code = int.from_bytes(sha[:8], "big")
        mask = len(self.slots) - 1
        at = code & mask
        while (found := self.slots[at]) >= 0:
            if self.hashes[found] == code and self.contents[found] == content:
                return self.values[found]
            at = (at + 1) & mask
        self.slots[at] = len(self.hashes)
        self.hashes.append(code)
        self.contents.append(content)
        self.values.append([])
        self.bytes += len(content) + 100
        made = self.values[-1]
        if 3 * len(self.hashes) > 2 * len(self.slots):
            self._grow()
        return made

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for i, code in enumerate(self.hashes):
            at = code & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = i

    def items(self) -> Iterator[tuple[bytes, list]]:
        return zip(self.contents, self.values, strict=True)


def _order(value: int | None) -> tuple[bool, int]:
    return (value is None, value or 0)


def local_groups(rows: Iterator[tuple], first_gid: int, limit: int, ids_per_row: int) -> Iterator[tuple]:
    """Group a task's (id, text) rows; emits (gid, sha, content, bytes, ids)."""
    gid, table, shas = first_gid, ContentTable(), []

    def flushed() -> Iterator[tuple]:
        nonlocal gid
        for sha, (content, ids) in zip(shas, table.items(), strict=True):
            ids.sort(key=_order)
            for i in range(0, len(ids), ids_per_row):
                yield gid, sha, content, len(content), ids[i : i + ids_per_row]
                gid += 1

    for doc_id, text in rows:
        content = normal_form(text)
        sha = hashlib.sha256(content).digest()
        ids = table.entry(sha, content)
        if not ids:
            shas.append(sha)
        ids.append(doc_id)
        table.bytes += 8
        if table.bytes > limit:
            yield from flushed()
            table, shas = ContentTable(), []
    yield from flushed()


class _Spill:
    """One spill file of a bucket, in the shared folder, removed once read."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}.arrow"
        self.held: list[tuple] = []
        self.size = 0
        self.writer = None

    def add(self, record: tuple) -> None:
        self.held.append(record)
        self.size += len(record[2]) + 64
        if self.size > 1 << 20:
            self._write()

    def _write(self) -> None:
        if self.writer is None:
            self.sink = open_output(self.uri)
            self.writer = pa.ipc.new_stream(self.sink, _RECORD)
        for batch in batches_of(iter(self.held), _RECORD):
            self.writer.write_batch(batch)
        self.held, self.size = [], 0

    def records(self) -> Iterator[tuple]:
        if self.held:
            self._write()
        if self.writer is None:
            return
        self.writer.close()
        self.sink.close()
        try:
            with open_input(self.uri) as source:
                yield from rows_of(pa.ipc.open_stream(source))
        finally:
            remove_file(self.uri)


def bucket_classes(records: Iterator[tuple], folder: str, limit: int, level: int = 0) -> Iterator[tuple]:
    """Classes of equal content in a bucket: (gid, keep_gid, keep_id, group_size)."""
    table, spills, shas = ContentTable(), None, []
    for record in records:
        if spills is None:
            gid, sha, content, least, n = record
            members = table.entry(sha, content)
            if not members:
                shas.append(sha)
            members.append((gid, least, n))
            if table.bytes > limit and level < 31 and len(table.contents) > 1:
                spills = [_Spill(folder) for _ in range(FAN_OUT)]
                for sha, (content, members) in zip(shas, table.items(), strict=True):
                    for gid, least, n in members:
                        spills[sha[31 - level] % FAN_OUT].add((gid, sha, content, least, n))
                table = None
        else:
            spills[record[1][31 - level] % FAN_OUT].add(record)
    if spills is not None:
        for spill in spills:
            yield from bucket_classes(spill.records(), folder, limit, level + 1)
        return
    for _, members in table.items():
        keep_gid, keep_id, _ = min(members, key=lambda m: (*_order(m[1]), m[0]))
        total = sum(m[2] for m in members)
        for gid, _, _ in members:
            yield gid, keep_gid, keep_id, total


def grace_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    local_bytes: int = LOCAL_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
    ids_per_row: int = IDS_PER_ROW,
) -> DataFrame:
    """Per row of ``docs``: its id, the id of the row that stays, the class size, whether it stays, the digest."""
    spark = prepare(docs.sparkSession)

    def group(batches):
        first = TaskContext.get().partitionId() << 40
        yield from batches_of(local_groups(rows_of(batches), first, local_bytes, ids_per_row), _GROUPS)

    groups = materialise(
        docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(group, _GROUPS_DDL),
        "grace-groups",
    )
    total = groups.agg(F.sum("content_bytes")).first()[0] or 0
    folder = make_folder(scratch_path(spark, "grace-spill"))

    def classes(batches):
        yield from batches_of(bucket_classes(rows_of(batches), folder, bucket_bytes), _CLASS)

    found = (
        groups.select("gid", "sha", "content", F.element_at("ids", 1).alias("least_id"), F.size("ids").cast("long").alias("n"))
        .repartition(shuffle_tasks(spark, total, bucket_bytes), "sha")
        .mapInArrow(classes, _CLASS_DDL)
    )
    return (
        groups.select("gid", "sha", "ids")
        .join(found, "gid")
        .select("gid", "sha", "keep_gid", "keep_id", "group_size", F.posexplode("ids").alias("at", "doc_id"))
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            ((F.col("gid") == F.col("keep_gid")) & (F.col("at") == 0)).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
    )
