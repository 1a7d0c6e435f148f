"""Removal of byte strings that also start earlier in the corpus, by suffix arrays.

A string of ``LENGTH`` bytes that occurs twice holds, at the same place in both, a
least ``GRAM``-byte hash: an anchor. So:

1. Tasks find the anchors of their documents and pack them in chunks by shard of the
   anchor hash, each with the hash of its surroundings (all bytes that a string
   around the anchor can reach). Of anchors of a chunk with equal surroundings only
   the earliest is sent on: all strings around the others start earlier too.
2. A shard drops anchors that occur once, does the same across chunks, and asks for
   the bytes around anchors whose surroundings differ.
3. The surroundings of an anchor are cut to what they share with any other; where
   that is shorter than a string, nothing repeats. Cut strings that are equal keep
   their earliest. The rest, joined in buckets, are put into suffix order by linear
   grouping; suffixes with equal first ``LENGTH`` bytes are neighbours then, and all
   but the earliest of them are repeats.
4. A document's repeats are united and cut out.

An anchor with more differing surroundings than one task should hold is instead
resolved by grouping its strings by their digest, which spreads over all tasks.

Surroundings are compared by 64-bit hashes in steps 1 and 2. Nulls and ties: a null
text is empty, a null id comes after all others. Rows with equal id are ordered by a
hash of their text; rows equal in id and text are one document and are cut alike.
Texts shorter than a string lose nothing. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os.path
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import batches_of, mix64, prepare, rows_of, shuffle_tasks
from larder.llm.suffix_array import suffix_array
from larder.llm.words import _CODES, _powers_for, text_bytes
from larder.session import materialise

LENGTH, GRAM = 100, 32
REACH = LENGTH - GRAM
CHUNK_BYTES, SHARD_ANCHORS = 4 << 20, 1 << 17
#: Bytes of a suffix array, and surroundings of one anchor that a task may hold.
BUCKET_BYTES = 1 << 16
HELD_SURROUNDINGS = 50_000
LAST_ID = (1 << 63) - 1

_PLACES = pa.schema([("anchor", pa.int64()), ("doc", pa.int64()), ("tie", pa.int64()), ("at", pa.int64()), ("asked", pa.bool_())])
_RANGE = pa.schema([("doc", pa.int64()), ("tie", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])


def _range_hashes(sums: np.ndarray, inverse: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64((sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _sliding(pick: np.ufunc, values: np.ndarray) -> np.ndarray:
    """Least or greatest of each ``REACH`` + 1 neighbours, by doubling."""
    width = 1
    while 2 * width <= REACH + 1:
        values = pick(values[:-width], values[width:])
        width *= 2
    if rest := REACH + 1 - width:
        values = pick(values[:-rest], values[rest:])
    return values


def anchors_of(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, hash of surroundings) of one text's anchors."""
    n = len(text)
    if n < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    power, inverse = _powers_for(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_CODES[text] * power[:n], out=sums[1:])
        grams = mix64((sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1])
    # a gram is an anchor if it is the least of a string that holds it: the greatest of these strings' least hashes
    least = _sliding(np.minimum, grams)
    rim = np.zeros(REACH, np.uint64)
    at = np.flatnonzero(_sliding(np.maximum, np.concatenate([rim, least, rim])) == grams)
    begin, end = np.maximum(at - REACH, 0), np.minimum(at + LENGTH, n)
    around = _range_hashes(sums, inverse, begin, end)
    with np.errstate(over="ignore"):
        around = mix64(around + (at - begin).astype(np.uint64))
    # anchors are small hashes; mixed again, they spread evenly over shards
    return at, mix64(grams[at]), around


def _planes(values: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _from_planes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view(np.int64)


def _pack(columns: list[np.ndarray]) -> bytes:
    parts = [_planes(c.view(np.int64)) for c in columns]
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "little")
        out.append(_from_planes(data[at + 4 : at + 4 + size]))
        at += 4 + size
    return out


def _later(hashes: np.ndarray, around: np.ndarray, doc: np.ndarray, tie: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by hash, surroundings and place; and which have equal surroundings before them."""
    order = np.lexsort((at, tie, doc, around, hashes))
    same = np.zeros(len(order), bool)
    same[1:] = (hashes[order[1:]] == hashes[order[:-1]]) & (around[order[1:]] == around[order[:-1]])
    return order, same


def _places(doc: np.ndarray, tie: np.ndarray, at: np.ndarray, anchor: np.ndarray | None) -> pa.RecordBatch:
    asked = anchor is not None
    anchor = anchor if asked else np.zeros(len(doc), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(doc), pa.array(tie), pa.array(at), pa.array(np.full(len(doc), asked))], schema=_PLACES)


_CHUNKS = pa.schema([("shard", pa.int64()), ("packed", pa.binary()), ("repeats", pa.binary())])


def _chunked(batches: Iterator[pa.RecordBatch], task: int, shards: int) -> Iterator[tuple]:
    """Rows (shard, anchors, None) and, of anchors that repeat inside a chunk, (any shard, None, places)."""
    held: list[list[np.ndarray]] = []
    size = number = 0

    def chunk():
        doc, tie, at, hashes, around = (np.concatenate(c) for c in zip(*held, strict=True))
        order, same = _later(hashes, around, doc, tie, at)
        again = order[same]
        if len(again):
            yield (task + number) % shards, None, _pack([doc[again], tie[again], at[again]])
        kept = order[~same]
        ranked = hashes[kept]
        limits = np.array([(s << 64) // shards for s in range(1, shards)], np.uint64)
        cuts = [0, *np.searchsorted(ranked, limits).tolist(), len(kept)]
        for shard in range(shards):
            mine = kept[cuts[shard] : cuts[shard + 1]]
            if len(mine):
                deltas = np.diff(hashes[mine], prepend=np.uint64(0))
                yield shard, _pack([deltas, around[mine], doc[mine], tie[mine], at[mine]]), None

    for batch in batches:
        docs, ties = (batch.column(i).to_numpy() for i in (0, 1))
        data, bounds = text_bytes(batch.column(2))
        for i in range(batch.num_rows):
            at, hashes, around = anchors_of(data[bounds[i] : bounds[i + 1]])
            if len(at):
                held.append([np.full(len(at), docs[i]), np.full(len(at), ties[i]), at, hashes, around])
            size += int(bounds[i + 1] - bounds[i])
            if size >= CHUNK_BYTES and held:
                yield from chunk()
                held, size, number = [], 0, number + 1
    if held:
        yield from chunk()


def _resolve(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Places of anchors from rows sorted by shard: repeated ones, and ones whose bytes are needed."""
    number, held = None, []

    def resolved():
        if not held:
            return
        hashes, around, doc, tie, at = (np.concatenate(c) for c in zip(*held, strict=True))
        order, same = _later(hashes, around, doc, tie, at)
        again = order[same]
        for i in range(0, len(again), 1 << 16):
            part = again[i : i + (1 << 16)]
            yield _places(doc[part], tie[part], at[part], None)
        kept = order[~same]
        ranked = hashes[kept]
        shared = np.zeros(len(kept), bool)
        shared[1:] |= ranked[1:] == ranked[:-1]
        shared[:-1] |= ranked[1:] == ranked[:-1]
        asked = kept[shared]
        for i in range(0, len(asked), 1 << 16):
            part = asked[i : i + (1 << 16)]
            yield _places(doc[part], tie[part], at[part], hashes[part].view(np.int64))

    for shard, packed, repeats in rows:
        if shard != number:
            yield from resolved()
            number, held = shard, []
        if packed is None:
            yield _places(*_unpack(repeats), None)
        else:
            deltas, around, doc, tie, at = _unpack(packed)
            held.append([np.cumsum(deltas.view(np.uint64), dtype=np.uint64), around.view(np.uint64), doc, tie, at])
    yield from resolved()


def _united(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of ranges; adjoining ones become one."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[new], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(reach) - 1]])]


_SURROUNDINGS = pa.schema([("anchor", pa.int64()), ("doc", pa.int64()), ("tie", pa.int64()), ("start", pa.int64()), ("left", pa.int64()), ("bytes", pa.binary())])
_SURROUNDINGS_DDL = "anchor long, doc long, tie long, start long, left long, bytes binary"


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows (anchor, doc, tie, start, bytes before the anchor, bytes) from (doc, tie, text, asked)."""
    for doc, tie, text, asked in rows_of(batches):
        for place in asked:
            at = place["at"]
            begin = max(0, at - REACH)
            yield place["anchor"], doc, tie, begin, at - begin, text[begin : at + LENGTH]


def _shared_lengths(strings: list[bytes]) -> list[int]:
    """How many leading bytes each string shares with any other."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    out = [0] * len(strings)
    for a, b in zip(order, order[1:], strict=False):
        common = len(os.path.commonprefix([strings[a], strings[b]]))
        out[a], out[b] = max(out[a], common), max(out[b], common)
    return out


def _cut_group(group: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """Distinct cut strings (doc, tie, start, bytes) of an anchor's surroundings; ranges of equal, later ones."""
    left = _shared_lengths([data[:k][::-1] for *_, k, data in group])
    right = _shared_lengths([data[k + GRAM :] for *_, k, data in group])
    cut = []
    for (_, doc, tie, start, k, data), a, b in zip(group, left, right, strict=True):
        if a + GRAM + b >= LENGTH:
            cut.append((data[k - a : k + GRAM + b], doc, tie, start + k - a))
    cut.sort()
    strings, repeats, before, twice = [], [], None, False
    for data, doc, tie, start in cut:
        if data == before:
            if (doc, tie, start) == strings[-1][:3]:
                twice = True  # two anchors in one string, which may repeat inside itself
            else:
                repeats.append((doc, tie, start, start + len(data)))
        else:
            strings.append((doc, tie, start, data))
            before = data
    return (strings if twice or len(strings) > 1 else []), repeats


def repeats_in(strings: list[tuple]) -> Iterator[tuple]:
    """Ranges (doc, tie, start, stop) of strings of ``LENGTH`` bytes that also start earlier among (doc, tie, start, bytes)."""
    text = b"".join(s[3] for s in strings)
    sizes = np.array([len(s[3]) for s in strings])
    bounds = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(strings)), sizes)
    place = np.arange(len(text)) - bounds[owner]
    whole = place + LENGTH <= sizes[owner]
    order = np.array(suffix_array(text), np.int64)
    order = order[whole[order]]
    if not len(order):
        return
    heads = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), LENGTH)
    same = np.zeros(len(order), bool)
    for i in range(1, len(order), 4096):
        stop = min(len(order), i + 4096)
        same[i:stop] = (heads[order[i:stop]] == heads[order[i - 1 : stop - 1]]).all(axis=1)
    run = np.cumsum(~same)
    doc, tie, start = (np.array([s[i] for s in strings], np.int64)[owner[order]] for i in range(3))
    start = start + place[order]
    ranked = np.lexsort((start, tie, doc, run))
    first = np.concatenate([[True], run[ranked[1:]] != run[ranked[:-1]]])
    lead = ranked[first][np.cumsum(first) - 1]
    again = ranked[(doc[ranked] != doc[lead]) | (tie[ranked] != tie[lead]) | (start[ranked] != start[lead])]
    again = again[np.lexsort((start[again], tie[again], doc[again]))]
    for i in again.tolist():
        yield int(doc[i]), int(tie[i]), int(start[i]), int(start[i]) + LENGTH


def _merged(ranges: Iterator[tuple]) -> Iterator[tuple]:
    """Ranges in order of place, overlapping neighbours united."""
    now = None
    for doc, tie, start, stop in ranges:
        if now and now[:2] == (doc, tie) and now[2] <= start <= now[3]:
            now = (doc, tie, now[2], max(stop, now[3]))
        else:
            if now:
                yield now
            now = (doc, tie, start, stop)
    if now:
        yield now


def _suffix_ranges(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Repeated ranges from surroundings sorted by anchor."""
    bucket: list[tuple] = []
    size, group = 0, []

    def closed():
        nonlocal size
        strings, repeats = _cut_group(group) if len(group) > 1 else ([], [])
        bucket.extend(strings)
        size += sum(len(s[3]) for s in strings)
        return repeats

    for row in rows:
        if group and row[0] != group[0][0]:
            yield from closed()
            group = []
            if size >= BUCKET_BYTES:
                yield from _merged(repeats_in(bucket))
                bucket, size = [], 0
        group.append(row)
    if group:
        yield from closed()
    if bucket:
        yield from _merged(repeats_in(bucket))


def _digest_ranges(around: DataFrame) -> DataFrame:
    """Repeated ranges around anchors too common for one task: strings grouped by digest."""
    schema = pa.schema([("digest", pa.binary()), ("doc", pa.int64()), ("tie", pa.int64()), ("start", pa.int64())])

    def strings(batches):
        def rows():
            for _, doc, tie, start, _, data in rows_of(batches):
                for i in range(len(data) - LENGTH + 1):
                    yield hashlib.blake2b(data[i : i + LENGTH], digest_size=16).digest(), doc, tie, start + i

        yield from batches_of(rows(), schema)

    found = around.mapInArrow(strings, "digest binary, doc long, tie long, start long")
    place = F.struct("doc", "tie", "start")
    first = found.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").select("digest", "first")
    return found.join(first, "digest").filter(place != F.col("first")).select("doc", "tie", "start", (F.col("start") + LENGTH).alias("stop"))


def repeated_ranges(rows: DataFrame) -> DataFrame:
    """Ranges (doc, tie, start, stop) to remove from rows (doc, tie, text); a range may end past its text."""
    spark = prepare(rows.sparkSession)
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = 1 << max(0, (total // 34 // SHARD_ANCHORS).bit_length())
    tasks = shuffle_tasks(spark, total, 64 << 20)

    def pack(batches):
        yield from batches_of(_chunked(batches, TaskContext.get().partitionId(), shards), _CHUNKS)

    def resolve(batches):
        yield from _resolve(rows_of(batches))

    places = materialise(
        rows.mapInArrow(pack, "shard long, packed binary, repeats binary")
        .repartition(max(shards, tasks), "shard")
        .sortWithinPartitions("shard")
        .mapInArrow(resolve, "anchor long, doc long, tie long, at long, asked boolean"),
        "repeat-places",
    )
    whole = places.filter("NOT asked").select("doc", "tie", F.greatest(F.lit(0), F.col("at") - REACH).alias("start"), (F.col("at") + LENGTH).alias("stop"))
    asked = places.filter("asked").groupBy("doc", "tie").agg(F.collect_list(F.struct("anchor", "at")).alias("asked"))

    def extract(batches):
        yield from batches_of(_surroundings(batches), _SURROUNDINGS)

    around = materialise(rows.join(asked, ["doc", "tie"]).select("doc", "tie", "text", "asked").mapInArrow(extract, _SURROUNDINGS_DDL), "repeat-surroundings")
    common = materialise(around.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > HELD_SURROUNDINGS).select("anchor"), "repeat-common")
    few = common.isEmpty()

    def order(batches):
        yield from batches_of(_suffix_ranges(rows_of(batches)), _RANGE)

    grouped = (around if few else around.join(common, "anchor", "left_anti").select(*around.columns)).repartition(tasks, "anchor").sortWithinPartitions("anchor")
    found = materialise(grouped.mapInArrow(order, "doc long, tie long, start long, stop long"), "repeat-ranges")
    ranges = whole.unionByName(found)
    return ranges if few else ranges.unionByName(_digest_ranges(around.join(common, "anchor", "left_semi").select(*around.columns)))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes, ``kept``)."""
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    unique = rows.groupBy("doc_id").count().filter("count > 1").isEmpty()
    tie = F.lit(0).cast("long") if unique else F.xxhash64("text")
    rows = rows.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc"), tie.alias("tie"), "text", F.col("doc_id").isNull().alias("no_id"))
    ranges = repeated_ranges(rows.select("doc", "tie", "text")).groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if with_text:
        fields, ddl = [*fields, ("kept", pa.binary())], ddl + ", kept binary"
    schema = pa.schema(fields)

    def cut(batches):
        def results():
            for batch in batches:
                columns = [batch.column(i).to_pylist() for i in range(3)]
                for doc, no_id, data, ranges in zip(*columns, batch.column(3), strict=True):
                    kept, removed, spans = data, 0, 0
                    if ranges.is_valid:
                        pairs = ranges.values
                        starts, stops = _united(pairs.field("start").to_numpy(), np.minimum(pairs.field("stop").to_numpy(), len(data)))
                        edges = np.concatenate([[0], np.stack([starts, stops], axis=1).reshape(-1), [len(data)]]).tolist()
                        kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                        removed, spans = int((stops - starts).sum()), len(starts)
                    row = (None if no_id else doc, len(data), removed, spans, hashlib.sha256(kept).hexdigest())
                    yield (*row, kept) if with_text else row

        yield from batches_of(results(), schema)

    return rows.join(ranges, ["doc", "tie"], "left").select("doc", "no_id", "text", "ranges").mapInArrow(cut, ddl)
