"""Benchmark decontamination by Wu-Manber search over words.

Texts become words: A-Z is lower-cased, every other ASCII character but digits
and letters separates. A pattern is a window of consecutive item words (ten; a
shorter item is one window). For each pattern length there is a matcher: a block
is two words; a block that no pattern holds moves the search nine words on; a
block that ends a pattern selects the patterns by their first block, and the
words themselves are then compared.

Patterns are hashed into blocks of bounded number, one file each in the shared
folder. A task searches a bounded chunk of texts with one block after another,
so memory stays bounded for any benchmark, and documents are never shuffled.

Nulls and ties: a null or wordless text has no words and no hits; an item
without id is no item. Repeated items count once. Columns to carry may have any
name; the results are in one struct column.
"""

from __future__ import annotations

import itertools
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import batches_of, fresh, give_back, make_folder, open_input, open_output, prepare, rows_of
from larder.session import materialise, scratch_path

WINDOW = 10
BLOCK_WORDS = 2
#: Patterns of one block and bytes of text of one chunk: what a task holds at once.
BLOCK_PATTERNS = 40_000
CHUNK_BYTES = 4 << 20

#: Bytes below 0x80 that are no letters or digits separate words; capitals become small.
_TO_WORDS = bytes(
    ord(chr(b).lower()) if b < 0x80 and chr(b).isalnum() else b if b >= 0x80 else 0x20 for b in range(256)
)
_WINDOWS = pa.schema([("window", pa.binary()), ("item", pa.string())])
_RESULT = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
    ]
)
RESULT_DDL = "struct<n_words: bigint, n_hit: bigint, items: array<string>, spans: array<struct<first: bigint, last: bigint>>>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TO_WORDS).split() if text else []


def windows_of(words: list[bytes], size: int = WINDOW) -> Iterator[bytes]:
    """Windows of ``size`` words; fewer words make one window, none make none."""
    if words:
        for i in range(max(1, len(words) - size + 1)):
            yield b" ".join(words[i : i + size])


class WuManber:
    """Matcher for patterns of equal length in words."""

    def __init__(self, patterns: list[list[bytes]]):
        self.length = m = len(patterns[0])
        self.block = b = min(BLOCK_WORDS, m)
        self.farthest = m - b + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, dict[bytes, list[int]]] = defaultdict(lambda: defaultdict(list))
        self.patterns = patterns
        for number, pattern in enumerate(patterns):
            for end in range(b, m + 1):
                key = b" ".join(pattern[end - b : end])
                self.shift[key] = min(self.shift.get(key, self.farthest), m - end)
            self.bucket[b" ".join(pattern[m - b :])][b" ".join(pattern[:b])].append(number)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(first word, pattern number) of every occurrence, in text order."""
        m, b, shift, farthest, patterns = self.length, self.block, self.shift, self.farthest, self.patterns
        last, n, join = m - 1, len(words), b" ".join
        while last < n:
            key = join(words[last - b + 1 : last + 1])
            skip = shift.get(key, farthest)
            if skip:
                last += skip
                continue
            first = last - m + 1
            for number in self.bucket[key].get(join(words[first : first + b]), ()):
                if words[first : last + 1] == patterns[number]:
                    yield first, number
            last += 1


class PatternBlock:
    """Matchers by pattern length, and the items of each pattern."""

    def __init__(self, rows: Iterator[tuple[bytes, str]]):
        items: dict[bytes, list[str]] = defaultdict(list)
        for window, item in rows:
            items[window].append(item)
        by_length = defaultdict(list)
        for window in items:
            by_length[window.count(b" ") + 1].append(window)
        self.parts = [
            (WuManber([w.split(b" ") for w in windows]), [items[w] for w in windows])
            for _, windows in sorted(by_length.items())
        ]

    def find(self, words: list[bytes], spans: list[tuple[int, int]], found: set[str]) -> None:
        for matcher, items in self.parts:
            for first, number in matcher.search(words):
                spans.append((first, first + matcher.length - 1))
                found.update(items[number])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of spans of words; adjoining spans become one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def pattern_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_patterns: int = BLOCK_PATTERNS) -> list[str]:
    """Write the distinct windows of all items as block files; returns their places."""
    spark = prepare(items.sparkSession)

    def cut(batches):
        yield from batches_of(((w, item) for item, text in rows_of(batches) for w in windows_of(words_of(text), window)), _WINDOWS)

    windows = materialise(
        items.filter(F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("string"), F.col(text_col).cast("binary"))
        .mapInArrow(cut, "window binary, item string")
        .distinct(),
        "benchmark-windows",
    )
    n_blocks = -(-windows.count() // block_patterns)
    folder = make_folder(scratch_path(spark, "benchmark-blocks"))
    if not n_blocks:
        return []

    def write(batches):
        sink = writer = current = None
        try:
            for batch in batches:
                numbers = batch.column(2).to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
                for first, last in itertools.pairwise(cuts):
                    if first == last:
                        continue
                    if current != numbers[first]:
                        if writer is not None:
                            writer.close()
                            sink.close()
                        current = int(numbers[first])
                        place = f"{folder}/{current}-{uuid.uuid4().hex}.arrow"
                        sink = open_output(place)
                        writer = pa.ipc.new_stream(sink, _WINDOWS)
                        yield pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([place])], names=["number", "place"])
                    part = batch.slice(first, last - first)
                    writer.write_batch(pa.RecordBatch.from_arrays([part.column(0).cast(pa.binary()), part.column(1).cast(pa.string())], schema=_WINDOWS))
        finally:
            if writer is not None:
                writer.close()
                sink.close()

    # each block is written by the task that gets its windows; the driver learns the places only
    numbered = windows.select("window", "item", F.pmod(F.xxhash64("window", "item"), F.lit(n_blocks)).cast("int").alias("number"))
    written = numbered.repartition(n_blocks, "number").sortWithinPartitions("number").mapInArrow(write, "number int, place string")
    return [row["place"] for row in written.orderBy("number").collect()]


def _loaded(place: str) -> PatternBlock:
    with open_input(place) as source:
        return PatternBlock(rows_of(pa.ipc.open_stream(source)))


def with_hits(docs: DataFrame, blocks: list[str], out: str, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` (all by default) and a struct ``out`` of each document's hits."""
    prepare(docs.sparkSession)
    carry = docs.columns if carry is None else carry
    kept = docs.select(*carry)
    names = [*kept.columns, out]

    def searched(chunk: pa.RecordBatch, only: PatternBlock | None) -> pa.RecordBatch:
        words = [words_of(text) for text in chunk.column(0).to_pylist()]
        spans, items = [[] for _ in words], [set() for _ in words]
        for place in blocks:
            block = only or _loaded(place)
            for i, doc in enumerate(words):
                block.find(doc, spans[i], items[i])
        rows = []
        for doc, found, known in zip(words, map(merged, spans), items, strict=True):
            rows.append(
                {
                    "n_words": len(doc),
                    "n_hit": sum(last - first + 1 for first, last in found),
                    "items": sorted(known),
                    "spans": [{"first": first, "last": last} for first, last in found],
                }
            )
        return pa.RecordBatch.from_arrays([*chunk.columns[1:], pa.array(rows, _RESULT)], names=names)

    def search(batches):
        only = _loaded(blocks[0]) if len(blocks) == 1 else None
        for chunk in _chunks(batches):
            yield searched(chunk, only)
        del only
        give_back()

    text = fresh(kept, "searched")
    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema), f"`{out}` {RESULT_DDL}"])
    return docs.select(F.col(text_col).cast("binary").alias(text), *carry).mapInArrow(search, schema)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a chunk's texts stay near a bounded size."""
    for batch in batches:
        start, size = 0, 0
        lengths = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_pylist()
        for i, n in enumerate(lengths):
            size += n
            if size >= CHUNK_BYTES:
                yield batch.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def items_digest(items: Column) -> Column:
    """Digest of item ids: in string order, comma-joined."""
    return F.sha2(F.array_join(items, ","), 256)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: words, hit words, items found, their digest, spans of hit words."""
    hits = with_hits(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), pattern_blocks(items), "hits", carry=["doc_id"])
    return hits.select(
        "doc_id",
        "hits.n_words",
        "hits.n_hit",
        F.size("hits.items").cast("long").alias("n_items"),
        items_digest(F.col("hits.items")).alias("items_sha256"),
        (F.col("hits.n_hit") > 0).alias("contaminated"),
        F.col("hits.spans").alias("spans"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents in which no window of an item occurs, with their columns."""
    out = fresh(docs, "hits")
    return with_hits(docs, pattern_blocks(items), out, text_col).filter(F.col(f"{out}.n_hit") == 0).drop(out)

