r"""Phrase collocations by dynamic itemset counting.

A phrase is a run of words inside a piece of text; pieces end at ``.,;:!?`` and line
ends, words at blanks and tabs. Texts are dealt to shards, which are scanned in a cycle.
Single words are counted from the first shard on. A longer phrase starts to be counted
with the next shard once both phrases that it consists of but for its last or its first
word have reached the threshold, and is counted for one full cycle, whichever shard it
began with. So lengths interleave: while late words are still counted in the last
shards, phrases of frequent words are nearly done.

Phrases are 64-bit hashes of language and words while they are counted; each step's
counts, summed in tasks first, are merged with those before by one aggregation, and
the table they replace is deleted. A phrase whose cycle must be over and that stayed
below the threshold is left out of the merged table. Which phrases have reached the threshold is a bit
set per length, in segments that tasks write and other tasks read, of a size fixed for
the corpus. Bits are only ever set. A phrase is counted in step t if its two parts are
set before t and were not both set before t - shards; that is exactly one cycle, also
for a phrase let in early by another one's bit, whose count is then exact as well. A
phrase that lacks a frequent part can't be frequent, so false bits add work only.

A last scan gives the frequent hashes of two and more words their words, shard by shard:
a phrase is read off in the first shard that has it. Hashes of their parts follow from
the words. Scores are exact: products are
decimals of 38 digits (enough for counts up to 10^15), and quotients are floored after
the remainder is taken off.

Nulls and ties: a null language is ``und``, a null text is empty. Repeated rows count
each time. Equal scores are ordered by count, then by the phrase's bytes. An empty
table gives no rows. Other columns are ignored. Phrases are told apart by their hashes.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm.common import filesystem, make_folder, mix64, open_input, open_output, prepare
from larder.llm.words import Words, text_bytes, words_of
from larder.session import materialise, scratch_path, small_table

LONGEST, LEAST, SHARDS, TOP = 3, 10, 4, 2000
#: A phrase goes if a longer one has this share of its occurrences, in percent.
INSIDE_PERCENT = 50
#: Bytes of text per bit of a set, and least and most bits of a set as powers of two.
BYTES_PER_BIT, LEAST_BITS, MOST_BITS = 32, 20, 30
#: Hashes that a task holds before it sums them, and bytes of text that it takes at once.
HELD, SLICE = 1 << 21, 4 << 20

_CUT = np.zeros(256, bool)
_CUT[list(b".,;:!?\n\x0b\x0c\r")] = True
_SEPARATOR = _CUT.copy()
_SEPARATOR[list(b" \t")] = True


def _segment_bits(bits: int) -> int:
    """Bits of a segment, as a power of two: 64 segments, fewer where they would be tiny."""
    return min(bits, max(14, bits - 6))


def _language(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _languages(langs: list[str]) -> np.ndarray:
    known = {lang: _language(lang) for lang in set(langs)}
    return np.array([known[lang] for lang in langs], np.uint64)


class Phrases:
    """The phrases of some texts by length: ``keys[n - 1][i]`` is that of the ``n`` words from word ``i``, where ``inside[n - 1][i]``."""

    def __init__(self, texts: pa.Array, langs: np.ndarray, longest: int):
        self.words: Words = words_of(texts, lower=True, separators=_SEPARATOR)
        counts, starts = self.words.counts, self.words.starts
        of_text = np.repeat(np.arange(len(counts)), counts)
        piece = np.searchsorted(np.flatnonzero(_CUT[self.words.data]), starts)
        joined = (piece[1:] == piece[:-1]) & (of_text[1:] == of_text[:-1])
        with np.errstate(over="ignore"):
            own = mix64(self.words.hashes ^ langs[of_text])
            self.keys, self.inside = [own], [np.ones(len(own), bool)]
            for n in range(2, longest + 1):
                self.keys.append(mix64(self.keys[-1][:-1] * np.uint64(3) + own[n - 1 :]))
                self.inside.append(self.inside[-1][:-1] & joined[n - 2 :])

    def text(self, first: int, n: int) -> bytes:
        found = self.words.data[self.words.starts[first] : self.words.ends[first + n - 1]].tobytes()
        return b" ".join(found.lower().split())


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    """Texts (column 0) and languages (column 1) in parts of bounded size; a longer text is cut between pieces."""
    data, bounds = text_bytes(batch.column(0))
    langs = batch.column(1).to_pylist()
    first = 0
    while first < len(langs):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + SLICE, side="right")) - 1)
        size = int(bounds[last] - bounds[first])
        if size <= 2 * SLICE:
            yield batch.column(0).slice(first, last - first), langs[first:last]
        else:
            text = data[bounds[first] : bounds[last]]
            at = 0
            while at < size:
                end = min(size, at + SLICE)
                while end < size and not len(cuts := np.flatnonzero(_CUT[text[end : end + SLICE]])):
                    end = min(size, end + SLICE)
                if end < size:
                    end += int(cuts[0])
                yield pa.array([text[at:end].tobytes()], pa.binary()), langs[first:last]
                at = end
        first = last


class KeySet:
    """Keys of one length that reached the threshold, as bits in segments; a missing segment has none."""

    def __init__(self, places: list[str], bits: int):
        self.shift, size = np.uint64(64 - bits), 1 << _segment_bits(bits)
        self.any = any(places)
        if self.any:
            self.bytes = np.concatenate([_segment(place, size) for place in places])

    def has(self, keys: np.ndarray) -> np.ndarray:
        if not self.any:
            return np.zeros(len(keys), bool)
        at = keys >> self.shift
        return (self.bytes[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def _segment(place: str, bits: int) -> np.ndarray:
    if not place:
        return np.zeros(bits >> 3, np.uint8)
    with open_input(place) as source:
        return np.frombuffer(source.read(), np.uint8)


#: Places of the segments by length.
Places = dict[int, list[str]]


def no_places(longest: int, bits: int) -> Places:
    return {n: [""] * (1 << (bits - _segment_bits(bits))) for n in range(1, longest + 1)}


def with_bits(reached: DataFrame, before: Places, bits: int, folder: str) -> Places:
    """Segments with the bits of rows (size, key) set too; tasks write them, by segment."""
    inner = _segment_bits(bits)

    def write(batches):
        held, current = None, None

        def place() -> pa.RecordBatch:
            uri = f"{folder}/{current[0]}-{current[1]}-{uuid.uuid4().hex}"
            with open_output(uri) as sink:
                sink.write(held.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([current[0]], pa.int32()), pa.array([current[1]], pa.int32()), pa.array([uri])], names=["size", "segment", "place"])

        for batch in batches:
            size, segment, at = (batch.column(c).to_numpy() for c in range(3))
            edges = np.flatnonzero((np.diff(size) != 0) | (np.diff(segment) != 0)) + 1
            for first, last in zip([0, *edges.tolist()], [*edges.tolist(), len(at)], strict=True):
                if first == last:
                    continue
                if current != (int(size[first]), int(segment[first])):
                    if current is not None:
                        yield place()
                    current = int(size[first]), int(segment[first])
                    held = _segment(before[current[0]][current[1]], 1 << inner).copy()
                bit = at[first:last]
                np.bitwise_or.at(held, bit >> 3, (1 << (bit & 7)).astype(np.uint8))
        if current is not None:
            yield place()

    index = F.shiftrightunsigned("key", 64 - bits)
    written = (
        reached.select("size", F.shiftright(index, inner).cast("int").alias("segment"), index.bitwiseAND((1 << inner) - 1).alias("bit"))
        .repartition("size", "segment")
        .sortWithinPartitions("size", "segment")
        .mapInArrow(write, "size int, segment int, place string")
    )
    after = {n: list(places) for n, places in before.items()}
    for row in written.collect():
        after[row["size"]][row["segment"]] = row["place"]
    return after


def _active(found: Phrases, n: int, now: list[KeySet], then: list[KeySet] | None) -> np.ndarray:
    """Which runs of ``n`` words are in their cycle."""
    parts = found.keys[n - 2]
    first, second = parts[:-1], parts[1:]
    at = np.flatnonzero(found.inside[n - 1])
    at = at[now[n - 2].has(first[at])]
    at = at[now[n - 2].has(second[at])]
    if then is not None and len(at):
        at = at[~(then[n - 2].has(first[at]) & then[n - 2].has(second[at]))]
    return at


def _counted(batches: Iterator[pa.RecordBatch], now: Places, then: Places | None, longest: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Counts (size, key, c) of the phrases in their cycle; size 0 is a language with its number of words."""
    sets = [KeySet(now[n], bits) for n in range(1, longest)]
    before = [KeySet(then[n], bits) for n in range(1, longest)] if then else None
    held: list[list[np.ndarray]] = [[] for _ in range(longest + 1)]
    words: dict[int, int] = {}
    size = 0

    def summed():
        for n in range(1, longest + 1):
            if held[n]:
                yield from _count_rows(n, *np.unique(np.concatenate(held[n]), return_counts=True))
                held[n].clear()

    for batch in batches:
        for texts, langs in _slices(batch):
            codes = _languages(langs)
            found = Phrases(texts, codes, longest)
            if before is None:
                held[1].append(found.keys[0])
                for code, n in zip(codes.tolist(), found.words.counts.tolist(), strict=True):
                    words[code] = words.get(code, 0) + n
            for n in range(2, longest + 1):
                held[n].append(found.keys[n - 1][_active(found, n, sets, before)])
            size += sum(len(h[-1]) for h in held if h)
            if size > HELD:
                yield from summed()
                size = 0
    yield from summed()
    yield from _count_rows(0, np.array([*words], np.uint64), np.array([*words.values()], np.int64))


def _count_rows(n: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(keys), 1 << 17):
        part = keys[at : at + (1 << 17)].view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(part), n, np.int32)), pa.array(part), pa.array(counts[at : at + (1 << 17)].astype(np.int64))], names=["size", "key", "c"]
        )


def _named(batches: Iterator[pa.RecordBatch], wanted: Places, longest: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Language and words (size, key, lang, phrase) of the wanted keys of two and more words, few times each."""
    sets = {n: KeySet(wanted[n], bits) for n in range(2, longest + 1)}
    seen = {n: np.empty(0, np.uint64) for n in sets}

    def unseen(n: int, keys: np.ndarray) -> np.ndarray:
        """Places of the first of each new key."""
        new, first = np.unique(keys, return_index=True)
        known = seen[n]
        if len(known):
            at = np.minimum(np.searchsorted(known, new), len(known) - 1)
            new, first = new[known[at] != new], first[known[at] != new]
        seen[n] = np.union1d(known if len(known) < HELD else known[:0], new)
        return first

    for batch in batches:
        for texts, langs in _slices(batch):
            found = Phrases(texts, _languages(langs), longest)
            ends = np.cumsum(found.words.counts)
            for n in sets:
                at = np.flatnonzero(found.inside[n - 1])
                at = at[sets[n].has(found.keys[n - 1][at])]
                at = at[unseen(n, found.keys[n - 1][at])]
                text = np.searchsorted(ends, at, side="right")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(at), n, np.int32)),
                        pa.array(found.keys[n - 1][at].view(np.int64)),
                        pa.array([langs[i] for i in text], pa.string()),
                        pa.array([found.text(i, n).decode() for i in at.tolist()], pa.string()),
                    ],
                    names=["size", "key", "lang", "phrase"],
                )


def _part_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, phrase, ...) with the keys of the language and the phrase."""
    for batch in batches:
        codes = _languages(batch.column(0).to_pylist())
        longest = max((p.count(" ") + 1 for p in batch.column(1).to_pylist()), default=1)
        found = Phrases(batch.column(1), codes, longest)
        first = np.cumsum(found.words.counts) - found.words.counts
        keys = np.array([found.keys[n - 1][i] for i, n in zip(first.tolist(), found.words.counts.tolist(), strict=True)], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(codes.view(np.int64)), pa.array(keys.view(np.int64))], names=[*batch.schema.names, "lang_key", "key"]
        )


def _remove(uri: str) -> None:
    store, path = filesystem(uri)
    store.delete_dir(path)


class Shards:
    """The texts, dealt out and stored; one shard is read at a time."""

    def __init__(self, docs: DataFrame, lang_col: str, text_col: str, shards: int):
        self.spark: SparkSession = docs.sparkSession
        self.number = shards
        self.folder = scratch_path(self.spark, "phrase-shards")
        rows = docs.select(
            F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"),
            F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
            (F.monotonically_increasing_id() % shards).cast("int").alias("shard"),
        )
        rows.write.partitionBy("shard").option("compression", "zstd").parquet(self.folder)

    def read(self, number: int | None = None) -> DataFrame:
        rows = self.spark.read.schema("text binary, lang string, shard int").parquet(self.folder)
        return (rows if number is None else rows.filter(F.col("shard") == number)).select("text", "lang")


def count_phrases(shards: Shards, longest: int, least: int, bits: int) -> tuple[DataFrame, int]:
    """Counts (size, key, c) of all frequent phrases, and the number of steps; others may be there too."""
    spark = shards.spark
    folder = make_folder(scratch_path(spark, "phrase-bits"))
    places, counts, where, t = [no_places(longest, bits)], None, None, 0
    known: dict[int, int] = {}
    while t < shards.number or places[t] != places[t - shards.number]:
        now, then = places[t], places[t - shards.number] if t >= shards.number else None

        def scan(batches, now=now, then=then):
            return _counted(batches, now, then, longest, bits)

        step = shards.read(t % shards.number).mapInArrow(scan, "size int, key long, c long").withColumn("since", F.lit(t))
        merged = (step if counts is None else step.unionByName(counts)).groupBy("size", "key")
        merged = merged.agg(F.sum("c").alias("c"), F.min("since").alias("since"))
        # seen for as many steps as there are shards: the cycle is over
        merged = merged.filter((F.col("size") == 0) | (F.col("c") >= least) | (F.col("since") > t - shards.number + 1))
        before, where = where, scratch_path(spark, "phrase-counts")
        merged.write.parquet(where)
        counts = spark.read.schema("size int, key long, c long, since int").parquet(where)
        if before:
            _remove(before)
        reached = counts.filter((F.col("c") >= least) & F.col("size").between(1, longest - 1)).select("size", "key")
        here = {r["size"]: r["count"] for r in reached.groupBy("size").count().collect()}
        places.append(with_bits(reached, now, bits, folder) if here != known else now)
        known, t = here, t + 1
    return counts, t


def floor_quotient(a: Column, l: Column, r: Column) -> Column:
    """floor(1000000 * a * a / (l * r)) without rounding."""
    wide = [c.cast("decimal(19,0)") for c in (a, l, r)]
    top, bottom = F.lit(1_000_000).cast("decimal(7,0)") * wide[0] * wide[0], wide[1] * wide[2]
    return ((top - top % bottom) / bottom).cast("long")


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    longest: int = LONGEST,
    least: int = LEAST,
    top: int = TOP,
    shards: int = SHARDS,
    bits: int | None = None,
) -> DataFrame:
    """The ``top`` phrases of each language by score: lang, rank, phrase, a, l, r, n, score."""
    spark = prepare(docs.sparkSession)
    if bits is None:
        size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
        bits = min(MOST_BITS, max(LEAST_BITS, (size // BYTES_PER_BIT).bit_length()))
    dealt = Shards(docs, lang_col, text_col, shards)
    counts, _ = count_phrases(dealt, longest, least, bits)
    frequent = materialise(counts.filter((F.col("c") >= least) | (F.col("size") == 0)).select("size", "key", "c"), "phrase-frequent")
    return _ranked(named_phrases(dealt, frequent.filter("size >= 2"), longest, bits), frequent, top)


def named_phrases(dealt: Shards, frequent: DataFrame, longest: int, bits: int) -> DataFrame:
    """Frequent phrases (size, key, c) with language and words; stored."""
    folder = make_folder(scratch_path(dealt.spark, "phrase-wanted"))
    left, parts = frequent, []
    for number in range(dealt.number):
        wanted = with_bits(left.select("size", "key"), no_places(longest, bits), bits, folder)

        def name(batches, wanted=wanted):
            return _named(batches, wanted, longest, bits)

        names = dealt.read(number).mapInArrow(name, "size int, key long, lang string, phrase string")
        names = names.groupBy("size", "key").agg(F.first("lang").alias("lang"), F.first("phrase").alias("phrase"))
        parts.append(materialise(left.join(names, ["size", "key"]), "phrases"))
        left = materialise(left.join(parts[-1], ["size", "key"], "left_anti"), "phrases-left")
    return functools.reduce(DataFrame.unionByName, parts)


def _ranked(candidates: DataFrame, frequent: DataFrame, top: int) -> DataFrame:
    """Scores, removals and ranks of phrases (size, lang, phrase, c), with the counts (size, key, c) of all."""
    candidates = candidates.select("lang", "phrase", "size", F.col("c").alias("a"), F.split("phrase", " ").alias("words"))

    def run(first: str, length: str) -> Column:
        return F.expr(f"array_join(slice(words, {first}, {length}), ' ')")

    cuts = candidates.select("lang", "phrase", "size", "a", "words", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    halves = F.array(
        F.struct(F.lit("l").alias("side"), run("1", "k").alias("part"), F.col("k").alias("size")),
        F.struct(F.lit("r").alias("side"), run("k + 1", "size - k").alias("part"), (F.col("size") - F.col("k")).alias("size")),
    )
    parts = cuts.select("lang", "phrase", "a", "k", F.explode(halves).alias("half"))
    parts = parts.select("lang", "half.part", "half.side", "half.size", "phrase", "a", "k").mapInArrow(
        _part_keys, "lang string, part string, side string, size int, phrase string, a long, k int, lang_key long, key long"
    )
    both = parts.join(frequent, ["size", "key"]).groupBy("lang", "lang_key", "phrase", "a", "k")
    scored = both.agg(*[F.max(F.when(F.col("side") == side, F.col("c"))).alias(side) for side in ("l", "r")])
    scored = scored.withColumn("score", floor_quotient(F.col("a"), F.col("l"), F.col("r")))
    lowest = scored.groupBy("lang", "lang_key", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = candidates.filter("size >= 3").select("lang", "a", "words", "size", F.explode(F.expr("sequence(2, size - 1)")).alias("length"))
    inner = inner.select("lang", "a", "words", "length", F.explode(F.expr("sequence(1, size - length + 1)")).alias("first"))
    longer = inner.groupBy("lang", run("first", "length").alias("phrase")).agg(F.max("a").alias("longer"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < INSIDE_PERCENT * F.col("a"), F.lit(True)))

    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    totals = small_table(frequent.filter("size = 0").select(F.col("key").alias("lang_key"), F.col("c").alias("n")))
    return ranked.join(totals, "lang_key").select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
