"""Language identification by bit-sliced Bloom filters of byte n-grams.

Training counts n-grams per language over all labelled text. A language contains an
n-gram if it has it ``LEAST_COUNT`` times or more, at a rate of at least ``RATE_SHARE``
of the highest in any language (below that it is a borrowed word or a slip); all such
n-grams are entered, however many. A slot of the filter is a mask with one bit per
language, so the masks of an n-gram's slots, ANDed, are all languages that contain it.
The filter has slots in proportion to the n-grams of the largest language. Spark
combines masks by slot, tasks write the slots in segments, and workers read those. For a text, each language's set
bits are counted over all n-grams and corrected for the filter's false positives,
whose rate is the language's share of set slots to the power of the hashes; the
language with the most wins.

More than 64 languages take further planes of masks. Texts are read with A-Z in
lower case and one space before and after.

Nulls and ties: a null text, or one without letters, is ``und`` with score 0, and so
is everything if nothing was learned. Equal counts go to the language with more
training n-grams, then to the name that comes first. Rows without language teach
nothing; repeated rows count as often as they occur.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import batches_of, make_folder, open_input, open_output, prepare
from larder.llm.words import text_bytes
from larder.session import materialise, scratch_path

GRAM = 4
#: Filter slots per n-gram of the largest language, hashes, and slots of a segment.
SLOTS_PER_GRAM = 16
HASHES = 3
SEGMENT_SLOTS = 1 << 17
RATE_SHARE = 0.3
LEAST_COUNT = 3
UNKNOWN = "und"
_SLICE = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _padded(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case texts with a space before and after each."""
    n = len(bounds) - 1
    out = np.full(len(data) + 2 * n, 32, np.uint8)
    inside = np.ones(len(out), bool)
    begin = bounds[:-1] + 2 * np.arange(n)
    inside[begin] = False
    inside[begin + np.diff(bounds) + 1] = False
    out[inside] = _LOWER[data]
    return out, bounds + 2 * np.arange(n + 1)


def grams_of(data: np.ndarray, bounds: np.ndarray, head: bool = True, tail: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of texts in a row, and the bounds of each text's; ``head`` or ``tail`` is off where a slice isn't the text's end."""
    text, ends = _padded(data, bounds)
    if not head:
        text, ends = text[1:], np.maximum(ends - 1, 0)
    if not tail:
        text, ends = text[:-1], np.minimum(ends, ends[-1] - 1)
    if len(text) < GRAM:
        return np.empty(0, np.uint64), np.zeros(len(bounds), np.int64)
    key = np.zeros(len(text) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        key |= text[k : len(text) - GRAM + 1 + k].astype(np.uint64) << np.uint64(8 * k)
    counts = np.maximum(np.diff(ends) - GRAM + 1, 0)
    place = np.arange(len(text)) - np.repeat(ends[:-1], np.diff(ends))
    return key[(place < np.repeat(counts, np.diff(ends)))[: len(key)]], np.concatenate([[0], np.cumsum(counts)])


def _parts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """n-grams of texts in parts of bounded size: (first text, end, n-grams, bounds); a long text comes in overlapping slices."""
    data, bounds = text_bytes(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + _SLICE, side="right")) - 1)
        a, b = int(bounds[first]), int(bounds[last])
        if last == first + 1 and b - a > _SLICE:
            for at in range(a, b, _SLICE):
                part = data[max(a, at - GRAM + 1) : min(b, at + _SLICE)]
                yield first, last, *grams_of(part, np.array([0, len(part)]), head=at == a, tail=at + _SLICE >= b)
        else:
            yield first, last, *grams_of(data[a:b], bounds[first : last + 1] - a)
        first = last


def _count(batches: Iterator[pa.RecordBatch], numbers: dict[str, int]) -> Iterator[tuple[int, int, int]]:
    held: list[np.ndarray] = []
    size = 0

    def summed():
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        yield from zip((keys >> np.uint64(32)).tolist(), (keys & np.uint64(0xFFFFFFFF)).tolist(), n.tolist(), strict=True)

    for batch in batches:
        language = np.array([numbers[x] for x in batch.column(1).to_pylist()], np.uint64)
        for first, last, keys, ends in _parts(batch.column(0)):
            held.append(keys | np.repeat(language[first:last], np.diff(ends)) << np.uint64(32))
            size += len(keys)
            if size > 2 << 20:
                yield from summed()
                held, size = [], 0
    if held:
        yield from summed()


def _slots(grams: np.ndarray, slots: int) -> Iterator[np.ndarray]:
    with np.errstate(over="ignore"):
        spread = (grams + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        spread ^= spread >> np.uint64(29)
        spread *= np.uint64(0xBF58476D1CE4E5B9)
    for k in range(HASHES):
        yield ((spread >> np.uint64(21 * k)) & np.uint64(slots - 1)).astype(np.int64)


def slots_for(grams: int) -> int:
    return 1 << min(21, max(10, int(SLOTS_PER_GRAM * grams).bit_length()))


class LanguageFilter:
    """Slots of language masks, in planes of 64 languages, and the share of slots that each language has set."""

    def __init__(self, languages: list[str], masks: np.ndarray, filled: np.ndarray):
        self.languages, self.masks = languages, masks
        self.planes = len(masks)
        self.false_rate = (np.asarray(filled) / masks.shape[1]) ** HASHES

    @classmethod
    def of(cls, languages: list[str], grams: np.ndarray, owners: np.ndarray) -> LanguageFilter:
        """From n-grams and the number of the language of each."""
        slots = slots_for(int(np.bincount(owners, minlength=1).max()))
        masks = np.zeros((-(-len(languages) // 64), slots), np.uint64)
        for plane, slot, mask in _slot_masks(grams, owners, slots):
            np.bitwise_or.at(masks[plane], slot, mask)
        return cls(languages, masks, _set_slots(masks, len(languages)))

    def containing(self, grams: np.ndarray, plane: int = 0) -> np.ndarray:
        """Mask of the plane's languages that contain each n-gram."""
        found = np.full(len(grams), ~np.uint64(0))
        for slot in _slots(grams, self.masks.shape[1]):
            found &= self.masks[plane, slot]
        return found

    def counts(self, grams: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Set bits per text and language."""
        out = np.zeros((len(ends) - 1, len(self.languages)), np.int64)
        for plane in range(self.planes):
            found = self.containing(grams, plane)
            for bit in range(min(64, len(self.languages) - 64 * plane)):
                sums = np.concatenate([[0], np.cumsum((found >> np.uint64(bit) & np.uint64(1)).astype(np.int32))])
                out[:, 64 * plane + bit] = sums[ends[1:]] - sums[ends[:-1]]
        return out

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        texts = len(column)
        hits, n = np.zeros((texts, len(self.languages)), np.int64), np.zeros(texts, np.int64)
        for first, last, grams, ends in _parts(column):
            hits[first:last] += self.counts(grams, ends)
            n[first:last] += np.diff(ends)
        corrected = np.maximum(0.0, (hits - n[:, None] * self.false_rate) / (1 - self.false_rate))
        best = corrected.argmax(axis=1)
        score = np.clip(corrected[np.arange(texts), best] / np.maximum(n, 1), 0.0, 1.0)
        return [self.languages[i] for i in best], score


def _slot_masks(grams: np.ndarray, owners: np.ndarray, slots: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(plane, slots, masks) of n-grams and their languages."""
    for plane in np.unique(owners // 64).tolist():
        mine = owners // 64 == plane
        mask = np.uint64(1) << (owners[mine] % 64).astype(np.uint64)
        for slot in _slots(grams[mine], slots):
            yield plane, slot, mask


def _set_slots(masks: np.ndarray, languages: int) -> np.ndarray:
    """Set slots per language."""
    return np.array([np.count_nonzero(masks[i // 64] >> np.uint64(i % 64) & np.uint64(1)) for i in range(languages)])


@dataclass
class StoredFilter:
    """A filter whose slots lie in segment files; tasks read them, the driver never does."""

    languages: list[str]
    slots: int
    filled: list[int]
    places: dict[tuple[int, int], str]

    def load(self) -> LanguageFilter:
        masks = np.zeros((-(-len(self.languages) // 64), self.slots), np.uint64)
        for (plane, segment), place in self.places.items():
            with open_input(place) as source:
                found = np.frombuffer(source.read(), "<u8")
            masks[plane, segment * SEGMENT_SLOTS : segment * SEGMENT_SLOTS + len(found)] = found
        return LanguageFilter(self.languages, masks, np.array(self.filled))


def _stored(entries: DataFrame, languages: list[str], slots: int) -> StoredFilter:
    """The filter of rows (place of the language, gram)."""
    folder = make_folder(scratch_path(entries.sparkSession, "language-slots"))
    size = min(slots, SEGMENT_SLOTS)

    def spread(batches):
        for batch in batches:
            grams, owners = batch.column(1).to_numpy().astype(np.uint64), batch.column(0).to_numpy()
            for plane, slot, mask in _slot_masks(grams, owners, slots):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), plane)), pa.array(slot), pa.array(mask.view(np.int64))], names=["plane", "slot", "mask"])

    def write(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            plane, slot, mask = (batch.column(c).to_numpy() for c in range(3))
            for key in set(zip(plane.tolist(), (slot // size).tolist(), strict=True)):
                mine = (plane == key[0]) & (slot // size == key[1])
                held.setdefault(key, np.zeros(size, np.uint64))[slot[mine] % size] = mask[mine].view(np.uint64)
        for (plane, segment), masks in held.items():
            place = f"{folder}/{plane}-{segment}-{uuid.uuid4().hex}"
            with open_output(place) as sink:
                sink.write(masks.tobytes())
            here = min(64, len(languages) - 64 * plane)
            counts = _set_slots(masks[None], here).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([plane]), pa.array([segment]), pa.array([place]), pa.array([counts], pa.list_(pa.int64()))], names=["plane", "segment", "place", "filled"]
            )

    masks = entries.select("place", "gram").mapInArrow(spread, "plane long, slot long, mask long").groupBy("plane", "slot").agg(F.bit_or("mask").alias("mask"))
    segment = F.floor(F.col("slot") / size)
    written = masks.repartition("plane", segment).mapInArrow(write, "plane long, segment long, place string, filled array<long>").collect()
    filled = [0] * len(languages)
    for row in written:
        for i, n in enumerate(row["filled"]):
            filled[64 * row["plane"] + i] += n
    return StoredFilter(languages, slots, filled, {(row["plane"], row["segment"]): row["place"] for row in written})


def train(rows: DataFrame) -> StoredFilter | None:
    """A filter from rows (text binary, lang); None without any."""
    prepare(rows.sparkSession)
    rows = rows.filter("lang IS NOT NULL AND text IS NOT NULL")
    known = sorted(r["lang"] for r in rows.select("lang").distinct().collect())  # one row per language
    if not known:
        return None
    numbers = {name: i for i, name in enumerate(known)}
    schema = pa.schema([("language", pa.int64()), ("gram", pa.int64()), ("c", pa.int64())])

    def count(batches):
        yield from batches_of(_count(batches, numbers), schema, rows_per_batch=1 << 16)

    counted = materialise(
        rows.select("text", "lang").mapInArrow(count, "language long, gram long, c long").groupBy("language", "gram").agg(F.sum("c").alias("c")),
        "language-grams",
    )
    totals = {r["language"]: r["n"] for r in counted.groupBy("language").agg(F.sum("c").alias("n")).collect()}
    order = sorted(totals, key=lambda i: (-totals[i], known[i]))  # ties go to the first
    total = F.create_map(*[F.lit(x) for i in totals for x in (i, float(totals[i]))])
    place = F.create_map(*[F.lit(x) for at, i in enumerate(order) for x in (i, at)])
    rates = counted.filter(F.col("c") >= LEAST_COUNT).withColumn("rate", F.col("c") / total[F.col("language")])
    highest = rates.groupBy("gram").agg(F.max("rate").alias("highest"))
    entries = materialise(
        rates.join(highest, "gram").filter(F.col("rate") >= RATE_SHARE * F.col("highest")).select(place[F.col("language")].cast("long").alias("place"), "gram"),
        "language-entries",
    )
    most = entries.groupBy("place").count().agg(F.max("count")).first()[0] or 0
    return _stored(entries, [known[i] for i in order], slots_for(most))


def identify(docs: DataFrame, model: StoredFilter | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, lang_pred, score."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def predict(batches):
        loaded = model.load()
        for batch in batches:
            text = batch.column(1)
            names, score = loaded.predict(text.cast(pa.binary()))
            letters = pc.fill_null(pc.match_substring_regex(text, r"\pL"), False).to_numpy(zero_copy_only=False)
            predicted = [name if ok else UNKNOWN for name, ok in zip(names, letters, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(predicted, pa.string()), pa.array(np.where(letters, score, 0.0))], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(predict, "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame) -> DataFrame:
    """Train on documents that aren't held out, predict all: doc_id, held_out, lang_pred, score."""
    taught = docs.filter(~held_out()).select(F.col("text").cast("binary").alias("text"), "lang")
    found = identify(docs, train(taught))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
