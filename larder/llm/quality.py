"""Quality by the perplexity of an interpolated modified Kneser-Ney model.

The model is over bytes, of order ``ORDER``, and is trained on all trusted text:
documents labelled good and not toxic, but for a fifth that is held out. An n-gram
is its bytes in a long, so its history is a shift and its suffix a mask; counts,
continuation counts, discounts, back-off weights and probabilities come from
grouped counts and joins that Spark hash-partitions by those longs.

Scoring looks every byte position up in the stored model, whose shards are files of
bounded size that the tasks of a shuffle by n-gram write: a worker holds a few at a
time and finds an n-gram's shard from its key. Positions that their shard doesn't have
as a full n-gram back off through ever shorter histories.

A short text says little, so a text's excess is its log perplexity less the median of
its language, as if ``PRIOR_BYTES`` bytes of median perplexity were added to it. A
document is rejected if its excess is above the ``LEVEL`` quantile of its language's
held-out trusted documents: that share of them stays, whatever their spread. Medians
and quantiles are exact, the quantile linearly interpolated. A language with fewer than
``LEAST`` held-out documents uses the median and the quantile of all of them. ``LEVEL``
is set to keep 99.5 % of held-out trusted documents, and ``PRIOR_BYTES`` is the one of
five lengths up to 1,024 at which fewest bad and toxic documents in all pass; README has
figures.

Nulls and ties: a null or empty text has no perplexity and is rejected; a null
language is a language of its own. A document whose labels disagree is not trusted.
Repeated rows are scored alike. With no trusted text every document with text is
accepted and its perplexity is that of the uniform model. Other columns are carried
by ``accepted_documents``.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import batches_of, fresh, give_back, make_folder, open_input, open_output, prepare
from larder.llm.words import HashIndex, text_bytes
from larder.operators.ranks import quantiles
from larder.session import materialise, scratch_path

ORDER = 5
#: n-grams of a model shard (32 to 64 bytes each in memory), and shards that a worker holds.
SHARD_GRAMS, SHARDS_HELD = 500_000, 4
LEVEL, LEAST = 0.995, 20
PRIOR_BYTES = 1024
HELD_OUT_OF = 5
#: Trusted documents whose ids are broadcast, 8 bytes each, so that no text is shuffled; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
_SLICE = 1 << 19


def _grams(data: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams ending at each byte, and where they lie inside one text.

    A key is the length in the top byte, then the bytes.
    """
    key = np.zeros(len(data), np.int64)
    for back in range(min(n, len(data))):
        key[back:] |= data[: len(data) - back].astype(np.int64) << (8 * back)
    place = np.arange(len(data)) - np.repeat(bounds[:-1], np.diff(bounds))
    return key | (n << 56), place >= n - 1


def _counts(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[tuple[int, int]]:
    """Counts of full n-grams (and of the shorter ones that open a text) per so many bytes."""
    held: list[np.ndarray] = []
    size = 0

    def summed():
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        yield from zip(keys.tolist(), n.tolist(), strict=True)

    for batch in batches:
        data, bounds = text_bytes(batch.column(0))
        if not len(data):
            continue
        key, inside = _grams(data, bounds, order)
        held.append(key[inside])
        place = np.arange(len(data)) - np.repeat(bounds[:-1], np.diff(bounds))
        for n in range(1, order):
            held.append(_grams(data, bounds, n)[0][place == n - 1])
        size += len(data)
        if size > 2 << 20:
            yield from summed()
            held, size = [], 0
    if held:
        yield from summed()


def _history(key: str) -> F.Column:
    return F.shiftright(F.col(key).bitwiseAND((1 << 56) - 1), 8)


def train(trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """The model from a column ``text`` (binary): key, n, log_p of each n-gram, log_backoff of it as a history."""
    prepare(trusted.sparkSession)
    schema = pa.schema([("key", pa.int64()), ("c", pa.int64())])

    def count(batches):
        yield from batches_of(_counts(batches, order), schema, rows_per_batch=1 << 16)

    counted = materialise(
        trusted.select("text").mapInArrow(count, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")), "kneser-ney-counts"
    )
    mask = {n: (1 << (8 * n)) - 1 for n in range(order + 1)}
    levels = {order: counted.filter(F.shiftright("key", 56) == order).select("key", "c")}
    for n in range(order - 1, 0, -1):
        # an n-gram's continuation count: its distinct extensions to the left, and each text it opens
        left = levels[n + 1].select(F.col("key").bitwiseAND(mask[n]).bitwiseOR(F.lit(n << 56)).alias("key"), F.lit(1).cast("long").alias("c"))
        opening = counted.filter(F.shiftright("key", 56) == n).select("key", F.lit(1).cast("long").alias("c"))
        levels[n] = materialise(left.unionByName(opening).groupBy("key").agg(F.sum("c").alias("c")), "kneser-ney-level")
    model, lower = [], None
    for n in range(1, order + 1):
        level = levels[n]
        of = {r["c"]: r["k"] for r in level.filter("c <= 4").groupBy("c").agg(F.count("*").alias("k")).collect()}
        d1, d2, d3 = discounts(*(of.get(c, 0) for c in (1, 2, 3, 4)))
        discount = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        counts = level.withColumn("history", _history("key")).withColumn("discount", discount)
        histories = counts.groupBy("history").agg(F.sum("c").alias("total"), (F.sum("discount") / F.sum("c")).alias("backoff"))
        joined = counts.join(histories, "history").withColumn("own", (F.col("c") - F.col("discount")) / F.col("total"))
        if lower is None:
            p = joined.withColumn("p", F.col("own") + F.col("backoff") / 256)
        else:
            suffix = F.col("key").bitwiseAND(mask[n - 1]).bitwiseOR(F.lit((n - 1) << 56))
            p = joined.withColumn("suffix", suffix).join(lower.select(F.col("key").alias("suffix"), F.col("p").alias("lower_p")), "suffix", "left")
            p = p.withColumn("p", F.col("own") + F.col("backoff") * F.coalesce("lower_p", F.lit(1 / 256)))
        lower = materialise(p.select("key", "p"), "kneser-ney-p")
        model.append(lower.select("key", F.log("p").alias("log_p"), F.lit(None).cast("double").alias("log_backoff")))
        as_history = F.col("history").bitwiseOR(F.lit((n - 1) << 56))
        model.append(histories.select(as_history.alias("key"), F.lit(None).cast("double").alias("log_p"), F.log("backoff").alias("log_backoff")))
    everything = model[0]
    for part in model[1:]:
        everything = everything.unionByName(part)
    merged = everything.groupBy("key").agg(F.max("log_p").alias("log_p"), F.max("log_backoff").alias("log_backoff"))
    return materialise(merged, "kneser-ney")


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and more from counts of counts.

    Where small data leave a ratio undefined or out of range, one half, one and one and a half hold.
    """
    if not n1 or not n2:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(d if 0 < d < c else c / 2 for c, d in zip((1, 2, 3), found, strict=True))


def shards_of(model: DataFrame, shard_grams: int = SHARD_GRAMS) -> list[str]:
    """Write the model as shard files of bounded size, each by the task that holds it; their places by shard number."""
    spark = model.sparkSession
    folder = make_folder(scratch_path(spark, "kneser-ney-shards"))
    n = -(-model.count() // shard_grams) | 1  # odd, so that the last byte of a key alone doesn't decide
    number = F.pmod(F.col("key").bitwiseXOR(F.shiftright("key", 17)).bitwiseXOR(F.shiftright("key", 31)), F.lit(n)).cast("int")

    def write(batches):
        held: list[pa.RecordBatch] = []

        def place(shard: int) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            uri = f"{folder}/{shard}-{uuid.uuid4().hex}"
            columns = [rows[c].to_numpy(zero_copy_only=False) for c in ("key", "log_p", "log_backoff")]
            with open_output(uri) as sink:
                for array in _slots(columns[0].astype(np.uint64), columns[1:]):
                    sink.write(array.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([uri])], names=["number", "place"])

        current = None
        for batch in batches:
            numbers = batch.column(3).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for first, last in itertools.pairwise(cuts):
                if first == last:
                    continue
                if held and current != numbers[first]:
                    yield place(current)
                    held = []
                current = int(numbers[first])
                held.append(batch.slice(first, last - first).select(["key", "log_p", "log_backoff"]))
        if held:
            yield place(current)

    written = (
        model.select("key", "log_p", "log_backoff", number.alias("number"))
        .repartition(n, "number")
        .sortWithinPartitions("number")
        .mapInArrow(write, "number int, place string")
    )
    places = {row["number"]: row["place"] for row in written.collect()}
    return [places.get(shard, "") for shard in range(n)]


def _slots(keys: np.ndarray, weights: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Keys and weights in the slots of an open-addressing table, half of them free."""
    size = 1 << max(4, (2 * len(keys) - 1).bit_length())
    slots, numbers = np.zeros(size, np.uint64), np.zeros(size, np.int64)
    index = HashIndex(1)
    index.keys, index.numbers = slots, numbers
    index._place(_spread(keys), np.arange(1, len(keys) + 1))
    return slots, *(np.concatenate([[np.nan], w]).astype("<f4")[numbers] for w in weights)


class _Shard:
    """One shard of the model: n-gram to log probability and back-off weight."""

    def __init__(self, place: str):
        if not place:
            self.keys, self.log_p, self.log_backoff = np.zeros(1, np.uint64), *(np.full(1, np.nan, np.float32),) * 2
            return
        with open_input(place) as source:
            data = source.read_buffer()
        size = data.size // 16
        self.keys = np.frombuffer(data, "<u8", size)
        self.log_p = np.frombuffer(data, "<f4", size, 8 * size)
        self.log_backoff = np.frombuffer(data, "<f4", size, 12 * size)

    def values(self, keys: np.ndarray, backoff: bool) -> np.ndarray:
        """Weights of the keys, not a number where there is none."""
        weights, mask = self.log_backoff if backoff else self.log_p, np.uint64(len(self.keys) - 1)
        wanted = _spread(keys.astype(np.uint64))
        slot = wanted & mask
        found = self.keys[slot]
        out = np.where(found == wanted, weights[slot], np.float32(np.nan))
        left = np.flatnonzero((found != wanted) & (found != 0))
        while len(left):
            slot[left] = (slot[left] + np.uint64(1)) & mask
            found = self.keys[slot[left]]
            hit = found == wanted[left]
            out[left[hit]] = weights[slot[left[hit]]]
            left = left[~hit & (found != 0)]
        return out


def _spread(keys: np.ndarray) -> np.ndarray:
    """A bijection that spreads keys over the slots; no key becomes zero, which marks a free slot."""
    with np.errstate(over="ignore"):
        return (keys * np.uint64(0x9E3779B97F4A7C15)) ^ ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32))


class Scorer:
    """Log probability of texts under the model's shards; the last ``SHARDS_HELD`` that were used stay in memory."""

    def __init__(self, places: list[str], order: int = ORDER):
        self.places, self.order = places, order
        self.held: dict[int, _Shard] = {}

    def _shard(self, number: int) -> _Shard:
        shard = self.held.pop(number, None) or _Shard(self.places[number])
        self.held[number] = shard
        if len(self.held) > SHARDS_HELD:
            del self.held[next(iter(self.held))]
        return shard

    def _look_up(self, keys: np.ndarray, backoff: bool) -> np.ndarray:
        if len(self.places) == 1:
            return self._shard(0).values(keys, backoff)
        numbers = (keys ^ (keys >> 17) ^ (keys >> 31)) % len(self.places)
        out = np.full(len(keys), np.nan, np.float32)
        wanted = np.unique(numbers).tolist()
        for number in sorted(wanted, key=lambda n: n not in self.held):
            mine = np.flatnonzero(numbers == number)
            out[mine] = self._shard(number).values(keys[mine], backoff)
        return out

    def positions(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Log probability of each byte after its history inside its text."""
        out = np.zeros(len(data))
        left = np.arange(len(data))
        place = left - np.repeat(bounds[:-1], np.diff(bounds))
        for n in range(self.order, 0, -1):
            key, inside = _grams(data, bounds, n)
            at = left[inside[left]]
            value = self._look_up(key[at], backoff=False)
            known = ~np.isnan(value)
            out[at[known]] += value[known]
            missed = at[~known]
            histories = (key[missed] & ((1 << 56) - 1)) >> 8 | ((n - 1) << 56)
            weight = self._look_up(histories, backoff=True)
            out[missed] += np.where(np.isnan(weight), 0.0, weight)
            left = np.union1d(left[place[left] < n - 1], missed)
        out[left] += np.log(1 / 256)
        return out

    def texts(self, column: pa.Array) -> np.ndarray:
        """Sum of log probabilities per text; long texts go in slices that overlap by a history."""
        data, bounds = text_bytes(column)
        sums = np.zeros(len(column))
        first = 0
        while first < len(column):
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + _SLICE, side="right")) - 1)
            if last == first + 1 and bounds[last] - bounds[first] > _SLICE:
                for at in range(int(bounds[first]), int(bounds[last]), _SLICE):
                    begin = max(int(bounds[first]), at - self.order + 1)
                    part = data[begin : min(at + _SLICE, int(bounds[last]))]
                    sums[first] += self.positions(part, np.array([0, len(part)]))[at - begin :].sum()
            else:
                part = data[bounds[first] : bounds[last]]
                inner = bounds[first : last + 1] - bounds[first]
                total = np.concatenate([[0.0], np.cumsum(self.positions(part, inner))])
                sums[first:last] = total[inner[1:]] - total[inner[:-1]]
            first = last
        return sums


def with_log_perplexity(docs: DataFrame, places: list[str], out: str, text_col: str = "text", carry: list[str] | None = None, order: int = ORDER) -> DataFrame:
    """Columns ``carry`` (all by default) and ``out``: minus the mean log probability of a byte, null for empty texts."""
    carry = docs.columns if carry is None else carry
    kept = docs.select(*carry)
    names, text = [*kept.columns, out], fresh(kept, "scored")

    def score(batches):
        scorer = Scorer(places, order)
        try:
            for batch in batches:
                sizes = np.diff(text_bytes(batch.column(0))[1])
                mean = -scorer.texts(batch.column(0)) / np.maximum(sizes, 1)
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(mean, mask=sizes == 0)], names=names)
        finally:
            scorer.held.clear()
            give_back()

    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema), f"`{out}` double"])
    return docs.select(F.col(text_col).cast("binary").alias(text), *carry).mapInArrow(score, schema)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents whose labels all say good and none toxic, and whether each is held out of training."""
    return (
        labels.filter("doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("trusted_id"))
        .agg(F.min("quality").alias("good"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"), F.count("quality").alias("n"), F.count("*").alias("rows"))
        .filter("good = 1 AND toxic = 0 AND n = rows")
        .select("trusted_id", (F.pmod(F.xxhash64("trusted_id"), F.lit(HELD_OUT_OF)) == 0).alias("held_out"))
    )


def _lang_key(lang: F.Column) -> F.Column:
    """A language as a key that is never null."""
    return F.when(lang.isNull(), "").otherwise(F.concat(F.lit("="), lang.cast("string")))


def _limit(size: F.Column, median: F.Column, excess: F.Column) -> F.Column:
    """The log perplexity at which a text of so many bytes has this excess."""
    return median + excess * (1 + PRIOR_BYTES / F.greatest(F.lit(1), size))


def thresholds(scored: DataFrame) -> DataFrame:
    """Rows (key, median, excess) per language with enough rows (lang, size, log_ppl), and for all with key ``all``.

    ``scored`` holds the held-out trusted documents; it is read several times: pass a stored table.
    """
    keys = F.array(_lang_key(F.col("lang")), F.lit("all"))
    rows = scored.filter("log_ppl IS NOT NULL").select(F.explode(keys).alias("key"), "size", "log_ppl")
    enough = rows.groupBy("key").agg(F.count("*").alias("n")).filter((F.col("n") >= LEAST) | (F.col("key") == "all"))
    medians = materialise(
        quantiles(rows, ["key"], ["log_ppl"], [0.5]).join(enough, "key", "left_semi").select("key", F.col("quantile").alias("median")), "trusted-medians"
    )
    excess = materialise(
        rows.join(medians, "key").select("key", ((F.col("log_ppl") - F.col("median")) * F.col("size") / (F.col("size") + PRIOR_BYTES)).alias("excess")),
        "trusted-excess",
    )
    upper = quantiles(excess, ["key"], ["excess"], [LEVEL]).select("key", F.col("quantile").alias("excess"))
    return materialise(medians.join(upper, "key"), "thresholds")


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, str]:
    """``docs`` with a struct of log_ppl, threshold and accepted; and that struct's name."""
    prepare(docs.sparkSession)
    ids = materialise(trusted_ids(labels), "trusted")
    few = ids.count() <= BROADCAST_IDS

    def chosen(rows: DataFrame, which: str) -> DataFrame:
        wanted = ids.filter(which).select("trusted_id")
        return rows.join(F.broadcast(wanted) if few else wanted, F.col("doc_id") == F.col("trusted_id"), "left_semi")

    good = chosen(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")), "NOT held_out")
    places = shards_of(train(good))
    log_ppl, name = fresh(docs, "log_ppl"), fresh(docs, "quality")
    small = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.octet_length(text_col).alias("size")
    )
    held = materialise(with_log_perplexity(chosen(small, "held_out"), places, "log_ppl", carry=["lang", "size"]), "trusted-scores")
    limits = thresholds(held)
    own, overall = limits.filter("key <> 'all'"), limits.filter("key = 'all'").first()
    scored = with_log_perplexity(docs, places, log_ppl, text_col)
    key = fresh(scored, "limit")
    own = own.select(F.struct("key", "median", "excess").alias(key))
    size = F.octet_length(F.col(text_col))
    general = _limit(size, F.lit(overall["median"]), F.lit(overall["excess"])) if overall else F.lit(float("inf"))
    limit = F.coalesce(_limit(size, F.col(f"{key}.median"), F.col(f"{key}.excess")), general)
    struct = F.struct(F.col(log_ppl).alias("log_ppl"), limit.alias("threshold"), F.coalesce(F.col(log_ppl) <= limit, F.lit(False)).alias("accepted"))
    joined = scored.join(F.broadcast(own) if own.count() <= 10_000 else own, _lang_key(F.col(lang_col)) == F.col(f"{key}.key"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], struct.alias(name)), name


def document_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per document: doc_id, lang, perplexity of a byte, threshold, accepted."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    found, name = judged(rows, labels)
    return found.select(
        "doc_id", "lang", F.exp(f"{name}.log_ppl").alias("perplexity"), F.exp(f"{name}.threshold").alias("threshold"), f"{name}.accepted"
    )


def accepted_documents(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """The documents that are not rejected, with their columns."""
    found, name = judged(docs, labels, **columns)
    return found.filter(f"`{name}`.accepted").select(*[F.col(f"`{c}`") for c in docs.columns])
