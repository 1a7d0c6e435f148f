"""Exact n-gram Jaccard join with prefix filters under several global orders.

1. Sharing filter. A task packs its documents' sets into chunks: per shard of the
   hash space, sorted truncated hashes with the documents that hold them. A shard
   sees which hashes two documents hold; a chunk then knows how many shared shingles
   each document has. A document can only have a link if the required share of its
   shingles is shared, so most documents end here, at a few bytes a shingle.
2. Documents with equal sets become one class, represented by one of its documents.
3. Prefixes. Shingles are ordered by frequency, ties by a hash, in ``ORDERS``
   different ways. Linked sets share a shingle in their prefixes under each order,
   so a candidate must be a candidate under all of them before its sets are compared.
   The first order's posting lists make the candidates, under the bound that parity
   sketches of the sets put on their difference; the other orders filter them.
4. Large groups of near copies are first joined by pivots: classes with the same
   least hash are compared with one pivot each, then, in rounds, one class of each
   component in a posting list with the list's first few. Only classes in different
   components then still need the join, so a group of copies never becomes all pairs.
   The join takes the closest sketches first and the full difference in its last pass,
   when few of a group's classes are still in different components.

Every pair of classes that could link is either compared or already connected, so
components are exact. Shingles are 64-bit hashes; the truncation in step 1 can only
let documents pass.

Nulls and ties: documents without words have an empty set and no link. Fewer words
than the shingle size make one shingle. A null id takes part and is never a
component's name unless it is alone. ``without_near_duplicates`` tells rows apart by a
row number, so rows with null or equal ids are rows of their own: of each group one row
stays, that of least id, nulls last, then of least hash of its text, then the first.
Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import batches_of, fresh, in_few_tasks, mix64, prepare, rows_of, shuffle_tasks
from larder.llm.components import connected_components
from larder.llm.words import sequences, words_of
from larder.session import materialise

SHINGLE, PERCENT = 3, 90
ORDERS = 3
PIVOT_HASHES = 4
PIVOT_ROUNDS, PIVOTS_PER_LIST = 6, 8
#: Percent of the allowed difference of sketches that the passes of the join take, the closest pairs first.
PASSES = (90, 100)
#: Class pairs and shingles that a task compares.
TASK_PAIRS, TASK_SHINGLES = 1 << 13, 1 << 21
#: Longs of a parity sketch.
SKETCH = 16
#: Shingles per chunk, documents per chunk (they number in 16 bits), shingles per shard.
CHUNK_SHINGLES, CHUNK_DOCS, SHARD_SHINGLES = 1 << 20, 1 << 16, 1 << 20

_PACKED = pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), ("docs", pa.binary()), ("keys", pa.binary())])
_PACKED_DDL = "shard long, chunk long, docs binary, keys binary"
_DOCS = pa.struct([("doc_id", pa.int64()), ("n", pa.int64()), ("set_id", pa.binary())])


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """The set of shingle hashes of each text, sorted."""
    words = words_of(column, lower=True)
    hashes, counts = sequences(words.hashes, words.counts, size)
    ends = np.cumsum(counts)
    return [np.unique(hashes[b - n : b]) for b, n in zip(ends.tolist(), counts.tolist(), strict=True)]


def set_id(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _planes(values: np.ndarray) -> bytes:
    """Integers as compressed planes of bytes."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _from_planes(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = kind().itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(kind)


def _pack_keys(keys: np.ndarray, ordinals: np.ndarray) -> bytes:
    deltas = _planes(np.diff(keys, prepend=np.uint64(0)))
    return len(deltas).to_bytes(4, "little") + deltas + _planes(ordinals)


def _unpack_keys(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = int.from_bytes(data[:4], "little")
    return np.cumsum(_from_planes(data[4 : 4 + size], np.uint64), dtype=np.uint64), _from_planes(data[4 + size :], np.uint16)


def _pack(batches: Iterator[pa.RecordBatch], task: int, size: int, bits: int, shards: int) -> Iterator[tuple]:
    """Chunks of documents: one row with them, and one row per shard with their keys."""
    ids: list[int | None] = []
    sets: list[np.ndarray] = []
    held = number = 0

    def chunk():
        name = (task << 24) | number
        about = pa.array([{"doc_id": i, "n": len(s), "set_id": set_id(s)} for i, s in zip(ids, sets, strict=True)], _DOCS)
        sink = pa.BufferOutputStream()
        batch = pa.RecordBatch.from_struct_array(about)
        with pa.ipc.new_stream(sink, batch.schema) as writer:
            writer.write_batch(batch)
        yield name % shards, name, sink.getvalue().to_pybytes(), None
        lengths = np.array([len(s) for s in sets])
        ordinals = np.repeat(np.arange(len(sets), dtype=np.uint64), lengths)
        keys = np.concatenate(sets) >> np.uint64(64 - bits) if sets else np.empty(0, np.uint64)
        both = np.sort(keys << np.uint64(16) | ordinals)
        keys, ordinals = both >> np.uint64(16), (both & np.uint64(0xFFFF)).astype(np.uint16)
        limits = np.array([(s << bits) // shards for s in range(1, shards)], np.uint64)
        cuts = [0, *np.searchsorted(keys, limits).tolist(), len(keys)]
        for shard in range(shards):
            a, b = cuts[shard], cuts[shard + 1]
            if a < b:
                yield shard, name, None, _pack_keys(keys[a:b], ordinals[a:b])

    for batch in batches:
        for doc_id, shingles in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), size), strict=True):
            ids.append(doc_id)
            sets.append(shingles)
            held += len(shingles)
            if held >= CHUNK_SHINGLES or len(ids) >= CHUNK_DOCS:
                yield from chunk()
                ids, sets, held, number = [], [], 0, number + 1
    if ids:
        yield from chunk()


def _count_shared(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows of sorted shards to (chunk, docs, counts): shared keys per document of each chunk."""
    shard, held = None, []

    def counted():
        if not held:
            return
        keys = np.concatenate([k for _, k, _ in held])
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = 0
        for chunk, k, ordinals in held:
            counts = np.bincount(ordinals[twice[at : at + len(k)]]).astype(np.uint32)
            at += len(k)
            if len(counts):
                yield chunk, None, _planes(counts)

    for number, chunk, docs, keys in rows:
        if number != shard:
            yield from counted()
            shard, held = number, []
        if docs is not None:
            yield chunk, docs, None
        else:
            held.append((chunk, *_unpack_keys(keys)))
    yield from counted()


def _sum_shared(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows sorted by chunk to (doc_id, n, set_id, shared)."""
    name, about, shared = None, None, np.zeros(CHUNK_DOCS, np.int64)

    def summed():
        if about is not None:
            table = pa.ipc.open_stream(about).read_all()
            columns = [table[c].to_pylist() for c in ("doc_id", "n", "set_id")]
            yield from zip(*columns, shared[: table.num_rows].tolist(), strict=True)

    for chunk, docs, counts in rows:
        if chunk != name:
            yield from summed()
            name, about = chunk, None
            shared[:] = 0
        if docs is not None:
            about = docs
        else:
            part = _from_planes(counts, np.uint32)
            shared[: len(part)] += part
    yield from summed()


def sharing(docs: DataFrame, size: int) -> DataFrame:
    """Per row of (doc_id, text): n (set size), set_id, shared (shingles that other documents may hold)."""
    spark = prepare(docs.sparkSession)
    total = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = 1 << max(0, (total // 6 // SHARD_SHINGLES).bit_length())
    bits = min(48, max(32, (total // 6).bit_length() + 12))
    counted = pa.schema([("chunk", pa.int64()), ("docs", pa.binary()), ("counts", pa.binary())])
    result = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set_id", pa.binary()), ("shared", pa.int64())])
    tasks = max(shards, shuffle_tasks(spark, total, 64 << 20))

    def pack(batches):
        yield from batches_of(_pack(batches, TaskContext.get().partitionId(), size, bits, shards), _PACKED)

    def count(batches):
        yield from batches_of(_count_shared(rows_of(batches)), counted)

    def add(batches):
        yield from batches_of(_sum_shared(rows_of(batches)), result)

    return materialise(
        docs.select("doc_id", "text")
        .mapInArrow(pack, _PACKED_DDL)
        .repartition(tasks, "shard")
        .sortWithinPartitions("shard")
        .mapInArrow(count, "chunk long, docs binary, counts binary")
        .repartition("chunk")
        .sortWithinPartitions("chunk")
        .mapInArrow(add, "doc_id long, n long, set_id binary, shared long"),
        "jaccard-sharing",
    )


def sketch_of(shingles: np.ndarray) -> list[int]:
    """Parity of the shingles' bits: sketches of two sets differ in no more bits than the sets do in shingles."""
    bits = np.bincount((mix64(shingles) % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


def _needed(percent: int, n: F.Column) -> F.Column:
    """The least overlap that a link asks of a set of ``n``."""
    return F.ceil(n * percent / 100)


def _sets_of(docs: DataFrame, wanted: DataFrame, size: int, shingles: int) -> DataFrame:
    """Sets of one document per wanted class: (set_id, shingles); so many ``shingles`` in all."""
    schema = pa.schema([("set_id", pa.binary()), ("shingles", pa.list_(pa.int64()))])

    def sets(batches):
        def rows():
            for batch in batches:
                for known, shingles in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), size), strict=True):
                    if set_id(shingles) == known:
                        yield known, shingles.view(np.int64)

        yield from batches_of(rows(), schema, rows_per_batch=512)

    found = (
        docs.join(wanted.select("set_id", F.col("rep_id").alias("wanted_id")), F.col("doc_id").eqNullSafe(F.col("wanted_id")))
        .select("set_id", "text")
        .mapInArrow(sets, "set_id binary, shingles array<long>")
    )
    return materialise(in_few_tasks(found.dropDuplicates(["set_id"]), shingles, TASK_SHINGLES), "jaccard-sets")


def _prefixes(sets: DataFrame, percent: int, shingles: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of classes that can link: rows (set_id, n, token, sketch) of the first order's prefix, (set_id, others) with
    the prefixes under the other orders, and pivot keys."""
    tokens = sets.select("set_id", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    frequency = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    shared = (
        tokens.join(frequency, "token")
        .groupBy("set_id", "n")
        .agg(F.collect_list(F.struct("df", "token")).alias("shared"))
        .filter(F.size("shared") >= _needed(percent, F.col("n")))
    )
    schema = pa.schema([("set_id", pa.binary()), ("n", pa.int64()), ("ord", pa.int64()), ("token", pa.int64()), ("others", pa.list_(pa.list_(pa.int64()))), ("sketch", pa.list_(pa.int64()))])

    def cut(batches):
        def rows():
            for batch in batches:
                columns = [batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)]
                for known, n, held, whole in zip(*columns, strict=True):
                    pairs = held.values
                    df, token = pairs.field("df").to_numpy(), pairs.field("token").to_numpy().astype(np.uint64)
                    length = len(token) - -(-percent * n // 100) + 1
                    prefixes = []
                    for k in range(ORDERS):
                        tie = mix64(token + np.uint64(k * 0x51ED2701))
                        rank = df if k == 0 else np.floor(np.log2(df))
                        prefixes.append(token[np.lexsort((tie, rank))[:length]].view(np.int64).tolist())
                    sketch = sketch_of(whole.values.to_numpy().view(np.uint64))
                    for t in prefixes[0]:
                        yield known, n, 0, t, None, sketch
                    yield known, n, 1, 0, prefixes[1:], None
                    for k in range(PIVOT_HASHES):
                        least = mix64(token ^ np.uint64((k + 1) * 0x7F4A7C15)).argmin()
                        yield known, n, -1 - k, int(token[least : least + 1].view(np.int64)[0]), None, sketch

        yield from batches_of(rows(), schema, rows_per_batch=1 << 14)

    ddl = "set_id binary, n long, ord long, token long, others array<array<long>>, sketch array<long>"
    both = in_few_tasks(in_few_tasks(shared, shingles, TASK_SHINGLES).join(sets, "set_id"), shingles, TASK_SHINGLES)
    rows = materialise(both.mapInArrow(cut, ddl), "jaccard-prefixes")
    return rows.filter("ord = 0").drop("ord", "others"), rows.filter("ord = 1").select("set_id", "others"), rows.filter("ord < 0")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int, shingles: int) -> DataFrame:
    """Of class pairs (a, b), those whose sets link; the sets hold so many ``shingles``."""
    pairs = materialise(pairs, "jaccard-pairs")
    number = pairs.count()
    if not number:
        return pairs
    left = sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("right"))
    both = F.size(F.array_intersect("left", "right"))
    either = F.size("left") + F.size("right") - both
    tasks = max(-(-number // TASK_PAIRS), -(-shingles // TASK_SHINGLES))
    found = in_few_tasks(in_few_tasks(pairs.join(left, "a"), tasks, 1).join(right, "b"), tasks, 1)
    return materialise(found.filter(both * 100 >= either * percent).select("a", "b"), "jaccard-links")


def _with_component(rows: DataFrame, components: DataFrame) -> DataFrame:
    return rows.join(components.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))


def _could_link(percent: int, share: int = 100) -> F.Column:
    """Whether sizes and sketches of sides ``a`` and ``b`` allow a link, at ``share`` percent of the difference."""
    sizes = (F.col("a.n") * 100 >= F.col("b.n") * percent) & (F.col("b.n") * 100 >= F.col("a.n") * percent)
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.col("a.sketch")[i].bitwiseXOR(F.col("b.sketch")[i])) for i in range(SKETCH)])
    return sizes & (differ * (100 + percent) * 100 <= (F.col("a.n") + F.col("b.n")) * (100 - percent) * share)


def _set_components(sets: DataFrame, percent: int, shingles: int) -> DataFrame:
    """Components of the classes that link: (node, component)."""
    prefixes, others, pivots = _prefixes(sets, percent, shingles)
    rows = prefixes.count()
    pivot = pivots.groupBy("ord", "token").agg(F.min(F.struct("set_id", "n", "sketch")).alias("a")).select("ord", "token", "a.*")
    pairs = (
        pivot.alias("a")
        .join(pivots.alias("b"), (F.col("a.ord") == F.col("b.ord")) & (F.col("a.token") == F.col("b.token")) & (F.col("a.set_id") < F.col("b.set_id")) & _could_link(percent))
        .select(F.col("a.set_id").alias("a"), F.col("b.set_id").alias("b"))
    )
    links = [_linked(_few_distinct(pairs, rows), sets, percent, shingles)]
    components = connected_components(links[0])
    for _ in range(PIVOT_ROUNDS):
        placed = in_few_tasks(_with_component(prefixes, components), rows)
        heads = placed.groupBy("token", "component").agg(F.min(F.struct("set_id", "n", "sketch")).alias("head")).select("token", "component", "head.*")
        heads = in_few_tasks(heads, rows)
        first = Window.partitionBy("token").orderBy("set_id")
        firsts = heads.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= PIVOTS_PER_LIST)
        pairs = (
            firsts.alias("a")
            .join(heads.alias("b"), (F.col("a.token") == F.col("b.token")) & (F.col("a.set_id") < F.col("b.set_id")) & _could_link(percent))
            .select(F.col("a.set_id").alias("a"), F.col("b.set_id").alias("b"))
        )
        more = _linked(_few_distinct(pairs, rows), sets, percent, shingles)
        if more.isEmpty():
            break
        links.append(more)
        components = connected_components(reduce(DataFrame.unionByName, links))
    for share in PASSES:
        placed = materialise(in_few_tasks(_with_component(prefixes, components), rows), "jaccard-placed")
        more = _linked(_joined(placed, others, rows, percent, share), sets, percent, shingles)
        if not more.isEmpty():
            links.append(more)
            components = connected_components(reduce(DataFrame.unionByName, links))
    return components


def _few_distinct(pairs: DataFrame, rows: int) -> DataFrame:
    """Distinct pairs of at most a few for each of ``rows``, in as many tasks as these need."""
    return in_few_tasks(in_few_tasks(pairs, rows).distinct(), rows)


def _joined(placed: DataFrame, others: DataFrame, rows: int, percent: int, share: int) -> DataFrame:
    """Candidates (a, b) among classes in different components that meet under all orders; ``placed`` has ``rows``."""
    lists = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("token")
    left = in_few_tasks(placed.select("set_id", "n", "token", "sketch", "component").join(lists, "token", "left_semi"), rows)
    met = (
        left.alias("a")
        .join(
            left.alias("b"),
            (F.col("a.token") == F.col("b.token"))
            & (F.col("a.set_id") < F.col("b.set_id"))
            & (F.col("a.component") != F.col("b.component"))
            & _could_link(percent, share),
        )
        .select(F.col("a.set_id").alias("a"), F.col("b.set_id").alias("b"))
        .distinct()
    )
    met = materialise(met, "jaccard-met")
    rows = max(rows, met.count())
    under_all = reduce(lambda x, y: x & y, [F.arrays_overlap(F.col("x.others")[k], F.col("y.others")[k]) for k in range(ORDERS - 1)])
    one = in_few_tasks(met.join(others.alias("x"), F.col("a") == F.col("x.set_id")), rows)
    return in_few_tasks(one.join(others.alias("y"), F.col("b") == F.col("y.set_id")), rows).filter(under_all).select("a", "b")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the least id reachable by links)."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    known = sharing(rows, size)
    number = known.count()
    grouped = known.filter("n > 0").groupBy("set_id", "n").agg(F.min("doc_id").alias("rep_id"), F.max("shared").alias("shared"), F.count("*").alias("members"))
    classes = materialise(in_few_tasks(grouped, number), "jaccard-classes")
    wanted = classes.filter(F.col("shared") >= _needed(percent, F.col("n")))
    shingles = wanted.agg(F.sum("n")).first()[0] or 0
    sets = _sets_of(rows, wanted.select("set_id", "rep_id"), size, shingles)
    components = _set_components(sets, percent, shingles)
    placed = in_few_tasks(_with_component(classes.select("set_id", "rep_id", "members"), components), number)
    least = in_few_tasks(placed.groupBy("component").agg(F.min("rep_id").alias("component_id"), F.sum("members").alias("members")), number)
    # only classes of several documents or links have another's id
    named = placed.select("set_id", "component").join(least.filter("members > 1"), "component").select("set_id", "component_id")
    named = materialise(in_few_tasks(named, number), "jaccard-named")
    return known.join(named, "set_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row, that of least id, of each group of near-duplicates; with its columns."""
    prepare(docs.sparkSession)
    row = fresh(docs, "row_number")
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "jaccard-rows")
    found = jaccard_components(numbered, row, text_col, size, percent).select(F.col("doc_id").alias("row"), "component_id")
    known = numbered.select(F.col(row).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"))
    first = F.min(F.struct(F.col("id").isNull(), "id", "hash", "row")).alias("first")
    leads = materialise(found.join(known, "row").groupBy("component_id").agg(first).select(F.col("first.row").alias(row)), "jaccard-kept")
    return numbered.join(leads, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
