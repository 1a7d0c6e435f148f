"""Token-id files coded by a static range asymmetric numeral system (rANS).

1. Documents are put in id order by range; each range's task encodes its texts with
   the tokenizer and writes the ids to a spool file. Token counts are summed.
2. The counts of all documents make one frequency table, stored beside the shards.
3. Each spool file becomes a shard: blocks of a fixed number of ids, each coded on
   its own in interleaved lanes, with checkpoints (lane states and stream position)
   inside the block and a checksum of its ids. A directory of blocks and documents
   ends the file, so any block, or part of one from a checkpoint, decodes alone.

Words are encoded once and kept: this tokenizer's normaliser and splitter never
look across ASCII white space, so a text's ids are those of its words in a row.

Recovery: files carry unique names and only those listed by successful tasks count.

Nulls and ties: a null text is empty and has the end id only. Null ids come first.
Rows of equal id keep an order by digest of their text. An empty table gives no
shards and no rows. Other columns are ignored.
"""

from __future__ import annotations

import contextlib
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import batches_of, make_folder, open_input, open_output, prepare, rows_of, shuffle_tasks
from larder.llm.words import HashIndex, distinct, words_of
from larder.session import materialise, scratch_path

END_ID = 1
SHARD_BYTES = 32 << 20
MAGIC = b"TOKRANS1"
#: Sum of the frequencies, ids per block, lanes per block, steps between checkpoints.
SCALE_BITS, BLOCK_IDS, LANES, CHECKPOINT_STEPS = 18, 1 << 20, 4096, 128
#: Words that a worker keeps with their ids.
WORDS_KEPT = 800_000

_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_SPOOL = pa.schema([("doc_id", pa.int64()), ("ids", pa.large_binary())])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: ASCII and Latin-1 letters, then marks other than apostrophes.
_LETTERS_THEN_MARKS = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")
#: Lower case of such letters' bytes; the second bytes of Latin-1 capitals are at 0x80 to 0x9e, but for 0x97.
_LOWER = bytes(b + 32 if 65 <= b <= 90 or (0x80 <= b <= 0x9E and b != 0x97) else b for b in range(256))


@contextlib.contextmanager
def _letters_only(tokenizer) -> Iterator[None]:
    """In the block the tokenizer leaves out what words of lower-case letters don't need."""
    from tokenizers import normalizers, pre_tokenizers

    before = tokenizer.normalizer, tokenizer.pre_tokenizer
    tokenizer.normalizer = normalizers.Sequence([])
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    try:
        yield
    finally:
        tokenizer.normalizer, tokenizer.pre_tokenizer = before


def _word_ends(tokenizer) -> np.ndarray | None:
    """Which ids end a word; None if words of letters get other ids by themselves, or ids don't show the ends."""
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
    if not suffix:
        return None
    ends = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), bool)
    ends[[i for token, i in tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
    letters = [c for c in map(chr, [*range(65, 91), *range(0xC0, 0x100)]) if c.isalpha()]
    words = " ".join([*letters, *(a + b for a in letters for b in letters)])
    lower = words.encode().translate(_LOWER).decode()
    ids = [tokenizer.encode(w, add_special_tokens=False).ids for w in (words, lower)]
    with _letters_only(tokenizer):
        ids.append(tokenizer.encode(lower, add_special_tokens=False).ids)
    return ends if ids[0] == ids[1] == ids[2] and ends[ids[2]].sum() == len(words.split()) else None


class WordEncoder:
    """Ids of texts through a table of words already encoded."""

    def __init__(self, tokenizer_file: str, words_kept: int = WORDS_KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.words_kept = words_kept
        (self.between,) = self.tokenizer.encode("0", add_special_tokens=False).ids
        self.ends = _word_ends(self.tokenizer)
        self._clear()

    def _clear(self) -> None:
        self.words = HashIndex()
        self.parts: dict[bytes, int] = {b"": 0}
        self.two = np.empty((0, 2), np.int32)  # the parts of each word
        self.flat = np.empty(0, np.uint32)  # ids of the parts in a row
        self.starts = np.zeros(1, np.int64)
        self.sizes = np.zeros(1, np.int64)

    def encode(self, texts: pa.Array, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, ``end_id`` after each, and how many each has."""
        if self.words.size > self.words_kept:
            self._clear()
        found = words_of(texts)
        at = self.words.find(found.hashes)
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            new, first = distinct(found.hashes[unknown])
            raw, places = found.data.tobytes(), unknown[first]
            self._learn([raw[s:e] for s, e in zip(found.starts[places].tolist(), found.ends[places].tolist(), strict=True)])
            self.words.add(new)
            at[unknown] = self.words.find(found.hashes[unknown])
        pieces = self.two[at].reshape(-1)
        sizes = self.sizes[pieces]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[pieces] - (ends - sizes), sizes) + np.arange(total)]
        until = np.concatenate([[0], ends])[2 * found.bounds]
        lengths = np.diff(until) + 1
        out = np.full(total + len(lengths), end_id, np.uint32)
        inside = np.ones(len(out), bool)
        inside[np.cumsum(lengths) - 1] = False
        out[inside] = ids
        return out, lengths

    def _learn(self, new: list[bytes]) -> None:
        """Take words in their order; most share their letters with words known before."""
        parts, first, second = self.parts, [], []
        letters, others = [], []  # unknown parts with their numbers
        for word in new:
            if word.isalpha():
                body, marks = word.lower(), b""
            elif found := _LETTERS_THEN_MARKS.fullmatch(word):
                body, marks = found[1].translate(_LOWER), found[2]
            else:
                body, marks = b"", word
            for part, unknown, numbers in ((body, letters, first), (marks, others, second)):
                size = len(parts)
                number = parts.setdefault(part, size)
                if number == size:
                    unknown.append((part, number))
                numbers.append(number)
        self.two = np.concatenate([self.two, np.array([first, second], np.int32).T])
        added = len(parts) - len(self.sizes)
        self.starts = np.concatenate([self.starts, np.zeros(added, np.int64)])
        self.sizes = np.concatenate([self.sizes, np.zeros(added, np.int64)])
        for unknown, encode in ((letters, self._encode_letters), (others, self._encode_words)):
            if unknown:
                words, numbers = zip(*unknown, strict=True)
                ids, sizes = encode(words)
                numbers = np.array(numbers)
                self.starts[numbers] = len(self.flat) + np.cumsum(sizes) - sizes
                self.sizes[numbers] = sizes
                self.flat = np.concatenate([self.flat, ids])

    def _encode_letters(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of lower-case letters in a row and how many each has: an id that ends a word ends it."""
        if self.ends is not None:
            texts = [b" ".join(words[at : at + 512]).decode() for at in range(0, len(words), 512)]
            with _letters_only(self.tokenizer):
                found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in found])
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(words):
                return ids, np.diff(last, prepend=-1)
        return self._encode_words(words)

    def _encode_words(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in a row and how many each has: many words in one call, with a digit of its own between them.

        Words with that digit go alone, after a digit too.
        """
        texts, held = [], []
        for word in words:
            if b"0" in word or len(held) == 512:
                texts.append(" 0 ".join(held))
                held = []
            if b"0" in word:
                texts.append(word.decode())
            else:
                held.append(word.decode())
        texts.append(" 0 ".join(held))
        ids, sizes = [], []
        for text, encoding in zip(texts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            if not text:
                continue
            got = np.array(encoding.ids, np.uint32)
            if "0" in text and " 0 " not in text:
                sizes.append(np.array([len(got)]))
            else:
                between = np.flatnonzero(got == self.between)
                sizes.append(np.diff(np.concatenate([[-1], between, [len(got)]])) - 1)
                got = np.delete(got, between)
            ids.append(got)
        return np.concatenate(ids), np.concatenate(sizes)


_encoders: dict[str, WordEncoder] = {}


def encoder(tokenizer_file: str) -> WordEncoder:
    """One encoder per worker process, kept between tasks."""
    if tokenizer_file not in _encoders:
        _encoders[tokenizer_file] = WordEncoder(tokenizer_file)
    return _encoders[tokenizer_file]


class FrequencyTable:
    """Static frequencies of ids, summing to a power of two; every id that occurs has one."""

    def __init__(self, frequency: np.ndarray, scale_bits: int):
        self.bits = np.uint64(scale_bits)
        self.frequency = frequency.astype(np.uint64)
        self.start = np.cumsum(self.frequency) - self.frequency
        kind = np.uint16 if len(frequency) <= 1 << 16 else np.uint32
        self.symbol = np.repeat(np.arange(len(frequency), dtype=kind), frequency.astype(np.int64))
        self.crc = zlib.crc32(frequency.astype("<u4").tobytes())

    @classmethod
    def from_counts(cls, counts: np.ndarray, scale_bits: int = SCALE_BITS) -> FrequencyTable:
        seen, scale = counts > 0, 1 << scale_bits
        if not seen.any():
            return cls(np.zeros(len(counts), np.int64), scale_bits)
        frequency = np.where(seen, np.maximum(1, np.floor(counts * (scale / counts.sum())).astype(np.int64)), 0)
        excess = int(frequency.sum()) - scale
        for i in np.argsort(-frequency, kind="stable"):
            step = min(max(excess, -scale), int(frequency[i]) - 1)
            frequency[i] -= step
            excess -= step
            if excess == 0:
                break
        if excess:
            raise ValueError("more ids than the scale has room for")
        return cls(frequency, scale_bits)

    def save(self, place: str) -> None:
        body = self.frequency.astype("<u4").tobytes()
        with open_output(place) as sink:
            sink.write(MAGIC + struct.pack("<III", int(self.bits), len(self.frequency), self.crc) + body)

    @classmethod
    def load(cls, place: str) -> FrequencyTable:
        with open_input(place) as source:
            data = source.read()
        bits, n, crc = struct.unpack_from("<III", data, 8)
        body = data[20 : 20 + 4 * n]
        if data[:8] != MAGIC or zlib.crc32(body) != crc:
            raise ValueError(f"{place} is no intact frequency table")
        return cls(np.frombuffer(body, "<u4").astype(np.int64), bits)


def encode_block(ids: np.ndarray, table: FrequencyTable, lanes: int = LANES, every: int = CHECKPOINT_STEPS) -> bytes:
    """Code ids in lanes: step s holds ids s * lanes and on; decoding runs forwards, coding backwards."""
    steps = -(-len(ids) // lanes)
    state = np.full(lanes, _LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, int, np.ndarray]] = []
    written, room = 0, np.uint64(63) - table.bits
    for step in range(steps - 1, -1, -1):
        symbols = ids[step * lanes : (step + 1) * lanes]
        x, f = state[: len(symbols)], table.frequency[symbols]
        full = x >= (f << room)
        words.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        written += len(words[-1])
        x = np.where(full, x >> _WORD, x)
        quotient = x // f
        state[: len(symbols)] = (quotient << table.bits) + (x - quotient * f) + table.start[symbols]
        if step % every == 0:
            marks.append((step, written, state.copy()))
    parts = [struct.pack("<IIIII", len(ids), lanes, every, len(marks), written)]
    for step, behind, states in reversed(marks):
        parts.append(struct.pack("<II", step, written - behind) + states.astype("<u8").tobytes())
    return b"".join(parts) + b"".join(w.tobytes() for w in reversed(words))


def decode_block(data: bytes, table: FrequencyTable, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids ``first`` to ``last`` of a block, starting at the checkpoint before ``first``."""
    n, lanes, every, marks, written = struct.unpack_from("<IIIII", data)
    last = n if last is None else min(last, n)
    if first >= last:
        return np.empty(0, np.uint32)
    size = 8 + 8 * lanes
    at = 20 + (first // lanes // every) * size
    step, place = struct.unpack_from("<II", data, at)
    state = np.frombuffer(data, "<u8", lanes, at + 8).astype(np.uint64)
    words = np.frombuffer(data, "<u4", written, 20 + marks * size)
    mask, out, begun = np.uint64((1 << int(table.bits)) - 1), [], step * lanes
    while step * lanes < last:
        k = min(lanes, n - step * lanes)
        x = state[:k]
        slot = x & mask
        symbols = table.symbol[slot]
        out.append(symbols)
        x = table.frequency[symbols] * (x >> table.bits) + slot - table.start[symbols]
        short = x < _LOW
        count = int(np.count_nonzero(short))
        x[short] = (x[short] << _WORD) | words[place : place + count]
        state[:k] = x
        place += count
        step += 1
    return np.concatenate(out)[first - begun : last - begun].astype(np.uint32)


def spool(batches: Iterator[pa.RecordBatch], place: str, words: WordEncoder) -> Iterator[tuple]:
    """Write the ids of ordered (doc_id, text) batches; rows (documents, ids, None, vocabulary), then (None, None, id, count)."""
    counts = np.zeros(words.vocabulary, np.int64)
    docs = total = 0
    kind = np.uint16 if words.vocabulary <= 1 << 16 else np.uint32
    with open_output(place) as sink, pa.ipc.new_stream(sink, _SPOOL, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, lengths = words.encode(batch.column(1))
            counts += np.bincount(ids, minlength=len(counts))
            docs, total = docs + len(lengths), total + len(ids)
            bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64) * kind().itemsize
            packed = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(bounds), pa.py_buffer(ids.astype(kind))])
            writer.write_batch(pa.RecordBatch.from_arrays([batch.column(0), packed], schema=_SPOOL))
    if docs:
        yield docs, total, None, words.vocabulary
        for i in np.flatnonzero(counts):
            yield None, None, int(i), int(counts[i])


def write_shard(spool_file: str, place: str, table: FrequencyTable, vocabulary: int, block_ids: int = BLOCK_IDS) -> int:
    """Code a spool file as a shard; its size in bytes."""
    kind = np.uint16 if vocabulary <= 1 << 16 else np.uint32
    blocks, doc_ids, sizes, held, waiting, at = [], [], [], [], 0, 0
    with open_input(spool_file) as source, open_output(place) as sink:

        def put(data: bytes) -> None:
            nonlocal at
            sink.write(data)
            at += len(data)

        def block(ids: np.ndarray) -> None:
            data = encode_block(ids, table)
            blocks.append((at, len(data), len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
            put(data)

        put(MAGIC + struct.pack("<I", table.crc))
        for batch in pa.ipc.open_stream(source):
            doc_ids += batch.column(0).to_pylist()
            for data in batch.column(1):
                ids = np.frombuffer(data.as_buffer(), kind)
                sizes.append(len(ids))
                held.append(ids)
                waiting += len(ids)
            if waiting >= block_ids:
                everything = np.concatenate(held)
                for first in range(0, waiting - block_ids + 1, block_ids):
                    block(everything[first : first + block_ids])
                held = [everything[waiting - waiting % block_ids :].copy()]
                waiting = len(held[0])
        if waiting:
            block(np.concatenate(held))
        foot = at
        put(np.array(sizes, "<u8").tobytes())
        put(np.array([i or 0 for i in doc_ids], "<i8").tobytes())
        put(np.array([i is None for i in doc_ids], np.uint8).tobytes())
        tail = json.dumps({"directory": foot, "documents": len(sizes), "blocks": blocks}).encode()
        put(tail + struct.pack("<I", len(tail)) + MAGIC)
    return at


class Shard:
    """A shard file open for reading."""

    def __init__(self, source, table: FrequencyTable):
        self.source, self.table = source, table
        end = source.size()
        head, tail = source.read_at(12, 0), source.read_at(12, end - 12)
        if head[:8] != MAGIC or tail[4:] != MAGIC or struct.unpack_from("<I", head, 8)[0] != table.crc:
            raise ValueError("no intact shard of this frequency table")
        size = struct.unpack_from("<I", tail)[0]
        about = json.loads(source.read_at(size, end - 12 - size))
        self.blocks, n, at = about["blocks"], about["documents"], about["directory"]
        self.sizes = np.frombuffer(source.read_at(8 * n, at), "<u8").astype(np.int64)
        self.doc_ids = np.frombuffer(source.read_at(8 * n, at + 8 * n), "<i8")
        self.nulls = np.frombuffer(source.read_at(n, at + 16 * n), np.uint8)

    def block(self, number: int) -> np.ndarray:
        at, size, n, crc = self.blocks[number]
        try:
            ids = decode_block(self.source.read_at(size, at), self.table)
        except (ArithmeticError, LookupError, ValueError, struct.error):  # what is left of it can't be decoded
            ids = np.empty(0, np.uint32)
        if len(ids) != n or zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {number} differs from its checksum")
        return ids

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc_id, ids before it in the shard, ids, crc of the ids), block by block."""
        number, ids, used, start = 0, np.empty(0, np.uint32), 0, 0
        for doc_id, null, size in zip(self.doc_ids.tolist(), self.nulls.tolist(), self.sizes.tolist(), strict=True):
            crc, left = 0, size
            while left:
                if used == len(ids):
                    ids, used, number = self.block(number), 0, number + 1
                    raw = memoryview(ids.astype("<u4").tobytes())
                take = min(left, len(ids) - used)
                crc = zlib.crc32(raw[4 * used : 4 * (used + take)], crc)
                used, left = used + take, left - take
            yield None if null else doc_id, start, size, crc
            start += size


def write_token_files(docs: DataFrame, tokenizer_file: str, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, str]:
    """Write all documents' ids; the stored list of shards (shard, place, documents, ids) and the table's place."""
    spark = prepare(docs.sparkSession)
    folder = make_folder(scratch_path(spark, "tokens"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    spooled = pa.schema([("shard", pa.int64()), ("spool", pa.string()), ("documents", pa.int64()), ("ids", pa.int64()), ("id", pa.int64()), ("count", pa.int64())])

    def tokenize(batches):
        shard = TaskContext.get().partitionId()
        place = f"{folder}/spool-{shard:06d}-{uuid.uuid4().hex}"
        found = ((shard, place, *row) for row in spool(batches, place, encoder(tokenizer_file)))
        yield from batches_of(found, spooled, rows_per_batch=1 << 16)

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    listed = materialise(
        rows.repartitionByRange(shuffle_tasks(spark, total, shard_bytes), *order)
        .sortWithinPartitions(*order)
        .mapInArrow(tokenize, "shard long, spool string, documents long, ids long, id long, count long"),
        "token-spool",
    )
    # the tasks' tokenizers know it, so that the driver needs none
    vocabulary = listed.filter("id IS NULL").agg(F.max("count")).first()[0] or 0
    counts = np.zeros(vocabulary, np.int64)
    # one row per id of the vocabulary at most
    for row in listed.filter("id IS NOT NULL").groupBy("id").agg(F.sum("count").alias("n")).collect():
        counts[row["id"]] = row["n"]
    table_place = f"{folder}/frequencies"
    FrequencyTable.from_counts(counts).save(table_place)

    def code(batches):
        def shards():
            table = None
            for shard, source, documents, ids in rows_of(batches):
                table = table or FrequencyTable.load(table_place)
                place = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.rans"
                yield shard, place, documents, ids, write_shard(source, place, table, vocabulary)

        yield from batches_of(shards(), pa.schema([("shard", pa.int64()), ("place", pa.string()), ("documents", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())]))

    sources = listed.filter("documents IS NOT NULL").select("shard", "spool", "documents", "ids")
    shards = sources.repartition(max(1, sources.count())).mapInArrow(code, "shard long, place string, documents long, ids long, bytes long")
    return materialise(shards, "token-shards"), table_place


def read_token_files(shards: DataFrame, table_place: str) -> DataFrame:
    """Per document, from the shards: doc_id, start, n_tokens, ids_crc32, shard."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.select("shard", "place", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.int64())])

    def read(batches):
        def documents():
            table = None
            for shard, place, offset in rows_of(batches):
                table = table or FrequencyTable.load(table_place)
                with open_input(place) as source:
                    for doc_id, start, size, crc in Shard(source, table).documents():
                        yield doc_id, offset + start, size, crc, shard

        yield from batches_of(documents(), schema)

    return placed.repartition(max(1, shards.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long")


def token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_file: str | None = None) -> DataFrame:
    """Write the ids of all documents and read them back."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return read_token_files(*write_token_files(rows, tokenizer_file or default_tokenizer()))
