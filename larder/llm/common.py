"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from larder.session import configure

#: Rows per Arrow batch: long texts make large batches.
BATCH_ROWS = 256
ASCII_SPACE = b" \t\n\x0b\x0c\r"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of these operators, where the user left the defaults."""
    configure(spark)
    if _BATCH not in {key for key, _ in spark.sparkContext.getConf().getAll()}:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    name, i = base, 0
    while name.lower() in taken:
        i += 1
        name = f"{base}_{i}"
    return name


def shuffle_tasks(spark: SparkSession, total_bytes: int, target: int) -> int:
    """Tasks for a shuffle of so many bytes, no fewer than the session's setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total_bytes // target))


def in_few_tasks(df: DataFrame, rows: int, rows_per_task: int = 1 << 16) -> DataFrame:
    """``df`` in as many tasks as ``rows`` need, one per core at least and never more than it has.

    A small result of a shuffle into hundreds of partitions otherwise goes on as as many tasks, each with
    files of its own for every further shuffle and stored table.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // rows_per_task)))


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a shared folder's URI."""
    uri = re.sub(r"^file:/*", "/", uri)
    if "://" not in uri:
        return fs.LocalFileSystem(use_mmap=True), uri
    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> str:
    store, path = filesystem(uri)
    store.create_dir(path, recursive=True)
    return uri


def open_output(uri: str):
    store, path = filesystem(uri)
    return store.open_output_stream(path, compression=None)


def open_input(uri: str):
    store, path = filesystem(uri)
    return store.open_input_file(path)


def remove_file(uri: str) -> None:
    store, path = filesystem(uri)
    store.delete_file(path)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples."""
    for batch in batches:
        yield from zip(*[column.to_pylist() for column in batch.columns], strict=True)


def batches_of(rows: Iterator[tuple], schema: pa.Schema, rows_per_batch: int = 4096, bytes_per_batch: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of bounded size from tuples; the bytes of binary and text values count."""
    held, size = [], 0
    try:
        for row in rows:
            held.append(row)
            size += sum(len(v) for v in row if isinstance(v, (bytes, str)))
            if len(held) >= rows_per_batch or size >= bytes_per_batch:
                yield _batch(held, schema)
                held, size = [], 0
        if held:
            yield _batch(held, schema)
    finally:
        held.clear()
        give_back()


def give_back() -> None:
    """Return freed memory to the system at a task's end: the worker lives on, idle or with other work."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
