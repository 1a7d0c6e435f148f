"""Reading and writing panel files, extracts and model folders."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.contract import TABLES
from larder.sources.panel import Panel


def write_panel(panel: Panel, directory: str) -> None:
    """Store the eight tables with their declared types, several at a time."""

    def store(item: tuple[str, DataFrame]) -> None:
        name, df = item
        declared = [F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name].schema.fields]
        df.select(*declared).write.parquet(f"{directory}/{name}.parquet")

    with ThreadPool(4) as pool:
        pool.map(store, panel.tables().items())


def manifest(spark: SparkSession) -> DataFrame:
    """The pinned rows and bytes of every table."""
    rows = [(t.name, t.pinned_rows, t.pinned_bytes) for t in TABLES.values()]
    return spark.createDataFrame(rows, "table_name STRING, expected_rows BIGINT, expected_bytes BIGINT")


def load_report(tables: dict[str, DataFrame], pinned: DataFrame) -> DataFrame:
    """Loaded rows per table beside the pinned number."""
    counts = reduce(
        DataFrame.unionByName,
        [
            df.agg(F.count(F.lit(1)).alias("actual_rows")).withColumn("table_name", F.lit(name))
            for name, df in tables.items()
        ],
    )
    return counts.join(pinned, "table_name").select(
        "table_name",
        "actual_rows",
        "expected_rows",
        (F.col("actual_rows") != F.col("expected_rows")).alias("drifted"),
    )


def file_report(spark: SparkSession, directory: str, pinned: DataFrame) -> DataFrame:
    """Which tables are missing from a folder or differ in size from the manifest.

    Only file metadata is read. A table may be one file or a folder of parts.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(directory)
        .select(F.regexp_extract("path", r"/([a-z_]+)\.parquet", 1).alias("table_name"), "length")
        .groupBy("table_name")
        .agg(F.sum("length").alias("actual_bytes"))
    )
    return pinned.join(files, "table_name", "left").select(
        "table_name",
        "expected_bytes",
        "actual_bytes",
        F.when(F.col("actual_bytes").isNull(), "missing")
        .when(F.col("actual_bytes") != F.col("expected_bytes"), "size differs")
        .otherwise("ok")
        .alias("status"),
    )


#: Bytes of a file that one task reads and digests at a time.
BLOCK_BYTES = 64 << 20
#: Files whose footers one task reads.
FILES_PER_TASK = 200


def data_files(spark: SparkSession, directory: str) -> DataFrame:
    """Every Parquet file below a folder: path, name within the folder, table, length. No content is read.

    An empty file is none: Spark lists it nowhere, so a file that was emptied is missing.
    """
    name = F.substring_index("path", f"/{directory.rstrip('/').rsplit('/', 1)[-1]}/", -1)
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(directory)
        .select("path", name.alias("file"), F.regexp_extract(name, r"^([^./]+)\.parquet", 1).alias("table_name"), "length")
    )


def _open(path: str) -> pa.NativeFile:
    """A file of a file system that Arrow knows, for reading parts of it."""
    local = re.sub(r"^file:/*", "/", path)
    store, name = (fs.LocalFileSystem(), local) if "://" not in local else fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def _sql_type(physical: str, converted: str, logical: str) -> str:
    """The SQL type of a column from its footer entry."""
    # The type names of the Parquet format.
    if converted.startswith("TIMESTAMP") or logical == "TIMESTAMP" or physical == "INT96":
        return "timestamp"
    if converted in ("UTF8", "DATE", "DECIMAL"):
        return {"UTF8": "string", "DATE": "date", "DECIMAL": "decimal"}[converted]
    plain = {"BOOLEAN": "boolean", "INT32": "int", "INT64": "bigint", "FLOAT": "float", "DOUBLE": "double"}
    return plain.get(physical, "binary")


def footer_columns(spark: SparkSession, directory: str, tables: Sequence[str]) -> DataFrame:
    """Type of every column of every file of some tables, from the files' footers.

    Tasks read the footers; a table may be one file or a folder of parts.
    """
    schema = pa.schema([("table_name", pa.string()), ("file", pa.string()), ("column_name", pa.string()), ("actual_type", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, file, table in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                with _open(path) as source:
                    footer = pq.ParquetFile(source).schema
                for i in range(len(footer)):
                    c = footer.column(i)
                    rows.append((table, file, c.path, _sql_type(c.physical_type, str(c.converted_type), c.logical_type.type)))
            columns = zip(*rows) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    files = data_files(spark, directory).filter(F.col("table_name").isin(*tables)).select("path", "file", "table_name")
    tasks = max(1, -(-files.count() // FILES_PER_TASK))
    return files.repartition(tasks, "path").mapInArrow(read, "table_name STRING, file STRING, column_name STRING, actual_type STRING")


def file_checksums(spark: SparkSession, directory: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Length and checksum of every file of a folder: a digest of its blocks' digests.

    Blocks are dealt to tasks one by one, so a large file is read by many.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path, block in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                with _open(path) as source:
                    source.seek(block * block_bytes)
                    found.append(hashlib.sha256(source.read(block_bytes)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3), pa.array(found, pa.string())], names=["file", "block", "length", "digest"])

    last = F.floor(F.greatest(F.col("length") - 1, F.lit(0)) / block_bytes).cast("bigint")
    blocks = data_files(spark, directory).select("path", "file", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("block"), "length")
    digests = blocks.repartition("path", "block").mapInArrow(digest, "file STRING, block BIGINT, length BIGINT, digest STRING")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("block", "digest"))), lambda b: b["digest"])
    return digests.groupBy("file", "length").agg(F.sha2(F.array_join(in_order, ""), 256).alias("checksum"))


def compare_manifests(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """Each file of two manifests: intact, changed, missing or extra."""
    before = recorded.select("file", F.col("length").alias("recorded_length"), F.col("checksum").alias("recorded"))
    same = F.col("recorded").eqNullSafe(F.col("checksum")) & F.col("recorded_length").eqNullSafe(F.col("length"))
    return before.join(found, "file", "full").select(
        "file",
        "recorded_length",
        "length",
        F.when(F.col("checksum").isNull(), "missing").when(F.col("recorded").isNull(), "extra").when(same, "intact").otherwise("changed").alias("status"),
    )


def status_by_table(compared: DataFrame) -> DataFrame:
    """One status per file or folder directly in the folder: that of its files, changed if they differ."""
    return compared.groupBy(F.substring_index("file", "/", 1).alias("file")).agg(
        F.when(F.min("status") == F.max("status"), F.min("status")).otherwise("changed").alias("status")
    )


def write_extract(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """CSV with a header, globally sorted by key.

    The range sort writes as many part files as the data needs; read in name
    order they are one sorted extract.
    """
    df.orderBy(*keys).write.mode("overwrite").option("header", True).csv(path)


def read_extract(
    spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str] | None = None
) -> DataFrame:
    """Read an extract with a declared schema, keeping the wanted columns."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.select(*columns) if columns else df


def save_model(model: PipelineModel, path: str, details: dict) -> None:
    """A fitted pipeline beside its feature list and parameters."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(details),)], "details STRING").write.mode("overwrite").json(f"{path}/details")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    details = spark.read.schema("details STRING").json(f"{path}/details").first()
    return PipelineModel.load(f"{path}/model"), json.loads(details["details"])
